"""Gates, diversity, neighbours and document coverage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidar.config import DEFAULT, Config
from evidar.functions.expr import r6
from evidar.functions.text import tokenize
from evidar.operators.ranking import evenly_spaced, first_per_locator, rank_hits, top_k
from evidar.operators.slices import carry


def passes_gate(cfg: Config = DEFAULT) -> Column:
    """Enough lexical support, or a near vector."""
    lexical = (F.col("lexical_score") >= cfg.gate_lexical) & (F.col("token_coverage") >= cfg.gate_coverage)
    return lexical | (F.col("vector_score") >= cfg.gate_vector)


def qa_gate(hits: DataFrame, k: int, cfg: Config = DEFAULT) -> DataFrame:
    """K1 first half: keep well-supported hits, best ``k`` per query."""
    return rank_hits(hits.filter(passes_gate(cfg)), k)


def expand_neighbours(hits: DataFrame, chunks: DataFrame, count: int, cfg: Config = DEFAULT) -> DataFrame:
    """Append the previous and next chunk of the same file, in rank order, up to ``count``.

    ``hits``: query_id, collection_id, chunk_id, chunk_ordinal, file_name, rank, score (few per query).
    """
    primary = hits.withColumn("adjacent", F.lit(False))
    size = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("_size"))
    wanted = hits.select(
        "query_id", "collection_id", F.col("rank").alias("_from"), F.col("score").alias("_score"),
        F.col("file_name").alias("_file"), F.col("chunk_ordinal").alias("_at"),
        F.explode(F.array(F.lit(-1), F.lit(1))).alias("_step"),
    ).withColumn("chunk_ordinal", F.col("_at") + F.col("_step"))
    place = chunks.select("collection_id", "chunk_ordinal", "chunk_id", "file_name")
    near = (
        wanted.join(place, ["collection_id", "chunk_ordinal"])
        .filter(F.col("file_name") == F.col("_file"))
        .join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    )
    once = top_k(near, ["query_id", "chunk_id"], [F.col("_from"), F.col("_step")], 1, "_first")
    numbered = once.withColumn(
        "_slot", F.row_number().over(Window.partitionBy("query_id").orderBy("_from", "_step"))
    ).join(size, "query_id")
    added = numbered.withColumn("rank", (F.col("_size") + F.col("_slot")).cast("int")).filter(F.col("rank") <= count)
    added = added.withColumn("score", F.col("_score") * cfg.neighbour_decay).withColumn("adjacent", F.lit(True))
    shared = [c for c in primary.columns if c in added.columns]
    return primary.unionByName(added.select(*shared), allowMissingColumns=True)


def context_fill(hits: DataFrame, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """K2: positive hits first, then evenly spaced chunks of the collection until ``k``."""
    return fill_evenly(rank_hits(hits.filter(F.col("hybrid_score") > 0), k), queries, chunks, k)


def fill_evenly(best: DataFrame, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """K2 second half: ``best`` holds at most ``k`` ranked rows per query."""
    spread = evenly_spaced(chunks, ["collection_id"], "chunk_ordinal", k).select(
        "collection_id", "chunk_id", "chunk_ordinal", "file_name", "slot"
    )
    fill = (
        queries.select("query_id", "collection_id").join(spread, "collection_id")
        .join(best.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
        .withColumn("rank", F.lit(k) + 1 + F.col("slot")).withColumn("score", F.lit(0.0)).drop("slot")
    )
    both = best.withColumn("rank", F.col("rank").cast("bigint")).unionByName(fill, allowMissingColumns=True)
    both = both.withColumnRenamed("rank", "_order")
    return top_k(both, ["query_id"], [F.col("_order")], k).drop("_order")


def rerank(hits: DataFrame, scores: DataFrame, top_n: int | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """K4: order by an external score; questions in ``qa`` mode drop weak rows.

    Queries without any external score keep their order.
    """
    top_n = top_n or cfg.rerank_top
    joined = hits.join(scores.select("query_id", "chunk_id", r6(F.col("rerank_score")).alias("rerank_score")),
                       ["query_id", "chunk_id"], "left")
    known = scores.select("query_id").distinct().withColumn("_scored", F.lit(True))
    joined = joined.join(known, "query_id", "left")
    scored = joined.filter(F.col("_scored") & F.col("rerank_score").isNotNull()).withColumnRenamed("rank", "_before")
    best = top_k(scored, ["query_id"], [F.col("rerank_score").desc(), F.col("_before")], top_n)
    best = best.filter((F.col("mode") != "qa") | (F.col("rerank_score") >= cfg.rerank_floor)).drop("_before")
    return best.unionByName(joined.filter(F.col("_scored").isNull())).drop("_scored")


def mmr_select(hits: DataFrame, chunks: DataFrame, count: int = 8, cfg: Config = DEFAULT) -> DataFrame:
    """K3: greedy choice of diverse evidence among the few ranked hits of each query.

    ``hits`` holds at most ``cfg.candidates`` rows per query, so a group is small.
    """
    has_vector = "embedding" in chunks.columns
    relevance = F.coalesce(F.col("rerank_score"), F.col("score")) if "rerank_score" in hits.columns else F.col("score")
    detail = chunks.select(
        "collection_id", "chunk_id", "kind",
        F.array_distinct(tokenize("text")).alias("_tokens"),
        (F.col("embedding").cast("array<double>") if has_vector else F.lit(None).cast("array<double>")).alias("_vector"),
    )
    rows = hits.join(detail, ["collection_id", "chunk_id"]).select(
        "query_id", "chunk_id", "rank", relevance.alias("relevance"), "_tokens", "_vector",
        F.concat_ws("|", "kind", "number", "content_type").alias("_place"),
    )

    def alike(a, b) -> float:
        if a["_vector"] is not None and b["_vector"] is not None:
            x, y = np.asarray(a["_vector"]), np.asarray(b["_vector"])
            scale = np.linalg.norm(x) * np.linalg.norm(y) if len(x) == len(y) else 0
            return max(0.0, float(x @ y / scale)) if scale else 0.0
        x, y = set(a["_tokens"]), set(b["_tokens"])
        return len(x & y) / len(x | y) if x | y else 0.0

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        left = group.sort_values("rank").to_dict("records")
        if len(left) <= count:
            return group[["query_id", "chunk_id"]].assign(pick=group["rank"].rank().astype("int32"))
        worst, places, picked = [0.0] * len(left), set(), []
        while len(picked) < count:
            value = [
                row["relevance"] * cfg.mmr_relevance - seen * cfg.mmr_redundancy
                - (cfg.mmr_locator if row["_place"] in places else 0)
                for row, seen in zip(left, worst)
            ]
            at = int(np.argmax(value))
            chosen = left.pop(at)
            worst.pop(at)
            picked.append((chosen["query_id"], chosen["chunk_id"], len(picked) + 1))
            places.add(chosen["_place"])
            worst = [max(seen, alike(row, chosen)) for row, seen in zip(left, worst)]
        return pd.DataFrame(picked, columns=["query_id", "chunk_id", "pick"])

    id_type = dict(hits.dtypes)["query_id"]
    picks = rows.groupBy("query_id").applyInPandas(choose, f"query_id {id_type}, chunk_id string, pick int")
    return hits.drop("rank").join(picks.withColumnRenamed("pick", "rank"), ["query_id", "chunk_id"])


def document_coverage(chunks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """K6: evidence that spans a whole collection.

    Greedy picks under the character budget depend only on order and length, and
    the picks of one length are always the first ones of that length. So the
    first few chunks of each length are a complete candidate list of bounded size.
    """
    most, budget = cfg.coverage_chunks, cfg.coverage_chars
    order = ["number", "chunk_id"]
    base = chunks.withColumn("n_chars", F.length("text"))
    totals = base.groupBy("collection_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("n_chars").alias("_chars")
    ).withColumn("_all", (F.col("_n") <= most) & (F.col("_chars") <= budget))
    tagged = base.join(totals.select("collection_id", "_all"), "collection_id")
    whole = tagged.filter("_all").select("collection_id", "chunk_id", "number", "n_chars")

    rest = tagged.filter(~F.col("_all"))
    firsts = first_per_locator(rest, order)
    slices = F.concat(F.lpad(F.col("number").cast("string"), 10, "0"), F.substring("chunk_id", 1, 4))
    placed = carry(firsts, ["collection_id"], slices, order, index="_pos")
    spread = evenly_spaced(placed.withColumn("_pos", F.col("_pos") - 1), ["collection_id"], "_pos", most)
    per_length = F.least(F.lit(most), F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("n_chars"), F.lit(1))), F.lit(1)))
    ranked = top_k(rest, ["collection_id", "n_chars"], [F.col(c) for c in order], most, "_seen")
    ranked = ranked.filter(F.col("_seen") <= per_length)
    first_round = spread.select("collection_id", "chunk_id", "number", "n_chars", F.lit(0).alias("round"), F.col("slot").cast("bigint"))
    second_round = ranked.select("collection_id", "chunk_id", "number", "n_chars", F.lit(1).alias("round"), F.lit(0).cast("bigint").alias("slot"))

    def greedy(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["round", "slot", "number", "chunk_id"])
        taken, used, keep = set(), 0, []
        for row in group.itertuples(index=False):
            if len(keep) >= most:
                break
            if row.chunk_id in taken or (keep and used + row.n_chars > budget):
                continue
            taken.add(row.chunk_id)
            used += row.n_chars
            keep.append(row)
        out = pd.DataFrame(keep, columns=group.columns)
        return out[["collection_id", "chunk_id", "number", "n_chars"]]

    picked = first_round.unionByName(second_round).groupBy("collection_id").applyInPandas(
        greedy, "collection_id string, chunk_id string, number int, n_chars int"
    )
    by_order = Window.partitionBy("collection_id").orderBy(*order)
    # At most ``most`` rows per collection reach this window.
    return whole.unionByName(picked).withColumn("rank", F.row_number().over(by_order))
