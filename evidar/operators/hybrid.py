"""Vector scores, hybrid scores and reciprocal rank fusion.

The exact ranking counts every chunk of the collection, also those without any
matching token. Only candidates that can reach the fusion depth are formed: the
token matches, and short ranked lists of the other chunks (by vector, by asked
type or page, by position). A chunk outside these lists is beaten by at least
``rrf_depth`` chunks inside, so the fused result is unchanged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidar.config import DEFAULT, Config
from evidar.functions.expr import r6
from evidar.functions.text import cosine, dot, page_hint, question_variants, structure_boost, tokenize, type_hint, unit
from evidar.operators.contenders import asked_of, scan
from evidar.operators.lexical import PLACE, LexicalIndex, bm25, phrase_hits, query_terms
from evidar.operators.joins import BROADCAST_ROWS, hint_small, is_small
from evidar.operators.ranking import top_k
from evidar.session import saved

VARIANT = ["query_id", "variant_pos"]
# Most vectors that are broadcast: at 256 numbers each about 40 MB.
VECTOR_ROWS = 20_000


def expand_queries(queries: DataFrame) -> DataFrame:
    """One row per query variant; only the question itself keeps its vector."""
    vector = F.col("embedding") if "embedding" in queries.columns else F.lit(None).cast("array<double>")
    return queries.select(
        "query_id", "collection_id", "mode", F.posexplode(question_variants("text")).alias("variant_pos", "text"),
        vector.alias("_vector"),
    ).select(
        "query_id", "collection_id", "mode", "variant_pos", "text",
        F.when(F.col("variant_pos") == 0, F.col("_vector")).alias("embedding"),
    )


def _blocks(df: DataFrame, key: str, size: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Cut every collection into hash blocks of about ``size`` rows."""
    counts = df.groupBy("collection_id").agg(F.ceil(F.count(F.lit(1)) / size).alias(f"n_{name}"))
    cut = df.join(counts, "collection_id").withColumn(name, F.pmod(F.xxhash64(key), F.col(f"n_{name}")))
    return cut.drop(f"n_{name}"), counts


def vector_candidates(queries: DataFrame, chunks: DataFrame, keep: int, cfg: Config = DEFAULT) -> DataFrame:
    """J4 over whole collections: per query the best ``keep`` chunks by vector part
    of the score and the best ``keep`` above the vector gate.

    Block against block: each pair of a chunk block and a query block is one
    bounded matrix product, and only the best rows of a block leave it.
    """
    docs, doc_blocks = _blocks(chunks.filter(F.col("embedding").isNotNull()), "chunk_id", cfg.vector_block, "doc_block")
    asks, ask_blocks = _blocks(queries.filter(F.col("embedding").isNotNull()), "query_id", cfg.query_block, "ask_block")
    docs = docs.join(ask_blocks, "collection_id").withColumn(
        "ask_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_ask_block") - 1))
    )
    asks = asks.join(doc_blocks, "collection_id").withColumn(
        "doc_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_doc_block") - 1))
    )
    docs = docs.select("collection_id", "doc_block", "ask_block", "chunk_id", "chunk_ordinal", "content_type",
                       "number", "reliability", F.col("embedding").cast("array<double>").alias("embedding"))
    asks = asks.select("collection_id", "doc_block", "ask_block", "query_id",
                       "want_type", "want_page", F.col("embedding").cast("array<double>").alias("embedding"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        for width, ask in right.groupby(right["embedding"].map(len)):
            doc = left[left["embedding"].map(len) == width].sort_values("chunk_ordinal", kind="stable")
            if doc.empty or width == 0:
                continue
            a, b = np.stack(ask["embedding"]), np.stack(doc["embedding"])
            scale = np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
            cos = np.divide(a @ b.T, scale, out=np.zeros_like(scale), where=scale > 0)
            kind, page = doc["content_type"].to_numpy(), doc["number"].to_numpy()
            trust, ids = doc["reliability"].to_numpy(), doc["chunk_id"].to_numpy()
            for i, (query, want_type, want_page) in enumerate(
                zip(ask["query_id"], ask["want_type"], ask["want_page"])
            ):
                boost = cfg.type_boost * (kind == want_type) + cfg.page_boost * (page == want_page)
                weight = np.round((cfg.vector_weight * np.maximum(cos[i], 0) + boost) * trust, 6)
                order = np.argsort(-weight, kind="stable")
                gated = order[cos[i][order] >= cfg.gate_vector - 1e-6][:keep]
                for gate, rows in ((False, order[:keep]), (True, gated)):
                    found.append(pd.DataFrame({
                        "collection_id": doc["collection_id"].iloc[0], "query_id": query, "chunk_id": ids[rows],
                        "chunk_ordinal": doc["chunk_ordinal"].to_numpy()[rows], "weight": weight[rows], "gated": gate,
                    }))
        columns = ["collection_id", "query_id", "chunk_id", "chunk_ordinal", "weight", "gated"]
        return pd.concat(found) if found else pd.DataFrame(columns=columns)

    id_type = dict(queries.dtypes)["query_id"]
    block = ["collection_id", "doc_block", "ask_block"]
    local = docs.groupBy(*block).cogroup(asks.groupBy(*block)).applyInPandas(
        best,
        f"collection_id string, query_id {id_type}, chunk_id string, chunk_ordinal bigint, weight double, gated boolean",
    )
    merged = top_k(local, ["query_id", "gated"], [F.col("weight").desc(), F.col("chunk_ordinal")], keep, "_best")
    return merged.select("query_id", "collection_id", "chunk_id").distinct()


def score_vectors(queries: DataFrame, chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """J4 for given (query, chunk) pairs: cosine, zero where a vector is missing."""
    asked = queries.select("query_id", F.col("embedding").alias("_q"))
    stored = chunks.select("collection_id", "chunk_id", F.col("embedding").alias("_c"))
    return (
        pairs.join(asked, "query_id")
        .join(stored, ["collection_id", "chunk_id"])
        .withColumn("vector_score", r6(cosine("_q", "_c")))
        .drop("_q", "_c")
    )


def unmatched_candidates(variants: DataFrame, index: LexicalIndex, cfg: Config = DEFAULT) -> DataFrame:
    """Chunks that may rank without a matching token: asked type or page, else first by position."""
    place = index.forward.select(*PLACE)
    depth = cfg.rrf_depth

    def by(keys: list[str], boost: float) -> DataFrame:
        order = [r6(F.col("reliability") * boost).desc(), F.col("chunk_ordinal")]
        return top_k(place, ["collection_id", *keys], order, depth, "_pos")

    asked = variants.select(
        *VARIANT, "collection_id", F.col("want_type").alias("content_type"), F.col("want_page").alias("number")
    )
    # At most depth - 1 of the first 2 * depth chunks have a positive score when the rest is needed.
    first = top_k(place, ["collection_id"], [F.col("chunk_ordinal")], 2 * depth, "_pos")
    lists = [asked.select(*VARIANT, "collection_id").join(first, "collection_id")]
    if not asked.filter("content_type IS NOT NULL OR number IS NOT NULL").isEmpty():
        kind, page, both = ["content_type"], ["number"], ["content_type", "number"]
        lists += [
            asked.select(*VARIANT, "collection_id", *keys).join(by(keys, boost), ["collection_id", *keys])
            for keys, boost in ((kind, cfg.type_boost), (page, cfg.page_boost), (both, cfg.type_boost + cfg.page_boost))
        ]
    out = None
    for part in lists:
        part = part.select(*VARIANT, *PLACE)
        out = part if out is None else out.unionByName(part)
    return out


def hybrid_score(
    lexical: DataFrame, variants: DataFrame, vectors: DataFrame | None = None, cfg: Config = DEFAULT
) -> DataFrame:
    """A3: lexical share of the best lexical score, vector part and boosts, times reliability.

    ``variants`` has want_type, want_page and embedding.  ``vectors``: collection_id, chunk_id, embedding.
    """
    few = is_small(variants)
    best = lexical.groupBy(*VARIANT).agg(F.max("lexical_score").alias("_best"))
    asked = variants.select(
        *VARIANT, F.col("want_type").alias("_type"), F.col("want_page").alias("_page"),
        F.col("embedding").isNotNull().alias("_has_vector"),
        (unit("embedding") if vectors is not None else F.lit(None).cast("array<double>")).alias("_q"),
    ).join(best, VARIANT, "left")
    scored = lexical.join(hint_small(asked, few), VARIANT)
    near = F.lit(0.0)
    if vectors is not None:
        stored = vectors.select("collection_id", "chunk_id", unit("embedding").alias("_c")).filter("_c IS NOT NULL")
        scored = scored.join(hint_small(stored, is_small(stored, VECTOR_ROWS)), ["collection_id", "chunk_id"], "left")
        alike = F.col("_q").isNotNull() & F.col("_c").isNotNull() & (F.size("_q") == F.size("_c"))
        near = F.when(alike, dot(F.col("_q"), F.col("_c"))).otherwise(F.lit(0.0))
    scored = scored.withColumn("_near", near)
    share = F.when(F.col("_best") > 0, F.col("lexical_score") / F.col("_best")).otherwise(F.lit(0.0))
    boost = structure_boost(
        F.col("title_hit"), F.col("content_type") == F.col("_type"), F.col("number") == F.col("_page"), cfg
    )
    raw = F.when(
        F.col("_has_vector"),
        share * cfg.lexical_weight + F.greatest(F.col("_near"), F.lit(0.0)) * cfg.vector_weight + boost,
    ).otherwise(share + boost)
    return scored.select(
        *VARIANT, *PLACE, "lexical_score", "token_coverage",
        r6(F.col("_near")).alias("vector_score"), r6(raw * F.col("reliability")).alias("hybrid_score"),
    )


def contending(
    variants: DataFrame, chunks: DataFrame, index: LexicalIndex, others: DataFrame, vectors: DataFrame | None, keep: int, cfg: Config = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """(query_id, variant_pos, collection_id, chunk_id) of all pairs that matter for ``keep``, and the phrase hits among them.

    ``others`` always count. Of the pairs that match, the best of each task are found with the largest score of the variant. The question itself is
    scored for every chunk of its variants. A row outside is beaten by as many rows as the list has, whose fused score only grows.
    """
    pair = ["query_id", "variant_pos", "collection_id", "chunk_id"]
    asked = asked_of(variants, index)
    id_type = dict(variants.dtypes)["query_id"]
    phrases = saved(phrase_hits(variants, chunks, index, cfg), "phrases")
    first = saved(scan(index, asked, phrases, cfg, id_type=id_type), "first")
    largest = {(r["query_id"], r["variant_pos"]): r["value"] for r in first.collect()}
    best = scan(index, asked, phrases, cfg, largest, keep, vectors, id_type)
    found = best.select(*pair).unionByName(first.select(*pair)).unionByName(others.select(*pair))
    found = saved(found.unionByName(found.withColumn("variant_pos", F.lit(0))).distinct(), "pairs")
    return found, phrases.join(hint_small(found, is_small(found)), pair, "left_semi")


def score_variants(
    queries: DataFrame, chunks: DataFrame, index: LexicalIndex, cfg: Config = DEFAULT, keep: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Scores of every candidate of every query variant, and the variants.

    With ``keep``, only rows that can reach the fusion depth of a variant, or the best ``keep`` of a question by fused score among those with a
    positive hybrid score or through the gate.
    """
    # A variant without tokens ranks nothing, even when it has a vector. The small
    # table is written once: many branches below start from it.
    variants = saved(
        expand_queries(queries).filter(F.size(tokenize("text")) > 0)
        .withColumn("want_type", type_hint("text")).withColumn("want_page", page_hint("text")),
        "variants",
    )
    others = unmatched_candidates(variants, index, cfg)
    vectors = None
    if "embedding" in queries.columns and "embedding" in chunks.columns:
        vectors = chunks.select("collection_id", "chunk_id", "embedding").filter("embedding IS NOT NULL")
        place = index.forward.select(*PLACE)
        near = vector_candidates(
            variants.filter("variant_pos = 0"), vectors.join(place, ["collection_id", "chunk_id"]), cfg.rrf_depth, cfg)
        others = others.unionByName(
            near.join(place, ["collection_id", "chunk_id"]).select("query_id", F.lit(0).alias("variant_pos"), *PLACE))
    few = keep is not None and is_small(query_terms(variants))
    pairs, phrases = contending(variants, chunks, index, others, vectors, keep, cfg) if few else (None, None)
    # Read several times below (best score, ranks, scores), so written once.
    lexical = saved(bm25(variants, chunks, index, cfg, also=others, pairs=pairs, phrases=phrases), "lexical")
    return hybrid_score(lexical, variants, vectors, cfg), variants


def rrf(scored: DataFrame, variants: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """A4: fuse the variant rankings and blend with the score of the question itself."""
    few = is_small(variants, BROADCAST_ROWS // cfg.rrf_depth)
    ranked = top_k(scored, VARIANT, [F.col("hybrid_score").desc(), F.col("chunk_ordinal")], cfg.rrf_depth)
    credit = ranked.groupBy("query_id", "collection_id", "chunk_id").agg(
        F.sum(1 / (F.lit(cfg.rrf_k) + F.col("rank"))).alias("_credit")
    )
    best = credit.groupBy("query_id").agg(F.greatest(F.max("_credit"), F.lit(cfg.rrf_floor)).alias("_best"))
    share = credit.join(best, "query_id").select(
        "query_id", "collection_id", "chunk_id", (F.col("_credit") / F.col("_best")).alias("_share")
    )
    return (
        scored.filter("variant_pos = 0").drop("variant_pos")
        .join(hint_small(share, few), ["query_id", "collection_id", "chunk_id"], "left")
        .fillna(0.0, ["_share"])
        .withColumn("rrf_score", r6(F.col("_share")))
        .withColumn("score", r6(F.col("hybrid_score") * cfg.hybrid_blend + F.col("_share") * cfg.rrf_blend))
        .drop("_share")
    )
