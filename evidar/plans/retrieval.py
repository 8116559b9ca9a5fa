"""K9: from questions to ranked evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidar.config import DEFAULT, Config
from evidar.functions.text import is_document_wide
from evidar.operators.hybrid import rrf, score_variants
from evidar.operators.lexical import LexicalIndex, build_index
from evidar.operators.joins import hint_small, is_small
from evidar.operators.ranking import rank_hits
from evidar.operators.selection import (
    document_coverage, expand_neighbours, fill_evenly, mmr_select, passes_gate, rerank,
)
from evidar.session import saved


def fused_hits(
    queries: DataFrame, chunks: DataFrame, index: LexicalIndex | None = None, cfg: Config = DEFAULT, keep: int | None = None
) -> DataFrame:
    """Scored candidates of every query, before any gate; with ``keep``, those that can be among the best ``keep`` with a positive hybrid score or
    through the gate."""
    scored, variants = score_variants(queries, chunks, index or build_index(chunks), cfg, keep)
    return rrf(scored, variants, cfg)


def retrieve_chunks(
    queries: DataFrame, chunks: DataFrame, k: int, index: LexicalIndex | None = None, cfg: Config = DEFAULT
) -> DataFrame:
    """Top ``k`` evidence per query: gate and neighbours for ``qa``, context fill otherwise."""
    modes = hint_small(queries.select("query_id", "mode"), is_small(queries))
    hits = fused_hits(queries, chunks, index, cfg, k).join(modes, "query_id")
    is_qa = F.col("mode") == "qa"
    supported = F.when(is_qa, passes_gate(cfg)).otherwise(F.col("hybrid_score") > 0)
    # At most k rows per query; the steps below read them several times.
    best = saved(rank_hits(hits.filter(supported), k), "hits").join(
        chunks.select("collection_id", "chunk_id", "file_name"), ["collection_id", "chunk_id"]
    )
    answers = expand_neighbours(best.filter(is_qa), chunks, k, cfg)
    asked = queries.filter(~is_qa)
    others = fill_evenly(best.filter(~is_qa), asked, chunks, k)
    both = answers.unionByName(others, allowMissingColumns=True).drop("mode")
    return both.join(queries.select("query_id", "mode"), "query_id").fillna(False, ["adjacent"])


def retrieve(
    queries: DataFrame,
    chunks: DataFrame,
    index: LexicalIndex | None = None,
    rerank_scores=None,
    cfg: Config = DEFAULT,
) -> DataFrame:
    """K9: whole-document questions get coverage, the others the candidate funnel.

    ``rerank_scores`` is an optional function from hits to (query_id, chunk_id, rerank_score).
    """
    routed = queries.withColumn("_wide", is_document_wide("text", "mode"))
    wide = routed.filter("_wide").drop("_wide")
    narrow = routed.filter("NOT _wide").drop("_wide")
    covered = wide.select("query_id", "collection_id", "mode").join(
        document_coverage(chunks.join(wide.select("collection_id").distinct(), "collection_id", "left_semi"), cfg), "collection_id"
    ).select("query_id", "collection_id", "mode", "chunk_id", "rank", F.lit(0.0).alias("score"),
             F.lit(False).alias("adjacent"), F.lit("document_coverage").alias("strategy"))

    hits = retrieve_chunks(narrow, chunks, cfg.candidates, index, cfg)
    if rerank_scores is not None:
        hits = rerank(hits, rerank_scores(hits), cfg=cfg)
    attributes = chunks.select("collection_id", "chunk_id", F.col("number").alias("_number"), F.col("content_type").alias("_type"))
    hits = hits.join(attributes, ["collection_id", "chunk_id"]).withColumn("number", F.col("_number")).withColumn(
        "content_type", F.col("_type")).drop("_number", "_type", "adjacent")
    chosen = saved(mmr_select(saved(hits, "candidates"), chunks, cfg.diverse, cfg), "chosen")
    evidence = expand_neighbours(chosen, chunks, cfg.evidence, cfg).select(
        "query_id", "collection_id", "mode", "chunk_id", "rank", "score", "adjacent",
        F.lit("ranked").alias("strategy"),
    )
    return covered.unionByName(evidence.drop("mode").join(narrow.select("query_id", "mode"), "query_id"))


def refusals(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """Questions in ``qa`` mode without evidence are refused."""
    return queries.filter(F.col("mode") == "qa").join(evidence.select("query_id"), "query_id", "left_anti")
