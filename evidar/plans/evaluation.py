"""Evaluation of retrieval on a dataset of questions with known evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidar.config import DEFAULT, Config
from evidar.operators.evaluation import category_scores, char_accuracy, quality_gates, retrieval_metrics, weighted_score
from evidar.operators.selection import document_coverage
from evidar.plans.retrieval import retrieve_chunks
from evidar.session import saved


def evaluate(chunks: DataFrame, cases: DataFrame, ocr_samples: DataFrame | None = None, priorities=None, k: int = 10, cfg: Config = DEFAULT) -> dict[str, DataFrame]:
    """Per-case metrics, scores per category, weighted score and gates.

    Overview questions and review mode are answered by document coverage; all that is retrieved counts.
    """
    scored = cases.filter(~F.col("should_refuse") & (F.size("relevant_ids") > 0))
    wide = (F.col("category") == "overview") | (F.col("mode") == "review")
    scored = scored.withColumn("document_wide", wide)
    covering = scored.filter("document_wide")
    cover = document_coverage(chunks.join(covering.select("collection_id").distinct(), "collection_id", "left_semi"), cfg)
    covered = covering.select("query_id", "collection_id").join(cover, "collection_id").select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"))
    narrow = scored.filter("NOT document_wide").select("query_id", "collection_id", "mode", "text")
    ranked = retrieve_chunks(narrow, chunks, k, cfg=cfg).select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"))
    metrics = saved(retrieval_metrics(covered.unionByName(ranked), scored, k), "metrics")
    scores = category_scores(metrics)
    samples = char_accuracy(ocr_samples) if ocr_samples is not None else None
    return {
        "cases": metrics, "scores": scores, "weighted": weighted_score(scores.filter("overall = 0"), priorities),
        "gates": quality_gates(scores, samples),
    }
