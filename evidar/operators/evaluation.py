"""Retrieval, OCR, citation and refusal quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidar.config import PRIORITIES
from evidar.functions.distance import edit_distance
from evidar.functions.text import comparable_text
from evidar.operators.ranking import top_k
from evidar.operators.slices import carry


def retrieval_metrics(hits: DataFrame, cases: DataFrame, k: int = 10) -> DataFrame:
    """Recall, reciprocal rank and NDCG per case.

    ``hits``: query_id, chunk_id, rank.  ``cases``: query_id, category, relevant_ids and optionally
    document_wide: then all retrieved chunks count and all three metrics are the recall.
    """
    wide = F.col("document_wide") if "document_wide" in cases.columns else F.lit(False)
    cases = cases.withColumn("_wide", wide).withColumn("_expected", F.array_distinct("relevant_ids"))
    relevant = cases.select("query_id", "_wide", F.explode("_expected").alias("chunk_id"))
    found = hits.select("query_id", "chunk_id", "rank").join(relevant, ["query_id", "chunk_id"])
    near = (F.col("rank") <= k) | F.col("_wide")
    per_case = found.groupBy("query_id").agg(
        F.count_distinct(F.when(near, F.col("chunk_id"))).alias("_hits"), F.min("rank").alias("_first"),
        F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1))).alias("_dcg"),
    )
    joined = cases.join(per_case, "query_id", "left")
    size = F.size("_expected")
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(size, F.lit(k)), F.lit(1))), F.lit(0.0),
        lambda total, i: total + 1 / F.log2(i + 1),
    )
    recall = F.when(size == 0, F.lit(1.0)).otherwise(F.coalesce("_hits", F.lit(0)) / size)
    first = F.coalesce(1 / F.col("_first"), F.lit(0.0))
    gain = F.when(size == 0, F.lit(1.0)).otherwise(F.coalesce("_dcg", F.lit(0.0)) / ideal)
    return joined.select(
        "query_id", "category", recall.alias("recall"),
        F.when(F.col("_wide"), recall).otherwise(first).alias("mrr"),
        F.when(F.col("_wide"), recall).otherwise(gain).alias("ndcg"),
    )


def category_scores(metrics: DataFrame) -> DataFrame:
    """Blended score per category and the macro means (category NULL), one pass."""
    blend = F.col("recall") * 0.5 + F.col("mrr") * 0.25 + F.col("ndcg") * 0.25
    sets = metrics.withColumn("_blend", blend).rollup("category").agg(
        F.count(F.lit(1)).alias("cases"), F.avg("_blend").alias("score"), F.avg("recall").alias("recall"),
        F.avg("mrr").alias("mrr"), F.avg("ndcg").alias("ndcg"), F.grouping("category").alias("overall"),
    )
    return sets


def weighted_score(scores: DataFrame, priorities: dict[str, float] | DataFrame | None = None) -> DataFrame:
    """Mean weighted by priority over the categories present."""
    if not isinstance(priorities, DataFrame):
        # A fixed handful of categories.
        rows = list((priorities or PRIORITIES).items())
        priorities = scores.sparkSession.createDataFrame(rows, "category string, weight double")
    joined = scores.join(F.broadcast(priorities), "category")
    return joined.agg(F.coalesce(F.try_divide(F.sum(F.col("score") * F.col("weight")), F.sum("weight")), F.lit(0.0)).alias("weighted_score"))


def quality_gates(scores: DataFrame, ocr: DataFrame | None = None) -> DataFrame:
    """Release gates from ``category_scores`` (rows with overall = 1 hold the means)."""
    total = F.col("overall") == 1
    gates = scores.agg(
        (F.max(F.when(total, F.col("recall"))) >= 0.85).alias("recall_gate"),
        (F.max(F.when(total, F.col("mrr"))) >= 0.75).alias("mrr_gate"),
        F.coalesce(F.min(F.when(~total, F.col("score"))) >= 0.75, F.lit(False)).alias("category_gate"),
    )
    if ocr is None:
        return gates
    sampled = ocr.agg((F.avg("accuracy") >= 0.9).alias("ocr_gate"))
    one = F.lit(1).alias("_one")
    return gates.select("*", one).join(sampled.select("*", one), "_one").drop("_one")


def accuracy_of(actual: Column | str, expected: Column | str, max_chars: int | None = None) -> Column:
    """A8 scalar: one minus the normalised edit distance of the comparable texts, of their first ``max_chars`` if given.

    Long texts cost their length times their distance, not their length squared.
    """
    left, right = comparable_text(actual), comparable_text(expected)
    if max_chars is not None:
        left, right = F.substring(left, 1, max_chars), F.substring(right, 1, max_chars)
    longest = F.greatest(F.length(left), F.length(right), F.lit(1))
    return (
        F.when(right == "", F.when(left == "", 1.0).otherwise(0.0))
        .otherwise(F.greatest(F.lit(0.0), 1 - edit_distance(left, right) / longest))
    )


def char_accuracy(samples: DataFrame) -> DataFrame:
    return samples.withColumn("accuracy", accuracy_of("actual", "expected"))


def valid_citations(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Keep the citation ids that are sources of the answer; order kept, no repeats."""
    cited = claims.select("answer_id", "claim_id", F.posexplode("citations").alias("pos", "source_id"))
    good = cited.join(sources.select("answer_id", "source_id"), ["answer_id", "source_id"], "left_semi")
    once = good.groupBy("answer_id", "claim_id", "source_id").agg(F.min("pos").alias("pos"))
    kept = once.groupBy("answer_id", "claim_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "source_id")))["source_id"].alias("_kept")
    )
    blank = F.array().cast(dict(claims.dtypes)["citations"])
    return claims.join(kept, ["answer_id", "claim_id"], "left").withColumn(
        "citations", F.coalesce("_kept", blank)
    ).drop("_kept")


def citation_precision(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Share of citing claims whose every citation exists. ``claims``: answer_id, claim_id, source_id rows."""
    known = sources.select("answer_id", "source_id").distinct().withColumn("_known", F.lit(True))
    per_claim = claims.join(known, ["answer_id", "source_id"], "left").groupBy("answer_id", "claim_id").agg(
        F.bool_and(F.coalesce("_known", F.lit(False))).alias("_valid")
    )
    return per_claim.agg(
        F.count(F.lit(1)).alias("cited_claims"), F.count_if("_valid").alias("valid_claims"),
        F.coalesce(F.avg(F.col("_valid").cast("double")), F.lit(1.0)).alias("precision"),
    )


def refusal_accuracy(results: DataFrame) -> DataFrame:
    """A10: share of results refused exactly when they should be."""
    right = (F.coalesce("refused", F.lit(False)) == F.coalesce("should_refuse", F.lit(False))).cast("double")
    return results.agg(F.count(F.lit(1)).alias("cases"), F.coalesce(F.avg(right), F.lit(1.0)).alias("accuracy"))


def clean_eval_cases(raw: DataFrame, allowed: DataFrame, per_document: int | None = None) -> DataFrame:
    """Usable evaluation cases from generated candidates, the first ``per_document`` of each document if given.

    ``raw``: document_id, position, category, question, reference_answer, relevant_ids, should_refuse, difficulty.
    """
    if per_document is None:
        first = carry(raw, ["document_id"], None, ["position"], index="case_no")
    else:
        first = top_k(raw, ["document_id"], [F.col("position")], per_document, "case_no")
    digits = F.col("case_no").cast("string")
    ids = first.select("document_id", "case_no", F.posexplode("relevant_ids").alias("pos", "chunk_id"))
    known = ids.join(allowed.select("document_id", "chunk_id"), ["document_id", "chunk_id"], "left_semi")
    once = known.groupBy("document_id", "case_no", "chunk_id").agg(F.min("pos").alias("pos"))
    kept = once.groupBy("document_id", "case_no").agg(
        F.sort_array(F.collect_list(F.struct("pos", "chunk_id")))["chunk_id"].alias("_kept"))
    names = ["overview", "detail", "visual", "review", "comparison", "unanswerable"]
    category = F.when(F.col("category").isin(names), F.col("category")).otherwise("detail")
    out = (
        first.join(kept, ["document_id", "case_no"], "left")
        .withColumn("category", category)
        .withColumn("should_refuse", (F.col("category") == "unanswerable") | F.coalesce("should_refuse", F.lit(False)))
        .withColumn("mode", F.when(F.col("category") == "review", "review").when(F.col("category") == "overview", "explain").otherwise("qa"))
        .withColumn("relevant_ids", F.when(F.col("should_refuse") | F.col("_kept").isNull(), F.array().cast("array<string>")).otherwise(F.col("_kept")))
        .withColumn("question", F.trim(F.coalesce("question", F.lit(""))))
        .withColumn("difficulty", F.when(F.col("difficulty").isin("easy", "medium", "hard"), F.col("difficulty")).otherwise("medium"))
        .withColumn("case_id", F.concat(F.substring("document_id", 1, 8), F.lit("-"), F.when(F.col("case_no") < 10, F.concat(F.lit("0"), digits)).otherwise(digits)))
        .withColumn("review_status", F.lit("pending_human_review"))
    )
    usable = (F.col("question") != "") & (F.col("should_refuse") | (F.size("relevant_ids") > 0))
    return out.filter(usable).drop("_kept", "position", "case_no")
