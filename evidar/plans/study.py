"""Controlled-study answers: reuse, generation, attribution, gating, blinding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidar.config import DEFAULT, Config
from evidar.functions.terms import content_key
from evidar.functions.text import canonical_text
from evidar.operators import answers as A
from evidar.operators import attribution as C
from evidar.operators.workspaces import memo_misses
from evidar.plans.retrieval import retrieve_chunks
from evidar.session import saved

VERSIONS = {"material_version": "material-v1", "model_version": "model-v1", "prompt_version": "prompt-v1"}


def cache_keys(questions: DataFrame, versions: dict[str, str] | None = None) -> DataFrame:
    """Key over grounding, history, versions and question; condition and attribution stay out."""
    known, _ = C.attach_factors(questions)
    fixed = {name: F.lit(value) for name, value in (versions or VERSIONS).items()}
    history = F.col("turns") if "turns" in questions.columns else F.array().cast("array<struct<role:string,content:string>>")
    clean = known.withColumn("question", canonical_text("question", 2_000))
    return clean.withColumn("cache_key", content_key(grounding=F.col("grounding"), history=history, question=F.col("question"), **fixed))


def study_answers(
    questions: DataFrame, chunks: DataFrame, anchors: DataFrame, cache: DataFrame,
    generate: Callable[[DataFrame], DataFrame], cfg: Config = DEFAULT,
) -> dict[str, DataFrame]:
    """J5 -> J12 -> generation -> P37 -> C2..C6 -> C9.

    ``questions``: answer_id, collection_id, condition, question.  ``cache``: cache_key, certified, created_at, answer (JSON).
    ``generate`` maps (cache_key, question, grounding) rows to (cache_key, json).
    """
    keyed = saved(cache_keys(questions), "study-keys")
    hits, misses = memo_misses(keyed, cache)
    todo = keyed.join(misses, "cache_key", "left_semi").select("cache_key", "question", "grounding").dropDuplicates(["cache_key"])
    made = generate(todo).select("cache_key", "json").unionByName(hits.select("cache_key", F.col("answer").alias("json")))
    raw = keyed.join(made, "cache_key").select("answer_id", "json", "question", "grounding")
    answers, claims = A.normalize_answers(raw)
    answers, claims = saved(answers, "study-answers"), saved(claims, "study-claims")
    asked = claims.join(questions.select("answer_id", "collection_id", "question"), "answer_id").select(
        F.concat_ws("\u0001", F.col("answer_id").cast("string"), "claim_id").alias("query_id"), "collection_id", F.lit("explain").alias("mode"),
        F.concat_ws("\n", "question", "text").alias("text"), "answer_id", "claim_id")
    found = retrieve_chunks(asked.select("query_id", "collection_id", "mode", "text"), chunks, 4, cfg=cfg)
    evidence = found.join(asked.select("query_id", "answer_id", "claim_id"), "query_id").select("answer_id", "claim_id", "chunk_id", "rank")
    ranked = C.rank_anchors(claims, evidence, anchors)
    rows = saved(C.candidates(claims, ranked, anchors), "study-candidates")
    checked = C.subset_cover(rows)
    gated, kept = C.gate_claims(answers, claims, checked)
    shown = C.visible_citations(kept, checked, questions.select("answer_id", "condition"))
    return {"answers": gated, "claims": kept, "citations": shown, "todo": todo}
