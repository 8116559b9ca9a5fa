"""From ranked evidence to cited sources and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidar.functions.expr import let, trim_ws
from evidar.functions.text import evidence_reliability, tokenize

# Sentence pattern and cut lengths.
SENTENCES = "[^。！？.!?\n]+[。！？.!?]?"
HIGHLIGHT, EXCERPT, LEAD = 260, 560, 160


def best_highlight(text: Column, query_tokens: Column) -> Column:
    """The sentence that shares most distinct tokens with the question."""

    def pick(sentences: Column) -> Column:
        scored = F.transform(
            sentences,
            lambda s, i: let(
                trim_ws(s),
                lambda t: F.struct(
                    F.size(F.array_intersect(F.array_distinct(tokenize(t)), query_tokens)).alias("score"),
                    F.length(t).alias("length"), (-i).alias("place"), t.alias("sentence"),
                ),
            ),
        )
        first = trim_ws(F.element_at(sentences, 1))
        plain = F.substring(F.when(first != "", first).otherwise(text), 1, HIGHLIGHT)
        return let(
            F.array_max(F.filter(scored, lambda s: s["length"] >= 8)),
            lambda top: F.when(top["score"] > 0, F.substring(top["sentence"], 1, HIGHLIGHT)).otherwise(plain),
        )

    found = F.regexp_extract_all(text, F.lit(f"({SENTENCES})"), F.lit(1))
    return let(F.when(F.size(found) > 0, found).otherwise(F.array(text)), pick)


def create_sources(hits: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Numbered sources with excerpt and highlight, in rank order."""
    asked = queries.select("query_id", F.array_distinct(tokenize("text")).alias("_tokens"))
    order = [c for c in ("rerank_score", "hybrid_score", "score") if c in hits.columns]
    joined = hits.select("query_id", "collection_id", "chunk_id", "rank", F.coalesce(*order, F.lit(0.0)).alias("score")).join(
        chunks, ["collection_id", "chunk_id"]
    ).join(asked, "query_id")
    lit = joined.withColumn("highlight", best_highlight(F.col("text"), F.col("_tokens")))
    start = F.greatest(F.lit(0), F.instr("text", F.col("highlight")) - 1 - LEAD)
    return lit.select(
        "query_id", F.col("rank").cast("int").alias("source_id"), "chunk_id", "file_name", "label", "kind", "number",
        "title", "content_type", F.coalesce("text_origin", F.lit("native")).alias("text_origin"),
        evidence_reliability("evidence_weight", "text_origin", "ocr_confidence").alias("confidence"),
        F.substring("text", start + 1, F.lit(EXCERPT)).alias("excerpt"), "highlight", "score",
    )


def grounding_context(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """One evidence text per query; a query has at most a few ranked chunks."""
    rows = hits.select("query_id", "collection_id", "chunk_id", "rank").join(chunks, ["collection_id", "chunk_id"])
    trust = evidence_reliability("evidence_weight", "text_origin", "ocr_confidence")
    head = F.concat(
        F.lit("[来源"), F.col("rank").cast("string"), F.lit("｜"), F.col("file_name"), F.lit("｜"), F.col("label"),
        F.lit("｜标题："), F.coalesce("title", F.lit("未命名")), F.lit("｜类型："), F.coalesce("content_type", F.lit("prose")),
        F.lit("｜证据来源："), F.coalesce("text_origin", F.lit("native")), F.lit("｜可靠度："),
        F.format_string("%.2f", trust), F.lit("]\n"),
    )
    return rows.withColumn("_part", F.concat(head, F.col("text"))).groupBy("query_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("rank", "_part")))["_part"], "\n\n---\n\n").alias("context"),
        F.count(F.lit(1)).alias("evidence_count"),
    )


def anchor_context(hits: DataFrame, chunks: DataFrame, anchors: DataFrame) -> DataFrame:
    """P24 with anchor tags: the first anchor of each chunk names it."""
    tags = anchors.groupBy("chunk_id").agg(F.min("anchor_id").alias("anchor_id"))
    rows = hits.select("query_id", "collection_id", "chunk_id", "rank").join(
        chunks, ["collection_id", "chunk_id"]).join(tags, "chunk_id")
    part = F.format_string("[%s] %s — %s\n%s", "anchor_id", "label", "title", "text")
    return rows.withColumn("_part", part).groupBy("query_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("rank", "_part")))["_part"], "\n\n").alias("context"))


def assemble_prompts(queries: DataFrame, contexts: DataFrame, history: DataFrame, instruction: str) -> DataFrame:
    """Chat messages per query; a grounded query without evidence gets an error code.

    ``queries``: query_id, text, grounding.  ``history``: query_id, turns array<struct<role, content>>.
    """
    message = "array<struct<role:string,content:string>>"
    joined = queries.join(contexts.select("query_id", "context"), "query_id", "left").join(history, "query_id", "left")
    system = F.when(F.col("grounding"), F.concat(F.lit(instruction + "\n\n"), F.col("context"))).otherwise(F.lit(instruction))

    def say(role: str, content: Column) -> Column:
        return F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))

    missing = F.col("grounding") & F.col("context").isNull()
    return joined.select(
        "query_id",
        F.when(missing, F.lit("GROUNDING_EVIDENCE_MISSING")).alias("error_code"),
        F.when(~missing, F.concat(
            say("system", system), F.coalesce("turns", F.array().cast(message)), say("user", F.col("text"))
        )).alias("messages"),
    )
