"""From page text to chunks: lines, sections, budgets and document statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidar.config import DEFAULT, Config
from evidar.functions.expr import SPACE, cut, half_up, trim_ws
from evidar.functions.structure import chunk_pieces, segment_text
from evidar.functions.text import infer_title, is_meaningful, normalize_ws
from evidar.operators.ranking import top_k
from evidar.operators.slices import carry


def flatten_nodes(tree: DataFrame, depth: int) -> DataFrame:
    """Text of every top node: its own, else its children's, joined by line ends.

    ``tree``: doc_id, node_id, parent_id (NULL at the top), node_seq, level (0 at the top), text.
    """
    known = tree.withColumn("text", F.coalesce(normalize_ws("text"), F.lit("")))
    for level in range(depth, 0, -1):
        below = (
            known.filter((F.col("level") == level) & (F.col("text") != ""))
            .groupBy("doc_id", F.col("parent_id").alias("node_id"))
            .agg(F.sort_array(F.collect_list(F.struct("node_seq", "text"))).alias("_below"))
            .withColumn("_below", normalize_ws(F.array_join("_below.text", "\n")))
        )
        upper = known.filter(F.col("level") < level).join(below, ["doc_id", "node_id"], "left")
        known = upper.withColumn(
            "text", F.when(F.col("text") == "", F.coalesce("_below", F.lit(""))).otherwise(F.col("text"))
        ).drop("_below")
    return known


def assemble_lines(items: DataFrame) -> DataFrame:
    """Positioned text items of a page -> page text.

    Items are joined to lines first, then lines to pages, so that no task holds
    more than one line of items or one page of lines.
    """
    cleaned = items.withColumn("str", trim_ws(F.regexp_replace("str", f"{SPACE}+", " "))).filter(F.col("str") != "")
    cleaned = cleaned.withColumn("x", F.coalesce("x", F.lit(0.0))).withColumn(
        "line_y", half_up(F.coalesce("y", F.lit(0.0)) / 3) * 3
    )
    lines = cleaned.groupBy("doc_id", "page", "line_y").agg(
        F.sort_array(F.collect_list(F.struct("x", "item_seq", "str"))).alias("_items")
    ).withColumn("line", F.array_join("_items.str", " "))
    return lines.groupBy("doc_id", "page").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("line_y", "line")), asc=False)["line"], "\n").alias("text"),
        F.count(F.lit(1)).alias("n_lines"),
    )


def extract_sections(nodes: DataFrame, whole_texts: DataFrame | None = None) -> DataFrame:
    """P5: slides and pages if there are any, else every top node; empty ones dropped.

    ``nodes``: doc_id, file_name, node_seq, type, number, text, text_origin, ocr_confidence.
    ``whole_texts`` (doc_id, file_name, text) serves documents left without sections.
    """
    paged = F.col("type").isin("slide", "page")
    has_pages = nodes.groupBy("doc_id").agg(F.max(paged).alias("_paged"))
    source = nodes.join(has_pages, "doc_id").filter(paged | ~F.col("_paged")).drop("_paged")
    placed = carry(source, ["doc_id"], None, ["node_seq"], index="position")
    kind = F.when(F.col("type").isin("slide", "page"), F.col("type")).otherwise("section")
    number = F.when(kind != "section", F.coalesce(F.nullif("number", F.lit(0)), F.col("position"))).otherwise(F.col("position"))
    sections = (
        placed.withColumn("text", normalize_ws("text")).filter(F.col("text") != "")
        .withColumn("kind", kind).withColumn("number", number.cast("int"))
        .withColumn("label", _label(F.col("kind"), F.col("number").cast("string")))
        .withColumn("text_origin", F.coalesce("text_origin", F.lit("native")))
        .drop("type", "position")
    )
    if whole_texts is not None:
        missing = whole_texts.join(sections.select("doc_id").distinct(), "doc_id", "left_anti")
        sections = sections.unionByName(
            missing.withColumn("text", normalize_ws("text")).filter(F.col("text") != "").select(
                "doc_id", "file_name", F.lit(1).alias("node_seq"), F.lit(1).alias("number"), "text",
                F.lit("native").alias("text_origin"), F.lit("section").alias("kind"), F.lit("文档内容").alias("label"),
            ),
            allowMissingColumns=True,
        )
    return sections.withColumn("section_id", F.concat_ws("-", "kind", "number")).withColumn(
        "title", infer_title("text", F.col("label"))
    )


def _label(kind, number):
    """Fixed formats of the locator labels."""
    return (
        F.when(kind == "slide", F.concat(F.lit("幻灯片 "), number))
        .when(kind == "page", F.concat(F.lit("第 "), number, F.lit(" 页")))
        .otherwise(F.concat(F.lit("内容片段 "), number))
    )


def running_budget(df: DataFrame, keys: list[str], order: str, size: str, limit: int) -> DataFrame:
    """Characters used before each row and what is left of the budget."""
    out = carry(df, keys, None, [order], before={"used_before": F.col(size)})
    return out.withColumn("allowed", F.greatest(F.least(F.col(size), F.lit(limit) - F.col("used_before")), F.lit(0)))


def budget_sections(sections: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """P13 for sections: numbered in order; the first ones, cut at the character budget, where limits are given."""
    placed = carry(sections, ["doc_id"], None, ["node_seq"], index="section_pos", before={"_before": F.length("text")})
    if cfg.max_sections is not None:
        placed = placed.filter(F.col("section_pos") <= cfg.max_sections)
    if cfg.max_chars is not None:
        placed = placed.withColumn("_left", F.lit(cfg.max_chars) - F.col("_before")).filter(F.col("_left") > 0)
        placed = placed.withColumn("text", F.substring("text", F.lit(1), F.col("_left").cast("int"))).drop("_left")
    return placed.withColumn("section_pos", F.col("section_pos").cast("int")).drop("_before")


def segments(sections: DataFrame) -> DataFrame:
    """P8 as rows."""
    return sections.select("section_id", F.posexplode(segment_text("text")).alias("unit_pos", "unit")).select(
        "section_id", "unit_pos", "unit.type", "unit.text"
    )


def chunk_sections(sections: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Every section to its chunks. Row-local: no shuffle, sections run in parallel."""
    keep = [c for c in sections.columns if c not in ("text", "title")]
    return sections.select(*keep, F.posexplode(chunk_pieces("text", "title", cfg)).alias("piece_pos", "piece")).select(
        *keep, "piece_pos", F.concat(F.col("section_id"), F.lit("-chunk-"), (F.col("piece_pos") + 1).cast("string")).alias("chunk_id"),
        "piece.title", "piece.content_type", "piece.structure_types", "piece.text",
    )


def apply_budgets(sections: DataFrame, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Chunks within the budgets that are given, and one header row per document.

    ``truncated`` tells whether anything was left out, except chunks cut inside
    the last section.
    """
    safe = budget_sections(sections, cfg)
    made = chunk_sections(safe, cfg)
    order = ["section_pos", "piece_pos"]
    if cfg.max_chunks is None:
        numbered = carry(made, ["doc_id"], None, order, index="_nth")
    else:
        numbered = top_k(made, ["doc_id"], [F.col(c) for c in order], cfg.max_chunks, "_nth")
    chunks = numbered.withColumn("chunk_ordinal", (F.col("_nth") - 1).cast("bigint")).drop("_nth")

    full = sections.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("_sections"), F.sum(F.length("text")).alias("_chars")
    )
    used = safe.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("section_count"), F.sum(F.length("text")).alias("character_count"),
        F.max("section_pos").alias("_last"),
    )
    kept = chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.max(F.when(F.col("chunk_ordinal") == (cfg.max_chunks or 0) - 1, F.col("section_pos"))).alias("_filled_in"),
    )
    header = full.join(used, "doc_id").join(kept, "doc_id", "left").select(
        "doc_id", "section_count", "character_count", F.coalesce("chunk_count", F.lit(0).cast("bigint")).alias("chunk_count"),
        (
            (F.lit(False) if cfg.max_sections is None else F.col("_sections") > cfg.max_sections)
            | (F.col("_chars") > F.col("character_count"))
            | F.coalesce(F.col("_filled_in") < F.col("_last"), F.lit(False))
        ).alias("truncated"),
    )
    return chunks, header


def union_visual(
    chunks: DataFrame, analyses: DataFrame, max_title: int | None = None, max_summary: int | None = None,
    max_observations: int | None = None, max_relationships: int | None = None,
) -> DataFrame:
    """Add chunks made from visual analyses, whole or up to the limits given.

    ``analyses``: collection_id, file_name, kind, number, visual_id, visual_kind, title, summary,
    observations, relationships, confidence.
    """

    def block(heading: str, lines) -> "F.Column":
        return F.when(F.size(lines) > 0, F.concat(F.lit(f"{heading}：\n- "), F.array_join(lines, "\n- ")))

    def some(c: str, n: int | None):
        filled = F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda s: s != "")
        return filled if n is None else F.slice(filled, 1, n)

    title = cut("title", max_title)
    sure = F.least(F.greatest(F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    visual = analyses.select(
        "collection_id", "file_name", "kind", "number",
        F.concat(F.col("kind"), F.lit("-"), F.col("number").cast("string"), F.lit("-visual-"), F.col("visual_id")).alias("chunk_id"),
        F.when(F.col("kind") == "slide", F.concat(F.lit("幻灯片 "), F.col("number").cast("string")))
        .otherwise(F.concat(F.lit("第 "), F.col("number").cast("string"), F.lit(" 页"))).alias("label"),
        title.alias("title"), F.lit("visual").alias("content_type"),
        F.array(F.lit("visual")).alias("structure_types"), F.lit("vision").alias("text_origin"),
        F.round(F.lit(0.7) + sure * 0.3, 4).alias("evidence_weight"),
        F.concat_ws(
            "\n",
            F.concat(F.lit("视觉证据类型："), F.col("visual_kind")),
            F.concat(F.lit("标题："), title),
            F.concat(F.lit("摘要："), cut("summary", max_summary)),
            block("可见元素", some("observations", max_observations)),
            block("可见关系", some("relationships", max_relationships)),
        ).alias("text"),
    )
    return chunks.unionByName(visual, allowMissingColumns=True)


def document_stats(chunks: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Size of every collection, and what a selection covers of it."""
    page = F.concat_ws(":", "kind", "number")
    size = chunks.groupBy("collection_id").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.sum(F.length("text")).alias("character_count"),
        F.count_distinct(page).alias("indexed_page_count"),
        F.count_if(F.col("content_type") == "visual").alias("visual_chunk_count"),
    )
    if hits is None:
        return size
    chosen = hits.select("query_id", "collection_id", "chunk_id").join(
        chunks.select("collection_id", "chunk_id", "kind", "number", "content_type"), ["collection_id", "chunk_id"]
    ).groupBy("query_id", "collection_id").agg(
        F.count_distinct(page).alias("selected_page_count"),
        F.count_if(F.col("content_type") == "visual").alias("visual_candidate_count"),
    )
    return chosen.join(size.select("collection_id", "chunk_count", "indexed_page_count"), "collection_id")


def no_text_documents(sections: DataFrame, headers: DataFrame, visuals: DataFrame | None = None) -> DataFrame:
    """Documents without enough text for an index: NO_TEXT_LAYER unless they have visuals."""
    texts = sections.groupBy("doc_id").agg(
        F.max(is_meaningful("text")).alias("_meaningful"), F.sum(F.length("text")).alias("_chars")
    )
    poor = headers.join(texts, "doc_id", "left").filter(
        (F.col("chunk_count") == 0) | ~F.coalesce(F.col("_meaningful"), F.lit(False))
    )
    if visuals is not None:
        poor = poor.join(visuals.select("doc_id").distinct(), "doc_id", "left_anti")
    return poor.select("doc_id", F.lit("NO_TEXT_LAYER").alias("error_code"))


def sanitize_chunks(
    chunks: DataFrame, max_chunks: int | None = None, max_chars: int | None = None, max_title: int | None = None,
    max_label: int | None = None, max_number: int | None = None,
) -> DataFrame:
    """Chunks with clamped fields; short texts dropped. Ids and file names stay whole; limits hold only where they are given."""
    first = chunks if max_chunks is None else top_k(chunks, ["collection_id"], [F.col("chunk_ordinal")], max_chunks, "_pos").drop("_pos")
    text = normalize_ws("text") if max_chars is None else F.substring(normalize_ws("text"), 1, max_chars)
    in_range = F.col("number") >= 1 if max_number is None else F.col("number").between(1, max_number)
    keep = lambda c, allowed, other: F.when(F.col(c).isin(allowed), F.col(c)).otherwise(other)
    out = (
        first.filter(F.col("chunk_id").isNotNull() & F.col("text").isNotNull() & F.col("label").isNotNull())
        .withColumn("title", cut(F.coalesce("title", "label"), max_title))
        .withColumn("label", cut("label", max_label))
        .withColumn("kind", keep("kind", ["page", "slide", "section"], "section"))
        .withColumn("number", F.when(in_range, F.col("number")).otherwise(1))
        .withColumn("content_type", keep("content_type", ["prose", "list", "definition", "table", "code", "visual"], "prose"))
        .withColumn("text_origin", keep("text_origin", ["native", "ocr", "mixed", "vision"], "native"))
        .withColumn("text", text)
        .filter(F.length("text") >= 12)
    )
    if "embedding" in out.columns:
        finite = F.size("embedding").between(64, 512) & F.forall(
            "embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
        )
        out = out.withColumn("embedding", F.when(finite, F.col("embedding")))
    return out
