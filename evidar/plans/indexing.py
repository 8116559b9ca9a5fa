"""From manifests or page nodes to the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidar.config import DEFAULT, Config
from evidar.operators.index import apply_budgets, extract_sections, no_text_documents, union_visual
from evidar.operators.ocr import apply_ocr, ocr_summary
from evidar.session import saved
from evidar.sources.manifests import read_manifests


def index_nodes(nodes: DataFrame, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Chunks (keyed as a collection) and one header row per document."""
    chunks, headers = apply_budgets(extract_sections(nodes), cfg)
    return chunks.withColumnRenamed("doc_id", "collection_id").withColumn("evidence_weight", F.lit(None).cast("double")), headers


def index_manifests(files: DataFrame, analyses: DataFrame | None = None, cfg: Config = DEFAULT) -> dict[str, DataFrame]:
    """S3 -> J1/M1 -> P5 -> P12 -> P13 -> U1. ``files``: doc_id, file_name, json, requested_mode."""
    pages, natives, visuals, errors = read_manifests(files, cfg=cfg)
    merged, mismatched = apply_ocr(natives, pages, cfg)
    merged = saved(merged, "merged")
    names = files.select("doc_id", "file_name")
    bad = errors.unionByName(mismatched)
    nodes = merged.join(names, "doc_id").join(bad.select("doc_id"), "doc_id", "left_anti").withColumn("node_seq", F.col("number").cast("bigint"))
    # Sections and chunks feed several results each.
    sections = saved(extract_sections(nodes), "sections")
    chunks, headers = apply_budgets(sections, cfg)
    chunks = saved(chunks, "chunks")
    empty = no_text_documents(sections, headers, visuals)
    chunks = chunks.join(empty.select("doc_id"), "doc_id", "left_anti").withColumnRenamed("doc_id", "collection_id")
    chunks = chunks.withColumn("evidence_weight", F.lit(None).cast("double"))
    if analyses is not None:
        chunks = union_visual(chunks, analyses)
    return {
        "chunks": chunks, "headers": headers, "ocr_summary": ocr_summary(pages), "visuals": visuals,
        "errors": bad.unionByName(empty),
    }
