"""Native and OCR text: reconciliation, summaries and failure rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from evidar.config import DEFAULT, Config
from evidar.functions.expr import col, let, trim_ws
from evidar.functions.text import comparable_text, is_meaningful, normalize_ws


class KnownLines:
    """Comparable lines with an index that finds those a text contains or that contain it.

    A line that contains a text of ``GRAM`` characters or more holds its first gram; a text that contains a long line holds that line's first
    gram, and short lines are looked up whole. So a test costs about the length of the text, not the number of lines.
    """

    GRAM = 8

    def __init__(self):
        self.whole: set[str] = set()
        self.short: set[int] = set()
        self.holding: dict[str, set[str]] = {}
        self.beginning: dict[str, set[str]] = {}

    def add(self, line: str) -> None:
        if line in self.whole:
            return
        self.whole.add(line)
        if len(line) < self.GRAM:
            self.short.add(len(line))
            return
        self.beginning.setdefault(line[: self.GRAM], set()).add(line)
        for k in range(len(line) - self.GRAM + 1):
            self.holding.setdefault(line[k : k + self.GRAM], set()).add(line)

    def related(self, text: str) -> bool:
        """Whether a line equals ``text`` or, if that has ``GRAM`` characters or more, contains it or is contained in it."""
        if text in self.whole or len(text) < self.GRAM:
            return text in self.whole
        if any(text in line for line in self.holding.get(text[: self.GRAM], ())):
            return True
        for k in range(len(text) - self.GRAM + 1):
            if any(text.startswith(line, k) for line in self.beginning.get(text[k : k + self.GRAM], ())):
                return True
        return any(text[k : k + n] in self.whole for n in self.short for k in range(len(text) - n + 1))


@F.pandas_udf(ArrayType(StringType()))
def _new_lines(known: pd.Series, keys: pd.Series, lines: pd.Series) -> pd.Series:
    """The lines whose key is new: not empty, and related to no known line nor to a key taken before."""

    def new(old, texts, whole):
        if old is None or texts is None:
            return None
        held, out = KnownLines(), []
        for line in old:
            held.add(line)
        for key, line in zip(texts, whole):
            if key != "" and not held.related(key):
                held.add(key)
                out.append(line)
        return out

    return pd.Series([new(*row) for row in zip(known, keys, lines)])


def merge_native_ocr(native: Column | str, ocr: Column | str) -> Column:
    """M1: native text plus the OCR lines it does not have, as ``struct<text, origin>``."""
    def result(text: Column, origin: str) -> Column:
        return F.struct(text.alias("text"), F.lit(origin).alias("origin"))

    def new_lines(a: Column, b: Column) -> Column:
        known = F.filter(F.transform(F.split(a, "\n"), comparable_text), lambda line: F.length(line) >= 4)
        lines = F.filter(F.transform(F.split(b, "\n"), trim_ws), lambda line: line != "")
        return _new_lines(known, F.transform(lines, comparable_text), lines)

    a, b = normalize_ws(F.coalesce(col(native), F.lit(""))), normalize_ws(F.coalesce(col(ocr), F.lit("")))
    covered = F.contains(comparable_text(a), comparable_text(b))
    extra = new_lines(a, b)
    return (
        F.when((b == "") & (a == ""), result(a, "ocr"))
        .when(b == "", result(a, "native"))
        .when(a == "", result(b, "ocr"))
        .when(covered, result(a, "native"))
        .when(F.size(extra) > 0, result(F.concat(a, F.lit("\n\n"), F.array_join(extra, "\n")), "mixed"))
        .otherwise(result(a, "native"))
    )


def apply_ocr(pages: DataFrame, ocr: DataFrame, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Merge OCR results into pages; second result: documents with OCR for unknown pages.

    ``pages``: doc_id, number, text.  ``ocr``: doc_id, mode, number, text, confidence.
    """
    read = ocr.select(
        "doc_id", "number", "mode", F.col("confidence").alias("ocr_confidence"), F.col("text").alias("_ocr"),
    )
    weak = (F.col("mode") == "auto") & (F.col("ocr_confidence") < cfg.ocr_min_confidence)
    joined = pages.join(read, ["doc_id", "number"], "left")
    merged = joined.withColumn("_merged", merge_native_ocr("text", F.when(weak, F.lit("")).otherwise(F.col("_ocr"))))
    has_ocr = F.col("mode").isNotNull()
    out = merged.withColumn("text_origin", F.when(has_ocr, F.col("_merged.origin")).otherwise("native")).withColumn(
        "text", F.when(has_ocr, F.col("_merged.text")).otherwise(F.col("text"))
    ).drop("_merged", "_ocr", "mode")
    unknown = ocr.join(pages.select("doc_id", "number"), ["doc_id", "number"], "left_anti")
    errors = unknown.select("doc_id").distinct().withColumn("error_code", F.lit("OCR_PAGE_MISMATCH"))
    return out, errors


def ocr_summary(pages: DataFrame) -> DataFrame:
    """One row per document. ``pages``: doc_id, number, confidence, duration_ms, status."""
    good = F.col("status") == "success"
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_pages"), F.count_if(good).alias("successful_pages"),
        F.count_if(~good).alias("failed_pages"),
        F.round(F.avg(F.when(good, F.col("confidence"))), 1).alias("average_confidence"),
        F.sum("duration_ms").alias("duration_ms"),
        # A document has at most 120 pages.
        F.sort_array(F.collect_list(F.when(~good, F.col("number")))).alias("failed_page_numbers"),
    )


def ocr_failure_check(pages: DataFrame, native: DataFrame) -> DataFrame:
    """Whether the OCR run of a document has to be repeated.

    ``pages``: doc_id, mode, number, status (a document without results has one row without number).
    """
    failed = F.count_if(F.col("status") == "failed")
    counts = pages.groupBy("doc_id", "mode").agg(F.count("number").alias("pages"), failed.alias("failed"))
    texts = native.groupBy("doc_id").agg(F.max(is_meaningful("text")).alias("meaningful"))
    all_failed = F.col("failed") == F.col("pages")
    many = (F.col("failed") > 0) & ((F.col("pages") <= 10) | (F.col("failed") / F.col("pages") > 0.1))
    return counts.join(texts, "doc_id", "left").withColumn(
        "must_retry",
        F.when(F.col("mode") == "force", all_failed | many)
        .when(F.col("mode") == "auto", (F.col("pages") > 0) & all_failed & ~F.coalesce("meaningful", F.lit(False)))
        .otherwise(False),
    )


def auto_ocr_pages(pages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """K8: pages that need OCR: all in force mode, those with little text in auto mode."""
    little = F.length("text") < cfg.auto_ocr_chars
    return pages.filter((F.col("mode") == "force") | ((F.col("mode") == "auto") & little))
