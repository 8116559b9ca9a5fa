"""S3: OCR manifests from JSON, with an error code instead of an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidar.config import DEFAULT, Config
from evidar.functions.expr import clamp, cut, first_match, half_up, let, safe_number
from evidar.functions.text import normalize_ws
from evidar.session import saved

# Fixed values.
MODES, SOURCE_TYPES, ENGINE, VERSION = ["none", "auto", "force"], ["pdf", "pptx"], "tesseract.js", 4
IMAGE_URL = "(?i)^data:image/(?:jpeg|png|webp);base64,[a-z0-9+/=]+$"
MANIFEST_JSON = (
    "version STRING, engine STRING, mode STRING, sourceType STRING, inspectedPageCount STRING, languages ARRAY<STRING>, "
    "pages ARRAY<STRUCT<number STRING, text STRING, confidence STRING, durationMs STRING, status STRING>>, "
    "nativePages ARRAY<STRUCT<number STRING, text STRING>>, "
    "visuals ARRAY<STRUCT<id STRING, number STRING, kind STRING, imageDataUrl STRING, "
    "crop STRUCT<x STRING, y STRING, width STRING, height STRING>, score STRING, nativeTextLength STRING>>"
)


def _whole(c: Column, cfg: Config) -> Column:
    """Integer page number in range, NULL otherwise."""
    return let(safe_number(c), lambda v: F.when((v == F.floor(v)) & v.between(1, cfg.ocr_max_pages or 2**31 - 1), v.cast("int")))


def _above(size: Column, limit: int | None) -> Column:
    return F.lit(False) if limit is None else size > limit


def _first_problem(entries: Column, bad_number: str, too_large: str, cfg: Config) -> Column:
    """First problem along the pages: a bad or repeated number, or too much text so far."""

    def step(state: Column, e: Column) -> Column:
        total = state["total"] + F.length(e["text"])
        code = first_match([
            (state["code"] != "", state["code"]),
            (e["number"].isNull() | F.array_contains(state["seen"], F.coalesce(e["number"], F.lit(-1))), bad_number),
            (_above(total, cfg.ocr_total_chars), too_large),
        ], "")
        return F.struct(F.array_append(state["seen"], F.coalesce(e["number"], F.lit(-1))).alias("seen"), total.alias("total"), code.alias("code"))

    begin = F.struct(F.array().cast("array<int>").alias("seen"), F.lit(0).alias("total"), F.lit("").alias("code"))
    return F.aggregate(entries, begin, step, lambda s: F.nullif(s["code"], F.lit("")))


def read_manifests(
    df: DataFrame, json_col: str = "json", mode_col: str = "requested_mode", cfg: Config = DEFAULT
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pages, native pages, visuals and errors of OCR manifests, one JSON text per document (``doc_id``)."""
    raw = F.col(json_col)
    mode = F.when(F.col(mode_col).isin(MODES), F.col(mode_col)).otherwise("none")
    base = df.select("doc_id", mode.alias("_mode"), raw.alias("_raw"), F.from_json(raw, MANIFEST_JSON).alias("m")).filter(
        "NOT (_raw IS NULL AND _mode = 'none')")
    m = F.col("m")

    def page(p: Column) -> Column:
        return F.struct(
            _whole(p["number"], cfg).alias("number"),
            cut(normalize_ws(F.coalesce(p["text"], F.lit(""))), cfg.ocr_page_chars).alias("text"),
            F.coalesce(clamp(safe_number(p["confidence"]), 0.0, 100.0), F.lit(0.0)).alias("confidence"),
            F.coalesce(clamp(safe_number(p["durationMs"]), 0.0, 300_000.0), F.lit(0.0)).alias("duration_ms"),
            F.when(p["status"] == "failed", "failed").otherwise("success").alias("status"))

    def native(p: Column) -> Column:
        return F.struct(_whole(p["number"], cfg).alias("number"),
                        cut(normalize_ws(F.coalesce(p["text"], F.lit(""))), cfg.ocr_page_chars).alias("text"))

    def coordinate(c: Column) -> Column:
        return clamp(half_up(F.coalesce(safe_number(c), F.lit(0.0))), 0, 20_000).cast("int")

    def visual(v: Column) -> Column:
        url = F.coalesce(v["imageDataUrl"], F.lit(""))
        number = _whole(v["number"], cfg)
        return F.struct(
            F.substring(F.regexp_replace(F.coalesce(v["id"], F.concat(F.lit("visual-"), v["number"])), "[^A-Za-z0-9_-]", ""), 1, 80).alias("id"),
            number.alias("number"), F.when(v["kind"] == "slide", "slide").otherwise("page").alias("kind"), url.alias("image_url"),
            coordinate(v["crop"]["x"]).alias("x"), coordinate(v["crop"]["y"]).alias("y"),
            F.greatest(coordinate(v["crop"]["width"]), F.lit(1)).alias("width"), F.greatest(coordinate(v["crop"]["height"]), F.lit(1)).alias("height"),
            clamp(F.coalesce(safe_number(v["score"]), F.lit(0.0)), 0.0, 1.0).alias("score"),
            clamp(F.coalesce(safe_number(v["nativeTextLength"]), F.lit(0.0)), 0.0, 50_000.0).alias("native_text_length"),
            (number.isNotNull() & url.rlike(IMAGE_URL) & (F.length(url) <= cfg.ocr_max_visual_url)).alias("valid"))

    none = F.lit("none")
    shown = F.coalesce(m["visuals"], F.array())
    shown = shown if cfg.ocr_max_visuals is None else F.slice(shown, 1, cfg.ocr_max_visuals)
    base = base.select(
        "doc_id", "_mode", "_raw", "m", F.transform(m["pages"], page).alias("_pages"),
        F.transform(F.coalesce(m["nativePages"], F.array()), native).alias("_native"),
        F.when(m["mode"] == none, F.array()).otherwise(
            F.transform(shown, visual)).alias("_visuals"))
    contiguous = lambda c: F.array_sort(F.transform(c, lambda e: e["number"])) == F.when(
        F.size(c) > 0, F.sequence(F.lit(1), F.size(c))).otherwise(F.array().cast("array<int>"))
    n_pages, n_native = F.size("_pages"), F.size("_native")
    known = (
        F.coalesce(m["version"] == str(VERSION), F.lit(False)) & F.coalesce(m["engine"] == ENGINE, F.lit(False))
        & F.coalesce(m["sourceType"].isin(SOURCE_TYPES), F.lit(False)) & F.coalesce(m["mode"].isin(MODES), F.lit(False)) & m["pages"].isNotNull()
    )
    complete = (n_pages == n_native) & (n_pages == F.coalesce(safe_number(m["inspectedPageCount"]), F.lit(-1.0))) & contiguous(F.col("_pages")) & contiguous(F.col("_native"))
    counts = _above(n_pages, cfg.ocr_max_pages) | ((m["mode"] == "force") & (n_pages == 0)) | ((m["mode"] == none) & (n_pages > 0))
    early = first_match([
        (_above(F.octet_length("_raw"), cfg.ocr_max_manifest_bytes), "OCR_MANIFEST_TOO_LARGE"),
        (F.col("_raw").isNotNull() & F.try_parse_json("_raw").isNull(), "INVALID_OCR_MANIFEST"),
        (~known, "OCR_MANIFEST_REQUIRED"),
        (m["mode"] != F.col("_mode"), "OCR_MODE_MISMATCH"),
        (counts, "INVALID_OCR_PAGE_COUNT"),
    ])
    checked = base.withColumn("error_code", F.coalesce(
        early,
        _first_problem(F.col("_pages"), "INVALID_OCR_PAGE", "OCR_TEXT_TOO_LARGE", cfg),
        _first_problem(F.col("_native"), "INVALID_NATIVE_PAGE", "NATIVE_TEXT_TOO_LARGE", cfg),
        F.when((m["mode"] == "force") & ~complete, "INCOMPLETE_FULL_PAGE_OCR"),
        F.when(F.exists("_visuals", lambda v: ~v["valid"]), "INVALID_VISUAL_CANDIDATE"),
    ))
    # Parsed once for the four results below.
    checked = saved(
        checked.select("doc_id", "_mode", m["mode"].alias("mode"), m["sourceType"].alias("source_type"), "_pages", "_native", "_visuals", "error_code"),
        "manifests",
    )
    good = checked.filter("error_code IS NULL")
    errors = checked.filter("error_code IS NOT NULL").select("doc_id", "error_code")
    pages = good.select("doc_id", F.col("_mode").alias("mode"), F.inline("_pages"))
    natives = good.select("doc_id", F.when(F.col("source_type") == "pptx", "slide").otherwise("page").alias("type"), F.inline("_native"))
    visuals = good.select("doc_id", F.inline("_visuals")).drop("valid")
    return pages, natives, visuals, errors
