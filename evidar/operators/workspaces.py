"""Stored documents, workspaces, jobs and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidar.config import DEFAULT, Config
from evidar.functions.expr import safe_number
from evidar.operators.ranking import top_k

MODES = ["none", "auto", "force"]
CHECKPOINT_JSON = (
    "id STRING, name STRING, indexVersion STRING, ocr STRUCT<mode STRING, totalPageCount STRING, successfulPageCount STRING, "
    "failedPageCount STRING, inspectedPageCount STRING>, chunks ARRAY<STRUCT<id STRING, text STRING, number STRING>>"
)
# Fixed values.
STAGES = ["parsed", "vision"]


def list_workspaces(workspaces: DataFrame) -> DataFrame:
    """Summaries, newest first."""
    return workspaces.select("workspace_id", "fingerprint", "name", "index_version", "ocr_mode", "mastery", "message_count", "saved_at").orderBy(
        F.col("saved_at").desc(), "workspace_id")


def list_jobs(jobs: DataFrame) -> DataFrame:
    """Processing jobs, newest first."""
    return jobs.orderBy(F.col("updated_at").desc(), "job_id")


def reuse_index(files: DataFrame, cache: DataFrame, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Files whose current index is cached, and the files still to do.

    ``files``: file_id, fingerprint, ocr_mode.  ``cache``: fingerprint, ocr_mode, index_version.
    """
    current = cache.filter(F.col("index_version") == cfg.index_version).select("fingerprint", "ocr_mode")
    keys = ["fingerprint", "ocr_mode"]
    return files.join(current, keys, "left_semi"), files.join(current, keys, "left_anti")


def memo_misses(keys: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cached rows per key (certified before newer), and the keys to compute.

    ``cache``: cache_key, certified, created_at, answer.
    """
    order = [F.col("certified").desc(), F.col("created_at").desc(), F.col("answer")]
    best = top_k(cache, ["cache_key"], order, 1, "_n").drop("_n")
    wanted = keys.select("cache_key").distinct()
    return best.join(wanted, "cache_key", "left_semi"), wanted.join(cache.select("cache_key"), "cache_key", "left_anti")


def orphans(documents: DataFrame, workspaces: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cached documents without a workspace, and the jobs of these documents."""
    unused = documents.join(workspaces.select("fingerprint"), "fingerprint", "left_anti")
    return unused, jobs.join(unused.select("fingerprint"), "fingerprint", "left_semi")


def validate_checkpoint(rows: DataFrame, cfg: Config = DEFAULT, max_bytes: int | None = None, max_text: int | None = None) -> DataFrame:
    """V1: error code of stored checkpoints. ``rows``: stage, json. Numbers of pages and chunks, texts and sizes are limited only as ``cfg`` and
    the parameters say.
    """
    def at_most(value, limit):
        return F.lit(True) if limit is None else value <= limit

    c = F.from_json("json", CHECKPOINT_JSON)
    rows = rows.withColumn("_c", c)
    whole = lambda name, low: F.coalesce(
        (safe_number(F.col(f"_c.ocr.{name}")) == F.floor(safe_number(F.col(f"_c.ocr.{name}")))) & (safe_number(F.col(f"_c.ocr.{name}")) >= low), F.lit(False))
    value = lambda name: safe_number(F.col(f"_c.ocr.{name}"))
    summary = (
        whole("totalPageCount", 1) & at_most(value("totalPageCount"), cfg.max_sections) & whole("successfulPageCount", 0) & whole("failedPageCount", 0)
        & (value("successfulPageCount") + value("failedPageCount") == value("totalPageCount")) & (value("inspectedPageCount") == value("totalPageCount"))
    )
    number = lambda k: k["number"].try_cast("double")
    chunk_ok = lambda k: F.coalesce(
        k["id"].isNotNull() & k["text"].isNotNull() & at_most(F.length(k["text"]), max_text)
        & (number(k) == F.floor(number(k))) & (number(k) >= 1) & at_most(number(k), cfg.max_sections), F.lit(False))
    valid = (
        F.col("stage").isin(STAGES) & at_most(F.octet_length("json"), max_bytes) & (F.col("_c.indexVersion") == str(cfg.index_version))
        & (F.col("_c.ocr.mode") == "force") & summary & F.col("_c.id").isNotNull() & F.col("_c.name").isNotNull()
        & at_most(F.size("_c.chunks"), cfg.max_chunks) & F.forall("_c.chunks", chunk_ok)
    )
    code = F.when(F.col("json").isNull(), None).when(~F.coalesce(valid, F.lit(False)), "INVALID_CHECKPOINT")
    return rows.withColumn("error_code", code).drop("_c")


def is_current(version, mode, total, good, failed, inspected, cfg: Config = DEFAULT):
    """V2 as a column: the stored index can still be used."""
    complete = (total >= 1) & (good + failed == total) & (inspected == total)
    return F.coalesce((version == cfg.index_version) & mode.isin(MODES) & ((mode != "force") | complete), F.lit(False))


def stale_indexes(documents: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """V2: documents whose index has to be rebuilt."""
    fresh = is_current(*[F.col(c) for c in ("index_version", "ocr_mode", "total_pages", "successful_pages", "failed_pages", "inspected_pages")], cfg=cfg)
    return documents.filter(~fresh)


def triage_jobs(jobs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """V3: which jobs are compatible, and the one to resume per owner.

    ``jobs``: owner, job_id, status, updated_at, ocr_mode, manifest_version, manifest_mode, checkpoint_current.
    """
    manifest = F.col("manifest_version").isNull() | ((F.col("manifest_version") == 4) & F.coalesce(F.col("manifest_mode") == F.col("ocr_mode"), F.lit(False)))
    compatible = F.coalesce(F.col("ocr_mode").isin(MODES) & manifest & F.coalesce("checkpoint_current", F.lit(True)), F.lit(False))
    tagged = jobs.withColumn("compatible", compatible)
    order = [(F.col("status") == "failed").cast("int"), F.col("updated_at").desc(), F.col("job_id")]
    pick = top_k(tagged.filter("compatible"), ["owner"], order, 1, "_n").select("owner", "job_id", F.lit(True).alias("resume"))
    return tagged.join(pick, ["owner", "job_id"], "left").withColumn("resume", F.coalesce("resume", F.lit(False))).withColumn(
        "restored_status", F.when(F.col("resume") & (F.col("status") == "processing"), "paused").otherwise(F.col("status")))
