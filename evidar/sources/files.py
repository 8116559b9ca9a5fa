"""Readers and writers: files, event logs, datasets, reports, tables of assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidar.config import DEFAULT, Config
from evidar.functions.expr import first_match
from evidar.functions.records import file_extension, file_reject_code, fingerprint

EVENT_LOG = (
    "eventId STRING, clientEventId STRING, sequence BIGINT, studyId STRING, condition STRING, stratum STRING, type STRING, "
    "serverTimestamp TIMESTAMP, clientTimestamp TIMESTAMP, elapsedMs BIGINT, data STRING"
)
EVAL_DATASET = (
    "name STRING, priorities MAP<STRING, DOUBLE>, documents ARRAY<STRUCT<id STRING, chunks ARRAY<STRUCT<id STRING, fileName STRING, kind STRING, "
    "number INT, label STRING, title STRING, contentType STRING, textOrigin STRING, ocrConfidence DOUBLE, evidenceWeight DOUBLE, text STRING>>>>, "
    "cases ARRAY<STRUCT<id STRING, documentId STRING, category STRING, mode STRING, question STRING, relevantChunkIds ARRAY<STRING>, shouldRefuse BOOLEAN>>, "
    "ocrSamples ARRAY<STRUCT<id STRING, expected STRING, actual STRING>>"
)


# MIME type by extension; any other extension is of unknown type.
MIME_OF = {
    "pdf": "application/pdf",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}


def read_files(spark: SparkSession, path: str, cfg: Config = DEFAULT) -> DataFrame:
    """Files of a folder with name, size, MIME type and content. Content above the size that ``intake`` takes is not read: NULL."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= cfg.max_file_bytes)
    large = files.where(F.col("length") > cfg.max_file_bytes).withColumn("content", F.lit(None).cast("binary"))
    name = F.element_at(F.split("path", "/"), -1)
    mime = first_match(((file_extension(name) == e, m) for e, m in MIME_OF.items()), "application/octet-stream")
    return small.unionByName(large).select(name.alias("name"), F.col("length").alias("size"), mime.alias("mime_type"), "content", "path")


def intake(files: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Extension, reject code and fingerprint of every file."""
    code = file_reject_code(F.col("name"), F.col("size"), F.col("mime_type"), F.col("content"), cfg)
    return files.withColumn("extension", file_extension(F.col("name"))).withColumn("reject_code", code).withColumn(
        "fingerprint", fingerprint("content"))


def _log_columns(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("studyId").alias("study_id"), F.col("clientEventId").alias("client_event_id"), "sequence", "type", "condition", "stratum",
        F.col("serverTimestamp").alias("server_ts"), F.col("clientTimestamp").alias("client_ts"), F.col("elapsedMs").alias("elapsed_ms"), "data")


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; malformed lines are skipped."""
    return _log_columns(spark.read.schema(EVENT_LOG).option("mode", "DROPMALFORMED").json(path))


def read_event_stream(spark: SparkSession, path: str) -> DataFrame:
    """S4 as a stream of files."""
    return _log_columns(spark.readStream.schema(EVENT_LOG).option("mode", "DROPMALFORMED").json(path))


def write_event_log(events: DataFrame, path: str) -> None:
    """S5 as files: one folder of JSON lines per category."""
    events.write.mode("overwrite").partitionBy("category").json(path)


def write_summary_csv(summary: DataFrame, path: str) -> None:
    """Header and rows; quotes only where needed, doubled inside."""
    summary.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def experiment_csv_rows(events: DataFrame) -> DataFrame:
    """S7 columns, ordered by time. ``events``: event_id, ts, participant_id, session_id, condition, material_version, event, data."""
    utc = F.to_utc_timestamp("ts", F.current_timezone())
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    data = F.col("data") if dict(events.dtypes)["data"] == "string" else F.to_json("data")
    return events.orderBy("ts", "event_id").select(
        text("event_id").alias("event_id"), F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp_iso"), text("participant_id").alias("participant_id"),
        text("session_id").alias("session_id"), text("condition").alias("condition"), text("material_version").alias("material_version"),
        text("event").alias("event"), F.coalesce(data, F.lit("")).alias("data_json"))


def write_experiment_csv(events: DataFrame, path: str) -> None:
    """Every cell quoted."""
    experiment_csv_rows(events).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def read_eval(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """Chunks, cases, OCR samples and priorities of evaluation datasets: one in a file, or with ``lines`` one in a line."""
    raw = spark.read.schema(EVAL_DATASET).json(path, multiLine=not lines)
    docs = raw.select(F.explode("documents").alias("d"))
    chunks = docs.select(F.col("d.id").alias("collection_id"), F.posexplode("d.chunks").alias("chunk_ordinal", "c")).select(
        "collection_id", F.col("c.id").alias("chunk_id"), F.col("chunk_ordinal").cast("bigint").alias("chunk_ordinal"), F.col("c.fileName").alias("file_name"),
        "c.kind", "c.number", "c.label", "c.title", F.col("c.contentType").alias("content_type"), "c.text", F.col("c.textOrigin").alias("text_origin"),
        F.col("c.ocrConfidence").alias("ocr_confidence"), F.col("c.evidenceWeight").alias("evidence_weight"))
    cases = raw.select(F.explode("cases").alias("c")).select(
        F.col("c.id").alias("query_id"), F.col("c.documentId").alias("collection_id"), "c.category", "c.mode", F.col("c.question").alias("text"),
        F.col("c.relevantChunkIds").alias("relevant_ids"), F.coalesce("c.shouldRefuse", F.lit(False)).alias("should_refuse"))
    return {
        "chunks": chunks, "cases": cases, "ocr_samples": raw.select(F.inline("ocrSamples")),
        "priorities": raw.select(F.explode("priorities").alias("category", "weight")),
    }


def write_report(report: DataFrame, path: str) -> None:
    """Report rows as JSON lines."""
    report.write.mode("overwrite").json(path)


def asset_audit(expected: DataFrame, observed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Status of every expected asset, and one row of overall readiness.

    ``expected``: path, sha256, metadata.  ``observed``: path, sha256, size, metadata.
    """
    seen = observed.select("path", F.col("sha256").alias("_sha"), "size", F.col("metadata").alias("_meta"))
    joined = expected.join(seen, "path", "left")
    status = (
        F.when(F.col("_sha").isNull() | (F.col("size") == 0), "missing")
        .when(F.lower("sha256") != F.lower("_sha"), "changed")
        .when(~F.col("metadata").eqNullSafe(F.col("_meta")), "metadata_mismatch")
        .otherwise("ok")
    )
    checked = joined.withColumn("status", status).drop("_sha", "_meta")
    ready = checked.agg(
        F.coalesce(F.bool_and(F.col("status") == "ok"), F.lit(True)).alias("ready"), F.count_if(F.col("status") == "missing").alias("missing"),
        F.count_if(F.col("status") == "changed").alias("changed"), F.count_if(F.col("status") == "metadata_mismatch").alias("mismatched"))
    return checked, ready
