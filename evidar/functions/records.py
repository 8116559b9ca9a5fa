"""Validation and small record scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidar.config import DEFAULT, PHASES, Config
from evidar.functions.expr import clamp, col, first_match, half_up

# Fixed values.
STUDY_ID = r"^APTT-\d{3}$"
EVENT_TYPE = "^[a-z][a-z0-9_:-]{0,79}$"
CONDITIONS = ["A", "B", "C", "D"]
STRATA = ["novice", "experienced"]
FINALIZE_REASONS = ["time_limit", "early_completion", "researcher_stop", "technical_failure", "participant_withdrawal"]
EXTENSIONS = ["pdf", "pptx"]
MIME_TYPES = [
    "application/pdf", "application/vnd.openxmlformats-officedocument.presentationml.presentation", "application/octet-stream", "",
]
MAGIC = {"pdf": b"%PDF-", "pptx": b"PK"}
PROMPT_VERSION, DEFAULT_MODEL = "rq1-grounding-v1", "qwen-plus"


def session_error(study_id: Column | str, condition: Column | str, stratum: Column | str) -> Column:
    """P31 for session fields: first failing check, NULL when all hold."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    return first_match([
        (~ok(F.trim(study_id).rlike(STUDY_ID)), "INVALID_STUDY_ID"),
        (~ok(F.upper(F.trim(condition)).isin(CONDITIONS)), "INVALID_CONDITION"),
        (~ok(F.lower(F.trim(stratum)).isin(STRATA)), "INVALID_STRATUM"),
    ])


def event_error(kind: Column | str) -> Column:
    """P31 for event types."""
    return F.when(~F.coalesce(F.lower(F.trim(kind)).rlike(EVENT_TYPE), F.lit(False)), "INVALID_EVENT_TYPE")


def finalize_reason(reason: Column | str) -> Column:
    """Reason with its default; NULL when it is not supported."""
    given = F.lower(F.trim(reason))
    return F.when(col(reason).isNull(), "time_limit").when(given.isin(FINALIZE_REASONS), given)


def file_reject_code(name: Column, size: Column, mime: Column, content: Column, cfg: Config = DEFAULT) -> Column:
    """First reason to reject a file, NULL when it is accepted."""
    extension = file_extension(name)
    signature = first_match(((extension == e, F.substring(content, 1, len(m)) == F.lit(m)) for e, m in MAGIC.items()), False)
    return first_match([
        (F.coalesce(size, F.lit(0)) == 0, "FILE_REQUIRED"),
        (~extension.isin(EXTENSIONS), "UNSUPPORTED_FORMAT"),
        (~F.coalesce(mime, F.lit("")).isin(MIME_TYPES), "MIME_TYPE_MISMATCH"),
        (size > cfg.max_file_bytes, "FILE_TOO_LARGE"),
        (~signature, "INVALID_FILE_SIGNATURE"),
    ])


def file_extension(name: Column) -> Column:
    return F.substring_index(F.lower(name), ".", -1)


def fingerprint(content: Column | str) -> Column:
    """SHA-256 of the bytes, as hex."""
    return F.sha2(col(content), 256)


def phase_progress(phase: Column | str, current: Column | str, total: Column | str) -> Column:
    """Percent done from the phase and the position inside it."""
    start = first_match(((col(phase) == p, float(a)) for p, (a, _) in PHASES.items()), 0.0)
    end = first_match(((col(phase) == p, float(b)) for p, (_, b) in PHASES.items()), 0.0)
    ratio = F.when(col(total) > 0, clamp(col(current) / col(total), 0.0, 1.0)).otherwise(F.lit(0.0))
    return half_up(start + (end - start) * ratio).cast("int")


def estimate_remaining(started_ms: Column | str, progress: Column | str, now_ms: Column | str) -> Column:
    """Expected remaining milliseconds; NULL near the start and at the end."""
    elapsed = F.greatest(col(now_ms) - col(started_ms), F.lit(0))
    return F.when((col(progress) >= 3) & (col(progress) < 100), half_up(elapsed * (100 - col(progress)) / col(progress)))


def experiment_versions(condition: Column | str, material: Column | str, model: str = DEFAULT_MODEL) -> list[Column]:
    """Version columns of generated rows."""
    known = F.when(col(condition).isin("full_evidence", "baseline"), col(condition)).otherwise("full_evidence")
    return [
        F.lit(PROMPT_VERSION).alias("prompt_version"), F.lit(model).alias("model_version"),
        col(material).alias("material_version"), known.alias("condition"),
    ]
