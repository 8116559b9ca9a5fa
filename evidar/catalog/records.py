"""Registered queries: files, caches, jobs, validation and small scalars."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from evidar.catalog.common import norm, tables
from evidar.config import DEFAULT, PHASES
from evidar.functions import records as R
from evidar.functions import text as T
from evidar.functions.terms import content_key
from evidar.operators import hooks, ranking, visuals
from evidar.operators import workspaces as W
from evidar.sources import files as S
from evidar.sources.manifests import read_manifests

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def pick(names, number):
    return F.element_at(F.array(*map(F.lit, names)), (number + 1).cast("int"))


# ---- files ---------------------------------------------------------------------
def intake(t):
    k = F.col("page_id")
    files = t("pages").select(
        F.concat(F.lit("File"), k.cast("string"), pick([".pdf", ".PPTX", ".txt", ".Pdf"], k % 4)).alias("name"),
        pick(["", "application/pdf", "text/html"], k % 3).alias("mime_type"),
        F.when(k % 10 == 0, F.lit("")).when(k % 5 < 2, F.concat(F.lit("%PDF-"), "html")).when(k % 5 == 2, F.concat(F.lit("PK"), "html"))
        .otherwise(F.col("html")).cast("binary").alias("content"))
    return S.intake(files.withColumn("size", F.octet_length("content"))).select("name", "extension", "reject_code", "fingerprint")


QUERIES["intake"] = tables(intake)
ORACLES["intake"] = """
WITH f AS (SELECT 'File' || page_id || ['.pdf', '.PPTX', '.txt', '.Pdf'][page_id % 4 + 1] AS name, ['pdf', 'pptx', 'txt', 'pdf'][page_id % 4 + 1] AS extension,
  ['', 'application/pdf', 'text/html'][page_id % 3 + 1] AS mime, CASE WHEN page_id % 10 = 0 THEN '' WHEN page_id % 5 < 2 THEN '%PDF-' || html WHEN page_id % 5 = 2 THEN 'PK' || html ELSE html END AS body FROM pages)
SELECT name, extension, CASE WHEN body = '' THEN 'FILE_REQUIRED' WHEN extension = 'txt' THEN 'UNSUPPORTED_FORMAT' WHEN mime = 'text/html' THEN 'MIME_TYPE_MISMATCH'
  WHEN strlen(body) > 20971520 THEN 'FILE_TOO_LARGE' WHEN NOT starts_with(body, CASE extension WHEN 'pdf' THEN '%PDF-' ELSE 'PK' END) THEN 'INVALID_FILE_SIGNATURE' END AS reject_code, sha256(body) AS fingerprint FROM f
"""


def exact_duplicates(t):
    print_ = t("documents").select("doc_id", R.fingerprint("text").alias("fingerprint"))
    return print_.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))


QUERIES["fingerprint"] = tables(exact_duplicates)
ORACLES["fingerprint"] = "SELECT sha256(text) AS fingerprint, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY ALL"


def asset_audit(t):
    k = F.col("doc_id")
    docs = t("documents")
    expected = docs.select(k.cast("string").alias("path"), F.sha2("text", 256).alias("sha256"), F.col("lang").alias("metadata"))
    body = F.when(k % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    observed = docs.filter("doc_id % 10 <> 0").select(
        k.cast("string").alias("path"), F.upper(F.sha2(body, 256)).alias("sha256"), F.length("text").alias("size"),
        F.when(k % 8 == 0, "xx").otherwise(F.col("lang")).alias("metadata"))
    checked, ready = S.asset_audit(expected, observed)
    counts = checked.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(ready.select(F.concat(F.lit("ready="), F.col("ready").cast("string")).alias("status"), F.col("missing").alias("n")))


QUERIES["asset_audit"] = tables(asset_audit)
ORACLES["asset_audit"] = """
WITH s AS (SELECT CASE WHEN doc_id % 10 = 0 OR length(text) = 0 THEN 'missing' WHEN doc_id % 9 = 0 THEN 'changed' WHEN doc_id % 8 = 0 THEN 'metadata_mismatch' ELSE 'ok' END AS status FROM documents)
SELECT status, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT 'ready=' || bool_and(status = 'ok'), count(*) FILTER (status = 'missing') FROM s
"""


def _manifests(t):
    """One manifest per conversation: turns as OCR pages and as native pages."""
    page = F.struct(
        F.col("turn").cast("int").alias("n"), F.struct((F.col("turn") + 1).alias("number"), F.concat("text", F.lit("\r\n scan")).alias("text"), (F.col("turn") * 40 - 20).alias("confidence"),
                                                      F.lit(-1).alias("durationMs"), F.when(F.col("role") == "system", "failed").otherwise("ok").alias("status")).alias("ocr"),
        F.struct((F.col("turn") + 1).alias("number"), F.col("text")).alias("native"))
    rows = t("conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list(page)).alias("p"))
    k = F.col("doc_id")
    mode = F.when(k % 2 == 0, "force").otherwise("auto")
    body = F.struct(
        F.when(k % 11 == 3, 3).otherwise(4).alias("version"), F.lit("tesseract.js").alias("engine"), F.lit("pdf").alias("sourceType"), mode.alias("mode"),
        F.when(k % 6 == 4, 0).otherwise(F.size("p")).alias("inspectedPageCount"), F.col("p.ocr").alias("pages"),
        F.when(k % 7 == 5, F.concat("p.native", F.slice("p.native", 1, 1))).otherwise(F.col("p.native")).alias("nativePages"))
    text = F.to_json(body)
    return rows.select("doc_id", F.lit("talk.pdf").alias("file_name"), F.when(k % 13 == 6, F.substring(text, F.lit(1), F.length(text) - 3)).otherwise(text).alias("json"),
                       F.when(k % 17 == 7, "none").otherwise(mode).alias("requested_mode"))


def manifests(t):
    pages, natives, _, errors = read_manifests(_manifests(t))
    return pages.select("doc_id", F.lit("page").alias("part"), "number", F.col("mode").alias("note"), "confidence", F.md5("text").alias("digest")).unionByName(
        natives.select("doc_id", F.lit("native").alias("part"), "number", F.col("type").alias("note"), F.lit(None).cast("double").alias("confidence"), F.md5("text").alias("digest"))
    ).unionByName(errors.select("doc_id", F.lit("error").alias("part"), F.lit(None).cast("int").alias("number"), F.col("error_code").alias("note"),
                                F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("digest")))


QUERIES["read_manifests"] = tables(manifests)
ORACLES["read_manifests"] = f"""
WITH d AS (SELECT DISTINCT conv_id AS k, CASE WHEN conv_id % 2 = 0 THEN 'force' ELSE 'auto' END AS mode FROM conversations),
z AS (SELECT *, CASE WHEN k % 13 = 6 THEN 'INVALID_OCR_MANIFEST' WHEN k % 11 = 3 THEN 'OCR_MANIFEST_REQUIRED' WHEN k % 17 = 7 THEN 'OCR_MODE_MISMATCH'
  WHEN k % 7 = 5 THEN 'INVALID_NATIVE_PAGE' WHEN mode = 'force' AND k % 6 = 4 THEN 'INCOMPLETE_FULL_PAGE_OCR' END AS err FROM d),
p AS (SELECT z.*, turn, text FROM z JOIN conversations ON conv_id = k WHERE err IS NULL)
SELECT k AS doc_id, 'page' AS part, (turn + 1)::INTEGER AS number, mode AS note, least(greatest(turn * 40 - 20, 0), 100)::DOUBLE AS confidence, md5({norm('text')} || chr(10) || 'scan') AS digest FROM p
UNION ALL SELECT k, 'native', (turn + 1)::INTEGER, 'page', NULL, md5({norm('text')}) FROM p
UNION ALL SELECT k, 'error', NULL, err, NULL, NULL FROM z WHERE err IS NOT NULL
"""


def index_manifests(t):
    from evidar.plans.indexing import index_manifests as plan

    chunks = plan(_manifests(t))["chunks"]
    return chunks.select("collection_id", "chunk_id", F.col("chunk_ordinal"), "content_type", "text_origin", F.md5("text").alias("digest"))


QUERIES["index_manifests"] = tables(index_manifests)


# ---- caches, workspaces, jobs ----------------------------------------------------
def _doc_files(t):
    return t("documents").select(
        F.col("doc_id").alias("file_id"), R.fingerprint("text").alias("fingerprint"), pick(["none", "auto", "force"], F.col("doc_id") % 3).alias("ocr_mode"))


def reuse_index(t):
    files = _doc_files(t)
    cache = files.join(t("labels").select(F.col("doc_id").alias("file_id"), "quality"), "file_id").select(
        "fingerprint", "ocr_mode", (F.col("quality") + 4).alias("index_version"))
    reused, todo = W.reuse_index(files, cache)
    return reused.select("file_id", F.lit("reused").alias("part")).unionByName(todo.select("file_id", F.lit("todo").alias("part")))


QUERIES["reuse_index"] = tables(reuse_index)
ORACLES["reuse_index"] = """
WITH f AS (SELECT doc_id, sha256(text) AS fp, doc_id % 3 AS m FROM documents), c AS (SELECT DISTINCT fp, m FROM f JOIN labels USING (doc_id) WHERE quality = 1)
SELECT doc_id AS file_id, CASE WHEN c.fp IS NULL THEN 'todo' ELSE 'reused' END AS part FROM f LEFT JOIN c USING (fp, m)
"""


def memo_misses(t):
    keys = t("orders").select(F.col("o_orderkey").cast("string").alias("cache_key"))
    cache = t("lineitem").select(
        F.col("l_orderkey").cast("string").alias("cache_key"), (F.col("l_returnflag") == "R").alias("certified"), F.col("l_linenumber").alias("created_at"),
        F.col("l_partkey").alias("answer"))
    hits, misses = W.memo_misses(keys, cache)
    return hits.select("cache_key", "certified", "created_at").unionByName(misses.select("cache_key", F.lit(None).cast("boolean").alias("certified"), F.lit(None).cast("int").alias("created_at")))


QUERIES["memo_misses"] = tables(memo_misses)
ORACLES["memo_misses"] = """
WITH c AS (SELECT l_orderkey, l_returnflag = 'R' AS certified, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R') DESC, l_linenumber DESC) = 1)
SELECT o_orderkey::VARCHAR AS cache_key, certified, l_linenumber AS created_at FROM orders LEFT JOIN c ON l_orderkey = o_orderkey
"""


def orphans(t):
    documents = t("customer").select(F.col("c_custkey").alias("fingerprint"))
    workspaces = t("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("fingerprint"))
    jobs = t("orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("fingerprint"))
    unused, gone = W.orphans(documents, workspaces, jobs)
    return unused.select(F.lit("document").alias("part"), F.col("fingerprint").alias("id")).unionByName(gone.select(F.lit("job").alias("part"), F.col("job_id").alias("id")))


QUERIES["orphans"] = tables(orphans)
ORACLES["orphans"] = """
WITH u AS (SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'))
SELECT 'document' AS part, c_custkey AS id FROM u UNION ALL SELECT 'job', o_orderkey FROM orders JOIN u ON o_custkey = c_custkey
"""


def stale_indexes(t):
    k = F.col("o_orderkey")
    docs = t("orders").select(
        k.alias("doc_id"), (k % 3 + 4).cast("int").alias("index_version"), pick(["none", "auto", "force", "odd"], k % 4).alias("ocr_mode"), (k % 5).alias("total_pages"),
        (k % 5 - k % 2).alias("successful_pages"), (k % 2).alias("failed_pages"), (k % 5 + F.when(k % 7 == 0, 1).otherwise(0)).alias("inspected_pages"))
    return W.stale_indexes(docs).select("doc_id")


QUERIES["stale_indexes"] = tables(stale_indexes)
ORACLES["stale_indexes"] = """
SELECT o_orderkey AS doc_id FROM orders WHERE NOT (o_orderkey % 3 = 1 AND o_orderkey % 4 < 3 AND (o_orderkey % 4 <> 2 OR (o_orderkey % 5 >= 1 AND o_orderkey % 7 <> 0)))
"""


def triage_jobs(t):
    k = F.col("o_orderkey")
    jobs = t("orders").select(
        F.col("o_custkey").alias("owner"), k.alias("job_id"), pick(["processing", "failed", "paused"], k % 3).alias("status"), k.alias("updated_at"),
        pick(["none", "auto", "force", "odd"], k % 4).alias("ocr_mode"), F.when(k % 5 > 0, F.when(k % 5 == 1, 3).otherwise(4)).alias("manifest_version"),
        pick(["none", "auto", "force", "odd"], F.when(k % 6 == 0, (k + 1) % 4).otherwise(k % 4)).alias("manifest_mode"), F.when(k % 2 == 0, k % 10 != 0).alias("checkpoint_current"))
    return W.triage_jobs(jobs).select("job_id", "compatible", "resume", "restored_status")


QUERIES["triage_jobs"] = tables(triage_jobs)
ORACLES["triage_jobs"] = """
WITH j AS (SELECT o_custkey AS owner, o_orderkey AS k, ['processing', 'failed', 'paused'][o_orderkey % 3 + 1] AS status,
  o_orderkey % 4 < 3 AND (o_orderkey % 5 = 0 OR (o_orderkey % 5 <> 1 AND o_orderkey % 6 <> 0)) AND (o_orderkey % 2 = 1 OR o_orderkey % 10 <> 0) AS ok FROM orders),
r AS (SELECT k FROM j WHERE ok QUALIFY row_number() OVER (PARTITION BY owner ORDER BY (status = 'failed')::INTEGER, k DESC) = 1)
SELECT j.k AS job_id, ok AS compatible, r.k IS NOT NULL AS resume, CASE WHEN r.k IS NOT NULL AND status = 'processing' THEN 'paused' ELSE status END AS restored_status FROM j LEFT JOIN r ON r.k = j.k
"""


def validate_checkpoint(t):
    k = F.col("o_orderkey")
    body = F.struct(
        F.lit("d").alias("id"), F.lit("n").alias("name"), F.when(k % 7 == 0, 4).otherwise(5).alias("indexVersion"),
        F.struct(F.when(k % 5 == 0, "auto").otherwise("force").alias("mode"), F.lit(3).alias("totalPageCount"), F.lit(2).alias("successfulPageCount"),
                 F.when(k % 11 == 0, 2).otherwise(1).alias("failedPageCount"), F.lit(3).alias("inspectedPageCount")).alias("ocr"),
        F.array(F.struct(F.lit("c").alias("id"), F.lit("text").alias("text"), (k % 130).alias("number"))).alias("chunks"))
    rows = t("orders").select(k, pick(["parsed", "vision", "other"], k % 3).alias("stage"), F.to_json(body).alias("json"))
    return W.validate_checkpoint(rows, replace(DEFAULT, max_sections=120, max_chunks=256), 3 * 1024 * 1024, 20_000).select(F.col("o_orderkey").alias("id"), "error_code")


QUERIES["validate_checkpoint"] = tables(validate_checkpoint)
ORACLES["validate_checkpoint"] = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 3 = 2 OR NOT (o_orderkey % 130 BETWEEN 1 AND 120) THEN 'INVALID_CHECKPOINT' END AS error_code FROM orders
"""


def workspace_views(t):
    spaces = t("orders").select(
        F.col("o_orderkey").alias("workspace_id"), F.col("o_custkey").alias("fingerprint"), F.col("o_orderpriority").alias("name"), F.lit(5).alias("index_version"),
        F.lit("auto").alias("ocr_mode"), F.lit("learning").alias("mastery"), F.lit(1).alias("message_count"), F.col("o_totalprice").alias("saved_at"), F.lit("x").alias("chunks"))
    jobs = spaces.select(F.col("workspace_id").alias("job_id"), F.col("saved_at").alias("updated_at"))
    return W.list_workspaces(spaces).select("workspace_id", "name", "saved_at").unionByName(
        W.list_jobs(jobs).select(F.col("job_id").alias("workspace_id"), F.lit("job").alias("name"), F.col("updated_at").alias("saved_at")))


QUERIES["list_workspaces"] = tables(workspace_views)
ORACLES["list_workspaces"] = """
SELECT o_orderkey AS workspace_id, o_orderpriority AS name, o_totalprice AS saved_at FROM orders UNION ALL SELECT o_orderkey, 'job', o_totalprice FROM orders
"""


def experiment_csv(t):
    log = t("events").select(
        F.col("event_id"), "ts", F.col("user_id").alias("participant_id"), F.lit("s").alias("session_id"), F.lit("baseline").alias("condition"),
        F.lit("m").alias("material_version"), F.col("event_type").alias("event"), F.create_map(F.lit("value"), F.col("value").cast("string")).alias("data"))
    return S.experiment_csv_rows(log)


QUERIES["experiment_csv"] = tables(experiment_csv)
ORACLES["experiment_csv"] = """
SELECT event_id::VARCHAR AS event_id, strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp_iso, user_id::VARCHAR AS participant_id, 's' AS session_id,
  'baseline' AS condition, 'm' AS material_version, event_type AS event, '{"value":"' || value::VARCHAR || '"}' AS data_json FROM events
"""


# ---- scalars -----------------------------------------------------------------------
def redact_secrets(t):
    body = F.create_map(F.lit("apiKey"), F.col("value").cast("string"), F.lit("text"), F.concat(F.lit("key sk-"), F.sha2("props", 256), F.lit(" end")),
                        F.lit("note"), F.concat(F.lit("Bearer "), F.sha2("props", 256)), F.lit("Access-Token"), F.lit("x"),
                        F.lit("payload"), F.to_json(F.struct(F.struct(F.col("props").alias("apiKey"), F.col("event_type").alias("kind")).alias("deep"), F.array(F.struct(F.col("props").alias("password"))).alias("list"))))
    log = t("events").select(F.col("event_id").alias("id"), T.redact_map(body).alias("m"))
    docs = t("documents").select((-F.col("doc_id") - 1).alias("id"), F.md5(T.redact_text("text")).alias("body"))
    return log.select("id", F.concat_ws("|", F.col("m")["apiKey"], F.col("m")["text"], F.col("m")["note"], F.col("m")["Access-Token"], F.col("m")["payload"]).alias("body")).unionByName(docs)


QUERIES["redact_secrets"] = tables(redact_secrets)
ORACLES["redact_secrets"] = """
SELECT event_id AS id, '[REDACTED]|key [REDACTED] end|[REDACTED]|[REDACTED]|{"deep":{"apiKey":"[REDACTED]","kind":"' || event_type || '"},"list":[{"password":"[REDACTED]"}]}' AS body FROM events
UNION ALL SELECT -doc_id - 1, md5(regexp_replace(regexp_replace(text, '(?i)\\bBearer\\s+[A-Za-z0-9._~+/=-]{8,}', '[REDACTED]', 'g'), '(?i)\\bsk-[A-Za-z0-9_-]{8,}', '[REDACTED]', 'g')) FROM documents
"""


def sanitize_metadata(t):
    raw = F.create_map(F.lit("appVersion"), F.col("o_orderpriority"), F.lit("other"), F.col("o_orderstatus"), F.lit("modelVersion"), F.when(F.col("o_orderstatus") == "F", "m"))
    kept = t("orders").select("o_orderkey", T.sanitize_metadata(raw).alias("m"))
    return kept.select("o_orderkey", F.size("m").cast("bigint").alias("n"), F.col("m")["appVersion"].alias("app"), F.col("m")["modelVersion"].alias("model"))


QUERIES["sanitize_metadata"] = tables(sanitize_metadata)
ORACLES["sanitize_metadata"] = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END::BIGINT AS n, o_orderpriority AS app, CASE WHEN o_orderstatus = 'F' THEN 'm' END AS model FROM orders"


def safe_identifier(t):
    return t("pages").select("page_id", T.safe_identifier("url", "anonymous").alias("id"), T.safe_identifier(F.regexp_replace("url", "[a-zA-Z0-9]", ""), "untracked").alias("rest"))


QUERIES["safe_identifier"] = tables(safe_identifier)
ORACLES["safe_identifier"] = """
SELECT page_id, coalesce(nullif(regexp_replace(url, '[^A-Za-z0-9_-]', '', 'g'), ''), 'anonymous') AS id,
  coalesce(nullif(regexp_replace(regexp_replace(url, '[a-zA-Z0-9]', '', 'g'), '[^A-Za-z0-9_-]', '', 'g'), ''), 'untracked') AS rest FROM pages
"""


def strip_attribution(t):
    marked = F.concat(T.normalize_ws("text"), F.lit(" [Source 3], then\n"), F.lit("more [12]. End [来源 4]"))
    plain = T.strip_attribution_normalized(marked)
    return t("conversations").select("conv_id", "turn", F.md5(plain).alias("digest"))


QUERIES["strip_attribution"] = tables(strip_attribution)
ORACLES["strip_attribution"] = f"""
SELECT conv_id, turn, md5({norm("text")} || ', then' || chr(10) || 'more. End') AS digest FROM conversations
"""


def canonical_text(t):
    wide = F.translate("text", "abcABC019", "ａｂｃＡＢＣ０１９")
    return t("documents").select("doc_id", F.md5(T.canonical_text(wide)).alias("digest"))


QUERIES["canonical_text"] = tables(canonical_text)
ORACLES["canonical_text"] = f"SELECT doc_id, md5({norm('nfc_normalize(text)')}) AS digest FROM documents"


def question_scalars(t):
    k = F.col("item_id")
    question = F.concat(pick(["", "Define ", "Explain step by step: ", "Lecture overview of ", "See the table on 12 slide. "], k % 5), "text")
    base = t("benchmark").select(k, question.alias("q"))
    return base.select(
        "item_id", T.question_style("q").alias("style"), T.page_hint("q").alias("page"), T.type_hint("q").alias("kind"),
        T.is_document_wide("q", F.when(k % 7 == 0, "review").otherwise("qa")).alias("wide"), T.wants_example("q").alias("example"))


QUERIES["question_scalars"] = tables(question_scalars)
ORACLES["question_scalars"] = """
SELECT item_id, CASE item_id % 5 WHEN 1 THEN 'brief' WHEN 2 THEN 'detailed' ELSE 'normal' END AS style, CASE WHEN item_id % 5 = 4 THEN 12 END::INTEGER AS page,
  CASE WHEN item_id % 5 = 4 THEN 'table' END AS kind, item_id % 7 = 0 OR item_id % 5 = 3 AS wide, FALSE AS example FROM benchmark
"""


def evidence_reliability(t):
    k = F.col("doc_id")
    weight = F.when(k % 5 == 0, F.col("n_chars") / 10_000)
    origin = pick(["native", "ocr", "mixed", "vision"], k % 4)
    return t("documents").select("doc_id", F.round(T.evidence_reliability(weight, origin, F.col("n_chars") % 140), 6).alias("reliability"))


QUERIES["evidence_reliability"] = tables(evidence_reliability)
ORACLES["evidence_reliability"] = """
SELECT doc_id, round(CASE WHEN doc_id % 5 = 0 THEN least(greatest(n_chars / 10000, 0.45), 1) ELSE CASE doc_id % 4 WHEN 1 THEN 0.5 + least(n_chars % 140, 100) / 100 * 0.45
  WHEN 2 THEN 0.72 + least(n_chars % 140, 100) / 100 * 0.25 WHEN 3 THEN 0.72 ELSE 1 END END::DOUBLE, 6) AS reliability FROM documents
"""


def validate_fields(t):
    k = F.col("c_custkey")
    rows = t("customer").select(
        k, F.concat(F.lit("APTT-"), (k % 1200).cast("string")).alias("sid"), pick(["a", "B", "x", " d "], k % 4).alias("cond"), pick(["novice", "Experienced", "?"], k % 3).alias("str"),
        pick(["answer_shown", "Bad Type", "x"], k % 3).alias("type"), F.when(k % 2 == 0, pick(["time_limit", "stop"], k % 4 / 2)).alias("reason"))
    return rows.select("c_custkey", F.coalesce(R.session_error("sid", "cond", "str"), F.lit("ok")).alias("session"), F.coalesce(R.event_error("type"), F.lit("ok")).alias("event"),
                       F.coalesce(R.finalize_reason("reason"), F.lit("INVALID")).alias("reason"))


QUERIES["validate_fields"] = tables(validate_fields)
ORACLES["validate_fields"] = """
SELECT c_custkey, CASE WHEN c_custkey % 1200 NOT BETWEEN 100 AND 999 THEN 'INVALID_STUDY_ID' WHEN c_custkey % 4 = 2 THEN 'INVALID_CONDITION' WHEN c_custkey % 3 = 2 THEN 'INVALID_STRATUM' ELSE 'ok' END AS session,
  CASE WHEN c_custkey % 3 = 1 THEN 'INVALID_EVENT_TYPE' ELSE 'ok' END AS event, CASE WHEN c_custkey % 4 = 2 THEN 'INVALID' ELSE 'time_limit' END AS reason FROM customer
"""


def progress(t):
    k = F.col("event_id")
    return t("events").select(
        "event_id", R.phase_progress(pick([*PHASES, "odd"], k % 10), F.col("value"), F.when(k % 3 > 0, F.lit(50.0))).alias("progress"),
        R.estimate_remaining(F.lit(1000), k % 110, k * 10).alias("remaining_ms"))


QUERIES["phase_progress"] = tables(progress)
_P = [*PHASES.values(), (0, 0)]
ORACLES["phase_progress"] = f"""
WITH x AS (SELECT event_id, {[a for a, _ in _P]}[event_id % 10 + 1] AS a, {[b for _, b in _P]}[event_id % 10 + 1] AS b, CASE WHEN event_id % 3 > 0 THEN least(greatest(value / 50, 0), 1) ELSE 0 END AS r, event_id % 110 AS p FROM events)
SELECT event_id, floor(a + (b - a) * r + 0.5)::INTEGER AS progress, CASE WHEN p >= 3 AND p < 100 THEN floor(greatest(event_id * 10 - 1000, 0) * (100 - p) / p + 0.5)::BIGINT END AS remaining_ms FROM x
"""


def content_keys(t):
    key = content_key(question=F.col("text"), grounding=F.col("item_id") % 2 == 0, note=F.when(F.col("item_id") % 3 == 0, "n"))
    return t("benchmark").select("item_id", key.alias("cache_key"))


QUERIES["content_key"] = tables(content_keys)
ORACLES["content_key"] = """
SELECT item_id, sha256('{"grounding":' || (item_id % 2 = 0) || CASE WHEN item_id % 3 = 0 THEN ',"note":"n"' ELSE '' END || ',"question":' || to_json(text) || '}') AS cache_key FROM benchmark
"""


def experiment_versions(t):
    rows = t("customer").select("c_custkey", pick(["baseline", "full_evidence", "x"], F.col("c_custkey") % 3).alias("cond"), T.safe_identifier("c_name", "unknown", 128).alias("mat"))
    return rows.select("c_custkey", *R.experiment_versions("cond", "mat"))


QUERIES["experiment_versions"] = tables(experiment_versions)
ORACLES["experiment_versions"] = """
SELECT c_custkey, 'rq1-grounding-v1' AS prompt_version, 'qwen-plus' AS model_version, regexp_replace(c_name, '[^A-Za-z0-9_-]', '', 'g') AS material_version,
  CASE WHEN c_custkey % 3 = 0 THEN 'baseline' ELSE 'full_evidence' END AS condition FROM customer
"""


# ---- visuals and hooks -----------------------------------------------------------------
def _pixels(t):
    """Every vector as a small picture: eight by eight grey and coloured points."""
    value = F.col("v")
    return t("embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("number"), F.posexplode("embedding").alias("i", "v")).select(
        "doc_id", "number", F.lit(160).alias("width"), F.lit(120).alias("height"), (F.col("number") % 900).alias("native_text_length"),
        ((F.col("i") % 8) * 18 + 8).alias("x"), (F.floor(F.col("i") / 8) * 12 + 10).alias("y"),
        F.when(value > 0.2, 10).otherwise(255).alias("red"), F.when(value > 0.1, 60).otherwise(255).alias("green"), F.when(value > 0.2, 10).otherwise(250).alias("blue"))


def visual_features(t):
    return visuals.visual_features(_pixels(t))


QUERIES["visual_features"] = tables(visual_features)
PIXELS_SQL = """
px AS (SELECT label AS doc_id, vec_id AS number, vec_id % 900 AS n, (i % 8) * 18 + 8 AS x, (i // 8) * 12 + 10 AS y, v FROM (SELECT label, vec_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings)),
mk AS (SELECT *, (CASE WHEN v > 0.2 THEN 10 ELSE 255 END + CASE WHEN v > 0.1 THEN 60 ELSE 255 END + CASE WHEN v > 0.2 THEN 10 ELSE 250 END) / 3 < 238 AS fg,
  v > 0.1 AS col FROM px),
ed AS (SELECT *, fg <> coalesce(lag(fg) OVER (PARTITION BY number, y ORDER BY x), FALSE) AS edge FROM mk),
ag AS (SELECT doc_id, number, n, avg(fg::INTEGER) AS fg, avg(col::INTEGER) AS c, avg(edge::INTEGER) AS e, min(x) FILTER (col OR (fg AND n < 160)) AS x0, min(y) FILTER (col OR (fg AND n < 160)) AS y0,
  max(x) FILTER (col OR (fg AND n < 160)) AS x1, max(y) FILTER (col OR (fg AND n < 160)) AS y1 FROM ed GROUP BY ALL),
ru AS (SELECT *, n < 120 AND fg > 0.035 AS image, c > 0.012 AND (fg > 0.025 OR e > 0.08) AS chart, n < 700 AND fg > 0.07 AND e > 0.11 AS diagram FROM ag),
bx AS (SELECT *, CASE WHEN x0 < x1 THEN x0 ELSE 6 END AS bx, CASE WHEN y0 < y1 THEN y0 ELSE 9 END AS by_, CASE WHEN x0 < x1 THEN x1 - x0 + 2 ELSE 148 END AS bw, CASE WHEN y0 < y1 THEN y1 - y0 + 2 ELSE 102 END AS bh
  FROM ru WHERE image OR chart OR diagram),
sm AS (SELECT *, bw < 160 * 0.28 OR bh < 120 * 0.22 AS small FROM bx),
vf AS (SELECT doc_id, number, CASE WHEN image THEN 'image_heavy' WHEN chart THEN 'chart_like' ELSE 'monochrome_diagram' END AS rule,
  CASE WHEN small THEN 12 ELSE least(greatest(bx - 4, 0), 159) END::BIGINT AS x, CASE WHEN small THEN 16 ELSE least(greatest(by_ - 3, 0), 119) END::BIGINT AS y, bw, bh, small,
  round(least(greatest(c * 5 + fg * 1.6 + e * 1.2 + CASE WHEN image THEN 0.18 ELSE 0 END, 0), 1), 4)::DOUBLE AS score FROM sm),
feat AS (SELECT doc_id, number, rule, x, y, CASE WHEN small THEN 134 ELSE least(greatest(bw + 8, 1), 160 - x) END::BIGINT AS crop_width,
  CASE WHEN small THEN 86 ELSE least(greatest(bh + 6, 1), 120 - y) END::BIGINT AS crop_height, score FROM vf)
"""
ORACLES["visual_features"] = f"WITH {PIXELS_SQL} SELECT * FROM feat"


def top_visuals(t):
    return ranking.top_visuals(visuals.visual_features(_pixels(t)), 6).select("doc_id", "number", "position", "score")


QUERIES["top_visuals"] = tables(top_visuals)
ORACLES["top_visuals"] = f"""
WITH {PIXELS_SQL}, b AS (SELECT * FROM feat QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, number) <= 6)
SELECT doc_id, number, row_number() OVER (PARTITION BY doc_id ORDER BY number)::INTEGER AS position, score FROM b
"""


def embed_hook(t):
    """A user function that measures the text stands in for a model."""
    chunks = t("documents").select("doc_id", F.lit("").alias("title"), F.col("source").alias("label"), F.col("lang").alias("content_type"), "text")
    vectors = hooks.embed(chunks, lambda texts: [[float(len(x)), float(x.count("e"))] for x in texts])
    return vectors.select("doc_id", F.col("embedding")[0].alias("size"), F.col("embedding")[1].alias("es"))


QUERIES["embed_hook"] = tables(embed_hook)
ORACLES["embed_hook"] = """
WITH x AS (SELECT doc_id, source || chr(10) || lang || CASE WHEN text = '' THEN '' ELSE chr(10) || text END AS body FROM documents)
SELECT doc_id, length(body)::DOUBLE AS size, (length(body) - length(replace(body, 'e', '')))::DOUBLE AS es FROM x
"""
