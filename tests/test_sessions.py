import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from evidar.config import Config
from evidar.operators import limits, procedure
from evidar.operators import sessions as S
from evidar.operators import workspaces as W
from evidar.operators.hooks import embed, generate, rerank_with
from evidar.sources import files
from evidar.sources.manifests import read_manifests
from evidar.streaming import runner
from evidar.streaming import sessions as St
from tests.helpers import rows

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
ARRIVAL = "study_id string, arrival_ts timestamp, arrival_seq bigint, client_event_id string, type string, client_ts timestamp, elapsed_ms double, data string"
SESSION = "study_id string, status string, started_at timestamp, scheduled_end_at timestamp, ended_at timestamp, completion_reason string, condition string, stratum string"
LIMIT = 1_500_000


def at(ms):
    return T0 + timedelta(milliseconds=ms)


def session(study="s", status="active", reason=None):
    return (study, status, T0, at(LIMIT), None, reason, "A", "novice")


def arrive(ms, seq, cid, kind="question_submitted", elapsed=None, study="s", data="{}"):
    elapsed = min(ms, LIMIT) if elapsed is None else elapsed
    return (study, at(ms), seq, cid, kind, at(elapsed), float(elapsed), data)


def ingest(spark, arrivals, sessions=None, log=None):
    out = S.ingest_events(spark.createDataFrame(arrivals, ARRIVAL), spark.createDataFrame(sessions or [session()], SESSION), log)
    return [(r.arrival_seq, r.outcome, r.code, r.sequence, r.finalised) for r in out.orderBy("arrival_seq").collect()]


def test_ingest_rules(spark):
    got = ingest(spark, [
        arrive(1_000, 1, "a"), arrive(2_000, 2, "a"), arrive(3_000, 3, None), arrive(3_000, 4, "bad", "Not ok!"), arrive(4_000, 5, "b"),
        arrive(LIMIT + 100, 6, "late", "source_view_closed", LIMIT - 100), arrive(LIMIT + 200, 7, "later", elapsed=LIMIT - 50),
        arrive(LIMIT + 300, 8, "a"), arrive(LIMIT + 300, 9, "late"),
    ])
    assert got == [
        (1, "accepted", None, 1, False), (2, "duplicate", None, 1, False), (3, "accepted", None, 2, False), (4, "rejected", "INVALID_EVENT_TYPE", None, False),
        (5, "accepted", None, 3, False), (6, "accepted", None, 4, True), (7, "rejected", "STUDY_TIME_ENDED", None, False),
        (8, "duplicate", None, 1, False), (9, "duplicate", None, 4, False)]


def test_first_late_event_outside_the_window_ends_the_session(spark):
    got = ingest(spark, [arrive(LIMIT + 5, 1, "x", elapsed=LIMIT + 5), arrive(LIMIT + 6, 2, "y", elapsed=10)])
    assert [g[1:3] for g in got] == [("rejected", "STUDY_TIME_ENDED")] * 2


def test_sequences_continue_the_log(spark):
    log = spark.createDataFrame([("s", "start", 1)], "study_id string, client_event_id string, sequence bigint")
    got = ingest(spark, [arrive(1_000 + i, i, f"e{i}") for i in range(12)] + [arrive(9_000, 99, "start")], log=log)
    assert [g[3] for g in got] == [*range(2, 14), 1] and got[-1][1] == "duplicate"


def test_unknown_and_closed_sessions(spark):
    got = ingest(spark, [arrive(1, 1, "a", study="gone"), arrive(1, 2, "a", study="p"), arrive(1, 3, "a", study="t")],
                 [session(), session("p", "prepared"), session("t", "completed", "time_limit")])
    assert [g[2] for g in got] == ["STUDY_NOT_FOUND", "SESSION_NOT_ACTIVE", "STUDY_TIME_ENDED"]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    sessions = [session(f"s{i}", "active" if i else "prepared") for i in range(4)]
    data = [arrive(rng.randrange(0, LIMIT + 400_000), i, f"c{rng.randrange(30)}" if i % 7 else None, rng.choice(["answer_shown", "BAD type"] + ["x"] * 6),
                   rng.randrange(-100, LIMIT + 100), f"s{i % 4}") for i in range(200)]
    data.sort(key=lambda r: (r[1], r[2]))
    batch = ingest(spark, data, sessions)
    for n in range(4):
        spark.createDataFrame(data[n * 50:(n + 1) * 50], ARRIVAL).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    source = spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = runner.run_available(St.ingest_stream(source, spark.createDataFrame(sessions, SESSION)), "t", "update", f"{tmp_path}/out")
    stream = [(r.arrival_seq, r.outcome, r.code, r.sequence, r.finalised) for r in out.orderBy("arrival_seq").collect()]
    assert stream == batch and {b[1] for b in batch} == {"accepted", "rejected", "duplicate"}


def test_counters_and_summary(spark):
    log = [("s", 2, "question_submitted", 100, "{}"), ("s", 3, "answer_shown", 900, '{"latencyMs":850}'), ("s", 4, "citation_clicked", 1_000, "{}"),
           ("s", 5, "source_view_closed", 3_000, '{"durationMs":2450}'), ("s", 6, "pdf_page_changed", 4_000, "{}"), ("s", 7, "answer_shown", 5_000, '{"latencyMs":-1}')]
    events = spark.createDataFrame(log, "study_id string, sequence bigint, type string, elapsed_ms bigint, data string")
    done = spark.createDataFrame([("s", "completed", T0, at(LIMIT), at(LIMIT), "time_limit", "A", "novice")], SESSION)
    row = S.session_summary(events, done).first()
    assert len(row) == 17 and (row.total_questions, row.total_ai_responses, row.total_citation_clicks, row.total_pdf_page_changes) == (1, 2, 1, 1)
    assert (row.total_source_view_seconds, row.mean_response_latency_ms, row.actual_learning_seconds) == (2, 850, 1500)
    assert row.started_at == "2026-01-01T00:00:00.000Z" and S.rebuild_counters(events).first().event_sequence == 7


def test_finalize_closes_the_open_view(spark):
    events = spark.createDataFrame([("s", 1, "study_started", 0, "{}"), ("s", 2, "source_view_opened", 2_000, '{"anchorId":"k"}')], "study_id string, sequence bigint, type string, elapsed_ms bigint, data string")
    ends = lambda reason, now, client=None: spark.createDataFrame([("s", reason, at(now), client)], "study_id string, reason string, ended_now timestamp, client_ended_at timestamp")
    base = spark.createDataFrame([session()], SESSION)
    added, after, refused = S.finalize(events, base, ends("time_limit", LIMIT + 50))
    got = added.orderBy("sequence").collect()
    assert [(r.sequence, r.type, r.elapsed_ms) for r in got] == [(3, "source_view_closed", LIMIT), (4, "study_ended", LIMIT)]
    assert json.loads(got[0].data) == {"anchorId": "k", "durationMs": LIMIT - 2_000, "synthetic": True, "closureReason": "time_limit"}
    assert after.first().status == "completed" and refused.count() == 0
    assert S.finalize(events, base, ends("time_limit", 10))[2].first().error_code == "STUDY_TIME_REMAINING"
    assert S.finalize(events, base, ends("early_completion", 5_000, at(9_000)))[2].first().error_code == "INVALID_EARLY_COMPLETION_TIME"
    assert S.finalize(events, base, ends("participant_withdrawal", 5_000))[1].first().status == "withdrawn"
    assert S.expire_sessions(base, F.lit(at(LIMIT))).count() == 1


def test_late_batch_is_idempotent(spark):
    schema = "study_id string, position int, client_event_id string, type string, client_ts timestamp, elapsed_ms double, data string"
    pending = spark.createDataFrame([("s", i, f"e{i}", "x", at(1_000), 1_000.0, "{}") for i in range(510)], schema)
    log = spark.createDataFrame([("s", "a", 1), ("s", "b", 2)], "study_id string, client_event_id string, sequence bigint")
    sessions = spark.createDataFrame([session()], SESSION)
    acked, added = S.late_batch(pending, log, sessions)
    assert acked.count() == added.count() == 510 and added.agg(F.max("sequence")).first()[0] == 512  # no limit unless asked for
    acked, added = S.late_batch(pending, log, sessions, limit=500)
    assert acked.count() == added.count() == 500 and added.agg(F.max("sequence")).first()[0] == 502
    again = log.unionByName(added.select("study_id", "client_event_id", "sequence"))
    acked, added = S.late_batch(pending, again, sessions, limit=500)
    assert acked.count() == 500 and added.count() == 0


def _limit(times, limit, window):
    out, count, reset = [], 0, -1
    for now in times:
        if reset <= now:
            count, reset = 0, now + window
        ok = count < limit
        count += ok
        out.append((ok, limit - count if ok else 0, reset, None if ok else max(1, -((now - reset) // 1_000))))
    return out


@pytest.mark.parametrize("times, limit, window", [
    ([1_000, 2_000, 2_001], 2, 10_000), ([5_000, 5_999, 6_000], 1, 1_000), (sorted(random.Random(1).randrange(0, 400_000) for _ in range(300)), 3, 7_000),
])
def test_rate_limit(spark, times, limit, window):
    requests = spark.createDataFrame([("r", "k", t, i) for i, t in enumerate(times)], "scope string, key string, now_ms bigint, seq bigint")
    out = limits.rate_limit(requests, limit, window).orderBy("seq").collect()
    assert [(r.allowed, r.remaining, r.reset_at, r.retry_after_s) for r in out] == _limit(times, limit, window)


def test_procedure(spark):
    steps = ["confirm_written_consent", "acknowledge_information_sheet", "acknowledge_information_sheet", "start", "confirm_written_consent", "confirm_form1", "start", "start",
             "confirm_form3", "finish", "start", "confirm_form2", "confirm_form3", "confirm_form2", "nonsense"]
    data = [("s", at(i), i, a, "early_completion" if a == "finish" else None) for i, a in enumerate(steps)]
    data += [("h", at(i), i, a, "technical_failure" if a == "finish" else None) for i, a in enumerate([*list(procedure.STEPS)[:5], "confirm_form3"])]
    out = procedure.procedure_replay(spark.createDataFrame(data, "study_id string, arrival_ts timestamp, arrival_seq bigint, action string, reason string"))
    got = [(r.outcome, r.stage_after) for r in out.filter("study_id = 's'").orderBy("arrival_seq").collect()]
    assert [g[0] for g in got] == [
        "PROCEDURE_OUT_OF_ORDER", "accepted", "idempotent", "STUDY_PREREQUISITES_INCOMPLETE", "accepted", "accepted", "accepted", "idempotent", "POST_STUDY_NOT_ELIGIBLE",
        "accepted", "SESSION_ALREADY_FINISHED", "PROCEDURE_OUT_OF_ORDER", "accepted", "accepted", "INVALID_PROCEDURE_ACTION"]
    assert got[0][1] == "information_sheet" and got[6][1] == "learning" and got[-1][1] == "done"
    halted = out.filter("study_id = 'h'").orderBy("arrival_seq").collect()
    assert (halted[-1].outcome, halted[-1].stage_after) == ("POST_STUDY_NOT_ELIGIBLE", "halted")


def test_timer_ends_a_silent_session(spark, tmp_path):
    for n, part in enumerate([[arrive(1_000, 1, "a")], [arrive(LIMIT + 9_000_000, 2, "b", study="other", elapsed=5)], [arrive(LIMIT + 9_900_000, 3, "c", study="other", elapsed=5)]]):
        spark.createDataFrame(part, ARRIVAL).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    source = spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    stream = St.ingest_stream(source, spark.createDataFrame([session()], SESSION), "10 seconds", grace_ms=1_000)
    out = runner.run_available(stream, "t", "append", f"{tmp_path}/out")
    ended = out.filter("type = 'study_ended'").collect()
    assert [(r.study_id, r.sequence, r.server_ms) for r in ended] == [("s", 2, int(T0.timestamp() * 1000) + LIMIT)]


def test_event_log_files(spark, tmp_path):
    line = {"studyId": "s", "sequence": 1, "type": "question_submitted", "serverTimestamp": "2026-01-01T00:00:00.000Z", "data": {"a": 1}}
    (tmp_path / "log.jsonl").write_text(json.dumps(line) + "\n{broken\n\n" + json.dumps({**line, "sequence": 2, "type": "citation_error"}) + "\n")
    log = files.read_event_log(spark, str(tmp_path / "log.jsonl"))
    assert [(r.sequence, json.loads(r.data)) for r in log.orderBy("sequence").collect()] == [(1, {"a": 1}), (2, {"a": 1})]
    files.write_event_log(S.fan_out(log), str(tmp_path / "out"))
    again = spark.read.json(str(tmp_path / "out"))
    assert rows(again, "category", "sequence") == [("citations", 2), ("errors", 2), ("messages", 1)]


def test_csv_sinks(spark, tmp_path):
    summary = spark.createDataFrame([("s", 'say "x", y', "")], "study_id string, note string, empty string")
    files.write_summary_csv(summary.coalesce(1), str(tmp_path / "summary"))
    assert next((tmp_path / "summary").glob("part-*")).read_text() == 'study_id,note,empty\ns,"say ""x"", y",\n'
    log = spark.createDataFrame([("e", T0, "p", "s", "c", "m", "ev", {"k": "v"})], "event_id string, ts timestamp, participant_id string, session_id string, condition string, material_version string, event string, data map<string,string>")
    files.write_experiment_csv(log, str(tmp_path / "exp"))
    text = next((tmp_path / "exp").glob("part-*")).read_text().splitlines()
    assert text[1] == '"e","2026-01-01T00:00:00.000Z","p","s","c","m","ev","{""k"":""v""}"'


def test_files_and_dataset(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "in" / "b.PPTX").write_bytes(b"no zip")
    got = files.intake(files.read_files(spark, str(tmp_path / "in")))
    assert rows(got, "name", "extension", "reject_code") == [("a.pdf", "pdf", None), ("b.PPTX", "pptx", "INVALID_FILE_SIGNATURE")]
    data = {"name": "n", "priorities": {"detail": 1.0}, "documents": [{"id": "d", "chunks": [{"id": "p1", "number": 1, "text": "x"}]}],
            "cases": [{"id": "1", "documentId": "d", "category": "detail", "mode": "qa", "question": "q", "relevantChunkIds": ["p1"]}], "ocrSamples": [{"id": "o", "expected": "a", "actual": "b"}]}
    (tmp_path / "set.json").write_text(json.dumps(data, indent=1))
    parts = files.read_eval(spark, str(tmp_path / "set.json"))
    assert {k: v.count() for k, v in parts.items()} == {"chunks": 1, "cases": 1, "ocr_samples": 1, "priorities": 1}
    files.write_report(parts["cases"], str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().query_id == "1"


def _manifest(**change):
    base = {"version": 4, "engine": "tesseract.js", "mode": "force", "sourceType": "pdf", "inspectedPageCount": 2,
            "pages": [{"number": 2, "text": "b\r\nc", "confidence": 101, "durationMs": -1}, {"number": 1, "text": "a", "confidence": 50}],
            "nativePages": [{"number": 1, "text": "a"}, {"number": 2, "text": ""}]}
    return json.dumps({**base, **change})


def test_manifests(spark):
    page = {"number": 1, "text": "a"}
    cases = {
        "ok": _manifest(), "dup": _manifest(pages=[page, page]), "missing": _manifest(pages=[page]), "old": _manifest(version=3), "broken": "{",
        "empty": _manifest(pages=[]), "large": _manifest(pages=[{"number": i + 1, "text": "x" * 15_000} for i in range(17)]),
        "picture": _manifest(visuals=[{"id": "v", "number": 1, "imageDataUrl": "http://x"}]), "none": None,
    }
    df = spark.createDataFrame([(k, v, "none" if k == "none" else "force") for k, v in cases.items()], "doc_id string, json string, requested_mode string")
    cfg = Config(ocr_max_pages=120, ocr_total_chars=250_000)
    pages, natives, _, errors = read_manifests(df, cfg=cfg)
    assert rows(errors, "doc_id", "error_code") == [
        ("broken", "INVALID_OCR_MANIFEST"), ("dup", "INVALID_OCR_PAGE"), ("empty", "INVALID_OCR_PAGE_COUNT"), ("large", "OCR_TEXT_TOO_LARGE"),
        ("missing", "INCOMPLETE_FULL_PAGE_OCR"), ("old", "OCR_MANIFEST_REQUIRED"), ("picture", "INVALID_VISUAL_CANDIDATE")]
    assert rows(pages, "number", "text", "confidence", "duration_ms") == [(1, "a", 50.0, 0.0), (2, "b\nc", 100.0, 0.0)]
    assert natives.count() == 2
    pages, _, _, errors = read_manifests(df)
    assert rows(errors.filter("doc_id = 'large'"), "error_code") == [("INCOMPLETE_FULL_PAGE_OCR",)]


def test_hooks(spark):
    df = spark.createDataFrame([(i, "", "l", "prose", "x" * i) for i in range(1, 26)], "id int, title string, label string, content_type string, text string")

    def fail_on_long(texts):
        if any(len(t) > 30 for t in texts):
            raise RuntimeError("down")
        return [[len(t) + 0.12345678] for t in texts]

    got = {r.id: r.embedding for r in embed(df.coalesce(1), fail_on_long).collect()}
    assert got[1] == [pytest.approx(9.123457)] and got[25] is None
    pairs = df.select(F.lit("q").alias("query_id"), F.col("id").cast("string").alias("chunk_id"), F.lit("?").alias("question"), "title", "label", "text")
    assert rerank_with(pairs, lambda rows_: [len(r["document"]) / 100 for r in rows_]).count() == 25
    prompts = spark.sql("SELECT 'q' AS query_id, CAST(NULL AS STRING) AS error_code, array(named_struct('role','user','content','hi')) AS messages")
    assert generate(prompts, lambda texts: [json.dumps({"n": len(json.loads(t))}) for t in texts]).first().json == '{"n": 1}'


def test_jobs(spark):
    schema = "owner string, job_id string, status string, updated_at int, ocr_mode string, manifest_version int, manifest_mode string, checkpoint_current boolean"
    jobs = spark.createDataFrame([("o", "a", "failed", 9, "auto", None, None, None), ("o", "b", "processing", 5, "auto", 4, "auto", True), ("o", "c", "paused", 7, "auto", 4, "force", None)], schema)
    assert rows(W.triage_jobs(jobs), "job_id", "compatible", "resume", "restored_status") == [("a", True, False, "failed"), ("b", True, True, "paused"), ("c", False, False, "paused")]
