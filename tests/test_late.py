"""Streams that resume, end by the clock, and keep late rows."""

import time
from datetime import datetime, timedelta, timezone

from evidar.operators import sessions as S
from evidar.streaming import late, runner
from evidar.streaming import sessions as St
from tests.test_sessions import ARRIVAL, LIMIT, SESSION, T0, at, session

ROW = "study_id string, client_event_id string, arrival_ts timestamp, arrival_seq bigint"


def arrive(ms, seq, name, kind="x", study="s", data="{}"):
    return (study, at(ms), seq, name, kind, at(ms - 5), float(ms), data)


def source(spark, path, per_trigger=1):
    return spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").parquet(str(path))


def test_session_that_began_before_the_stream(spark, tmp_path):
    old = [arrive(1_000, 1, "a"), arrive(2_000, 2, "b"), arrive(2_500, 3, None), arrive(3_000, 4, "a"), arrive(100, 5, "o", study="other")]
    new = [arrive(4_000, 6, "b"), arrive(5_000, 7, "c", data='{"apiKey":"hunter2","n":1}'), arrive(6_000, 8, "c"), arrive(7_000, 9, None), arrive(LIMIT + 10, 10, "z"), arrive(8_000, 11, "o", study="other")]
    sessions = spark.createDataFrame([session(), session("other"), session("never")], SESSION)
    log = S.ingest_events(spark.createDataFrame(old, ARRIVAL), sessions).where("outcome = 'accepted'").select("study_id", "client_event_id", "sequence")
    batch = S.ingest_events(spark.createDataFrame(new, ARRIVAL), sessions, log=log)
    for n in range(3):
        spark.createDataFrame(new[n * 2 : n * 2 + 2], ARRIVAL).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    out = runner.run_available(St.ingest_stream(source(spark, tmp_path / "in"), sessions, log=log), "t", "update", f"{tmp_path}/out")
    names = ["arrival_seq", "study_id", "client_event_id", "type", "outcome", "code", "sequence", "client_ts", "elapsed_ms", "data", "finalised"]
    stream = [tuple(r) for r in out.select(*names).orderBy("arrival_seq").collect()]
    assert stream == [tuple(r) for r in batch.select(*names).orderBy("arrival_seq").collect()]
    assert [s[6] for s in stream] == [2, 4, 4, 5, None, 1] and "hunter2" not in stream[1][9]


def test_silent_session_ends_by_the_clock(spark, tmp_path):
    """No later row of any session comes."""
    now = datetime.now(timezone.utc)
    begun = now - timedelta(minutes=25) + timedelta(seconds=4)
    sessions = spark.createDataFrame([("s", "active", begun, now + timedelta(seconds=4), None, None, "A", "novice")], SESSION)
    spark.createDataFrame([("s", now, 1, "a", "x", now, 5.0, "{}")], ARRIVAL).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    out = f"{tmp_path}/out"
    query = St.ingest_stream(source(spark, tmp_path / "in"), sessions, grace_ms=60_000, clock=True).writeStream.outputMode("update").foreachBatch(
        lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch_id={n}")).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
    try:
        ended, until = [], time.time() + 90
        while not ended and time.time() < until:
            time.sleep(1)
            if query.lastProgress is not None:
                ended = spark.read.parquet(out).where("outcome = 'expired'").collect()
        assert query.exception() is None
    finally:
        query.stop()
    assert [(r.study_id, r.type, r.sequence) for r in ended] == [("s", "study_ended", 2)]


def test_state_is_cleared_after_the_grace(spark, tmp_path):
    """What comes later than the grace is refused without state, and the cleared session is not begun again."""
    parts = [[arrive(1_000, 1, "a")], [arrive(LIMIT + 9_000_000, 2, "q", study="other")], [arrive(LIMIT + 9_900_000, 3, "r", study="other")], [arrive(LIMIT + 9_950_000, 4, "a"), arrive(LIMIT + 9_950_001, 5, "n")]]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, ARRIVAL).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = St.ingest_stream(source(spark, tmp_path / "in"), spark.createDataFrame([session()], SESSION), "10 seconds", grace_ms=1_000)
    out = runner.run_available(stream, "t", "append", f"{tmp_path}/out").where("study_id = 's'").orderBy("batch_id", "arrival_seq").collect()
    assert [(r.outcome, r.code, r.sequence) for r in out] == [("accepted", None, 1), ("expired", None, 2), ("rejected", "STUDY_TIME_ENDED", None), ("rejected", "STUDY_TIME_ENDED", None)]


def test_every_arrival_is_in_one_table(spark, tmp_path):
    second = 1_000
    deliveries = [
        [("s", "a", 100, 1), ("s", "a", 101, 2), ("s", "b", 200, 3), ("s", None, 200, 4), ("s", None, 201, 5)],
        [("s", "a", 195, 6), ("s", "c", 189, 7), ("s", "b", 260, 8), ("t", "a", None, 9)],
        [("s", "c", 249, 10), ("s", "c", 250, 11), ("s", "b", 300, 12), ("s", "a", 400, 13)],
    ]
    for n, rows in enumerate(deliveries):
        made = [(s, i, None if ms is None else T0 + timedelta(milliseconds=ms * second), k) for s, i, ms, k in rows]
        spark.createDataFrame(made, ROW).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(ROW).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        late.split_late(stream, f"{tmp_path}/out", 10 * second).awaitTermination()
    schema = spark.createDataFrame([], ROW).schema
    on_time, behind = late.tables(spark, f"{tmp_path}/out", schema)
    assert sorted(r.arrival_seq for r in behind.collect()) == [7, 10]
    # 6 repeats a key of the first delivery, but that lay more than twice the delay behind.
    assert sorted((r.arrival_seq, r.duplicate) for r in on_time.collect()) == [
        (1, False), (2, True), (3, False), (4, False), (5, False), (6, False), (8, True), (9, False), (11, False), (12, True), (13, False)]
