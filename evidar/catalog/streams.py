"""Registered queries: Structured Streaming over the given events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidar.catalog import sessions as B
from evidar.catalog.common import table
from evidar.operators import sessions as S
from evidar.session import saved, shared_folder
from evidar.streaming import late, runner
from evidar.streaming import sessions as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def streamed(query):
    """Give a query a reader whose ``events`` table is a stream."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        runner.with_rocksdb(spark)

        def read(name: str, stream: bool = False) -> DataFrame:
            if not stream:
                return table(spark, sf_dir, name)
            raw = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
            source = spark.readStream.schema(raw).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
            if raw["ts"].dataType.typeName() == "timestamp_ntz":
                micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
                source = source.withColumn("ts", F.timestamp_micros(micros))
            return source

        return query(read)

    run.__name__ = query.__name__
    run.__doc__ = query.__doc__
    return run


class _Streaming:
    """Reader that streams ``events`` once and gives tables otherwise."""

    def __init__(self, read):
        self.read = read

    def __call__(self, name: str) -> DataFrame:
        return self.read(name, name == "events")


def _stream_arrivals(read, sessions):
    """The arrivals of ``B.arrivals`` as a stream."""
    log = B.event_log(_Streaming(read)).join(sessions.select("study_id", "started_at"), "study_id")
    client = F.unix_millis("arrival_ts") - (F.col("arrival_seq") % 5) * 3_600_000
    kind = F.when(F.col("arrival_seq") % 13 == 0, F.lit("Bad type!")).otherwise(F.col("type"))
    return log.select(
        "study_id", "arrival_ts", "arrival_seq", "client_event_id", kind.alias("type"), F.timestamp_millis(client).alias("client_ts"),
        (client - F.unix_millis("started_at")).cast("double").alias("elapsed_ms"), "data")


def ingest_stream(read):
    sessions = B.session_table(read)
    out = runner.run_available(T.ingest_stream(_stream_arrivals(read, sessions), sessions, cfg=B.WEEK), "ingest", "update")
    return out.select("study_id", "arrival_seq", "outcome", "code", "sequence", "elapsed_ms", "finalised", "server_ms")


QUERIES["ingest_stream"] = streamed(ingest_stream)
ORACLES["ingest_stream"] = B.ORACLES["ingest_events"]


def _begun(arrivals):
    """Arrivals of a session's first four days: they came before the stream began."""
    return F.unix_millis("arrival_ts") < F.unix_millis("started_at") + 4 * 86_400_000


def resumed_ingest(read):
    """Sessions that began before the stream go on from the log of their first four days."""
    sessions = B.session_table(read)
    starts = sessions.select("study_id", "started_at")
    old = B.arrivals(read).join(starts, "study_id")
    log = S.ingest_events(old.where(_begun(old)).drop("started_at"), sessions, cfg=B.WEEK).where("outcome = 'accepted'")
    log = saved(log.select("study_id", "client_event_id", "sequence"), "log")
    new = _stream_arrivals(read, sessions).join(starts, "study_id")
    out = runner.run_available(T.ingest_stream(new.where(~_begun(new)).drop("started_at"), sessions, cfg=B.WEEK, log=log), "resumed", "update")
    return out.select(
        "study_id", "arrival_seq", "outcome", "code", "sequence", "elapsed_ms", "finalised", "server_ms",
        F.unix_millis("client_ts").alias("client_ms"), F.get_json_object("data", "$.anchorId").cast("int").alias("anchor"))


QUERIES["resumed_ingest"] = streamed(resumed_ingest)
ORACLES["resumed_ingest"] = f"""
WITH base AS ({B.ORACLES['ingest_events']}),
s AS (SELECT user_id AS study_id, epoch_us(min(ts)) // 1000 AS start_ms FROM events GROUP BY user_id)
SELECT base.*, epoch_us(ts) // 1000 - (event_id % 5) * 3600000 AS client_ms, (props->>'$.k')::INTEGER AS anchor
FROM base JOIN events ON event_id = arrival_seq JOIN s ON s.study_id = user_id WHERE epoch_us(ts) // 1000 >= start_ms + 345600000
"""


def clock_expiry(read):
    """Sessions without an arrival at or after their deadline are ended by a wall-clock timer alone."""
    sessions = B.session_table(read)
    arrivals = _stream_arrivals(read, sessions).join(sessions.select("study_id", "scheduled_end_at"), "study_id")
    silent = arrivals.where("arrival_ts < scheduled_end_at").drop("scheduled_end_at")
    out = runner.run_by_clock(T.ingest_stream(silent, sessions, grace_ms=3_600_000, cfg=B.WEEK, clock=True), "clock")
    return out.where("outcome = 'expired'").select("study_id", "type", "sequence", "server_ms", "elapsed_ms", "finalised")


QUERIES["clock_expiry"] = streamed(clock_expiry)
ORACLES["clock_expiry"] = f"""
WITH base AS ({B.ORACLES['ingest_events']}),
s AS (SELECT user_id AS study_id, epoch_us(min(ts)) // 1000 + 604800000 AS end_ms FROM events GROUP BY user_id)
SELECT s.study_id, 'study_ended' AS type, 1 + count(*) FILTER (outcome = 'accepted' AND server_ms < end_ms AND NOT finalised) AS sequence, end_ms AS server_ms, 604800000::BIGINT AS elapsed_ms, TRUE AS finalised
FROM s JOIN base USING (study_id) WHERE s.study_id % 10 <> 0 GROUP BY s.study_id, end_ms
"""

TEN_DAYS = 10 * 86_400_000


def late_events(read):
    """T4, T5: four deliveries of the events, one micro-batch each; what is ten days behind the ones before goes to the table of late rows."""
    log = B.event_log(read).select("study_id", "client_event_id", "arrival_ts", "arrival_seq", (F.col("arrival_seq") % 4).alias("delivery"))
    spark = log.sparkSession
    base = f"{shared_folder(spark)}/evidar/late-{uuid.uuid4().hex}"
    for k in range(4):
        log.where(F.col("delivery") == k).write.parquet(f"{base}/source/part={k}")
        source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{base}/source/part=*")
        late.split_late(source, f"{base}/tables", TEN_DAYS).awaitTermination()
    on_time, behind = late.tables(spark, f"{base}/tables", log.schema)
    both = on_time.withColumn("late", F.lit(False)).unionByName(behind.withColumn("late", F.lit(True)), allowMissingColumns=True)
    return both.select("study_id", "arrival_seq", "delivery", "late", "duplicate")


QUERIES["late_events"] = streamed(late_events)
ORACLES["late_events"] = f"""
WITH {B.EVENTS_SQL}, d AS (SELECT *, arrival_seq % 4 AS delivery, epoch_us(arrival_ts) // 1000 AS ms FROM e),
m AS (SELECT b.delivery, (SELECT max(ms) FROM d WHERE d.delivery < b.delivery) AS mark FROM (SELECT DISTINCT delivery FROM d) b),
x AS (SELECT d.*, mark, coalesce(ms < mark - {TEN_DAYS}, FALSE) AS late FROM d JOIN m USING (delivery)),
f AS (SELECT *, row_number() OVER (PARTITION BY study_id, client_event_id, delivery ORDER BY arrival_ts, arrival_seq) AS n FROM x WHERE NOT late)
SELECT study_id, arrival_seq, delivery, FALSE AS late, n > 1 OR EXISTS (SELECT 1 FROM f g WHERE g.study_id = f.study_id AND g.client_event_id = f.client_event_id
  AND g.delivery < f.delivery AND g.ms >= f.mark - {2 * TEN_DAYS}) AS duplicate FROM f
UNION ALL SELECT study_id, arrival_seq, delivery, TRUE, NULL FROM x WHERE late
"""


def rate_limit_stream(read):
    requests = _Streaming(read)("events").select(
        F.lit("events").alias("scope"), F.col("user_id").cast("string").alias("key"), F.unix_millis("ts").alias("now_ms"), F.col("event_id").alias("seq"))
    out = runner.run_available(T.rate_limit_stream(requests, 2, 86_400_000), "limit", "update")
    return out.withColumn("key", F.substring_index("k", ":", -1)).drop("k", "batch_id")


QUERIES["rate_limit_stream"] = streamed(rate_limit_stream)
ORACLES["rate_limit_stream"] = B.ORACLES["rate_limit"]


def dedup_stream(read):
    log = B.event_log(_Streaming(read)).select("study_id", "client_event_id", "arrival_ts")
    return runner.run_available(T.dedup_stream(log, "40 days"), "dedup").select("study_id", "client_event_id")


QUERIES["dedup_stream"] = streamed(dedup_stream)
ORACLES["dedup_stream"] = f"WITH {B.EVENTS_SQL} SELECT DISTINCT study_id, client_event_id FROM e"


def rollup_stream(read):
    out = runner.run_available(T.session_rollup(B.event_log(_Streaming(read))), "rollup", "update")
    return runner.latest(out, ["study_id"])


QUERIES["rollup_stream"] = streamed(rollup_stream)
ORACLES["rollup_stream"] = B.ORACLES["session_counters"]


def progress_feed(read):
    events = _Streaming(read)("events")
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "complete").otherwise("progress")
    records = events.select(
        F.floor(F.col("event_id") / 7).alias("job_id"), F.col("event_id").alias("updated_at"), kind.alias("type"),
        F.col("event_type").alias("phase"), F.col("value").alias("progress"), F.col("props").alias("message"))
    return runner.latest(runner.run_available(T.progress_feed(records), "progress", "update"), ["job_id"])


QUERIES["progress_feed"] = streamed(progress_feed)
ORACLES["progress_feed"] = """
WITH x AS (SELECT *, event_id // 7 AS job_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'complete' ELSE 'progress' END AS type FROM events)
SELECT job_id, max(event_id) AS updated_at, arg_max(type, event_id) AS type, arg_max(event_type, event_id) AS phase, arg_max(value, event_id) AS progress,
  arg_max(props, event_id) AS message, bool_or(type <> 'progress') AS finished, count(*) AS records FROM x GROUP BY job_id
"""
