"""Session streams: ingest, deduplication, counters, limits and progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidar.config import DEFAULT, Config
from evidar.functions.text import redact_json
from evidar.operators.limits import limiter_key
from evidar.operators.sessions import client_id, EVENT_TYPE, fan_out, in_window, millis, session_counters

OUTCOME = (
    "arrival_seq bigint, client_event_id string, type string, outcome string, code string, sequence bigint, server_ms bigint, "
    "client_ts timestamp, elapsed_ms bigint, data string, finalised boolean"
)
STATE = "next_seq bigint, ended boolean, end_ms bigint, ids map<string,bigint>"


class _Ingest(StatefulProcessor):
    """T1 with the session in one state value: next sequence, whether it has ended, its deadline and known client ids.

    The value is read and written once per session and micro-batch. Timers end a silent session and, ``grace_ms`` after its deadline,
    clear its state; arrivals from then on are refused without it.
    """

    def __init__(self, key_name: str, session_ms: int, grace_ms: int, timers: str):
        self.key_name, self.session_ms, self.grace_ms, self.timers = key_name, session_ms, grace_ms, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", STATE)

    def _read(self) -> tuple[int, bool, int, dict]:
        next_seq, ended, end_ms, ids = self.session.get() if self.session.exists() else (1, False, 0, {})
        return next_seq, ended, end_ms, dict(ids or {})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """The session as an existing log left it."""
        row = initialState.iloc[0]
        self.session.update((int(row["next_seq"]), False, 0, {k: int(v) for k, v in dict(row["ids"]).items()}))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["arrival_ms", "arrival_seq"])
        next_seq, ended, _, ids = self._read()
        out = []
        for r in batch.itertuples(index=False):
            named = r.client_event_id is not None and r.client_event_id == r.client_event_id
            known = ids.get(r.client_event_id) if named else None
            late = r.active and r.arrival_ms >= r.end_ms
            over = late and self.grace_ms >= 0 and r.arrival_ms >= r.end_ms + self.grace_ms
            taken, code = False, None
            if known is None:
                taken = bool(r.active and not ended and not over and r.valid and (not late or r.inside))
                ended = ended or bool(over or (late and not (r.inside and not r.valid)))
                if not taken:
                    code = r.closed_code if not r.active else "STUDY_TIME_ENDED" if ended else "INVALID_EVENT_TYPE"
            sequence = next_seq if taken else known
            if taken:
                if named:
                    ids[r.client_event_id] = next_seq
                next_seq += 1
            stamp = min(r.arrival_ms, r.end_ms) if taken else None
            elapsed = None
            if taken:
                supplied = r.elapsed_ms if r.elapsed_ms == r.elapsed_ms and r.elapsed_ms is not None else stamp - r.start_ms
                elapsed = int(min(max(supplied + 0.5, 0), self.session_ms))
            outcome = "duplicate" if known is not None else "accepted" if taken else "rejected"
            out.append((key[0], r.arrival_seq, r.client_event_id if named else None, r.type, outcome, code, sequence, stamp, r.client_ts, elapsed, r.data, bool(taken and late)))
        last = batch.iloc[-1]
        end_ms = 0 if pd.isna(last["end_ms"]) else int(last["end_ms"])
        if bool(last["active"]) and self.timers != "None":
            if not ended:
                # By event time a session may still get what was sent in time; by the clock it ends at its deadline.
                self.handle.registerTimer(end_ms + (self.grace_ms if self.timers == "EventTime" else 0))
            self.handle.registerTimer(end_ms + self.grace_ms + 1)
        self.session.update((int(next_seq), bool(ended), end_ms, ids))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The deadline passed without another touch, the session ends by itself; after the grace its state goes."""
        out = []
        if self.session.exists():
            next_seq, ended, end_ms, ids = self._read()
            if not ended:
                out.append((key[0], None, None, "study_ended", "expired", None, next_seq, end_ms, None, self.session_ms, None, True))
            if expiredTimerInfo.getExpiryTimeInMs() > end_ms + self.grace_ms:
                self.session.clear()
            elif not ended:
                self.session.update((next_seq + 1, True, end_ms, ids))
        yield self._frame(out)

    def _frame(self, rows) -> pd.DataFrame:
        names = [self.key_name, "arrival_seq", "client_event_id", "type", "outcome", "code", "sequence", "server_ms", "client_ts", "elapsed_ms", "data", "finalised"]
        frame = pd.DataFrame(rows, columns=names)
        for name in ("arrival_seq", "sequence", "server_ms", "elapsed_ms"):
            frame[name] = frame[name].astype("Int64")
        frame["client_ts"] = pd.to_datetime(frame["client_ts"])
        return frame

    def close(self) -> None:
        pass


def ingest_stream(
    arrivals: DataFrame, sessions: DataFrame, delay: str = "1 hour", grace_ms: int = -1, cfg: Config = DEFAULT,
    log: DataFrame | None = None, clock: bool = False,
) -> DataFrame:
    """T1, T2 on a stream: (study_id, arrival_seq, .., outcome, code, sequence, client_ts, elapsed_ms, data). ``arrivals`` as in the batch
    operator, ``sessions`` is a table; credentials are taken out of ``data``.

    ``log``: events accepted before the stream began (study_id, client_event_id, sequence); sessions go on from there.
    With ``grace_ms`` of zero or more, arrivals that long after the deadline are refused, a session also ends by a timer, and its state is cleared
    then: by event time once the watermark passes the grace, or with ``clock`` at the deadline by the wall clock, whether or not other rows come.
    """
    kind = F.lower(F.trim("type"))
    late_code = F.when(F.col("completion_reason") == "time_limit", "STUDY_TIME_ENDED").otherwise("SESSION_NOT_ACTIVE")
    table = sessions.select("study_id", "status", "started_at", "scheduled_end_at", "completion_reason")
    rows = arrivals.join(table, "study_id", "left").select(
        "study_id", "arrival_ts", millis("arrival_ts").alias("arrival_ms"), "arrival_seq", client_id("client_event_id").alias("client_event_id"),
        kind.alias("type"), F.coalesce(kind.rlike(EVENT_TYPE), F.lit(False)).alias("valid"), "elapsed_ms", F.col("client_ts").cast("timestamp").alias("client_ts"),
        redact_json("data").alias("data"),
        in_window(millis("scheduled_end_at"), cfg).alias("inside"), F.coalesce(F.col("status") == "active", F.lit(False)).alias("active"),
        F.coalesce(millis("started_at"), F.lit(0)).alias("start_ms"), F.coalesce(millis("scheduled_end_at"), F.lit(0)).alias("end_ms"),
        F.when(F.col("status").isNull(), "STUDY_NOT_FOUND").otherwise(late_code).alias("closed_code"))
    timers = "None" if grace_ms < 0 else "ProcessingTime" if clock else "EventTime"
    if timers == "EventTime":
        rows = rows.withWatermark("arrival_ts", delay)
    before = None
    if log is not None:
        named = F.col("client_event_id").isNotNull()
        ids = log.where(named).groupBy("study_id", "client_event_id").agg(F.min("sequence").cast("long").alias("s"))
        held = ids.groupBy("study_id").agg(F.map_from_entries(F.collect_list(F.struct("client_event_id", "s"))).alias("ids"))
        last = log.groupBy("study_id").agg((F.max("sequence") + 1).cast("long").alias("next_seq"))
        none = F.create_map().cast("map<string,bigint>")
        before = last.join(held, "study_id", "left").select("study_id", "next_seq", F.coalesce("ids", none).alias("ids")).groupBy("study_id")
    key_type = dict(arrivals.dtypes)["study_id"]
    return rows.groupBy("study_id").transformWithStateInPandas(
        statefulProcessor=_Ingest("study_id", cfg.session_ms, grace_ms, timers), outputStructType=f"study_id {key_type}, {OUTCOME}",
        outputMode="Append" if timers == "EventTime" else "Update", timeMode=timers, initialState=before)


class _Limiter(StatefulProcessor):
    """T6 with the open window in state."""

    def __init__(self, limit: int, window_ms: int):
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "count bigint, reset_at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["now_ms", "seq"])
        count, reset = self.bucket.get() if self.bucket.exists() else (0, 0)
        out = []
        for r in batch.itertuples(index=False):
            now = int(r.now_ms)
            if reset <= now:
                count, reset = 0, now + self.window_ms
            allowed = count < self.limit
            count += allowed
            wait = None if allowed else max(1, -((now - reset) // 1_000))
            out.append((key[0], now, int(r.seq), bool(allowed), self.limit - count if allowed else 0, reset, wait))
        self.bucket.update((int(count), int(reset)))
        frame = pd.DataFrame(out, columns=["k", "now_ms", "seq", "allowed", "remaining", "reset_at", "retry_after_s"])
        frame["retry_after_s"] = frame["retry_after_s"].astype("Int64")
        yield frame

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """T6 on a stream of (scope, key, now_ms, seq)."""
    keyed = requests.select(limiter_key("scope", "key").alias("k"), "now_ms", "seq")
    return keyed.groupBy("k").transformWithStateInPandas(
        statefulProcessor=_Limiter(limit, window_ms),
        outputStructType="k string, now_ms bigint, seq bigint, allowed boolean, remaining bigint, reset_at bigint, retry_after_s bigint",
        outputMode="Update", timeMode="None")


def dedup_stream(events: DataFrame, delay: str = "1 day", ts: str = "arrival_ts") -> DataFrame:
    """T5: drop repeated deliveries of a client id; the state is bounded by the watermark. Rows behind it vanish; ``late.split_late`` keeps them."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["study_id", "client_event_id"])


def session_rollup(events: DataFrame) -> DataFrame:
    """Live counters per session, for update mode."""
    return session_counters(events)


def progress_feed(records: DataFrame) -> DataFrame:
    """Latest state per job, for update mode. ``records``: job_id, updated_at, type, phase, progress, message."""
    state = F.struct("updated_at", "type", "phase", "progress", "message")
    done = F.bool_or(F.col("type").isin("complete", "error"))
    return records.groupBy("job_id").agg(F.max(state).alias("s"), done.alias("finished"), F.count(F.lit(1)).alias("records")).select(
        "job_id", "s.*", "finished", "records")


def fan_out_sink(events: DataFrame, path: str, checkpoint: str):
    """S5 on a stream: category folders of JSON lines; a repeated batch replaces its own files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        fan_out(batch).write.mode("overwrite").partitionBy("category").json(f"{path}/batch_id={batch_id}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
