"""Learning sessions in batch: ingest rules, counters, summaries, finalisation.

Arrival order is (arrival_ts, arrival_seq). Everything is aggregates, joins and
sliced windows, so one session with very many events does not become one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidar.config import DEFAULT, Config
from evidar.functions.expr import half_up, safe_number
from evidar.functions.text import redact_json
from evidar.operators.ranking import top_k
from evidar.operators.slices import carry
from evidar.session import saved

# ---- fixed values ---------------------------------------------------------------
EVENT_TYPE = "^[a-z][a-z0-9_:-]{0,79}$"
CLIENT_ID = "^[A-Za-z0-9._:-]{1,128}$"
NORMAL_REASONS = ["time_limit", "early_completion"]
STATUS_OF_REASON = {"participant_withdrawal": "withdrawn", "technical_failure": "interrupted", "researcher_stop": "interrupted"}
CHECKPOINTS = [25, 50, 75, 100]
# ---- end of fixed values ----------------------------------------------------------


def millis(ts: Column | str) -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def at_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def safe_duration(c: Column) -> Column:
    number = safe_number(c)
    return F.when(number >= 0, half_up(number).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def field(name: str) -> Column:
    return F.get_json_object("data", f"$.{name}")


def is_error(kind: Column) -> Column:
    return F.contains(kind, F.lit("error")) | (kind == "answer_failed")


# ---- counters and summaries --------------------------------------------------------
def session_counters(events: DataFrame) -> DataFrame:
    """Counters per session; also runs on a stream."""
    kind = F.col("type")
    latency = F.when(kind == "answer_shown", safe_duration(field("latencyMs")))
    return events.groupBy("study_id").agg(
        F.count_if(kind == "question_submitted").alias("questions"),
        F.count_if(kind == "answer_shown").alias("ai_responses"),
        F.count_if(kind == "citation_clicked").alias("citation_clicks"),
        F.count_if(kind.isin("manual_pdf_page_changed", "pdf_page_changed")).alias("pdf_page_changes"),
        F.sum(F.when(kind == "source_view_closed", safe_duration(field("durationMs"))).otherwise(0)).alias("source_view_ms"),
        F.count_if(kind == "window_hidden").alias("window_hidden"),
        F.sum(F.when(latency > 0, latency).otherwise(0)).alias("latency_ms"),
        F.count_if(latency > 0).alias("latency_samples"),
        F.count_if(is_error(kind)).alias("errors"),
    )


def rebuild_counters(events: DataFrame) -> DataFrame:
    """Counters from the log with the highest sequence number."""
    last = events.groupBy("study_id").agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("event_sequence"))
    return session_counters(events).join(last, "study_id")


def session_summary(events: DataFrame, sessions: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One summary row per session."""
    joined = sessions.join(session_counters(events), "study_id", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    utc = lambda c: F.to_utc_timestamp(F.col(c), F.current_timezone())
    iso = lambda c: F.coalesce(F.date_format(utc(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(""))
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    seconds = half_up((millis("ended_at") - millis("started_at")) / 1_000)
    return joined.select(
        "study_id", "condition", "stratum", "status", blank("completion_reason").alias("completion_reason"),
        iso("started_at").alias("started_at"), iso("ended_at").alias("ended_at"),
        F.lit(cfg.session_ms // 1_000).alias("planned_learning_seconds"),
        F.coalesce(F.greatest(seconds, F.lit(0)), F.lit(0)).cast("bigint").alias("actual_learning_seconds"),
        count("questions").alias("total_questions"), count("ai_responses").alias("total_ai_responses"),
        count("citation_clicks").alias("total_citation_clicks"), count("pdf_page_changes").alias("total_pdf_page_changes"),
        half_up(count("source_view_ms") / 1_000).alias("total_source_view_seconds"),
        count("window_hidden").alias("window_hidden_count"),
        F.coalesce(half_up(F.try_divide("latency_ms", "latency_samples")), F.lit(0)).alias("mean_response_latency_ms"),
        count("errors").alias("error_count"),
    )


def fan_out(events: DataFrame) -> DataFrame:
    """One row per category an event belongs to."""
    kind = F.col("type")
    starts = lambda *prefixes: F.array_contains(F.array(*[kind.startswith(p) for p in prefixes]), True)
    categories = F.array_compact(F.array(
        F.when(starts("question_", "answer_") | (kind == "initial_explanation_shown"), "messages"),
        F.when(starts("citation_", "source_"), "citations"),
        F.when(is_error(kind), "errors"),
    ))
    return events.withColumn("category", F.explode(categories))


# ---- order, windows, pairs ------------------------------------------------------------
def first_seen(events: DataFrame) -> DataFrame:
    """First event per client id; events without an id stay."""
    named = events.filter("client_event_id IS NOT NULL")
    first = top_k(named, ["study_id", "client_event_id"], [F.col("arrival_ts"), F.col("arrival_seq")], 1, "_n").drop("_n")
    return first.unionByName(events.filter("client_event_id IS NULL"))


def number_events(events: DataFrame) -> DataFrame:
    """Gapless sequence per session in arrival order."""
    return carry(events, ["study_id"], None, ["arrival_ts", "arrival_seq"], index="sequence")


def in_window(end_ms: Column, cfg: Config = DEFAULT) -> Column:
    """J8 rule on elapsed_ms, client_ts and started_at."""
    start = millis("started_at")
    longest = F.greatest(F.least(end_ms - start, F.lit(cfg.session_ms)), F.lit(0))
    client = millis("client_ts")
    inside = (
        F.col("elapsed_ms").isNotNull() & (F.col("elapsed_ms") >= 0) & (F.col("elapsed_ms") <= longest)
        & (client >= start - cfg.client_slack_ms) & (client <= end_ms)
    )
    return F.coalesce(inside, F.lit(False))


def events_in_window(events: DataFrame, sessions: DataFrame, end_override: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Mark events that belong to the learning window. ``end_override``: study_id, recorded_end."""
    joined = events.join(sessions.select("study_id", "started_at", "scheduled_end_at"), "study_id", "left")
    end = millis("scheduled_end_at")
    if end_override is not None:
        joined = joined.join(end_override, "study_id", "left")
        end = F.least(end, millis("recorded_end"))
    return joined.withColumn("in_window", in_window(end, cfg)).select(*events.columns, "in_window")


def pair_source_views(events: DataFrame) -> DataFrame:
    """Every opened source view with the close that follows it, NULL if none does."""
    views = events.filter(F.col("type").isin("source_view_opened", "source_view_closed")).select(
        "study_id", "sequence", "type", "elapsed_ms")
    nxt = F.struct("sequence", "type", "elapsed_ms")
    paired = carry(views, ["study_id"], None, ["sequence"], following={"_next": nxt})
    closed = F.col("_next.type") == "source_view_closed"
    return paired.filter("type = 'source_view_opened'").select(
        "study_id", F.col("sequence").alias("open_seq"), F.when(closed, F.col("_next.sequence")).alias("close_seq"),
        F.when(closed, F.greatest(F.col("_next.elapsed_ms") - F.col("elapsed_ms"), F.lit(0))).alias("duration_ms"))


def scroll_checkpoints(scrolls: DataFrame) -> DataFrame:
    """First time each checkpoint is reached. ``scrolls``: study_id, ts, percentage."""
    reached = scrolls.withColumn("checkpoint", F.explode(F.array(*map(F.lit, CHECKPOINTS)))).filter(
        F.col("percentage") >= F.col("checkpoint"))
    return reached.groupBy("study_id", "checkpoint").agg(F.min("ts").alias("first_ts"))


def first_click(clicks: DataFrame) -> DataFrame:
    """First source click per message and its delay. ``clicks``: session_id, message_id, ts, source_id, generated_at."""
    first = clicks.groupBy("session_id", "message_id").agg(
        F.min(F.struct("ts", "source_id", "generated_at")).alias("c"), F.count(F.lit(1)).alias("clicks"))
    delay = F.greatest(millis(F.col("c.ts")) - millis(F.col("c.generated_at")), F.lit(0))
    return first.select("session_id", "message_id", "clicks", F.col("c.source_id").alias("source_id"),
                        F.coalesce(delay, F.lit(0)).alias("first_click_latency_ms"))


# ---- ingest -----------------------------------------------------------------------------
def client_id(c: Column | str) -> Column:
    trimmed = F.trim(c)
    return F.when(trimmed.rlike(CLIENT_ID), trimmed)


def ingest_events(arrivals: DataFrame, sessions: DataFrame, log: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Outcome of every arrival.

    The rules are sequential per session, yet only three facts depend on earlier arrivals: the first
    accepted arrival of each client id, the first undecided arrival at or after the deadline, and the
    number of accepted arrivals before. The first two are minima, the third a running count.

    ``arrivals``: study_id, arrival_ts, arrival_seq, client_event_id, type, client_ts, elapsed_ms, data (JSON text; P28 takes
    credentials out of it).
    ``sessions``: study_id, status, started_at, scheduled_end_at, completion_reason.
    ``log``: events already accepted (study_id, client_event_id, sequence).
    """
    pos = F.struct("arrival_ts", "arrival_seq")
    base = arrivals.withColumn("data", redact_json("data")).withColumn("client_event_id", client_id("client_event_id")).withColumn(
        "type", F.lower(F.trim("type"))).withColumn("_valid", F.coalesce(F.col("type").rlike(EVENT_TYPE), F.lit(False)))
    joined = base.join(
        sessions.select("study_id", "status", "started_at", "scheduled_end_at", "completion_reason"), "study_id", "left")
    deadline = millis("scheduled_end_at")
    active = F.coalesce(F.col("status") == "active", F.lit(False))
    staged = joined.withColumn("_inside", in_window(deadline, cfg)).withColumn(
        "_phase", F.when(~active, "closed").when(millis("arrival_ts") >= deadline, "after").otherwise("before"))

    names = ["study_id", "client_event_id"]
    firsts = staged.filter("_phase = 'before' AND _valid AND client_event_id IS NOT NULL").groupBy(*names).agg(F.min(pos).alias("_first"))
    known = staged.join(firsts, names, "left")
    past = F.lit(None).cast("bigint")
    if log is not None:
        old = log.filter("client_event_id IS NOT NULL").groupBy(*names).agg(F.min("sequence").alias("_old"))
        known, past = known.join(old, names, "left"), F.col("_old")
    known = known.withColumn("_past", past)
    repeated = F.col("_past").isNotNull() | F.coalesce(F.col("_first") < pos, F.lit(False))
    known = known.withColumn("_repeat", repeated)
    ending = known.filter("_phase = 'after' AND NOT _repeat AND NOT (_inside AND NOT _valid)").groupBy("study_id").agg(
        F.min(F.struct(pos.alias("at"), F.col("_inside").alias("taken"), F.col("client_event_id").alias("id"))).alias("_end"))
    decided = known.join(ending, "study_id", "left")
    at_end = pos == F.col("_end.at")
    echo = (pos > F.col("_end.at")) & F.col("_end.taken") & (F.col("client_event_id") == F.col("_end.id"))
    timed_out = F.coalesce((F.col("_phase") == "after") & (pos >= F.col("_end.at")), F.lit(False))
    outcome = (
        F.when(F.col("status").isNull(), "rejected")
        .when(F.col("_repeat") | F.coalesce(echo, F.lit(False)), "duplicate")
        .when((F.col("_phase") == "before") & F.col("_valid"), "accepted")
        .when((F.col("_phase") == "after") & F.coalesce(at_end & F.col("_inside"), F.lit(False)), "accepted")
        .otherwise("rejected")
    )
    late_code = F.when(F.col("completion_reason") == "time_limit", "STUDY_TIME_ENDED").otherwise("SESSION_NOT_ACTIVE")
    code = (
        F.when(F.col("status").isNull(), "STUDY_NOT_FOUND").when(timed_out, "STUDY_TIME_ENDED")
        .when(F.col("_phase") == "closed", late_code).otherwise("INVALID_EVENT_TYPE")
    )
    decided = decided.withColumn("outcome", outcome).withColumn("code", F.when(F.col("outcome") == "rejected", code))
    finalised = (F.col("_phase") == "after") & (F.col("outcome") == "accepted")
    decided = saved(decided.select(
        *arrivals.columns, "started_at", "scheduled_end_at", "outcome", "code", F.col("_past"), finalised.alias("finalised")), "outcomes")

    taken = decided.filter("outcome = 'accepted'")
    offset = F.lit(0)
    if log is not None:
        top = log.groupBy("study_id").agg(F.max("sequence").alias("_base"))
        taken, offset = taken.join(top, "study_id", "left"), F.coalesce(F.col("_base"), F.lit(0))
    numbered = number_events(taken).withColumn("sequence", F.col("sequence") + offset)
    start = millis("started_at")
    stamp = F.when(F.col("finalised"), millis("scheduled_end_at")).otherwise(millis("arrival_ts"))
    own = F.least(F.greatest(half_up(F.col("elapsed_ms")), F.lit(0)), F.lit(cfg.session_ms))
    served = F.least(F.greatest(stamp - start, F.lit(0)), F.lit(cfg.session_ms))
    accepted = numbered.withColumn("server_ts", at_millis(stamp)).withColumn(
        "elapsed_ms", F.coalesce(own, served).cast("bigint"))
    originals = accepted.filter("client_event_id IS NOT NULL").groupBy(*names).agg(F.min("sequence").alias("_original"))
    others = decided.filter("outcome <> 'accepted'").join(originals, names, "left").withColumn(
        "sequence", F.when(F.col("outcome") == "duplicate", F.coalesce("_past", "_original"))
    ).withColumn("server_ts", F.lit(None).cast("timestamp")).withColumn("elapsed_ms", F.lit(None).cast("bigint"))
    columns = ["study_id", "arrival_ts", "arrival_seq", "client_event_id", "type", "outcome", "code", "sequence",
               "server_ts", "client_ts", "elapsed_ms", "data", "finalised"]
    return accepted.select(*columns).unionByName(others.select(*columns))


def late_batch(pending: DataFrame, events: DataFrame, sessions: DataFrame, ends: DataFrame | None = None, cfg: Config = DEFAULT, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """T4: pending events delivered with the end of a session: (acknowledged, appended); the first ``limit`` of each if given.

    ``pending``: study_id, position, client_event_id, type, client_ts, elapsed_ms, data.
    """
    first = pending if limit is None else top_k(pending, ["study_id"], [F.col("position")], limit, "_n").drop("_n")
    usable = events_in_window(first.withColumn("client_event_id", client_id("client_event_id")), sessions, ends, cfg).filter(
        "in_window AND client_event_id IS NOT NULL").drop("in_window")
    names = ["study_id", "client_event_id"]
    logged = events.select(*names).distinct()
    new = usable.join(logged, names, "left_anti").filter(F.lower(F.trim("type")).rlike(EVENT_TYPE))
    once = top_k(new, names, [F.col("position")], 1, "_n").drop("_n")
    numbered = carry(once, ["study_id"], None, ["position"], index="_nth")
    last = events.groupBy("study_id").agg(F.max("sequence").alias("_last"))
    appended = numbered.join(last, "study_id", "left").withColumn(
        "sequence", F.coalesce("_last", F.lit(0)) + F.col("_nth")).drop("_nth", "_last")
    acknowledged = usable.join(logged.unionByName(once.select(*names)).distinct(), names, "left_semi").select("study_id", "position", "client_event_id")
    return acknowledged, appended


# ---- finalisation -----------------------------------------------------------------------
def expire_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    """End requests for the active sessions whose deadline has come."""
    due = sessions.filter((F.col("status") == "active") & (F.col("scheduled_end_at") <= now))
    return due.select("study_id", F.lit("time_limit").alias("reason"), now.alias("ended_now"), F.lit(None).cast("timestamp").alias("client_ended_at"))


def finalize(events: DataFrame, sessions: DataFrame, ends: DataFrame, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events to append, sessions after the end, and refused end requests.

    ``events``: study_id, sequence, type, elapsed_ms, data.  ``ends``: study_id, reason, ended_now, client_ended_at.
    """
    start, deadline, now = millis("started_at"), millis("scheduled_end_at"), millis("ended_now")
    asked = sessions.join(ends, "study_id")
    client = millis("client_ended_at")
    early = (F.col("reason") == "early_completion") & F.col("client_ended_at").isNotNull()
    bad_client = early & ((client < start) | (client > deadline) | (client > now + cfg.client_slack_ms))
    error = (
        F.when((F.col("status") != "active") | F.col("started_at").isNull(), "SESSION_NOT_STARTED")
        .when((F.col("reason") == "time_limit") & (now < deadline), "STUDY_TIME_REMAINING")
        .when(bad_client, "INVALID_EARLY_COMPLETION_TIME")
    )
    end_ms = F.when(F.col("reason") == "time_limit", deadline).when(early, F.least(client, now)).otherwise(now)
    asked = asked.withColumn("error_code", error).withColumn("_end_ms", end_ms)
    refused = asked.filter("error_code IS NOT NULL").select("study_id", "reason", "error_code")
    good = asked.filter("error_code IS NULL")

    view = F.struct(F.col("sequence").alias("at"), "type", "elapsed_ms", "data")
    views = F.col("type").isin("source_view_opened", "source_view_closed")
    state = events.groupBy("study_id").agg(F.max("sequence").alias("_last"), F.max(F.when(views, view)).alias("_view"))
    closing = good.join(state, "study_id", "left").withColumn("_last", F.coalesce("_last", F.lit(0)))
    elapsed = F.least(F.greatest(F.col("_end_ms") - start, F.lit(0)), F.lit(cfg.session_ms))
    open_view = F.coalesce(F.col("_view.type") == "source_view_opened", F.lit(False))
    duration = F.greatest(elapsed - F.coalesce(safe_duration(F.col("_view.elapsed_ms").cast("string")), F.lit(0)), F.lit(0))
    close_data = F.to_json(F.struct(
        F.get_json_object("_view.data", "$.anchorId").alias("anchorId"), duration.alias("durationMs"),
        F.lit(True).alias("synthetic"), F.col("reason").alias("closureReason")))
    row = lambda seq, kind, data: F.struct(
        seq.cast("bigint").alias("sequence"), F.lit(kind).alias("type"), at_millis(F.col("_end_ms")).alias("server_ts"),
        elapsed.cast("bigint").alias("elapsed_ms"), data.alias("data"))
    close = row(F.col("_last") + 1, "source_view_closed", close_data)
    end = row(F.col("_last") + F.when(open_view, 2).otherwise(1), "study_ended", F.to_json(F.struct("reason")))
    appended = closing.select("study_id", F.inline(F.array_compact(F.array(F.when(open_view, close), end))))
    status = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS_OF_REASON.items() for x in kv]), F.col("reason")), F.lit("completed"))
    done = good.select("study_id", status.alias("_status"), F.col("reason").alias("_reason"), at_millis(F.col("_end_ms")).alias("_ended"))
    after = sessions.join(done, "study_id", "left").withColumn("status", F.coalesce("_status", "status")).withColumn(
        "completion_reason", F.coalesce("_reason", "completion_reason")).withColumn("ended_at", F.coalesce("_ended", "ended_at"))
    return appended, after.drop("_status", "_reason", "_ended"), refused


def public_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    """Participant view without condition, stratum, token and counters."""
    left = F.ceil((millis("scheduled_end_at") - millis(now)) / 1_000)
    hidden = ["session_token_hash", "event_sequence", "counters", "condition", "stratum"]
    return sessions.withColumn(
        "remaining_seconds",
        F.when((F.col("status") == "active") & F.col("scheduled_end_at").isNotNull(), F.greatest(left, F.lit(0))).otherwise(0).cast("bigint"),
    ).drop(*hidden)


# ---- product log ---------------------------------------------------------------------------
def message_metrics(log: DataFrame) -> DataFrame:
    """Product log per condition and session. ``log``: session_id, condition, event, ts, data (JSON)."""
    number = lambda name: safe_number(field(name))
    event = F.col("event")
    first = (event == "source_click") & (field("first_click") == "true")
    return log.groupBy("condition", "session_id").agg(
        F.count_if(event == "answer_generated").alias("answers"), F.count_if(event == "citation_shown").alias("citations_shown"),
        F.count_if(event == "source_click").alias("source_clicks"), F.count_if(first).alias("first_clicks"),
        F.sum(F.when(first, number("first_click_latency_ms"))).alias("first_click_latency_ms"),
        F.sum(F.when(event == "citation_view", number("source_viewing_duration_ms"))).alias("view_ms"),
        F.max(F.when(event == "learning_time", number("duration_ms"))).alias("learning_ms"),
        F.count_if(event == "quiz_answer").alias("quiz_answers"),
    )


def mastery_progress(log: DataFrame) -> DataFrame:
    """Study progress per workspace. ``log``: workspace_id, pos, ts, kind (question, mastery, feedback), value, message_id."""
    kind = F.col("kind")
    base = log.groupBy("workspace_id").agg(
        F.max_by(F.when(kind == "mastery", F.col("value")), F.when(kind == "mastery", F.col("pos"))).alias("_choice"),
        F.max(F.when(kind == "mastery", F.col("pos"))).alias("_chosen_at"),
        F.max(F.when(kind == "question", F.col("pos"))).alias("_asked_at"),
        F.max(F.when(kind == "question", F.col("ts"))).alias("last_studied_at"),
        F.count_if(kind == "question").alias("messages"),
    )
    asked_after = F.col("_asked_at") > F.coalesce("_chosen_at", F.lit(-1))
    choice = F.coalesce("_choice", F.lit("not_started"))
    lifted = F.when((choice == "not_started") & F.coalesce(asked_after, F.lit(False)), "learning").otherwise(choice)
    # Feedback: the last value stands if it ends an odd run of equal clicks.
    clicks = log.filter("kind = 'feedback'").select("workspace_id", "message_id", "pos", "value")
    keys = ["workspace_id", "message_id"]
    last = clicks.groupBy(*keys).agg(F.max_by("value", "pos").alias("_last"))
    other = clicks.join(last, keys).filter("value <> _last").groupBy(*keys).agg(F.max("pos").alias("_other_at"))
    runs = clicks.join(last, keys).join(other, keys, "left").filter(
        (F.col("value") == F.col("_last")) & (F.col("pos") > F.coalesce("_other_at", F.lit(-1)))
    ).groupBy(*keys).agg(F.count(F.lit(1)).alias("_run"))
    feedback = runs.groupBy("workspace_id").agg(F.count_if(F.col("_run") % 2 == 1).alias("feedback_count"))
    return base.withColumn("mastery", lifted).join(feedback, "workspace_id", "left").fillna(0, ["feedback_count"]).drop(
        "_choice", "_chosen_at", "_asked_at")
