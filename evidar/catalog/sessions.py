"""Registered queries: session logs, ingest rules, limits and the procedure."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from evidar.catalog.common import tables
from evidar.config import DEFAULT
from evidar.operators import limits, procedure
from evidar.operators import sessions as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

WEEK = replace(DEFAULT, session_ms=7 * 86_400_000)
TYPES = {"view": "source_view_opened", "click": "citation_clicked", "signup": "question_submitted",
         "purchase": "answer_shown", "error": "answer_failed"}


def event_log(t):
    """Given events as a session log: one session per user, in time order."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when((F.col("event_type") == "click") & (k % 2 == 0), "source_view_closed")
    for name, mapped in TYPES.items():
        kind = kind.when(F.col("event_type") == name, mapped)
    return t("events").select(
        F.col("user_id").alias("study_id"), F.col("ts").alias("arrival_ts"), F.col("event_id").alias("arrival_seq"),
        F.concat(F.lit("c"), k.cast("string")).alias("client_event_id"), kind.alias("type"),
        F.to_json(F.struct(F.col("value").alias("latencyMs"), F.col("value").alias("durationMs"), k.alias("anchorId"))).alias("data"))


EVENTS_SQL = """
e AS (SELECT user_id AS study_id, ts AS arrival_ts, event_id AS arrival_seq, 'c' || (props->>'$.k') AS client_event_id, (props->>'$.k')::INTEGER AS k, value,
  CASE WHEN event_type = 'click' AND (props->>'$.k')::INTEGER % 2 = 0 THEN 'source_view_closed' WHEN event_type = 'view' THEN 'source_view_opened'
       WHEN event_type = 'click' THEN 'citation_clicked' WHEN event_type = 'signup' THEN 'question_submitted'
       WHEN event_type = 'purchase' THEN 'answer_shown' ELSE 'answer_failed' END AS type FROM events)
"""


def session_table(t):
    """A session per user: a week from its first event; every tenth was never started."""
    return t("events").groupBy(F.col("user_id").alias("study_id")).agg(F.min("ts").alias("started_at")).select(
        "study_id", F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("study_id") % 4 + 1).cast("int")).alias("condition"),
        F.when(F.col("study_id") % 2 == 0, "novice").otherwise("experienced").alias("stratum"),
        F.when(F.col("study_id") % 10 == 0, "prepared").otherwise("active").alias("status"), "started_at",
        F.timestamp_millis(F.unix_millis("started_at") + WEEK.session_ms).alias("scheduled_end_at"),
        F.lit(None).cast("timestamp").alias("ended_at"), F.lit(None).cast("string").alias("completion_reason"))


SESSIONS_SQL = """
s AS (SELECT user_id AS study_id, min(ts) AS started_at, (epoch_us(min(ts)) // 1000) AS start_ms, (epoch_us(min(ts)) // 1000) + 604800000 AS end_ms,
  CASE WHEN user_id % 10 = 0 THEN 'prepared' ELSE 'active' END AS status FROM events GROUP BY user_id)
"""


def arrivals(t):
    starts = session_table(t).select("study_id", "started_at")
    log = event_log(t).join(starts, "study_id")
    lag = (F.col("arrival_seq") % 5) * 3_600_000
    client = F.unix_millis("arrival_ts") - lag
    kind = F.when(F.col("arrival_seq") % 13 == 0, F.lit("Bad type!")).otherwise(F.col("type"))
    return log.select(
        "study_id", "arrival_ts", "arrival_seq", "client_event_id", kind.alias("type"), F.timestamp_millis(client).alias("client_ts"),
        (client - F.unix_millis("started_at")).cast("double").alias("elapsed_ms"), "data")


ARRIVALS_SQL = f"""
{EVENTS_SQL}, {SESSIONS_SQL},
a AS (SELECT e.study_id, arrival_ts, (epoch_us(arrival_ts) // 1000) AS now_ms, arrival_seq, client_event_id AS id,
  CASE WHEN arrival_seq % 13 = 0 THEN 'bad type!' ELSE type END AS type, arrival_seq % 13 <> 0 AS valid,
  (epoch_us(arrival_ts) // 1000) - (arrival_seq % 5) * 3600000 AS client_ms, start_ms, end_ms, status FROM e JOIN s USING (study_id)),
w AS (SELECT *, client_ms - start_ms AS elapsed,
  client_ms - start_ms BETWEEN 0 AND 604800000 AND client_ms >= start_ms - 2000 AND client_ms <= end_ms AS inside FROM a)
"""


def ingest_events(t):
    out = S.ingest_events(arrivals(t), session_table(t), cfg=WEEK)
    return out.select("study_id", "arrival_seq", "outcome", "code", "sequence", "elapsed_ms", "finalised", F.unix_millis("server_ts").alias("server_ms"))


QUERIES["ingest_events"] = tables(ingest_events)
# The same rules as a row-by-row replay of each session.
ORACLES["ingest_events"] = f"""
WITH RECURSIVE {ARRIVALS_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY arrival_ts, arrival_seq) AS n FROM w),
r(study_id, n, seq_no, ids, seqs, next_seq, ended, dup, take, closes) AS (
  SELECT study_id, 0::BIGINT, NULL::BIGINT, []::VARCHAR[], []::BIGINT[], 1::BIGINT, FALSE, FALSE, FALSE, FALSE FROM s
  UNION ALL
  SELECT study_id, n, seq_no, CASE WHEN take THEN list_append(ids, id) ELSE ids END, CASE WHEN take THEN list_append(seqs, next_seq) ELSE seqs END,
    CASE WHEN take THEN next_seq + 1 ELSE next_seq END, ended OR closes, dup, take, closes
  FROM (SELECT r.study_id, o.n, o.arrival_seq AS seq_no, ids, seqs, next_seq, ended, o.id, list_contains(ids, o.id) AS dup,
      NOT list_contains(ids, o.id) AND status = 'active' AND NOT ended AND valid AND (now_ms < end_ms OR inside) AS take,
      NOT list_contains(ids, o.id) AND status = 'active' AND NOT ended AND now_ms >= end_ms AND NOT (inside AND NOT valid) AS closes
    FROM r JOIN o ON o.study_id = r.study_id AND o.n = r.n + 1) x)
SELECT o.study_id, o.arrival_seq, CASE WHEN dup THEN 'duplicate' WHEN take THEN 'accepted' ELSE 'rejected' END AS outcome,
  CASE WHEN dup OR take THEN NULL WHEN status <> 'active' THEN 'SESSION_NOT_ACTIVE' WHEN ended THEN 'STUDY_TIME_ENDED' ELSE 'INVALID_EVENT_TYPE' END AS code,
  CASE WHEN dup THEN seqs[list_position(ids, o.id)] WHEN take THEN next_seq - 1 END AS sequence,
  CASE WHEN take THEN least(greatest(elapsed, 0), 604800000)::BIGINT END AS elapsed_ms, take AND now_ms >= end_ms AS finalised,
  CASE WHEN take THEN least(now_ms, end_ms) END AS server_ms
FROM r JOIN o ON o.study_id = r.study_id AND o.n = r.n
"""


def session_counters(t):
    return S.session_counters(event_log(t))


COUNTERS_SQL = """
c AS (SELECT study_id, count(*) FILTER (type = 'question_submitted') AS questions, count(*) FILTER (type = 'answer_shown') AS ai_responses,
  count(*) FILTER (type = 'citation_clicked') AS citation_clicks, 0::BIGINT AS pdf_page_changes,
  coalesce(sum(floor(value + 0.5)) FILTER (type = 'source_view_closed'), 0)::BIGINT AS source_view_ms, 0::BIGINT AS window_hidden,
  coalesce(sum(floor(value + 0.5)) FILTER (type = 'answer_shown'), 0)::BIGINT AS latency_ms,
  count(*) FILTER (type = 'answer_shown' AND floor(value + 0.5) > 0) AS latency_samples, count(*) FILTER (type = 'answer_failed') AS errors FROM e GROUP BY study_id)
"""
QUERIES["session_counters"] = tables(session_counters)
ORACLES["session_counters"] = f"WITH {EVENTS_SQL}, {COUNTERS_SQL} SELECT * FROM c"


def rebuild_counters(t):
    log = S.number_events(event_log(t))
    return S.rebuild_counters(log).select("study_id", "questions", "errors", "event_sequence")


QUERIES["rebuild_counters"] = tables(rebuild_counters)
ORACLES["rebuild_counters"] = f"WITH {EVENTS_SQL}, {COUNTERS_SQL} SELECT study_id, questions, errors, n AS event_sequence FROM c JOIN (SELECT study_id, count(*) AS n FROM e GROUP BY ALL) USING (study_id)"


def session_summary(t):
    ended = session_table(t).withColumn("ended_at", F.when(F.col("status") == "active", F.col("scheduled_end_at")))
    return S.session_summary(event_log(t), ended)


QUERIES["session_summary"] = tables(session_summary)
ORACLES["session_summary"] = f"""
WITH {EVENTS_SQL}, {SESSIONS_SQL}, {COUNTERS_SQL}
SELECT s.study_id, ['A', 'B', 'C', 'D'][s.study_id % 4 + 1] AS condition, CASE WHEN s.study_id % 2 = 0 THEN 'novice' ELSE 'experienced' END AS stratum, status,
  '' AS completion_reason, strftime(make_timestamp(start_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS started_at,
  CASE WHEN status = 'active' THEN strftime(make_timestamp(end_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') ELSE '' END AS ended_at,
  1500::INTEGER AS planned_learning_seconds, CASE WHEN status = 'active' THEN 604800 ELSE 0 END::BIGINT AS actual_learning_seconds,
  questions AS total_questions, ai_responses AS total_ai_responses, citation_clicks AS total_citation_clicks, pdf_page_changes AS total_pdf_page_changes,
  floor(source_view_ms / 1000 + 0.5)::BIGINT AS total_source_view_seconds, window_hidden AS window_hidden_count,
  CASE WHEN latency_samples > 0 THEN floor(latency_ms / latency_samples + 0.5)::BIGINT ELSE 0 END AS mean_response_latency_ms, errors AS error_count
FROM s JOIN c USING (study_id)
"""


def fan_out(t):
    return S.fan_out(event_log(t)).groupBy("study_id", "category", "type").agg(F.count(F.lit(1)).alias("n"))


QUERIES["fan_out_events"] = tables(fan_out)
ORACLES["fan_out_events"] = f"""
WITH {EVENTS_SQL}, f AS (SELECT study_id, type, 'messages' AS category FROM e WHERE type LIKE 'question%' OR type LIKE 'answer%'
  UNION ALL SELECT study_id, type, 'citations' FROM e WHERE type LIKE 'citation%' OR type LIKE 'source%' UNION ALL SELECT study_id, type, 'errors' FROM e WHERE type = 'answer_failed')
SELECT study_id, category, type, count(*) AS n FROM f GROUP BY ALL
"""


def first_seen(t):
    return S.first_seen(event_log(t)).select("study_id", "client_event_id", "arrival_seq")


QUERIES["first_seen"] = tables(first_seen)
ORACLES["first_seen"] = f"WITH {EVENTS_SQL} SELECT study_id, client_event_id, arrival_seq FROM e QUALIFY row_number() OVER (PARTITION BY study_id, client_event_id ORDER BY arrival_ts, arrival_seq) = 1"


def sequence_numbers(t):
    return S.number_events(event_log(t)).select("study_id", "arrival_seq", "sequence")


QUERIES["sequence_numbers"] = tables(sequence_numbers)
ORACLES["sequence_numbers"] = f"WITH {EVENTS_SQL} SELECT study_id, arrival_seq, row_number() OVER (PARTITION BY study_id ORDER BY arrival_ts, arrival_seq) AS sequence FROM e"


def event_window(t):
    return S.events_in_window(arrivals(t), session_table(t), cfg=WEEK).select("study_id", "arrival_seq", "in_window")


QUERIES["events_in_window"] = tables(event_window)
ORACLES["events_in_window"] = f"WITH {ARRIVALS_SQL} SELECT study_id, arrival_seq, inside AS in_window FROM w"


def _numbered(t):
    log = S.number_events(event_log(t))
    starts = session_table(t).select("study_id", "started_at")
    return log.join(starts, "study_id").withColumn("elapsed_ms", F.unix_millis("arrival_ts") - F.unix_millis("started_at")).drop("started_at")


NUMBERED_SQL = """
n AS (SELECT e.*, (epoch_us(arrival_ts) // 1000) - start_ms AS elapsed_ms, start_ms, end_ms, status, row_number() OVER (PARTITION BY study_id ORDER BY arrival_ts, arrival_seq) AS sequence FROM e JOIN s USING (study_id)),
v AS (SELECT *, lead(sequence) OVER z AS next_seq, lead(type) OVER z AS next_type, lead(elapsed_ms) OVER z AS next_elapsed FROM n
  WHERE type LIKE 'source_view%' WINDOW z AS (PARTITION BY study_id ORDER BY sequence))
"""


def source_view_pairs(t):
    return S.pair_source_views(_numbered(t))


QUERIES["pair_source_views"] = tables(source_view_pairs)
ORACLES["pair_source_views"] = f"""
WITH {EVENTS_SQL}, {SESSIONS_SQL}, {NUMBERED_SQL}
SELECT study_id, sequence AS open_seq, CASE WHEN next_type = 'source_view_closed' THEN next_seq END AS close_seq,
  CASE WHEN next_type = 'source_view_closed' THEN greatest(next_elapsed - elapsed_ms, 0) END AS duration_ms FROM v WHERE type = 'source_view_opened'
"""


def finalize(t):
    sessions = session_table(t)
    reasons = F.array(*map(F.lit, ["time_limit", "early_completion", "participant_withdrawal"]))
    ends = sessions.select(
        "study_id", F.element_at(reasons, (F.col("study_id") % 3 + 1).cast("int")).alias("reason"),
        F.timestamp_millis(F.unix_millis("started_at") + (F.col("study_id") % 7 + 2) * 86_400_000).alias("ended_now"),
        F.when(F.col("study_id") % 2 == 0, F.timestamp_millis(F.unix_millis("started_at") + 86_400_000)).alias("client_ended_at"))
    appended, after, refused = S.finalize(_numbered(t), sessions, ends, WEEK)
    out = appended.select("study_id", "sequence", "type", "elapsed_ms", F.get_json_object("data", "$.durationMs").cast("bigint").alias("duration_ms"), F.lit("").alias("note"))
    states = after.select("study_id", F.lit(0).cast("bigint").alias("sequence"), "status", F.unix_millis("ended_at").alias("elapsed_ms"),
                          F.lit(None).cast("bigint").alias("duration_ms"), F.coalesce("completion_reason", F.lit("")).alias("note"))
    errors = refused.select("study_id", F.lit(-1).cast("bigint").alias("sequence"), F.col("reason").alias("type"), F.lit(None).cast("bigint").alias("elapsed_ms"),
                            F.lit(None).cast("bigint").alias("duration_ms"), F.col("error_code").alias("note"))
    return out.unionByName(states.withColumnRenamed("status", "type")).unionByName(errors)


QUERIES["finalize_sessions"] = tables(finalize)
ORACLES["finalize_sessions"] = f"""
WITH {EVENTS_SQL}, {SESSIONS_SQL}, {NUMBERED_SQL},
q AS (SELECT *, ['time_limit', 'early_completion', 'participant_withdrawal'][study_id % 3 + 1] AS reason, start_ms + (study_id % 7 + 2) * 86400000 AS now_ms,
  CASE WHEN study_id % 2 = 0 THEN start_ms + 86400000 END AS client_ms FROM s),
d AS (SELECT *, CASE WHEN status <> 'active' THEN 'SESSION_NOT_STARTED' WHEN reason = 'time_limit' AND now_ms < end_ms THEN 'STUDY_TIME_REMAINING' END AS err,
  CASE WHEN reason = 'time_limit' THEN end_ms WHEN reason = 'early_completion' AND client_ms IS NOT NULL THEN least(client_ms, now_ms) ELSE now_ms END AS fin FROM q),
l AS (SELECT study_id, max(sequence) AS last FROM n GROUP BY ALL),
x AS (SELECT d.*, last, least(greatest(fin - start_ms, 0), 604800000) AS el, o.elapsed_ms AS opened FROM d JOIN l USING (study_id)
  LEFT JOIN (SELECT study_id, elapsed_ms FROM v WHERE next_seq IS NULL AND type = 'source_view_opened') o USING (study_id) WHERE err IS NULL)
SELECT study_id, last + 1 AS sequence, 'source_view_closed' AS type, el AS elapsed_ms, greatest(el - opened, 0) AS duration_ms, '' AS note FROM x WHERE opened IS NOT NULL
UNION ALL SELECT study_id, last + CASE WHEN opened IS NULL THEN 1 ELSE 2 END, 'study_ended', el, NULL, '' FROM x
UNION ALL SELECT study_id, 0, CASE WHEN err IS NOT NULL THEN status WHEN reason = 'participant_withdrawal' THEN 'withdrawn' ELSE 'completed' END,
  CASE WHEN err IS NULL THEN fin END, NULL, CASE WHEN err IS NULL THEN reason ELSE '' END FROM d
UNION ALL SELECT study_id, -1, reason, NULL, NULL, err FROM d WHERE err IS NOT NULL
"""


def late_batch(t):
    """Events after the third day arrive late, with the end of the session."""
    everything = arrivals(t)
    cut = F.col("elapsed_ms") > 3 * 86_400_000
    logged = S.number_events(everything.filter(~cut))
    late = everything.filter(cut).withColumn("position", F.col("arrival_seq"))
    acknowledged, appended = S.late_batch(late, logged, session_table(t), None, WEEK)
    return acknowledged.select("study_id", "position", F.lit("ack").alias("part"), F.lit(None).cast("bigint").alias("sequence")).unionByName(
        appended.select("study_id", "position", F.lit("new").alias("part"), F.col("sequence").cast("bigint")))


QUERIES["late_batch"] = tables(late_batch)
ORACLES["late_batch"] = f"""
WITH {ARRIVALS_SQL}, lg AS (SELECT study_id, id FROM w WHERE elapsed <= 259200000),
f AS (SELECT * FROM w WHERE elapsed > 259200000),
u AS (SELECT * FROM f WHERE inside), nw AS (SELECT * FROM u WHERE valid AND NOT EXISTS (SELECT 1 FROM lg WHERE lg.study_id = u.study_id AND lg.id = u.id)
  QUALIFY row_number() OVER (PARTITION BY study_id, id ORDER BY arrival_seq) = 1),
m AS (SELECT study_id, count(*) AS n FROM lg GROUP BY ALL)
SELECT study_id, arrival_seq AS position, 'ack' AS part, NULL::BIGINT AS sequence FROM u WHERE EXISTS (SELECT 1 FROM lg WHERE lg.study_id = u.study_id AND lg.id = u.id)
  OR EXISTS (SELECT 1 FROM nw WHERE nw.study_id = u.study_id AND nw.id = u.id)
UNION ALL SELECT study_id, arrival_seq, 'new', coalesce(n, 0) + row_number() OVER (PARTITION BY study_id ORDER BY arrival_seq) FROM nw LEFT JOIN m USING (study_id)
"""


def public_sessions(t):
    return S.public_sessions(session_table(t), F.timestamp_millis(F.lit(1_704_412_800_000))).select("study_id", "status", "remaining_seconds")


QUERIES["public_sessions"] = tables(public_sessions)
ORACLES["public_sessions"] = f"""
WITH {SESSIONS_SQL} SELECT study_id, status, CASE WHEN status = 'active' THEN greatest(ceil((end_ms - (epoch_us(TIMESTAMP '2024-01-05 00:00:00') // 1000)) / 1000), 0) ELSE 0 END::BIGINT AS remaining_seconds FROM s
"""


def scroll_checkpoints(t):
    scrolls = t("events").select(F.col("user_id").alias("study_id"), "ts", F.get_json_object("props", "$.k").cast("int").alias("percentage"))
    return S.scroll_checkpoints(scrolls).select("study_id", "checkpoint", F.unix_millis("first_ts").alias("first_ms"))


QUERIES["scroll_checkpoints"] = tables(scroll_checkpoints)
ORACLES["scroll_checkpoints"] = """
SELECT user_id AS study_id, checkpoint, (epoch_us(min(ts)) // 1000) AS first_ms FROM events, (VALUES (25), (50), (75), (100)) v(checkpoint) WHERE (props->>'$.k')::INTEGER >= checkpoint GROUP BY ALL
"""


def first_click(t):
    clicks = t("events").filter("event_type = 'click'").select(
        F.col("user_id").alias("session_id"), (F.col("event_id") % 7).alias("message_id"), "ts", F.col("event_id").alias("source_id"),
        F.timestamp_millis(F.floor(F.unix_millis("ts") / 86_400_000) * 86_400_000).alias("generated_at"))
    return S.first_click(clicks)


QUERIES["first_click"] = tables(first_click)
ORACLES["first_click"] = """
SELECT user_id AS session_id, event_id % 7 AS message_id, count(*) AS clicks, arg_min(event_id, ts) AS source_id,
  arg_min((epoch_us(ts) // 1000) - (epoch_us(date_trunc('day', ts)) // 1000), ts)::BIGINT AS first_click_latency_ms FROM events WHERE event_type = 'click' GROUP BY ALL
"""


def rate_limit(t):
    requests = t("events").select(
        F.lit("events").alias("scope"), F.col("user_id").cast("string").alias("key"), F.unix_millis("ts").alias("now_ms"), F.col("event_id").alias("seq"))
    return limits.rate_limit(requests, 2, 86_400_000).drop("scope")


QUERIES["rate_limit"] = tables(rate_limit)
ORACLES["rate_limit"] = """
WITH RECURSIVE q AS (SELECT user_id::VARCHAR AS key, (epoch_us(ts) // 1000) AS now_ms, event_id AS seq FROM events),
a(key, t) AS (SELECT key, min(now_ms) FROM q GROUP BY key
  UNION ALL SELECT a.key, (SELECT min(now_ms) FROM q WHERE q.key = a.key AND q.now_ms >= a.t + 86400000) FROM a WHERE t IS NOT NULL),
p AS (SELECT q.*, (SELECT max(t) FROM a WHERE a.key = q.key AND a.t <= q.now_ms) AS opened FROM q),
n AS (SELECT *, row_number() OVER (PARTITION BY key, opened ORDER BY now_ms, seq) AS i FROM p)
SELECT key, now_ms, seq, i <= 2 AS allowed, CASE WHEN i <= 2 THEN 2 - i ELSE 0 END AS remaining, opened + 86400000 AS reset_at,
  CASE WHEN i > 2 THEN greatest(ceil((opened + 86400000 - now_ms) / 1000), 1)::BIGINT END AS retry_after_s FROM n
"""


# ---- procedure -------------------------------------------------------------------
ACTIONS = [*procedure.STEPS, "bogus"]
REASONS = ["time_limit", "early_completion", "participant_withdrawal"]


def _actions(t):
    k = F.get_json_object("props", "$.k").cast("int")
    name = F.element_at(F.array(*map(F.lit, ACTIONS)), (F.col("event_id") % 8 + 1).cast("int"))
    return t("events").select(
        F.col("user_id").alias("study_id"), F.col("ts").alias("arrival_ts"), F.col("event_id").alias("arrival_seq"), name.alias("action"),
        F.when(name == "finish", F.element_at(F.array(*map(F.lit, REASONS)), (k % 3 + 1).cast("int"))).alias("reason"))


def procedure_replay(t):
    return procedure.procedure_replay(_actions(t)).select("study_id", "arrival_seq", "action", "outcome", "stage_after")


QUERIES["procedure_replay"] = tables(procedure_replay)
_LIST = "[" + ", ".join(f"'{a}'" for a in ACTIONS) + "]"
_STAGES = "['information_sheet', " + ", ".join(f"'{s}'" for s in procedure.STEPS.values()) + "]"
ACTIONS_SQL = f"""
x AS (SELECT user_id AS study_id, event_id, ts, {_LIST}[event_id % 8 + 1] AS action, event_id % 8 AS a,
  CASE WHEN event_id % 8 = 4 THEN (props->>'$.k')::INTEGER % 3 < 2 END AS normal, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
"""
ORACLES["procedure_replay"] = f"""
WITH RECURSIVE {ACTIONS_SQL},
r(study_id, n, event_id, action, stage, halted, took, a) AS (
  SELECT DISTINCT study_id, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, 0::BIGINT, FALSE, FALSE, NULL::BIGINT FROM x
  UNION ALL
  SELECT r.study_id, x.n, x.event_id, x.action, CASE WHEN x.a = stage AND NOT halted AND x.a < 7 THEN stage + 1 ELSE stage END,
    halted OR (x.a = stage AND x.a = 4 AND NOT x.normal), x.a = stage AND NOT halted AND x.a < 7, x.a
  FROM r JOIN x ON x.study_id = r.study_id AND x.n = r.n + 1)
SELECT study_id, event_id AS arrival_seq, action,
  CASE WHEN a = 7 THEN 'INVALID_PROCEDURE_ACTION' WHEN took THEN 'accepted' WHEN a = 3 AND stage > 4 THEN 'SESSION_ALREADY_FINISHED' WHEN a < stage THEN 'idempotent'
    WHEN a = 3 THEN 'STUDY_PREREQUISITES_INCOMPLETE' WHEN a = 4 THEN 'SESSION_NOT_STARTED' WHEN a IN (5, 6) AND (stage < 5 OR halted) THEN 'POST_STUDY_NOT_ELIGIBLE'
    ELSE 'PROCEDURE_OUT_OF_ORDER' END AS outcome,
  CASE WHEN halted THEN 'halted' ELSE {_STAGES}[stage + 1] END AS stage_after FROM r WHERE n > 0
"""


def procedure_funnel(t):
    return procedure.procedure_funnel(_actions(t)).select("step", "action", "n", "median_ms")


QUERIES["procedure_funnel"] = tables(procedure_funnel)
ORACLES["procedure_funnel"] = f"""
WITH RECURSIVE {ACTIONS_SQL},
r(study_id, n, stage, halted, took, ms, last_ms) AS (
  SELECT DISTINCT study_id, 0::BIGINT, 0::BIGINT, FALSE, FALSE, NULL::BIGINT, NULL::BIGINT FROM x
  UNION ALL SELECT study_id, n, CASE WHEN hit THEN stage + 1 ELSE stage END, halted OR (hit AND a = 4 AND NOT normal), hit,
    CASE WHEN hit THEN now_ms - last_ms END, CASE WHEN hit THEN now_ms ELSE last_ms END
  FROM (SELECT r.study_id, x.n, stage, halted, last_ms, x.a, x.normal, epoch_us(x.ts) // 1000 AS now_ms, x.a = stage AND NOT halted AND x.a < 7 AS hit
    FROM r JOIN x ON x.study_id = r.study_id AND x.n = r.n + 1) y)
SELECT stage::INTEGER AS step, {_LIST}[stage] AS action, count(*) AS n, median(ms) AS median_ms FROM r WHERE took GROUP BY ALL
"""


# ---- product log ---------------------------------------------------------------
def message_metrics(t):
    k = F.get_json_object("props", "$.k").cast("int")
    names = {"view": "citation_view", "click": "source_click", "signup": "citation_shown", "purchase": "answer_generated", "error": "learning_time"}
    event = F.lit(None).cast("string")
    for given, name in names.items():
        event = F.when(F.col("event_type") == given, name).otherwise(event)
    data = F.to_json(F.struct((k % 2 == 0).alias("first_click"), k.alias("first_click_latency_ms"), F.col("value").alias("source_viewing_duration_ms"), k.alias("duration_ms")))
    log = t("events").select(
        F.col("user_id").alias("session_id"), F.when(F.col("user_id") % 2 == 0, "full_evidence").otherwise("baseline").alias("condition"),
        event.alias("event"), "ts", data.alias("data"))
    return S.message_metrics(log).withColumn("view_ms", F.round("view_ms", 4))


QUERIES["message_metrics"] = tables(message_metrics)
ORACLES["message_metrics"] = """
WITH x AS (SELECT *, (props->>'$.k')::INTEGER AS k FROM events)
SELECT user_id AS session_id, CASE WHEN user_id % 2 = 0 THEN 'full_evidence' ELSE 'baseline' END AS condition,
  count(*) FILTER (event_type = 'purchase') AS answers, count(*) FILTER (event_type = 'signup') AS citations_shown, count(*) FILTER (event_type = 'click') AS source_clicks,
  count(*) FILTER (event_type = 'click' AND k % 2 = 0) AS first_clicks, sum(k::DOUBLE) FILTER (event_type = 'click' AND k % 2 = 0) AS first_click_latency_ms,
  round(sum(value) FILTER (event_type = 'view'), 4) AS view_ms, max(k::DOUBLE) FILTER (event_type = 'error') AS learning_ms, 0::BIGINT AS quiz_answers FROM x GROUP BY ALL
"""


def mastery_progress(t):
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type") == "click", "feedback").when(F.col("event_type") == "signup", "mastery").when(F.col("event_type") == "view", "question").otherwise("other")
    choice = F.element_at(F.array(*map(F.lit, ["not_started", "mastered", "review_needed"])), (k % 3 + 1).cast("int"))
    value = F.when(kind == "feedback", F.when(k % 2 == 0, "helpful").otherwise("inaccurate")).when(kind == "mastery", choice)
    log = t("events").select(
        F.col("user_id").alias("workspace_id"), F.col("event_id").alias("pos"), F.unix_millis("ts").alias("ts"), kind.alias("kind"), value.alias("value"), (k % 4).alias("message_id"))
    return S.mastery_progress(log)


QUERIES["mastery_progress"] = tables(mastery_progress)
ORACLES["mastery_progress"] = """
WITH x AS (SELECT user_id AS w, event_id AS pos, (epoch_us(ts) // 1000) AS ms, event_type AS ty, (props->>'$.k')::INTEGER AS k FROM events),
b AS (SELECT w, arg_max(['not_started', 'mastered', 'review_needed'][k % 3 + 1], pos) FILTER (ty = 'signup') AS choice, max(pos) FILTER (ty = 'signup') AS cp,
  max(pos) FILTER (ty = 'view') AS qp, max(ms) FILTER (ty = 'view') AS last_ms, count(*) FILTER (ty = 'view') AS messages FROM x GROUP BY w),
f AS (SELECT w, k % 4 AS m, k % 2 AS v, pos, sum(CASE WHEN k % 2 IS DISTINCT FROM pv THEN 1 ELSE 0 END) OVER (PARTITION BY w, k % 4 ORDER BY pos) AS run
  FROM (SELECT *, lag(k % 2) OVER (PARTITION BY w, k % 4 ORDER BY pos) AS pv FROM x WHERE ty = 'click')),
g0 AS (SELECT w, m, run, count(*) AS n FROM f GROUP BY ALL),
g AS (SELECT * FROM g0 QUALIFY row_number() OVER (PARTITION BY w, m ORDER BY run DESC) = 1),
h AS (SELECT w, count(*) FILTER (n % 2 = 1) AS fb FROM g GROUP BY w)
SELECT w AS workspace_id, last_ms AS last_studied_at, messages,
  CASE WHEN coalesce(choice, 'not_started') = 'not_started' AND qp > coalesce(cp, -1) THEN 'learning' ELSE coalesce(choice, 'not_started') END AS mastery,
  coalesce(fb, 0) AS feedback_count FROM b LEFT JOIN h USING (w)
"""


# ---- sinks and expiry ----------------------------------------------------------------
def expire_sessions(t):
    due = S.expire_sessions(session_table(t), F.timestamp_millis(F.lit(1_704_715_200_000)))
    return due.select("study_id", "reason")


QUERIES["expire_sessions"] = tables(expire_sessions)
ORACLES["expire_sessions"] = f"WITH {SESSIONS_SQL} SELECT study_id, 'time_limit' AS reason FROM s WHERE status = 'active' AND end_ms <= 1704715200000"


def event_log_files(t):
    """Category folders of JSON lines, written and read back."""
    from uuid import uuid4

    from evidar.session import shared_folder
    from evidar.sources import files

    log = S.number_events(event_log(t)).select(
        F.col("study_id").cast("string").alias("studyId"), F.col("client_event_id").alias("clientEventId"), "sequence", "type", "data")
    path = f"{shared_folder(log.sparkSession)}/evidar/event-log-{uuid4().hex}"
    files.write_event_log(S.fan_out(log), path)
    back = files.read_event_log(log.sparkSession, path)
    return back.groupBy("study_id", "type").agg(F.count(F.lit(1)).alias("n"), F.max("sequence").alias("last"))


QUERIES["event_log_files"] = tables(event_log_files)
ORACLES["event_log_files"] = f"""
WITH {EVENTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY arrival_ts, arrival_seq) AS sequence FROM e)
SELECT study_id::VARCHAR AS study_id, type, count(*) * CASE WHEN type = 'answer_failed' THEN 2 ELSE 1 END AS n, max(sequence) AS last FROM n GROUP BY study_id, type
"""


def summary_csv(t):
    """The summary as CSV, written and read back as text."""
    from uuid import uuid4

    from evidar.session import shared_folder
    from evidar.sources import files

    summary = session_summary(t)
    path = f"{shared_folder(summary.sparkSession)}/evidar/summary-{uuid4().hex}"
    files.write_summary_csv(summary, path)
    schema = ", ".join(f"{c} STRING" for c in summary.columns)
    back = summary.sparkSession.read.csv(path, header=True, schema=schema, escape='"')
    return back.select("study_id", "condition", "status", "started_at", "total_questions", "mean_response_latency_ms")


QUERIES["summary_csv"] = tables(summary_csv)
ORACLES["summary_csv"] = f"""
WITH base AS ({ORACLES['session_summary']})
SELECT study_id::VARCHAR AS study_id, condition, status, started_at, total_questions::VARCHAR AS total_questions, mean_response_latency_ms::VARCHAR AS mean_response_latency_ms FROM base
"""
