"""Tool-call linking for chat data (operator 5). DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidar.llm.common import stored
from evidar.operators.slices import carry


def canonical(fields: dict[str, Column]) -> Column:
    """Canonical JSON of an object: names in order, no blanks, NULL fields as null; values are JSON texts."""
    parts = [F.concat(F.lit(f'"{name}":'), F.coalesce(fields[name], F.lit("null"))) for name in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_text(value: Column) -> Column:
    """A JSON string of a text. Control characters, quotes and backslashes are escaped, all else is kept as it is."""
    whole = F.to_json(F.struct(value.cast("string").alias("v")))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))


def faults(arguments: Column, schema: dict[str, str], required: tuple[str, ...]) -> Column:
    """Names of schema fields whose value in a JSON object is missing or of another type; 'arguments' when there is no object.

    Types are string, integer and number. A value that is there must fit its type whether it is required or not.
    """
    whole = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(whole).startswith("OBJECT"), F.lit(False))
    found = [F.when(~is_object, F.lit("arguments"))]
    fits = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL")}
    for name in sorted(schema):
        kind = F.schema_of_variant(F.try_variant_get(whole, f"$.{name}", "variant"))
        known = kind.isNotNull() & (kind != "VOID")
        right = F.lit(False)
        for start in fits[schema[name]]:
            right = right | kind.startswith(start)
        wrong = F.coalesce(known & ~right, F.lit(False))
        if name in required:
            wrong = wrong | ~F.coalesce(known, F.lit(False))
        found.append(F.when(is_object & wrong, F.lit(name)))
    return F.array_compact(F.array(*found))


def link_calls(
    calls: DataFrame, results: DataFrame, schema: dict[str, str], required: tuple[str, ...], messages: DataFrame | None = None
) -> DataFrame:
    """One row per call, per result without a call and per message: conv_id, call_id, parent_id, status, depth, faults, json.

    ``calls`` has conv_id, call_id, parent_id (the call whose result this one uses; NULL for none), name and arguments (JSON text); ``results`` has conv_id, call_id and
    content; ``messages`` are turns that are neither, with conv_id, call_id, name (who speaks) and content. Calls and results are hash-joined by conversation and identifier.
    The least contents and the chains are written to the shared folder while the plan is built. Other columns are ignored; empty tables give no rows.

    status: 'linked', 'unanswered' (no result), 'orphan' (a result without a call), 'cycle' (the call is its own
    ancestor, or uses such a call). depth is the number of ancestors, found by pointer doubling; (depth, call_id) orders a conversation so that
    every call comes after what it uses. A parent that does not exist counts as none. Of several calls or results with one identifier the
    least by content is linked; the others are kept with status 'repeated'. Rows whose conv_id or call_id is NULL are kept with status 'unnamed'.
    Messages are kept one by one with status 'message', whatever their identifiers, and are checked against no schema.
    """
    key = ["conv_id", "call_id"]
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    nothing = F.lit(None).cast("string")

    def numbered(df: DataFrame, *content: str) -> tuple[DataFrame, DataFrame]:
        """Distinct identifiers with their least content, and the number of other rows each content has."""
        counts = df.where(named).groupBy(*key, *content).agg(F.count(F.lit(1)).alias("_n"))
        best = counts.groupBy(*key).agg(F.min(F.struct(*content)).alias("_best"))
        rest = counts.join(best, key).withColumn("_n", F.col("_n") - F.struct(*content).eqNullSafe(F.col("_best")).cast("int"))
        others = rest.where("_n > 0").withColumn("_each", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
        return best.select(*key, "_best.*"), others.select(*key, *content)

    asked, more_calls = numbered(calls, "parent_id", "name", "arguments")
    asked = stored(asked, "calls")
    answered, more_results = numbered(results, "content")

    # Pointer doubling: after k rounds, up is the ancestor 2^k calls back, or NULL with depth final.
    ids = asked.select("conv_id", F.col("call_id").alias("up"), F.lit(True).alias("known"))
    chain = asked.select(*key, F.col("parent_id").alias("up")).join(ids, ["conv_id", "up"], "left")
    chain = stored(chain.select(
        *key, F.when(F.col("known"), F.col("up")).alias("up"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("depth"),
    ), "chain")
    total = chain.count()
    # No chain is longer than the table, so what is still open after these rounds is a cycle.
    for _ in range(math.ceil(math.log2(total + 1)) + 1):
        if not chain.where("up IS NOT NULL").limit(1).count():
            break
        back = chain.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        open_rows = chain.where("up IS NOT NULL").join(back, ["conv_id", "up"])
        open_rows = open_rows.select(*key, F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        chain = stored(open_rows.unionByName(chain.where("up IS NULL")), "chain")
    chain = chain.select(*key, "up", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))

    whole = asked.join(answered.withColumn("answered", F.lit(True)), key, "full").join(chain, key, "left")
    status = (
        F.when(F.col("name").isNull() & F.col("arguments").isNull() & F.col("depth").isNull() & F.col("up").isNull(), "orphan")
        .when(F.col("up").isNotNull(), "cycle").when(F.col("answered"), "linked").otherwise("unanswered")
    )
    columns = [*key, "parent_id", "name", "arguments", "content", "depth", "status"]
    out = whole.withColumn("status", status).select(*columns)
    for df, label, keep in (
        (more_calls, "repeated", ("parent_id", "name", "arguments")), (more_results, "repeated", ("content",)),
        (calls.where(~named), "unnamed", ("parent_id", "name", "arguments")), (results.where(~named), "unnamed", ("content",)),
        *([(messages, "message", ("name", "content"))] if messages is not None else []),
    ):
        fields = [F.col(c) if c in (*key, *keep) else nothing.alias(c) for c in columns[:6]]
        out = out.unionByName(df.select(*fields, F.lit(None).cast("long").alias("depth"), F.lit(label).alias("status")))

    has_call = (F.col("status") != "message") & (F.col("name").isNotNull() | F.col("arguments").isNotNull())
    checked = F.when(has_call, faults(F.col("arguments"), schema, required))
    parsed = F.try_parse_json("arguments")  # a variant keeps the names of an object in order
    record = canonical({
        "id": json_text(F.col("call_id")), "parent": json_text(F.col("parent_id")), "name": json_text(F.col("name")),
        "arguments": F.when(parsed.isNotNull(), F.to_json(parsed)).otherwise(json_text(F.col("arguments"))),
        "result": json_text(F.col("content")),
    })
    return out.select(*key, "parent_id", "status", "depth", F.concat_ws(",", checked).alias("faults"), record.alias("json"))


#: Fixed values of the registered query: arguments of the only tool, 'reply'.
REPLY_SCHEMA = {"text": "string", "turn": "integer"}


def op5_tool_calls(spark, sf_dir: str) -> DataFrame:
    """Operator 5 over all conversations.

    The table holds no tool calls, so they are read off its turns: a user turn is a call of 'reply' with its text and number,
    which uses the call of the user turn before it in the conversation, whatever stands between; the turn after it, if by the assistant, is its result.
    System turns, and any of another role, are messages.
    """
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    name = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))
    turn, role = F.col("turn"), F.coalesce("role", F.lit(""))
    asked = turns.where(role == "user")
    places = asked.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct()
    places = carry(places, ["conv_id"], None, ["turn"], prev={"previous": turn})
    arguments = canonical({"text": json_text(F.col("text")), "turn": F.coalesce(turn.cast("string"), F.lit("null"))})
    calls = asked.join(places, ["conv_id", "turn"], "left").select(
        "conv_id", name(turn).alias("call_id"), name(F.col("previous")).alias("parent_id"), F.lit("reply").alias("name"), arguments.alias("arguments")
    )
    results = turns.where(role == "assistant").select("conv_id", name(turn - 1).alias("call_id"), F.col("text").alias("content"))
    messages = turns.where(~role.isin("user", "assistant")).select("conv_id", name(turn).alias("call_id"), F.col("role").alias("name"), F.col("text").alias("content"))
    return link_calls(calls, results, REPLY_SCHEMA, ("text", "turn"), messages)


#: The same reading of the turns; a chain has no branches here, so a call's depth is its rank among the calls of its conversation.
OP5_SQL = """
WITH asked AS (
  SELECT conv_id, turn, conv_id || ':' || turn AS call_id,
         '{"text":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"turn":' || coalesce(CAST(turn AS VARCHAR), 'null') || '}' AS arguments,
         concat_ws(',', CASE WHEN text IS NULL THEN 'text' END, CASE WHEN turn IS NULL THEN 'turn' END) AS faults
  FROM conversations WHERE role = 'user'),
places AS (
  SELECT conv_id, turn, lag(turn) OVER w AS previous, row_number() OVER w - 1 AS depth
  FROM (SELECT DISTINCT conv_id, turn FROM asked WHERE call_id IS NOT NULL) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
calls AS (
  SELECT a.*, p.depth, a.conv_id || ':' || p.previous AS parent_id, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY a.arguments) AS copy
  FROM asked a LEFT JOIN places p ON p.conv_id = a.conv_id AND p.turn = a.turn),
replies AS (
  SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, text AS content, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text NULLS FIRST) AS copy
  FROM conversations WHERE role = 'assistant'),
whole AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.parent_id, c.depth, c.faults, c.arguments,
         CASE WHEN c.arguments IS NOT NULL THEN 'reply' END AS name, r.content,
         CASE WHEN c.arguments IS NULL THEN 'orphan' WHEN r.call_id IS NOT NULL THEN 'linked' ELSE 'unanswered' END AS status
  FROM (SELECT * FROM calls WHERE call_id IS NOT NULL AND copy = 1) c
  FULL JOIN (SELECT * FROM replies WHERE call_id IS NOT NULL AND copy = 1) r ON r.conv_id = c.conv_id AND r.call_id = c.call_id
  UNION ALL
  SELECT conv_id, call_id, parent_id, NULL, faults, arguments, 'reply', NULL, CASE WHEN call_id IS NULL THEN 'unnamed' ELSE 'repeated' END
  FROM calls WHERE call_id IS NULL OR copy > 1
  UNION ALL
  SELECT conv_id, call_id, NULL, NULL, NULL, NULL, NULL, content, CASE WHEN call_id IS NULL THEN 'unnamed' ELSE 'repeated' END
  FROM replies WHERE call_id IS NULL OR copy > 1
  UNION ALL
  SELECT conv_id, conv_id || ':' || turn, NULL, NULL, NULL, NULL, role, text, 'message'
  FROM conversations WHERE coalesce(role, '') NOT IN ('user', 'assistant'))
SELECT conv_id, call_id, parent_id, status, depth, coalesce(faults, '') AS faults,
       '{"arguments":' || coalesce(arguments, 'null') || ',"id":' || coalesce(CAST(to_json(call_id) AS VARCHAR), 'null')
       || ',"name":' || coalesce(CAST(to_json(name) AS VARCHAR), 'null') || ',"parent":' || coalesce(CAST(to_json(parent_id) AS VARCHAR), 'null')
       || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS json
FROM whole
"""
