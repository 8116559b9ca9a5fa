"""The participant procedure as a fold of its actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidar.functions.expr import first_match
from evidar.operators.quantiles import exact_median
from evidar.operators.slices import evenly_sliced
from evidar.session import saved

# Actions in order and the stage each one leads to.
STEPS = {
    "acknowledge_information_sheet": "written_consent",
    "confirm_written_consent": "form1",
    "confirm_form1": "ready",
    "start": "learning",
    "finish": "form3",
    "confirm_form3": "form2",
    "confirm_form2": "done",
}
FIRST_STAGE, HALTED = "information_sheet", "halted"
NORMAL = ["time_limit", "early_completion"]
POST = ["confirm_form3", "confirm_form2"]


POSITION = "struct<ts:timestamp,seq:bigint>"


def _taken(sliced: DataFrame) -> DataFrame:
    """Accepted action of every step, one row per study, from one fold over the actions.

    An action moves exactly one stage on and leaves all others, so a slice of actions is a function of the stage it begins with. Functions of
    slices are composed in order: a study with very many actions is folded in many tasks. A stage that a slice begins with is followed through
    the slice with the place of every step it takes.
    """
    names = list(STEPS)
    code = F.array_position(F.array(*map(F.lit, names)), F.col("action")).cast("int") - 1
    goes_on = F.coalesce(F.col("reason").isin(NORMAL), F.lit(False))
    # The stage after the last step is ``done``; one more is the halted stage. Neither takes an action.
    following = F.when((F.col("action") == "finish") & ~goes_on, len(names) + 1).otherwise(code + 1)
    steps = sliced.withColumn("_code", code).where("_code >= 0").groupBy("study_id", "_slice").agg(F.sort_array(F.collect_list(F.struct(
        F.col("arrival_ts").alias("ts"), F.col("arrival_seq").alias("seq"), F.col("_code").alias("code"), following.alias("next"), "reason"))).alias("_steps"))
    none = F.transform(F.sequence(F.lit(1), F.lit(len(names))), lambda _: F.lit(None).cast(POSITION))

    def begin(stage):
        return F.struct(stage.cast("int").alias("at"), none.alias("seen"), F.lit(None).cast("string").alias("reason"))

    def move(path, step):
        hit = path["at"] == step["code"]
        here = F.struct(step["ts"].alias("ts"), step["seq"].alias("seq"))
        return F.when(hit, F.struct(
            step["next"].cast("int").alias("at"), F.transform(path["seen"], lambda x, i: F.when(i == step["code"], here).otherwise(x)).alias("seen"),
            F.when(step["code"] == names.index("finish"), step["reason"]).otherwise(path["reason"]).alias("reason"))).otherwise(path)

    starts = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), begin)
    functions = steps.select("study_id", "_slice", F.aggregate("_steps", starts, lambda paths, step: F.transform(paths, lambda p: move(p, step))).alias("_paths"))

    def compose(path, part):
        on = F.get(part["_paths"], path["at"])
        return F.when(path["at"] < len(names), F.struct(
            on["at"].alias("at"), F.zip_with(path["seen"], on["seen"], lambda a, b: F.coalesce(a, b)).alias("seen"),
            F.coalesce(path["reason"], on["reason"]).alias("reason"))).otherwise(path)

    whole = functions.groupBy("study_id").agg(F.sort_array(F.collect_list(F.struct("_slice", "_paths"))).alias("_parts"))
    path = F.aggregate("_parts", begin(F.lit(0)), compose)
    return whole.select("study_id", path.alias("_path")).select(
        "study_id", *[F.get("_path.seen", F.lit(i)).alias(name) for i, name in enumerate(names)], F.col("_path.reason").alias("finish_reason"))


def _sliced(actions: DataFrame) -> DataFrame:
    """The actions in order, in slices of equal count: the one read of ``actions``."""
    named = actions.withColumn("action", F.lower(F.trim("action"))).withColumn("arrival_seq", F.col("arrival_seq").cast("bigint"))
    return evenly_sliced(named, ["study_id"], ["arrival_ts", "arrival_seq"])


def accepted_steps(actions: DataFrame) -> DataFrame:
    """Position (ts, seq) of the accepted action of every step and the reason of ``finish``, one row per study with a known action."""
    return _taken(_sliced(actions))


def procedure_replay(actions: DataFrame) -> DataFrame:
    """Outcome of every action and the stage after it.

    ``actions``: study_id, arrival_ts, arrival_seq, action, reason (of ``finish``).
    """
    named = _sliced(actions)
    pos = F.struct(F.col("arrival_ts").alias("ts"), F.col("arrival_seq").alias("seq"))
    joined = named.join(_taken(named), "study_id", "left")
    own = first_match(((F.col("action") == step, F.col(step)) for step in STEPS), F.lit(None).cast(POSITION))
    ended = F.coalesce(pos > F.col("finish"), F.lit(False))
    eligible = ended & F.col("finish_reason").isin(NORMAL)
    later = F.coalesce(pos > own, F.lit(False))
    outcome = (
        F.when(~F.col("action").isin(list(STEPS)), "INVALID_PROCEDURE_ACTION")
        .when(F.coalesce(pos == own, F.lit(False)), "accepted")
        .when((F.col("action") == "start") & later & ended, "SESSION_ALREADY_FINISHED")
        .when(later, "idempotent")
        .when(F.col("action") == "start", "STUDY_PREREQUISITES_INCOMPLETE")
        .when(F.col("action") == "finish", "SESSION_NOT_STARTED")
        .when(F.col("action").isin(POST) & ~eligible, "POST_STUDY_NOT_ELIGIBLE")
        .otherwise("PROCEDURE_OUT_OF_ORDER")
    )
    reached = [(F.coalesce(F.col(step) <= pos, F.lit(False)), stage) for step, stage in reversed(STEPS.items())]
    halted = ended | F.coalesce(pos == F.col("finish"), F.lit(False))
    stage = F.when(halted & ~F.col("finish_reason").isin(NORMAL), HALTED).otherwise(first_match(reached, FIRST_STAGE))
    return joined.select(*actions.columns, outcome.alias("outcome"), stage.alias("stage_after"))


def procedure_funnel(actions: DataFrame) -> DataFrame:
    """How many studies reach each step, and the median time since the step before (NULL for the first)."""
    steps = accepted_steps(actions)
    names = list(STEPS)
    rows = [
        F.struct(
            F.lit(i + 1).alias("step"), F.lit(name).alias("action"), F.col(name)["ts"].alias("ts"),
            (F.col(names[i - 1])["ts"] if i else F.lit(None).cast("timestamp")).alias("before"))
        for i, name in enumerate(names)
    ]
    long = saved(steps.select(F.inline(F.array(*rows))).filter("ts IS NOT NULL").withColumn("ms", F.unix_millis("ts") - F.unix_millis("before")), "steps")
    counts = long.groupBy("step", "action").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(exact_median(long, ["step"], "ms", "median_ms"), "step", "left")
