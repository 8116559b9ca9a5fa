"""Fixed windows that start at their first request.

A window opens at the first request at or after the end of the one before, a
chain along time. The chain is found by pointer doubling: every request time
points to the time that would open the next window, and the pointers are squared
until the chain is covered, so a hot key costs a logarithmic number of joins and
never one long task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidar.operators.slices import carry
from evidar.session import checkpointed


def limiter_key(scope: Column | str, key: Column | str) -> Column:
    """Scope and key in one text; a long one is told apart by its hash."""
    whole = F.concat(scope, F.lit(":"), F.coalesce(key, F.lit("unknown")))
    return F.when(F.length(whole) > 256, F.concat(F.substring(whole, 1, 80), F.lit("#"), F.sha2(whole, 256))).otherwise(whole)


def _next_target(rows: DataFrame, width: int) -> DataFrame:
    """For rows (k, at, target or NULL): smallest target at or after ``at``."""
    cut = rows.withColumn("_slice", F.floor(F.col("at") / width))
    inside = Window.partitionBy("k", "_slice").orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy("k").orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = cut.groupBy("k", "_slice").agg(F.min("target").alias("_min")).select(
        "k", "_slice", F.min("_min").over(along).alias("_later"))
    return cut.join(later, ["k", "_slice"]).withColumn("next", F.coalesce(F.min("target").over(inside), F.col("_later"))).drop("_slice", "_later")


def _last_anchor(rows: DataFrame, width: int) -> DataFrame:
    """For rows (k, at, anchor or NULL): largest anchor at or before ``at``."""
    cut = rows.withColumn("_slice", F.floor(F.col("at") / width))
    inside = Window.partitionBy("k", "_slice").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy("k").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sooner = cut.groupBy("k", "_slice").agg(F.max("anchor").alias("_max")).select(
        "k", "_slice", F.max("_max").over(along).alias("_sooner"))
    return cut.join(sooner, ["k", "_slice"]).withColumn("opened", F.coalesce(F.max("anchor").over(inside), F.col("_sooner"))).drop("_slice", "_sooner")


def window_anchors(times: DataFrame, window_ms: int) -> DataFrame:
    """Opening times of all windows. ``times``: distinct (k, t)."""
    targets = times.select("k", F.col("t").alias("at"), F.col("t").alias("target"), F.lit(None).cast("bigint").alias("src"))
    probes = times.select("k", (F.col("t") + window_ms).alias("at"), F.lit(None).cast("bigint").alias("target"), F.col("t").alias("src"))
    width = max(window_ms, 3_600_000)
    jump = checkpointed(
        _next_target(targets.unionByName(probes), width).filter("src IS NOT NULL AND next IS NOT NULL").select("k", "src", F.col("next").alias("dst")))
    reached = checkpointed(times.groupBy("k").agg(F.min("t").alias("t")))
    while not jump.isEmpty():
        stepped = reached.withColumnRenamed("t", "src").join(jump, ["k", "src"]).select("k", F.col("dst").alias("t"))
        reached = checkpointed(reached.unionByName(stepped).distinct())
        onward = jump.select("k", F.col("src").alias("dst"), F.col("dst").alias("far"))
        jump = checkpointed(jump.join(onward, ["k", "dst"]).select("k", "src", F.col("far").alias("dst")))
    return reached


def rate_limit(requests: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """T6. ``requests``: scope, key, now_ms, seq (order of equal times)."""
    keyed = requests.withColumn("k", limiter_key("scope", "key"))
    times = keyed.select("k", F.col("now_ms").alias("t")).distinct()
    anchors = window_anchors(times, window_ms)
    width = max(window_ms, 3_600_000)
    opened = _last_anchor(
        times.join(anchors.withColumn("anchor", F.col("t")), ["k", "t"], "left").select("k", F.col("t").alias("at"), "anchor"), width
    ).select("k", F.col("at").alias("now_ms"), "opened")
    placed = carry(
        keyed.join(opened, ["k", "now_ms"]), ["k", "opened"], F.floor((F.col("now_ms") - F.col("opened")) * 64 / window_ms),
        ["now_ms", "seq"], index="nth")
    allowed = F.col("nth") <= limit
    reset = F.col("opened") + window_ms
    return placed.select(
        *requests.columns, allowed.alias("allowed"),
        F.when(allowed, F.lit(limit) - F.col("nth")).otherwise(0).cast("bigint").alias("remaining"), reset.alias("reset_at"),
        F.when(~allowed, F.greatest(F.ceil((reset - F.col("now_ms")) / 1_000), F.lit(1))).alias("retry_after_s"))
