"""Exact quantiles without a list per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median", accuracy: int = ACCURACY) -> DataFrame:
    """Median of a numeric column per key, the mean of the two middle values where there are two. Groups without a value have no row.

    A sketch, merged on the map side, brackets the middle: its ranks are off by one in ``accuracy`` at most. A second pass counts what lies
    below the bracket and how often each value inside it occurs; the middle is then picked from those counts.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    room = 2.0 / accuracy
    sketch = F.approx_percentile("_v", F.array(F.lit(0.5 - room), F.lit(0.5 + room)), F.lit(accuracy))
    brackets = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), sketch.alias("_s")).select(
        *keys, "_n", F.col("_s")[0].alias("_low"), F.col("_s")[1].alias("_high"))
    placed = rows.join(brackets, keys).where("_v <= _high")
    # Everything below the bracket is one counter; inside, one counter per value.
    counts = placed.groupBy(*keys, "_n", F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    along = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())
    ranked = counts.withColumn("_to", F.sum("_c").over(along)).withColumn("_from", F.col("_to") - F.col("_c"))
    first, second = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    middle = ranked.where(F.col("_v").isNotNull()).select(
        *keys, F.inline(F.transform(F.array(first, second), lambda r: F.struct(((r > F.col("_from")) & (r <= F.col("_to"))).alias("_hit"), F.col("_v").alias("_m")))))
    return middle.where("_hit").groupBy(*keys).agg((F.sum(F.col("_m").cast("double")) / 2).alias(name))
