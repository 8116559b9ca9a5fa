"""Running windows that stay parallel inside one hot key.

A plain window over a key runs in one task. Here every key is cut into slices
along its order; a slice is windowed on its own and what earlier or later
slices contribute is carried over from one small summary row per slice. Slices
have about equal numbers of rows, whatever the values of the order are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidar.session import saved


def evenly_sliced(df: DataFrame, keys: list[str], order: list[str], slices: int | None = None) -> DataFrame:
    """``df`` with ``_slice``, which never decreases along keys and order: ranges of about equal size by sampled bounds.

    A burst of a key in one moment is many slices, a key with few rows is one. Written to the shared folder, so that both the
    summaries and the rows see the same bounds and what comes before is computed once.
    """
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(df.repartitionByRange(n, *keys, *order).withColumn("_slice", F.spark_partition_id()), "slices")


def carry(
    df: DataFrame,
    keys: list[str],
    part: Column | None,
    order: list[str],
    index: str | None = None,
    before: dict[str, Column] | None = None,
    prev: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
) -> DataFrame:
    """Position, running sums before the row, previous and next values.

    ``part`` must never decrease along ``order``; without it, slices are of equal count. Keys and order are not NULL.
    """
    before, prev, following = before or {}, prev or {}, following or {}
    df = evenly_sliced(df, keys, order) if part is None else df.withColumn("_slice", part)
    at = F.struct(*order)
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.sum(e).alias(f"_s_{n}") for n, e in before.items()]
    aggs += [F.max_by(F.struct(e.alias("v")), at).alias(f"_p_{n}") for n, e in prev.items()]
    aggs += [F.min_by(F.struct(e.alias("v")), at).alias(f"_f_{n}") for n, e in following.items()]
    totals = df.groupBy(*keys, "_slice").agg(*aggs)

    along = Window.partitionBy(*keys).orderBy("_slice")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_slice",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"),
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_s_{n}") for n in before],
        *[F.lag(f"_p_{n}").over(along).alias(f"_p_{n}") for n in prev],
        *[F.lead(f"_f_{n}").over(along).alias(f"_f_{n}") for n in following],
    )
    out = df.join(carried, [*keys, "_slice"], "left")
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    inside_before = inside.rowsBetween(Window.unboundedPreceding, -1)
    if index:
        out = out.withColumn(index, F.col("_n") + F.row_number().over(inside))
    for n, e in before.items():
        out = out.withColumn(n, F.col(f"_s_{n}") + F.coalesce(F.sum(e).over(inside_before), F.lit(0)))
    for n, e in prev.items():
        out = out.withColumn(n, F.coalesce(F.lag(F.struct(e.alias("v"))).over(inside), F.col(f"_p_{n}"))["v"])
    for n, e in following.items():
        out = out.withColumn(n, F.coalesce(F.lead(F.struct(e.alias("v"))).over(inside), F.col(f"_f_{n}"))["v"])
    helpers = ["_slice", "_n"] + [f"_s_{n}" for n in before] + [f"_p_{n}" for n in prev] + [f"_f_{n}" for n in following]
    return out.drop(*helpers)


def time_slice(ts: str, seconds: int = 3_600) -> Column:
    """Slice number of a timestamp column."""
    return F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds)


def number_slice(value: str, width: int = 65_536) -> Column:
    """Slice number of a numeric order column."""
    return F.floor(F.col(value) / width)
