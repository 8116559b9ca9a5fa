"""Join helpers whose choice rests on a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows; reads no more than that."""
    return df.select(F.lit(1)).limit(limit + 1).count() <= limit


def join_hot(big: DataFrame, side: DataFrame, keys: list[str], spread_by: str, salts: int, small: bool) -> DataFrame:
    """Inner join of a large table with hot keys and a side that is usually small.

    A side of checked size is broadcast, so the large table is not shuffled at
    all. Beyond that size the large table is salted by ``spread_by`` and the side
    is repeated once per salt.
    """
    if small:
        return big.join(F.broadcast(side), keys)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    repeated = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*keys, "_salt"]).drop("_salt")


def hint_small(df: DataFrame, small: bool) -> DataFrame:
    """``df`` with a broadcast hint when its size was checked."""
    return F.broadcast(df) if small else df
