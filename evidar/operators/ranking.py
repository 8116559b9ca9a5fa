"""Ranking, numbering and even selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidar.operators.slices import carry


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Catalyst cuts to ``k`` before the shuffle too,
    so a hot key sends at most ``k`` rows per map task."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def rank_hits(hits: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Best ``k`` hits per query; ties keep the chunk order."""
    return top_k(hits, ["query_id"], [F.col(score).desc(), F.col("chunk_ordinal")], k)


def with_ordinals(chunks: DataFrame, order: str) -> DataFrame:
    """Dense zero-based position of every chunk in its collection."""
    numbered = carry(chunks.drop("chunk_ordinal"), ["collection_id"], None, [order], index="chunk_ordinal")
    return numbered.withColumn("chunk_ordinal", F.col("chunk_ordinal") - 1)


def is_even_slot(position: Column, n: Column, count: int) -> Column:
    """Slot of zero-based ``position`` among ``count`` evenly spaced picks of ``n``; NULL if not picked."""
    steps = max(count - 1, 1)
    near = F.floor(position * steps / F.greatest(n - 1, F.lit(1)))
    slots = F.filter(
        F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: near + d),
        lambda i: i.between(0, count - 1) & (F.floor(i * (n - 1) / steps + 0.5) == position),
    )
    return F.when(n <= count, position).otherwise(F.try_element_at(slots, F.lit(1)))


def evenly_spaced(df: DataFrame, keys: list[str], position: str, count: int, slot: str = "slot") -> DataFrame:
    """``count`` rows per key spread over dense zero-based positions."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    picked = df.join(sizes, keys).withColumn(slot, is_even_slot(F.col(position), F.col("_size"), count))
    return picked.filter(F.col(slot).isNotNull()).drop("_size")


def first_per_locator(chunks: DataFrame, order: list[str]) -> DataFrame:
    """First chunk of every (file, kind, number)."""
    keys = ["collection_id", "file_name", "kind", "number"]
    return top_k(chunks, keys, [F.col(c) for c in order], 1, "_first").drop("_first")


def top_visuals(candidates: DataFrame, k: int = 6) -> DataFrame:
    """K7: best ``k`` visual candidates per document, then page order."""
    best = top_k(candidates, ["doc_id"], [F.col("score").desc(), F.col("number")], k, "_best").drop("_best")
    return best.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy("number", F.col("score").desc(), *[c for c in ("id",) if c in best.columns])))
