"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidar.session import shared_folder


def text_bytes(name: str = "text"):
    """UTF-8 bytes of a text column; NULL counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder, densely packed, and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/evidar/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once everything made from them is stored itself; a union of such tables is taken apart by its files."""
    for table in tables:
        spark = table.sparkSession
        folders = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
        for folder in folders:
            if "/evidar/" in folder:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remainder(name: str, divisor: int):
    """crc32 of an id as text, modulo ``divisor``; a NULL id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(name).cast("string")) % divisor, F.lit(0)).cast("int")


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """The rows of all batches in blocks of about ``limit`` bytes of ``column``, whatever the size of a batch; a row is never cut."""
    kept, size = [], 0
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < batch.num_rows:
            done = int(sizes[begin - 1]) if begin else 0
            end = min(batch.num_rows, int(np.searchsorted(sizes, done + limit - size)) + 1)
            kept.append(batch.slice(begin, end - begin))
            size += int(sizes[end - 1]) - done
            begin = end
            if size >= limit:
                yield pa.Table.from_batches(kept)
                kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept)


def index_words(lists: Iterable[list]) -> tuple[list, np.ndarray, np.ndarray]:
    """Distinct words of a block, the word number of every token, and where each list begins."""
    numbers: dict = defaultdict()
    numbers.default_factory = numbers.__len__
    at, parts = [0], [np.zeros(0, np.int32)]
    for words in lists:
        parts.append(np.fromiter((numbers[w] for w in words), np.int32, len(words)))
        at.append(at[-1] + len(words))
    return list(numbers), np.concatenate(parts), np.array(at, np.int64)


def segment_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring bounds; empty segments give 0."""
    total = np.add.reduceat(np.append(values, 0.0).astype(np.float64), at[:-1]) if len(at) > 1 else np.zeros(0)
    return np.where(at[1:] > at[:-1], total, 0.0)


def by_block(
    df: DataFrame, keys: list[str], fn: Callable[[pa.Table, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str, order: list[str] | None = None
) -> DataFrame:
    """Apply ``fn`` to blocks of whole groups, with where each begins and ends; for many small groups of bounded size.

    One shuffle by key and one sort; groups are then read off the sorted stream, so a group costs no
    call into Spark. The caller bounds the rows of a key (chunks of hot keys).
    """
    ordered = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *(order or []))

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            if not table.num_rows:
                continue
            change = np.zeros(table.num_rows, bool)
            for key in keys:
                values = table.column(key).to_numpy(zero_copy_only=False)
                change[1:] |= values[1:] != values[:-1]
            starts = np.flatnonzero(change)
            last = int(starts[-1]) if len(starts) else 0
            bounds = np.concatenate([[0], starts])
            yield from fn(table.slice(0, last), bounds[:-1], bounds[1:])
            rest = table.slice(last)
        if rest is not None:
            yield from fn(rest, np.array([0]), np.array([rest.num_rows]))

    return ordered.mapInArrow(run, schema)


def by_group(
    df: DataFrame, keys: list[str], fn: Callable[[pa.Table], dict | None], schema: str, order: list[str] | None = None
) -> DataFrame:
    """Apply ``fn`` to the rows of every key, as ``by_block`` reads them."""
    def emit(table, starts, ends):
        out = None
        for a, b in zip(starts, ends):
            found = fn(table.slice(int(a), int(b - a)))
            if found:
                out = out or {name: [] for name in found}
                for name, values in found.items():
                    out[name].append(values)
        if out:
            yield pa.RecordBatch.from_pydict({name: np.concatenate(values) for name, values in out.items()})

    return by_block(df, keys, emit, schema, order)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links between numbers: (node, root), root being the least node.

    ``edges`` has the long columns a, b. Alternating stars: every node hangs its larger neighbours, then its
    smaller ones, under its least neighbour, until nothing changes (a logarithmic number of rounds in practice). Each round
    writes its links to the shared folder, which cuts the lineage and survives lost executors. Minima are
    combined before the shuffle and joined back, so a node with very many links is never one task's list.
    Nodes without a link to another node are not returned.
    """
    def tidy(df):
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def stamp(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()

    links = stored(tidy(edges), "links")
    before = stamp(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        following = stored(tidy(small.unionByName(low.select("a", F.col("m").alias("b")))), "links")
        discard(links)
        links = following
        after = stamp(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def spanning_labels(near: Callable[[int, int], np.ndarray], n: int, strip: int = 1024) -> np.ndarray:
    """Least member of the component of each of ``n`` rows; ``near(i, j)`` gives which rows link with rows i..j."""
    label = np.arange(n)
    while True:
        old = label.copy()
        for i in range(0, n, strip):
            rows = near(i, min(n, i + strip))
            label[i : i + rows.shape[0]] = np.minimum(label[i : i + rows.shape[0]], np.where(rows, label[None, :], n).min(1))
        np.minimum.at(label, old, label)
        while (label[label] != label).any():
            label = label[label]
        if (label == old).all():
            return label
