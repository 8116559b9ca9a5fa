"""Removal of repeated byte strings by bucket refinement over sampled suffixes (operator 10)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidar.llm.common import stored, text_bytes

GRAM = 32
STEP = 32
SEGMENT = 1 << 20
KEY = ["doc_id", "body_hash"]


def _runs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts that share their sampled suffix: (suffix, first start, last start).

    The suffix of a window of ``length`` bytes is its least ``GRAM``-byte string by hash, the leftmost of equals, so equal windows
    have their suffix at the same place. About one position in (length - GRAM) / 2 is ever sampled.
    """
    none = np.zeros(0, np.int64)
    m, width = len(data) - GRAM + 1, length - GRAM + 1
    if m < width:
        return none, none, none
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    hashed = words[:m] * np.uint64(0x9E3779B97F4A7C15)
    for k, odd in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
        hashed += words[k : m + k] * np.uint64(odd)
    hashed ^= hashed >> np.uint64(29)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    low = np.uint64(SEGMENT - 1)
    hashed = (hashed & ~low) | np.arange(m, dtype=np.uint64)
    # Minimum of every window from minima of aligned stretches, forwards and backwards.
    padded = np.full(-(-m // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = hashed
    grid = padded.reshape(-1, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(backward[: m - width + 1], forward[width - 1 : m])
    suffix = (least & low).astype(np.int64)
    change = np.zeros(len(suffix) + 1, np.int32)
    np.add.at(change, begins, 1)
    np.add.at(change, ends - length + 1, -1)
    start = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    if not len(start):
        return none, none, none
    suffix = suffix[start]
    first = np.flatnonzero(np.concatenate([[True], (suffix[1:] != suffix[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.append(first[1:], len(start)) - 1
    return suffix[first], start[first], start[last]


def sampled(texts: list[bytes], length: int):
    """(text number, suffix, first start, last start) of every run in the given texts, a bounded stretch at a time."""
    group, size = [], 0

    def flush():
        data = np.frombuffer(b"".join(part for _, _, part in group), np.uint8)
        ends = np.cumsum([len(part) for _, _, part in group])
        begins = ends - [len(part) for _, _, part in group]
        suffix, first, last = _runs(data, begins, ends, length)
        part = np.searchsorted(ends, first, "right")
        owner = np.array([k for k, _, _ in group])
        moved = np.array([a for _, a, _ in group]) - begins
        for k, a, b, c in zip(owner[part].tolist(), (suffix + moved[part]).tolist(), (first + moved[part]).tolist(), (last + moved[part]).tolist()):
            yield k, a, b, c

    for k, text in enumerate(texts):
        for a in range(0, len(text) - length + 1, SEGMENT - length + 1):
            part = text[a : a + SEGMENT]
            if size + len(part) > SEGMENT:
                yield from flush()
                group, size = [], 0
            group.append((k, a, part))
            size += len(part)
    if group:
        yield from flush()


class _Shape:
    """Byte ranges that decide which windows around a suffix can be repeated."""

    def __init__(self, length: int):
        self.length = length
        self.half = (length - GRAM) // 2

    def cores(self, text: bytes, p: int, first: int, last: int) -> tuple[int | None, int | None]:
        """Buckets of the bytes before and after a suffix: every window of the run holds one of the two ranges whole."""
        left = right = None
        if first <= p - self.half:
            left = xxhash.xxh3_64_intdigest(text[p - self.half : p + GRAM], 1)
        if last > p - self.half:
            right = xxhash.xxh3_64_intdigest(text[p : p + self.length - self.half + 1], 2)
        return left, right

    def span(self, text: bytes, p: int, first: int, last: int) -> bytes:
        """Identifier of all bytes of the windows that start in first..last, and of the place of the suffix in them."""
        return xxhash.xxh3_128_digest(text[first : last + self.length], p - first)

    def nodes(self, text: bytes, p: int, first: int, last: int):
        """A run cut at fixed distances from the suffix: (first, last, span identifier, bucket of what its windows share)."""
        for k in range((p - last) // STEP, (p - first) // STEP + 1):
            a, b = max(first, p - k * STEP - STEP + 1), min(last, p - k * STEP)
            shared = text[p - k * STEP : p - k * STEP - STEP + 1 + self.length]
            yield a, b, self.span(text, p, a, b), _signed(xxhash.xxh3_64_intdigest(shared, 3 + k))


def _signed(number: int | None) -> int | None:
    return number - (1 << 64) if number is not None and number >> 63 else number


def _documents(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    return rows.withColumn("body_hash", F.xxhash64("body"))


def _with_text(docs: DataFrame, items: DataFrame, *columns: str) -> DataFrame:
    """Documents that have ``items``, with those of each document as one list (bounded by the text's length)."""
    lists = items.groupBy(*KEY).agg(F.collect_list(F.struct(*columns)).alias("items")).withColumnsRenamed({k: f"_{k}" for k in KEY})
    rows = _documents(docs)
    match = rows.doc_id.eqNullSafe(lists._doc_id) & (rows.body_hash == lists._body_hash)
    return rows.join(lists, match).select(*KEY, "body", "items")


def _emit(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def _survivors(classes: DataFrame, core: str, own: str) -> DataFrame:
    """Of each bucket with several classes, one of them alone so far: its classes, one member each, are refined further."""
    busy = classes.groupBy(core).agg(F.min(own).alias("_lo"), F.max(own).alias("_hi"), F.min("n").alias("_n"))
    return classes.join(busy.where("_lo < _hi AND _n = 1").select(core), core, "left_semi")


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, body_hash, a, b): byte ranges whose union is every byte covered by a ``length``-byte string that starts elsewhere too.

    1. Initial buckets: suffixes sampled by least hash are put in buckets by the bytes before and after them that a window must
       share. Only documents with a bucket of two or more go on.
    2. A run of windows that share a suffix is identified by all of its bytes. Runs with an equal identifier are repeated as a
       whole. Of the classes of one bucket, one member each is refined; a class found repeated is a partner only.
    3. Refinement sorts such runs again by the identifiers of parts at fixed distances from the suffix, then of single windows. Each step
       drops what is alone in its bucket and keeps what the step before has settled.
    All counts are combined before the shuffle; texts are only moved for documents in question.
    """
    shape = _Shape(length)

    def first_buckets(batches):
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("body_hash")
            texts = batch.column("body").to_pylist()
            owner, found = [], []
            for k, p, a, b in sampled(texts, length):
                for core in shape.cores(texts[k], p, a, b):
                    if core is not None:
                        owner.append(k)
                        found.append(core)
            owner = pa.array(owner, pa.int32())
            cores = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([ids.take(owner), hashes.take(owner), cores], [*KEY, "core"])

    buckets = _documents(docs).mapInArrow(first_buckets, "doc_id long, body_hash long, core long")
    buckets = stored(buckets, "buckets")
    several = buckets.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core")
    suspects = stored(buckets.join(several, "core", "left_semi").distinct(), "suspects")

    def runs(batches):
        names = [*KEY, "p", "first", "last", "span", "core"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        for batch in batches:
            texts, keep = batch.column("body").to_pylist(), batch.column("items").to_pylist()
            keep = [{item["core"] for item in items} for items in keep]
            ids, hashes, out = batch.column("doc_id").to_pylist(), batch.column("body_hash").to_pylist(), []
            for k, p, a, b in sampled(texts, length):
                cores = [_signed(c) for c in shape.cores(texts[k], p, a, b)]
                cores = [c for c in cores if c in keep[k]]
                if cores:
                    out.append((ids[k], hashes[k], p, a, b, shape.span(texts[k], p, a, b), cores))
            yield _emit(names, kinds, out)

    flagged = _with_text(docs, suspects, "core").mapInArrow(
        runs, "doc_id long, body_hash long, p long, first long, last long, span binary, core array<long>"
    )
    flagged = stored(flagged, "runs")
    member = F.struct(*KEY, "p", "first", "last", "core")
    classes = flagged.groupBy("span").agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("one"))
    whole = flagged.join(classes.where("n > 1").select("span"), "span", "left_semi")
    open_runs = classes.select("span", "n", "one.*").withColumn("core", F.explode("core"))
    open_runs = _survivors(open_runs, "core", "span").select(*KEY, "p", "first", "last", "n").distinct()

    def cut(batches):
        names = [*KEY, "p", "first", "last", "settled", "span", "core"]
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.binary(), pa.int64()]
        for batch in batches:
            texts, ids, hashes = (batch.column(c).to_pylist() for c in ("body", "doc_id", "body_hash"))
            out = []
            for k, items in enumerate(batch.column("items").to_pylist()):
                for r in items:
                    for a, b, span, core in shape.nodes(texts[k], r["p"], r["first"], r["last"]):
                        out.append((ids[k], hashes[k], r["p"], a, b, r["n"] > 1, span, core))
            yield _emit(names, kinds, out)

    parts = _with_text(docs, open_runs, "p", "first", "last", "n").mapInArrow(
        cut, "doc_id long, body_hash long, p long, first long, last long, settled boolean, span binary, core long"
    )
    parts = stored(parts, "parts")
    member = F.struct(*KEY, "p", "first", "last", "settled", "core")
    part_classes = parts.groupBy("span").agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("one"))
    part_whole = parts.where("NOT settled").join(part_classes.where("n > 1").select("span"), "span", "left_semi")
    open_parts = part_classes.select("span", F.when(F.col("one.settled"), 2).otherwise(F.col("n")).alias("n"), "one.*")
    open_parts = _survivors(open_parts, "core", "span").select(*KEY, "p", "first", "last", "n")

    def windows(batches):
        names = [*KEY, "a", "settled", "window"]
        kinds = [pa.int64()] * 3 + [pa.bool_(), pa.binary()]
        for batch in batches:
            texts, ids, hashes = (batch.column(c).to_pylist() for c in ("body", "doc_id", "body_hash"))
            out = []
            for k, items in enumerate(batch.column("items").to_pylist()):
                for r in items:
                    for a in range(r["first"], r["last"] + 1):
                        out.append((ids[k], hashes[k], a, r["n"] > 1, shape.span(texts[k], r["p"], a, a)))
            yield _emit(names, kinds, out)

    single = _with_text(docs, open_parts, "p", "first", "last", "n").mapInArrow(
        windows, "doc_id long, body_hash long, a long, settled boolean, window binary"
    )
    single = stored(single, "windows")
    again = single.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    leaves = single.where("NOT settled").join(again, "window", "left_semi")

    spans = whole.select(*KEY, "first", "last").unionByName(part_whole.select(*KEY, "first", "last"))
    spans = spans.unionByName(leaves.select(*KEY, F.col("a").alias("first"), F.col("a").alias("last")))
    return spans.select(*KEY, F.col("first").alias("a"), (F.col("last") + length).alias("b"))


def remove_repeats(docs: DataFrame, length: int = 400, keep_text: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the remaining bytes).

    Judged on the input: a byte goes if a ``length``-byte string that covers it starts at any other place, in the same
    text or another row. NULL counts as empty. Rows that repeat are separate documents, so long ones lose every byte. NULL and repeated ids are kept apart by the
    hash of their text. Other columns are ignored.
    """
    ranges = stored(repeated_spans(docs, length), "ranges")

    def remove(batches):
        names = [*KEY, "n_removed", "n_spans", "kept_sha256", "kept"]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        for batch in batches:
            ids, hashes = batch.column("doc_id").to_pylist(), batch.column("body_hash").to_pylist()
            out = []
            for k, items in enumerate(batch.column("items").to_pylist()):
                text = batch.column("body")[k].as_py()
                kept, at, removed, runs = [], 0, 0, 0
                open_a = open_b = None
                for a, b in [*sorted((r["a"], r["b"]) for r in items), (len(text) + 1, len(text) + 1)]:
                    if open_a is None or a > open_b:
                        if open_a is not None:
                            kept.append(text[at:open_a])
                            removed, runs, at = removed + open_b - open_a, runs + 1, open_b
                        open_a, open_b = a, b
                    else:
                        open_b = max(open_b, b)
                kept.append(text[at:])
                left = b"".join(kept)
                out.append((ids[k], hashes[k], removed, runs, hashlib.sha256(left).hexdigest(), left if keep_text else None))
            yield _emit(names, kinds, out)

    changed = _with_text(docs, ranges, "a", "b").mapInArrow(
        remove, "doc_id long, body_hash long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    changed = changed.dropDuplicates(KEY).withColumnsRenamed({k: f"_{k}" for k in KEY})
    rows = _documents(docs)
    rows = rows.select(
        *KEY, F.length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("whole"), *(["body"] if keep_text else [])
    )
    match = rows.doc_id.eqNullSafe(changed._doc_id) & (rows.body_hash == changed._body_hash)
    out = rows.join(changed, match, "left")
    columns = [
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
    ]
    return out.select(*columns, *([F.coalesce("kept", "body").alias("kept")] if keep_text else []))


def op10_repeated_substrings(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 10 over all documents."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)
