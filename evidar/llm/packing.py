"""Best-fit packing planned on the histogram of lengths (operator 8)."""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from evidar.llm.common import blocks, stored, text_bytes

BLOCK = 1 << 20
#: Marks that end words; a run of them after letters is one piece for the splitter. No apostrophe, which it treats apart.
TAIL = ".,!?;:*$#%&|)"
SALT_ROWS = 250_000


def _plain(word: str) -> bool:
    """Latin letters only: such a word is one piece for the splitter and does not change under composition."""
    return word.isalpha() and max(word) < "ɐ" and "İ" not in word


def _byte_signs() -> dict[int, int]:
    """Bytes as the printable characters that byte-level vocabularies use: printable ones are themselves, others follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + k for k, b in enumerate(others)}


class _Words:
    """Token ids of words, each encoded once: one flat array, where each word's ids begin, how many they are, how often it was asked for.

    White space is dropped by this kind of tokenizer and separates its pieces, so ids of a text are the ids of its words in order.
    Plain words need no splitter and go to the merges at once. Number 0 stands for ``end_id``. An instance is broadcast without its
    words: a worker process unpickles it once and keeps it over all its tasks. Past ``MOST`` words only the frequent half stays.
    """

    MOST = 200_000

    def __init__(self, definition: str, end_id: int):
        self.definition, self.end_id, self.tokenizer = definition, end_id, None

    def __reduce__(self):
        return type(self), (self.definition, self.end_id)

    def open(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would only add memory
        self.tokenizer = Tokenizer.from_str(self.definition)
        self.signs = _byte_signs()
        self._number([None])
        self.flat, self.start, self.size = np.array([self.end_id], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.uses = np.ones(1, np.int64)

    def _number(self, words: list) -> None:
        self.known = defaultdict()
        self.known.default_factory = self.known.__len__
        self.known.update(zip(words, range(len(words))))

    def texts(self, texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with ``end_id`` behind it, one after the other; and how many each has."""
        if self.tokenizer is None:
            self.open()
        before, known = len(self.known), self.known
        tokens, counts = [np.zeros(0, np.int32)], []
        for text in texts:
            words = text.split()
            words.append(None)
            counts.append(len(words))
            tokens.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        self._learn(list(islice(known, before, None)))
        at = np.concatenate(tokens)
        self.uses += np.bincount(at, minlength=len(self.uses))
        sizes = self.size[at]
        ids = _gather(self.flat, self.start[at], sizes)
        lengths = np.add.reduceat(sizes, np.cumsum(counts) - counts) if counts else np.zeros(0, np.int64)
        if len(known) > self.MOST:
            self._forget()
        return ids, lengths

    def _learn(self, words: list[bytes]) -> None:
        """Ids of words that were numbered just now."""
        names, body, tail = _units(words)
        ids, first, size = self._encode(names)
        units = np.stack([body, tail], 1).ravel()
        units = units[units >= 0]
        own = size[body] + np.where(tail >= 0, size[tail] if len(size) else 0, 0)
        self.start = np.concatenate([self.start, np.cumsum(own) - own + len(self.flat)])
        self.size = np.concatenate([self.size, own])
        self.flat = np.concatenate([self.flat, _gather(ids, first[units], size[units])])
        self.uses = np.concatenate([self.uses, np.zeros(len(own), np.int64)])

    def _forget(self) -> None:
        """Keep the words asked for most, at least twice, and halve their counts."""
        order = np.argsort(-self.uses[1:], kind="stable")[: self.MOST // 2] + 1
        keep = np.concatenate([[0], order[self.uses[order] > 1]])
        words = list(self.known)
        self._number([words[k] for k in keep])
        self.flat = _gather(self.flat, self.start[keep], self.size[keep])
        self.size, self.uses = self.size[keep], self.uses[keep] // 2
        self.start = np.cumsum(self.size) - self.size

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        merge, signs = self.tokenizer.model.tokenize, self.signs
        found: list = [None] * len(words)
        rest = []
        for i, w in enumerate(words):
            if not _plain(w):
                rest.append(i)
                continue
            w = w.lower()
            found[i] = [t.id for t in merge(w if w.isascii() else w.encode().decode("latin-1").translate(signs))]
        for k in range(0, len(rest), 4096):
            group = rest[k : k + 4096]
            for i, e in zip(group, self.tokenizer.encode_batch_fast([words[i] for i in group], add_special_tokens=False)):
                found[i] = e.ids
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
        return flat, np.cumsum(size) - size, size


def _units(words: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Every word as a body and a tail of marks, so that both are encoded once."""
    numbers: dict[str, int] = {}
    body, tail = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
    for k, raw in enumerate(words):
        word = raw.decode("utf-8", "replace")
        core = word.rstrip(TAIL)
        if core != word and core and _plain(core):
            tail[k] = numbers.setdefault(word[len(core) :], len(numbers))
            word = core
        body[k] = numbers.setdefault(word, len(numbers))
    return list(numbers), body, tail


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Segments of ``flat``, one after the other."""
    ends = np.cumsum(size)
    return flat[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def token_pieces(docs: DataFrame, tokenizer_path: str, limit: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids): the ids of every whole text and ``end_id``, cut into pieces of ``limit``.

    ``ids`` holds unsigned 32-bit little-endian numbers. A NULL or empty text is one piece with ``end_id`` alone; repeated
    rows are packed as often as they occur.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        encoder = docs.sparkSession.sparkContext.broadcast(_Words(file.read(), end_id))

    def run(batches):
        for block in blocks(batches, "body", BLOCK):
            ids, lengths = encoder.value.texts(t.as_py() for t in block.column("body"))
            pieces = -(-lengths // limit)
            row = np.repeat(np.arange(len(lengths)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * limit
            length = np.minimum(limit, lengths[row] - start)
            ends, ids = np.cumsum(length), ids.astype("<u4")
            for a in range(0, len(row), 2000):
                b = min(a + 2000, len(row))
                first = int(ends[a] - length[a])
                places = np.append(0, ends[a:b] - first) * 4
                data = [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(ids[first : ends[b - 1]])]
                made = [pa.array(piece[a:b], pa.int32()), pa.array(start[a:b], pa.int64()), pa.array(length[a:b], pa.int64())]
                made += [pa.Array.from_buffers(pa.binary(), b - a, data)]
                keys = block.column("doc_id").take(pa.array(row[a:b])).combine_chunks()
                yield pa.RecordBatch.from_arrays([keys, *made], ["doc_id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def plan(histogram: dict[int, int], limit: int) -> dict[str, np.ndarray]:
    """Best fit over counts, longest first: runs of ranks within a length and the places they take.

    Equal bins are one group. An item goes to the group with the least room that holds it; its bins take as many items
    of that length as fit, so a group is used as a whole except for the last items of a length. A
    used group keeps less than half its room and every length adds at most three groups, so
    there are at most 3 * limit * log2(limit) runs however many documents there are.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    free: list[int] = []
    runs: dict[str, list[int]] = {name: [] for name in ("length", "rank", "sequence", "each", "offset")}
    bins = 0

    def keep(space: int, first: int, count: int) -> None:
        if space and count:
            if space not in room:
                room[space] = []
                insort(free, space)
            room[space].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(free, length)
            if at < len(free):
                space = free[at]
                first, count = room[space].pop()
                if not room[space]:
                    del room[space], free[at]
            else:
                space, first = limit, bins
                count = -(-left // (limit // length))
                bins += count
            each = space // length
            whole = min(count, left // each)
            for used, items in ((whole, each), (1 if whole < count and left % each else 0, left % each)):
                if used and items and left:
                    for name, value in zip(runs, (length, rank, first, items, limit - space)):
                        runs[name].append(value)
                    keep(space - items * length, first, used)
                    rank, left = rank + used * items, left - used * items
                    first, count = first + used, count - used
                if not left:
                    break
            keep(space, first, count)
    return {name: np.array(values, np.int64) for name, values in runs.items()}


def pack(pieces: DataFrame, limit: int = 4096, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with sequence_id and offset: sequences of at most ``limit`` by best fit over lengths.

    Only the histogram (at most ``limit`` rows) reaches the driver. A piece finds its place by its rank among pieces of its length. Lengths with very many
    pieces are ranked in salted parts, whose counts are summed up first, so that a length shared by a third of all rows is many tasks.
    ``length`` must be 1..limit. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = plan(histogram, limit)
    sizes = spark.createDataFrame(
        [(int(n), -(-c // SALT_ROWS)) for n, c in histogram.items()], "length long, _parts long"
    )
    rows = pieces.join(F.broadcast(sizes), "length")
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.col("_parts"))).drop("_parts")
    counts = rows.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_salt").orderBy(*order)
    rows = rows.withColumn("_rank", F.row_number().over(inside) - 1).join(counts, ["length", "_salt"])
    rows = rows.withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_salt", "_before")

    by_key = np.lexsort((runs["rank"], runs["length"]))
    table = spark.sparkContext.broadcast({name: values[by_key] for name, values in runs.items()})
    schema = T.StructType([f for f in rows.schema.fields if f.name != "_rank"])
    schema = schema.add("sequence_id", "long").add("offset", "long")

    def place(batches):
        runs = table.value
        key = (runs["length"] << 44) + runs["rank"]
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "_rank"))
            run = np.searchsorted(key, (length << 44) + rank, "right") - 1
            step = rank - runs["rank"][run]
            own = [batch.column(n) for n in batch.schema.names if n != "_rank"]
            sequence = runs["sequence"][run] + step // runs["each"][run]
            offset = runs["offset"][run] + step % runs["each"][run] * length
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence), pa.array(offset)], schema.names)

    return rows.mapInArrow(place, schema)


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 8 over all documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def packed_documents(docs: DataFrame, tokenizer_path: str, limit: int = 4096) -> DataFrame:
    """Pieces of all documents with their places; the ids themselves are kept as a checksum."""
    pieces = token_pieces(docs, tokenizer_path, limit)
    digest = stored(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    placed = pack(digest, limit, ("doc_id", "piece", "ids_crc32"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
