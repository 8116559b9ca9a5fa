"""Document probability under a subword lattice (operator 6)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidar.llm.common import blocks, index_words, remainder, segment_sums, stored, text_bytes

BLOCK = 32 << 20
WORDS = 50_000
#: The mark of a word's begin in the vocabulary; inside this module it is a blank, which no word contains.
MARK = "▁"
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(model_file: str) -> list[tuple[bytes, float]]:
    """Pieces of a sentencepiece model with their own scores; every single byte is a piece, so any word has a segmentation.

    Left out are pieces that can't occur: control marks, upper-case A-Z, and a word's begin inside a piece.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    found: dict[bytes, float] = {}
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if model.is_control(k) or model.is_unknown(k) or model.is_unused(k) or MARK in piece[1:]:
            continue
        raw = bytes([int(piece[3:-1], 16)]) if model.is_byte(k) else piece.replace(MARK, " ").encode()
        if raw == raw.lower() and raw not in found:
            found[raw] = model.get_score(k)
    for b in range(256):
        found.setdefault(bytes([b]), min(found.values()))
    return sorted(found.items())


class Lattice:
    """All segmentations of words into pieces, many words of one length at a time, in log space."""

    def __init__(self, pieces: list[bytes], weights: np.ndarray):
        self.weights = weights
        self.longest = max(map(len, pieces))
        self.tables = []
        for n in range(1, self.longest + 1):
            own = [k for k, p in enumerate(pieces) if len(p) == n]
            raw = np.frombuffer(b"".join(pieces[k] for k in own), np.uint8).reshape(len(own), n)
            h = np.zeros(len(own), np.uint64)
            for j in range(n):
                h = self._step(h, raw[:, j])
            by = np.argsort(h)
            self.tables.append((h[by], np.array(own, np.int64)[by], raw[by]))

    @staticmethod
    def _step(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
        h = (h + byte.astype(np.uint64) + np.uint64(1)) * FACTOR
        return h ^ (h >> np.uint64(31))

    def _arcs(self, words: np.ndarray):
        """(from, to, rows, pieces) for every place where a piece matches."""
        count, n = words.shape
        for i in range(n):
            h = np.zeros(count, np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = self._step(h, words[:, j - 1])
                known, own, raw = self.tables[j - i - 1]
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rows = np.flatnonzero(known[at] == h)
                    if len(rows):
                        rows = rows[(raw[at[rows]] == words[rows, i:j]).all(1)]
                    if len(rows):
                        yield i, j, rows, own[at[rows]]

    def log_probability(self, words: np.ndarray, counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """Log of the summed probability of all segmentations of every word (rows of bytes of one length).

        With ``counts``, the expected use of every piece is added to ``expected``.
        """
        count, n = words.shape
        forward = np.full((n + 1, count), -np.inf)
        forward[0] = 0.0
        arcs = []
        for i, j, rows, pieces in self._arcs(words):
            forward[j, rows] = np.logaddexp(forward[j, rows], forward[i, rows] + self.weights[pieces])
            if counts is not None:
                arcs.append((i, j, rows, pieces))
        if counts is not None:
            backward = np.full((n + 1, count), -np.inf)
            backward[n] = 0.0
            for i, j, rows, pieces in reversed(arcs):
                through = backward[j, rows] + self.weights[pieces]
                backward[i, rows] = np.logaddexp(backward[i, rows], through)
                np.add.at(expected, pieces, np.exp(forward[i, rows] + through - forward[n, rows]) * counts[rows])
        return forward[n]

    def by_length(self, words: list[bytes]):
        """Row numbers and bytes of marked words of one length."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            # A word of thousands of bytes needs as many steps; rows are cut so that a step stays bounded.
            for part in np.array_split(rows, -(-len(rows) * (int(n) + 2) // 4_000_000)):
                raw = np.frombuffer(b"".join(b" " + words[k] for k in part), np.uint8)
                yield part, raw.reshape(len(part), int(n) + 1)


def _read(docs: DataFrame, kinds: int) -> DataFrame:
    """Blocks of documents as one table: distinct words of a block with training counts by kind, and documents as word numbers."""
    counts = [f"n{z}" for z in range(kinds)]
    types = {
        "block": pa.int64(), "number": pa.int32(), "word": pa.binary(), **{c: pa.int32() for c in counts}, "doc_id": pa.int64(),
        "kind": pa.int32(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "payload": pa.binary(),
    }
    schema = "block long, number int, word binary, " + "".join(f"{c} int, " for c in counts)
    schema += "doc_id long, kind int, held_out boolean, n_tokens long, payload binary"

    def run(batches):
        part = TaskContext.get().partitionId()
        for k, block in enumerate(blocks(batches, "body", BLOCK)):
            words, flat, at = index_words(t.as_py().lower().split() for t in block.column("body"))
            held, kind = np.array(block.column("held_out").to_pylist(), bool), block.column("kind").to_numpy()
            size, owner = np.diff(at), np.repeat(np.arange(block.num_rows), np.diff(at))
            n = [np.bincount(flat[((kind == z) & ~held)[owner]], minlength=len(words)) for z in range(kinds)]
            payload = []
            for d in range(block.num_rows):
                number, uses = np.unique(flat[at[d] : at[d + 1]], return_counts=True)
                payload.append(np.diff(number, prepend=0).astype("<i4").tobytes() + uses.astype("<i4").tobytes())

            def batch(rows, **columns):
                fields = {"block": np.full(rows, (part << 24) + k), **columns}
                made = [pa.array(fields[c], t) if c in fields else pa.nulls(rows, t) for c, t in types.items()]
                return pa.RecordBatch.from_arrays(made, list(types))

            yield batch(
                block.num_rows, doc_id=block.column("doc_id").to_pylist(), kind=kind, held_out=held, n_tokens=size + 1, payload=payload,
            )
            for a in range(0, len(words), WORDS):
                own = words[a : a + WORDS]
                yield batch(
                    len(own), number=np.arange(a, a + len(own)), word=own, **{c: n[z][a : a + WORDS] for z, c in enumerate(counts)}
                )

    return stored(docs.mapInArrow(run, schema), "blocks")


def score_documents(
    docs: DataFrame, held_out, model_file: str, kind: str | None = None, kinds: int = 6, rounds: int = 2, prior: float = 0.1,
    discount: float = 0.75,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    ``held_out`` is a boolean column of rows that are scored but not learned from. Words are runs without ASCII blanks, A-Z lower-cased; every text
    ends with one end token, and NULL counts as empty.

    Pieces come from an existing vocabulary. Its scores, which rank the pieces, give the first weights; ``rounds`` passes over all distinct
    training words replace them by the expected use of each piece over all segmentations plus ``prior``. A word's lattice has
    an arc for every piece and one for the whole word: the whole word has its training count less ``discount``, the paths of pieces share what is taken off.
    With ``kind``, whole-word arcs are learned for the ``kinds`` - 1 most frequent values of that column and for all others together, and a
    text's probability is the mixture over kinds; the column of a scored text is not looked at. Probabilities of all texts sum to one.

    Words are counted per block of about 32 MB first, so one row per distinct word and block is shuffled, not one per token.
    Without any training text, paths of pieces and the end share the probability evenly.
    """
    spark = docs.sparkSession
    names: list[str] = []
    if kind:
        top = docs.where(~held_out).groupBy(F.col(kind).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        names = [r["v"] for r in top.where("v IS NOT NULL").orderBy(F.desc("n"), "v").limit(kinds - 1).collect()]
    number = F.lit(0)
    for z, name in enumerate(names, 1):
        number = F.when(F.col(kind).cast("string") == name, z).otherwise(number)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), number.alias("kind"), text_bytes().alias("body")
    )
    many = len(names) + 1
    counts = [f"n{z}" for z in range(many)]
    read = _read(rows, many)
    words = read.where("number IS NOT NULL").select("block", "number", "word", *counts)
    texts = read.where("number IS NULL").select("block", "doc_id", "held_out", "n_tokens", "payload")
    counted = stored(words.groupBy("word").agg(*[F.sum(c).alias(c) for c in counts]), "words")
    everywhere = sum((F.col(c) for c in counts[1:]), F.col(counts[0]))

    ended = {r["kind"]: r["n"] for r in read.where("NOT held_out").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    ends = np.array([ended.get(z, 0) for z in range(many)], np.float64)
    sums = counted.agg(
        *[F.sum(c) for c in counts], *[F.sum((F.col(c) > 0).cast("long")) for c in counts], F.sum((everywhere > 0).cast("long"))
    ).first()
    uses = np.array([v or 0 for v in sums[:many]], np.float64)
    kinds_of = np.array([v or 0 for v in sums[many : 2 * many]], np.float64)
    distinct, total = (sums[2 * many] or 0) + int(ends.sum() > 0), int(uses.sum() + ends.sum())

    ranked = vocabulary(model_file)
    pieces = [p for p, _ in ranked]
    order = np.argsort([-s for _, s in ranked], kind="stable")
    share = np.empty(len(pieces))
    share[order] = 1.0 / (np.arange(len(pieces)) + 2.0)
    for turn in range(rounds + 1):
        shared = spark.sparkContext.broadcast((pieces, np.log(share / share.sum())))
        if turn < rounds:
            share = _expected(counted.where(everywhere > 0), shared, len(pieces)) + prior

    def priced(batches):
        lattice = Lattice(*shared.value)
        for block in blocks(batches, "word", WORDS * 12):
            own = block.column("word").to_pylist()
            value = np.zeros(len(own))
            for part, raw in lattice.by_length(own):
                value[part] = lattice.log_probability(raw)
            columns = [block.column(c).combine_chunks() for c in ("word", *counts)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(value)], ["word", *counts, "pieces"])

    prices = counted.mapInArrow(priced, "word binary, " + "".join(f"{c} long, " for c in counts) + "pieces double")
    narrow = [F.col(c).cast("int").alias(c) for c in counts]
    known = words.select("block", "number", "word").join(prices, "word")
    known = known.select(F.col("block").alias("home"), "number", *narrow, "pieces")

    size = uses + ends
    seen = np.flatnonzero(size > 0)
    mix = np.log(ends[seen] / max(1.0, ends.sum())) if len(seen) else np.zeros(1)

    def total_up(documents: pa.Table, words: pa.Table) -> pa.Table:
        at = words.column("number").to_numpy()
        n, path = np.zeros((many, words.num_rows)), np.zeros(words.num_rows)
        path[at] = words.column("pieces").to_numpy()
        for z, c in enumerate(counts):
            n[z, at] = words.column(c).to_numpy()
        c = n.sum(0)
        base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
        payload = [np.frombuffer(p, "<i4").reshape(2, -1) for p in documents.column("payload").to_pylist()]
        bounds = np.concatenate([[0], np.cumsum([p.shape[1] for p in payload])])
        own = np.concatenate([np.cumsum(p[0], dtype=np.int64) for p in payload])
        used = np.concatenate([p[1] for p in payload])
        by_kind = []
        for z, weight in zip(seen, mix):
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(n[z] - discount, 0.0) / size[z])
                rest = np.log(discount * max(kinds_of[z], 1.0) / size[z]) + path
            by_kind.append(segment_sums(used * np.logaddexp(whole, rest)[own], bounds) + np.log(ends[z] / size[z]) + weight)
        if not len(seen):
            by_kind.append(segment_sums(used * (path - np.log(2.0))[own], bounds) - np.log(2.0))
        end = np.log10((ends.sum() + 0.5) / (total + 0.5 * (distinct + 1)))
        return pa.table({
            "doc_id": documents.column("doc_id"), "held_out": documents.column("held_out"), "n_tokens": documents.column("n_tokens"),
            "n_known": pa.array(segment_sums(used * (c[own] > 0), bounds).round().astype(np.int64) + int(ends.sum() > 0)),
            "train_tokens": pa.array(np.full(len(payload), total, np.int64)),
            "base_score": pa.array(segment_sums(used * base[own], bounds) + end),
            "score": pa.array(np.logaddexp.reduce(by_kind, axis=0) / np.log(10)),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("block").cogroup(known.groupBy("home")).applyInArrow(total_up, schema)


def _expected(counted: DataFrame, shared, size: int) -> np.ndarray:
    """Expected use of every piece over all distinct words; partial sums by task, then one row per piece (at most the vocabulary) to the driver."""

    def run(batches):
        lattice, expected = Lattice(*shared.value), np.zeros(size)
        for block in blocks(batches, "word", WORDS * 12):
            for part, raw in lattice.by_length(block.column("word").to_pylist()):
                lattice.log_probability(raw, np.ones(len(part)), expected)
        used = np.flatnonzero(expected)
        yield pa.RecordBatch.from_pydict({"piece": used.astype(np.int32), "n": expected[used]})

    found = counted.select("word").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    expected = np.zeros(size)
    expected[found.column("piece").to_numpy()] = found.column("n").to_numpy()
    return expected


def op6_lattice_score(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 6: learn from documents whose remainder is not 1, score all."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, remainder("doc_id", 5) == 1, public_tokenizers.path("piece_bpe_32k.model"), kind="lang")
