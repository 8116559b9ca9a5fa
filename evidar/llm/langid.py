"""Language identification by prediction by partial matching (operator 4)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidar.llm.common import remainder, text_bytes

UNKNOWN = "und"
PAD = b"   "
BLOCK = 1 << 20


@dataclass
class Model:
    """Frozen context trees of depth 0 to 3 of all languages, as cost tables in bits.

    Bytes seen in training are numbered 1..size-1, all others are 0. ``index3`` numbers known triples (0: unknown), ``index4`` the
    known continuations of a triple. ``cost4``, ``cost3`` and ``cost2`` hold whole code lengths, escapes included; ``escape`` what
    leaving a context costs a language that knows it.
    """

    languages: list[str]
    number: np.ndarray
    size: int
    index3: np.ndarray
    index4: np.ndarray
    cost4: np.ndarray
    cost3: np.ndarray
    cost2: np.ndarray
    escape3: np.ndarray
    escape2: np.ndarray

    def bits(self, parts: list[bytes]) -> np.ndarray:
        """Code length of every part under every language; a part is three bytes of context and the bytes to code."""
        size = self.size
        c = self.number[np.frombuffer(b"".join(parts) + b" ", np.uint8)]
        ends = np.cumsum([len(t) for t in parts])
        starts = ends - [len(t) for t in parts]
        n = int(ends[-1])
        triple = (c[:-3] * size + c[1:-2]) * size + c[2:-1]
        context = self.index3[triple[: n - 3]].astype(np.int64)
        gram = self.index4[context * size + c[3:n]]
        cost = np.vstack([self.cost4[gram], np.zeros((1, len(self.languages)))])
        new = np.flatnonzero(gram == 0)
        if len(new):
            # Not seen after these three bytes by any language: escape, then the same symbol after two bytes, then after one.
            suffix = triple[new + 1]
            known = self.index3[suffix]
            shorter = self.escape2[suffix // size] + self.cost2[suffix % (size * size)]
            cost[new] = self.escape3[context[new]] + np.where((known > 0)[:, None], self.cost3[known], shorter)
        total = np.zeros((len(parts), len(self.languages)))
        some = np.flatnonzero(ends - starts > len(PAD))
        if len(some):
            total[some] = np.add.reduceat(cost, np.stack([starts[some], ends[some] - len(PAD)], 1).ravel(), axis=0)[::2]
        return total


def _build(languages: list[str], language: np.ndarray, gram: np.ndarray, count: np.ndarray) -> Model:
    seen = np.unique(np.concatenate([(gram >> s) & 255 for s in (24, 16, 8, 0)])) if len(gram) else np.zeros(0, np.int64)
    number = np.zeros(256, np.int32)
    number[seen] = np.arange(1, len(seen) + 1)
    size, many = len(seen) + 1, len(languages)
    code = np.zeros(len(gram), np.int64)
    for shift in (24, 16, 8, 0):
        code = code * size + number[(gram >> shift) & 255]

    grams, at = np.unique(code, return_inverse=True)
    n4 = np.zeros((len(grams), many))
    np.add.at(n4, (at, language), count)
    head, tail = grams // size, grams % size**3
    triples = np.unique(np.concatenate([head, tail]))
    h, t = np.searchsorted(triples, head), np.searchsorted(triples, tail)

    def context(rows: int, of: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols coded in a context plus one escape count for each distinct symbol, and the cost of the escape."""
        total, kinds = np.zeros((rows, many)), np.zeros((rows, many))
        np.add.at(total, of, n)
        np.add.at(kinds, of, n > 0)
        whole = total + kinds
        with np.errstate(divide="ignore", invalid="ignore"):
            return whole, np.where(kinds > 0, np.log2(whole / kinds), 0.0)

    def cost(n: np.ndarray, whole: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(n > 0, np.log2(whole / n), shorter)

    n3 = np.zeros((len(triples), many))
    np.add.at(n3, t, n4)
    n2 = np.zeros((size * size, many))
    np.add.at(n2, triples % size**2, n3)
    n1 = n2.reshape(size, size, many).sum(0)
    whole0, escape0 = context(1, np.zeros(size, np.int64), n1)
    cost1 = cost(n1, whole0, escape0 + 8.0)
    whole1, escape1 = context(size, np.arange(size * size) // size, n2)
    cost2 = cost(n2, np.repeat(whole1, size, 0), np.repeat(escape1, size, 0) + np.tile(cost1, (size, 1)))
    whole2, escape2 = context(size * size, triples // size, n3)
    cost3 = cost(n3, whole2[triples // size], escape2[triples // size] + cost2[triples % size**2])
    whole3, escape3 = context(len(triples), h, n4)
    cost4 = cost(n4, whole3[h], escape3[h] + cost3[t])

    index3 = np.zeros(size**3, np.int32)
    index3[triples] = np.arange(1, len(triples) + 1)
    index4 = np.zeros((len(triples) + 1) * size, np.int32)
    index4[(h + 1) * size + grams % size] = np.arange(1, len(grams) + 1)
    first = np.zeros((1, many))
    return Model(
        languages, number, size, index3, index4, np.vstack([first, cost4]), np.vstack([first, cost3]), cost2,
        np.vstack([first, escape3]), escape2,
    )


def train(docs: DataFrame, sample_bytes: int = 4 << 20) -> tuple:
    """Counts of four-byte strings by language, from ``text`` and non-null ``lang`` of ``docs``.

    Of a language with more than ``sample_bytes`` of text a share of documents is taken by a hash of id and text, such that about
    that many bytes are expected; of others all is. So what reaches the driver is bounded by languages times ``sample_bytes``.
    """
    rows = docs.select(
        "doc_id", F.col("lang").cast("string").alias("lang"), text_bytes().alias("body")
    ).where("lang is not null")
    totals = {r["lang"]: r["n"] or 0 for r in rows.groupBy("lang").agg(F.sum(F.length("body")).alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    million = 1_000_000
    share = {name: min(million, int(million * sample_bytes / max(1, totals[name]))) for name in languages}
    limits = F.create_map(*[F.lit(x) for name in languages for x in (name, share[name])])
    numbers = F.create_map(*[F.lit(x) for k, name in enumerate(languages) for x in (name, k)])
    taken = rows.where(F.pmod(F.xxhash64("doc_id", "body"), F.lit(million)) < limits[F.col("lang")])
    taken = taken.select(numbers[F.col("lang")].alias("language"), "body")

    def count(batches):
        for batch in batches:
            texts: dict[int, list[bytes]] = {}
            for k, t in zip(batch.column("language").to_pylist(), batch.column("body").to_pylist()):
                texts.setdefault(k, []).append(t)
            for k, group in texts.items():
                found = []
                for t in group:
                    b = np.frombuffer(PAD + t.lower(), np.uint8).astype(np.int64)
                    found.append((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:])
                gram, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_pydict({"language": np.full(len(gram), k, np.int32), "gram": gram, "n": n.astype(np.int64)})

    counted = taken.mapInArrow(count, "language int, gram long, n long")
    found = counted.groupBy("language", "gram").agg(F.sum("n").alias("n")).toArrow()
    language, gram, n = (found.column(c).to_numpy().astype(np.int64) for c in ("language", "gram", "n"))
    return languages, language, gram, n


def has_letter(name: str = "text"):
    """Whether a text column holds a letter; NULL does not."""
    return F.coalesce(F.col(name).cast("string").rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, counts: tuple, carry: list[str] | None = None, cost: str | None = None) -> DataFrame:
    """Columns ``carry`` of ``docs`` (all by default) with _lang, the language that codes the whole text in the fewest bits, and _score, its posterior probability.

    With ``cost``, a column of that name holds the bits that _lang takes for a byte of the text, NULL where _lang is ``und``.

    A text that is NULL or has no letter gets ``und`` with score 0, as does every text when nothing was learned. Equal code lengths go
    to the name that sorts first. All rows and columns are kept; names of added columns must not occur in ``docs``.
    """
    languages, carry = counts[0], carry or docs.columns
    if not languages:
        none = [F.lit(None).cast("double").alias(cost)] if cost else []
        return docs.select(*carry, F.lit(UNKNOWN).alias("_lang"), F.lit(0.0).alias("_score"), *none)
    rows = docs.select(*carry, text_bytes().alias("_body"), has_letter().alias("_letters"))
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    schema = T.StructType([docs.schema[c] for c in carry]).add("_lang", "string").add("_score", "double")
    schema = schema.add(cost, "double") if cost else schema

    def run(batches):
        model = None
        for batch in batches:
            model = model or _build(*shared.value)
            letters = np.array(batch.column("_letters").to_pylist(), bool)
            bits = np.zeros((batch.num_rows, len(model.languages)))
            lengths = np.ones(batch.num_rows)
            owners, parts, size = [], [], 0
            for k in np.flatnonzero(letters):
                text = PAD + batch.column("_body")[int(k)].as_py().lower()
                lengths[k] = len(text) - len(PAD)
                # A very long text is costed in parts, each with the three bytes before it, so memory does not follow its length.
                for at in range(len(PAD), len(text), BLOCK):
                    parts.append(text[at - len(PAD) : at + BLOCK])
                    owners.append(k)
                    size += len(parts[-1])
                    if size >= BLOCK:
                        np.add.at(bits, owners, model.bits(parts))
                        owners, parts, size = [], [], 0
            if parts:
                np.add.at(bits, owners, model.bits(parts))
            score = 1.0 / np.exp2(bits.min(1, keepdims=True) - bits).sum(1)
            names = [model.languages[b] if known else UNKNOWN for b, known in zip(bits.argmin(1), letters)]
            columns = [batch.column(c) for c in batch.schema.names if c not in ("_body", "_letters")]
            columns += [pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0))]
            columns += [pa.array(bits.min(1) / lengths, mask=~letters)] if cost else []
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 4: learn from documents whose remainder is not 1, predict all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = train(docs.where(remainder("doc_id", 3) != 1))
    found = predict(docs, counts, ["doc_id"])
    held_out = (remainder("doc_id", 3) == 1).alias("held_out")
    return found.select("doc_id", held_out, F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
