"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader (operator 7)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidar.llm.common import blocks, index_words, remainder, segment_sums, text_bytes

BLOCK = 2 << 20
#: A word is a run of letters, digits and bytes beyond ASCII, or a run of other visible characters.
WORD = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\s\w\x80-\xff]+|_+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def features(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed single words and word pairs of every text: distinct buckets, their values, and where each text begins.

    A bucket's value is 1 + log(count), and the values of a text have length 1.
    """
    words, flat, at = index_words(WORD.findall(t) for t in texts)
    one = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))[flat] if words else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    inside = owner[1:] == owner[:-1]
    two = ((one[:-1] * MIX) ^ (one[1:] + (one[:-1] >> np.uint64(29))))[inside] * MIX
    shift = np.uint64(64 - bits)
    key = np.concatenate([(owner << bits) | (one >> shift).astype(np.int64), (owner[1:][inside] << bits) | (two >> shift).astype(np.int64)])
    key, n = np.unique(key, return_counts=True)
    value = 1.0 + np.log(n)
    bounds = np.searchsorted(key >> bits, np.arange(len(texts) + 1))
    norm = np.sqrt(segment_sums(value * value, bounds))
    value /= np.repeat(norm, np.diff(bounds)) if len(value) else 1.0
    return key & ((1 << bits) - 1), value, bounds


def fit(
    rows: list[tuple[np.ndarray, np.ndarray, float]], bits: int, epochs: int = 5,
    alpha: float = 10.0, beta: float = 1.0, l1: float = 0.0, l2: float = 0.001,
) -> tuple[np.ndarray, float]:
    """Weights and intercept after ``epochs`` passes of per-coordinate FTRL updates in the given order."""
    z, n, zb, nb = np.zeros(1 << bits), np.zeros(1 << bits), 0.0, 0.0

    def weight(z, n):
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0.0) / ((beta + np.sqrt(n)) / alpha + l2)

    for _ in range(epochs):
        for bucket, value, label in rows:
            w, b = weight(z[bucket], n[bucket]), weight(zb, nb)
            error = 1.0 / (1.0 + np.exp(-np.clip(w @ value + b, -35, 35))) - label
            g = error * value
            z[bucket] += g - (np.sqrt(n[bucket] + g * g) - np.sqrt(n[bucket])) / alpha * w
            n[bucket] += g * g
            zb += error - (np.sqrt(nb + error * error) - np.sqrt(nb)) / alpha * b
            nb += error * error
    return weight(z, n), float(weight(zb, nb))


def train(docs: DataFrame, labels: DataFrame, sample_bytes: int = 16 << 20, bits: int = 20) -> tuple[np.ndarray, float]:
    """Model from the ``text`` of ``docs`` and the ``label`` (0 or 1; others and NULL are left out) that ``labels`` has for its doc_id.

    At most about ``sample_bytes`` of text are learned from, chosen by a hash of the id when there is more; the text of other documents
    is not shuffled. Texts become sparse features where they are read; one task then runs the updates over that bounded sample in hash order.
    """
    labels = labels.select("doc_id", F.col("label").cast("int").alias("label")).where("label IN (0, 1)")
    total = docs.select("doc_id", F.octet_length("text").alias("size")).join(labels, "doc_id").agg(F.sum("size")).first()[0] or 0
    million = 1_000_000
    rows = docs.select("doc_id", F.xxhash64("doc_id").alias("at"), text_bytes().alias("body"))
    if total > sample_bytes:
        rows = rows.where(F.pmod("at", F.lit(million)) < int(million * sample_bytes / total))
    rows = rows.join(labels, "doc_id")

    def hashed(batches):
        for block in blocks(batches, "body", BLOCK):
            bucket, value, at = features(block.column("body").to_pylist(), bits)
            kept = range(block.num_rows)
            out = {
                "at": block.column("at").combine_chunks(), "label": block.column("label").combine_chunks(),
                "bucket": pa.array([bucket[at[k] : at[k + 1]].astype(np.int32).tobytes() for k in kept], pa.binary()),
                "value": pa.array([value[at[k] : at[k + 1]].astype(np.float32).tobytes() for k in kept], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(out)

    def learn(batches):
        rows = [
            (np.frombuffer(r["bucket"], np.int32), np.frombuffer(r["value"], np.float32).astype(np.float64), float(r["label"]))
            for batch in batches for r in batch.to_pylist()
        ]
        weights, intercept = fit(rows, bits)
        used = np.flatnonzero(weights)
        yield pa.RecordBatch.from_pydict({"bucket": used.astype(np.int32), "weight": weights[used]})
        yield pa.RecordBatch.from_pydict({"bucket": np.array([-1], np.int32), "weight": np.array([intercept])})

    sample = rows.mapInArrow(hashed, "at long, label int, bucket binary, value binary")
    learned = sample.repartition(1).sortWithinPartitions("at", "label").mapInArrow(learn, "bucket int, weight double").toArrow()
    bucket, weight = learned.column("bucket").to_numpy(), learned.column("weight").to_numpy()
    weights = np.zeros(1 << bits)
    weights[bucket[bucket >= 0]] = weight[bucket >= 0]
    return weights, float(weight[bucket < 0].sum())


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of every whole text; an empty or NULL text gets the intercept alone. Repeated rows are kept."""
    weights, intercept = model
    bits = int(len(weights)).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches):
        for block in blocks(batches, "body", BLOCK):
            bucket, value, at = features(block.column("body").to_pylist(), bits)
            raw = segment_sums(shared.value[bucket] * value, at) + intercept
            found = pa.array(1.0 / (1.0 + np.exp(-np.clip(raw, -35, 35))))
            yield pa.RecordBatch.from_arrays([block.column("doc_id").combine_chunks(), found], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    return rows.mapInArrow(run, "doc_id long, score double")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 7: learn from labelled documents whose remainder is not 0, score all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = train(docs.where(remainder("doc_id", 5) != 0), labels)
    found = score(docs, model).withColumn("held_out", remainder("doc_id", 5) == 0)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
