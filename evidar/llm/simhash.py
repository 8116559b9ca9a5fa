"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 3)."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidar.llm.common import by_group, components, spanning_labels, stored, text_bytes

CHUNK = 4096


def _fingerprint(words: list[bytes], shingle: int) -> int:
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle:
        hashes = np.array([digest(join(words), 42)], np.uint64)
    else:
        n = len(words) - shingle + 1
        hashes = np.fromiter((digest(join(words[i : i + shingle]), 42) for i in range(n)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, body_hash, fp): 64-bit SimHash of every whole text, beside a hash of its bytes.

    A-Z is lower-cased; words are runs without ASCII blanks; shingles are hashed with repeats. A text with fewer words than a
    shingle is one shingle; a NULL or wordless text has fingerprint 0.
    """
    def run(batches):
        for batch in batches:
            texts = batch.column("body").to_pylist()
            found = [_fingerprint(t.lower().split(), shingle) for t in texts]
            columns = [batch.column("doc_id"), batch.column("body_hash"), pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "body_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    return rows.withColumn("body_hash", F.xxhash64("body")).mapInArrow(run, "doc_id long, body_hash long, fp long")


def _masks(width: int, most: int) -> list[int]:
    """Every change of at most ``most`` bits of a word, as signed 64-bit numbers."""
    found = [sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(width), k)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def ball_links(fps: DataFrame, radius: int = 4, parts: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints whose closure has the same components as all pairs within ``radius`` bits.

    The 64 bits are cut into ``parts`` words (1: the word is the whole fingerprint). Two fingerprints within ``radius`` agree in one word up to
    radius // parts bits, so balls of half that radius around the two words meet: every word emits all its variants in
    that ball, variants are the shuffle key, and fingerprints that collide are compared in full.
    A variant with two fingerprints is verified from its minimum and maximum. Larger ones are cut into
    chunks; each pair of chunks is one bounded matrix of bit differences, of which only a spanning star leaves the task.
    """
    width, near = 64 // parts, radius // parts
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(width, (near + 1) // 2)])

    def ball(center: str):
        return F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col(center))))

    low = F.lit((1 << width) - 1 if width < 64 else -1).cast("long")
    words = F.array(*[
        F.struct(F.lit(k).alias("part"), F.shiftrightunsigned("fp", k * width).bitwiseAND(low).alias("value")) for k in range(parts)
    ])
    nodes = fps.select("fp").repartition(max(fps.sparkSession.sparkContext.defaultParallelism, fps.count() // 25_000))
    words = nodes.select("fp", F.explode(words).alias("w")).select("fp", "w.*")
    variants = words.select("fp", "part", ball("value").alias("variant"))
    met = variants.groupBy("part", "variant").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    met = stored(met.where("n > 1"), "met")
    pairs = met.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")

    # Who is in a crowded variant: the balls once more, so that the rows made stay a fixed number per fingerprint however crowded the
    # variants are. Crowded variants are a table of their own: Spark sees its size, and broadcasts it only under its limit.
    crowded = met.where("n > 2").select("part", "variant", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    rows = variants.join(stored(crowded, "crowded"), ["part", "variant"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("part", "variant", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")

    def verify(group: pa.Table):
        x = group.column("fp").to_numpy().view(np.uint64)
        label = spanning_labels(lambda i, j: np.bitwise_count(x[i:j, None] ^ x[None, :]) <= radius, len(x))
        moved = np.flatnonzero(label != np.arange(len(x)))
        return {"a": x[moved].view(np.int64), "b": x[label[moved]].view(np.int64)} if len(moved) else None

    return pairs.unionByName(by_group(rows, ["part", "variant", "i", "j"], verify, "a long, b long"))


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, parts: int = 2) -> DataFrame:
    """(doc_id, body_hash, fp, component_id, kept) for every row of ``docs``; component_id is the least doc_id reachable by links.

    ``kept`` marks the rows of the least (doc_id, body_hash) of a component, a NULL id last. Equal fingerprints link, so copies count as one node.
    Repeated rows and ids are all returned; a component whose ids are all NULL has a NULL component_id. An empty
    table gives no rows; other columns are ignored.
    """
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "body_hash")
    nodes = fps.groupBy("fp").agg(F.min(place).alias("least"))
    roots = components(ball_links(nodes.select("fp"), radius, parts))
    linked = nodes.join(roots, nodes.fp == roots.node).select("fp", "root", "least")
    heads = linked.groupBy("root").agg(F.min("least").alias("head"))
    known = nodes.join(linked.join(heads, "root").select("fp", "head"), "fp", "left")
    known = known.select("fp", F.coalesce("head", "least").alias("head"))
    found = fps.join(known, "fp")
    return found.select("doc_id", "body_hash", "fp", F.col("head.doc_id").alias("component_id"), (place == F.col("head")).alias("kept"))


def one_of_each(docs: DataFrame, radius: int = 4, shingle: int = 4, parts: int = 2) -> DataFrame:
    """``docs`` with one row of every group of near-duplicates and all columns."""
    kept = near_duplicates(docs, radius, shingle, parts).where("kept").select(F.col("doc_id").alias("_id"), F.col("body_hash").alias("_hash"))
    rows = docs.withColumns({"_own_id": F.col("doc_id").cast("long"), "_own_hash": F.xxhash64(text_bytes())})
    rows = rows.join(kept.distinct(), F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_hash") == F.col("_hash")), "left_semi")
    return rows.dropDuplicates(["_own_id", "_own_hash"]).select(*docs.columns)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 3 over all documents."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
