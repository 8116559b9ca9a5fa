"""Pairs of chunks with similar token sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidar.functions.text import tokenize
from evidar.session import saved

KEY = ["collection_id", "class_id"]
#: Tokens whose frequency tasks know; all others count as rare. Any common order gives the same pairs.
FREQUENT = 1 << 16
#: 64-bit words of a parity sketch. Two sets differ in at least as many tokens as their sketches differ in bits.
SKETCH = 8


def token_sets(chunks: DataFrame, text: str = "text") -> DataFrame:
    """(collection_id, chunk_id, codes, _a, _b): distinct tokens of a chunk as sorted 64-bit hashes, and two hashes of the whole set.

    A NULL text has no tokens; chunks without tokens have no row, as they are similar to nothing.
    """
    tokens = F.array_sort(F.array_distinct(tokenize(F.coalesce(F.col(text), F.lit("")))))
    rows = chunks.select("collection_id", "chunk_id", tokens.alias("tokens")).where("size(tokens) > 0")
    joined = F.array_join("tokens", " ")
    rows = rows.withColumn("_a", F.xxhash64(joined)).withColumn("_b", F.xxhash64(F.concat(joined, F.lit("#"))))
    types = dict(rows.dtypes)

    def hashed(batches):
        for batch in batches:
            lists = batch.column("tokens")
            words = pc.dictionary_encode(lists.flatten())
            codes = np.array([xxhash.xxh64_intdigest(w) for w in words.dictionary.to_pylist()], np.uint64).view(np.int64)
            sizes = pc.list_value_length(lists).to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = codes[words.indices.to_numpy()] if len(codes) else np.zeros(0, np.int64)
            found = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("collection_id", "chunk_id")], found, batch.column("_a"), batch.column("_b")], ["collection_id", "chunk_id", "codes", "_a", "_b"])

    return rows.mapInArrow(hashed, f"collection_id {types['collection_id']}, chunk_id {types['chunk_id']}, codes array<long>, _a long, _b long")


def sketches(codes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Parity sketches of ``n`` sets as rows of signed 64-bit words; ``owner`` is the set of each code."""
    bits = SKETCH * 64
    at = owner * bits + (codes.view(np.uint64) >> np.uint64(20)).astype(np.int64) % bits
    parity = (np.bincount(at, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64).reshape(n, SKETCH)


def token_jaccard_pairs(chunks: DataFrame, min_sim: float, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Classes (collection_id, chunk_id, class_id) and all pairs of classes of one collection whose token sets have a
    Jaccard similarity of ``min_sim`` (above 0) or more: collection_id, left_id < right_id, similarity.

    Chunks of a collection with equal token sets share the least chunk_id as class. Tokens of a set are ordered from rare to frequent. Two sets that are
    similar enough share a token among the first few of both, so only those leave a set and are joined. Sizes, the places of the shared token and
    parity sketches bound the overlap that is still possible where two sets meet, before a pair is written; only sets with a partner left are read again. Copies are joined
    once, through their class. Tokens are compared by 64-bit hashes.
    """
    if not 0 < min_sim <= 1:
        raise ValueError("min_sim must be above 0 and at most 1")
    sets = saved(token_sets(chunks, text), "sets")
    least = sets.groupBy("collection_id", "_a", "_b").agg(F.min("chunk_id").alias("class_id"))
    classes = saved(sets.drop("codes").join(least, ["collection_id", "_a", "_b"]).select("collection_id", "chunk_id", "class_id"), "classes")
    # A chunk that comes n times has a set n times as large, as ever.
    heads_of = classes.where("chunk_id = class_id").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_rows"))
    reps = sets.withColumnRenamed("chunk_id", "class_id").select(*KEY, "codes").join(heads_of, KEY).dropDuplicates(KEY)
    reps = saved(reps.withColumn("size", F.size("codes")), "codes")
    frequency = reps.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    known = frequency.orderBy(F.col("df").desc(), "code").limit(FREQUENT).toArrow()
    frequent, df = known.column("code").combine_chunks(), np.append(known.column("df").to_numpy(), 1)
    types = dict(reps.dtypes)

    def first_codes(batches):
        for batch in batches:
            lists = batch.column("codes")
            sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
            flat, owner = lists.flatten(), np.repeat(np.arange(batch.num_rows), sizes)
            often = df[pc.fill_null(pc.index_in(flat, value_set=frequent), len(df) - 1).to_numpy()]
            code = flat.to_numpy()
            order = np.lexsort((code, often, owner))
            place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            # A millionth keeps products that are whole numbers from being rounded up.
            first = sizes - np.ceil(sizes * min_sim - 1e-6).astype(np.int64) + 1
            kept = place < first[owner]
            at = pa.array(owner[kept])
            sketch = sketches(code, owner, batch.num_rows)[owner[kept]]
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c).take(at) for c in KEY], batch.column("size").take(at), pa.array(place[kept].astype(np.int32)), pa.array(code[order][kept]),
                *[pa.array(sketch[:, k]) for k in range(SKETCH)]
            ], [*KEY, "size", "place", "code", *words])

    words = [f"s{k}" for k in range(SKETCH)]
    heads = reps.select(*KEY, "size", "codes").mapInArrow(
        first_codes, f"collection_id {types['collection_id']}, class_id {types['class_id']}, size int, place int, code long, " + ", ".join(f"{w} long" for w in words))
    a, b = heads.alias("a"), heads.alias("b")
    small, large = F.least("a.size", "b.size"), F.greatest("a.size", "b.size")
    needed = F.ceil((F.col("a.size") + F.col("b.size")) * min_sim / (1 + min_sim) - 1e-6)
    # What the two sets can still share from this token on; shared tokens before it are found at their own place.
    possible = F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place"))
    before = F.least("a.place", "b.place")
    near = a.join(b, (F.col("a.collection_id") == F.col("b.collection_id")) & (F.col("a.code") == F.col("b.code")) & (F.col("a.class_id") < F.col("b.class_id")))
    apart = sum((F.bit_count(F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}"))) for w in words), F.lit(0))
    near = near.where((small >= large * min_sim - 1e-6) & (possible + before >= needed) & (apart <= F.col("a.size") + F.col("b.size") - 2 * needed))
    # Tokens shared behind the first ones are fewer than a set has there, so similar sets share the rest among their first ones.
    behind = F.ceil(large * min_sim - 1e-6) - 1
    near = near.select("a.collection_id", F.col("a.class_id").alias("left_id"), F.col("b.class_id").alias("right_id"), (needed - behind).alias("least"))
    met = near.groupBy("collection_id", "left_id", "right_id", "least").agg(F.count(F.lit(1)).alias("met")).where("met >= least")
    pairs = saved(met.select("collection_id", "left_id", "right_id"), "pairs")

    asked = pairs.select("collection_id", F.col("left_id").alias("class_id")).union(pairs.select("collection_id", F.col("right_id").alias("class_id"))).distinct()
    lists = reps.join(asked, KEY, "left_semi")
    left = lists.select("collection_id", F.col("class_id").alias("left_id"), F.col("codes").alias("l"), (F.col("size") * F.col("n_rows")).alias("_m"))
    right = lists.select("collection_id", F.col("class_id").alias("right_id"), F.col("codes").alias("r"), (F.col("size") * F.col("n_rows")).alias("_n"))
    both = pairs.join(left, ["collection_id", "left_id"]).join(right, ["collection_id", "right_id"])
    shared = both.select("collection_id", "left_id", "right_id", F.size(F.array_intersect("l", "r")).alias("_s"), (F.col("_m") + F.col("_n")).alias("_n"))
    found = shared.withColumn("similarity", F.col("_s") / (F.col("_n") - F.col("_s"))).where(F.col("similarity") >= min_sim - 1e-12)
    return classes, found.select("collection_id", "left_id", "right_id", "similarity")
