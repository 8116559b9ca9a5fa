"""Block-max top-k against full scoring."""

import random

from evidar.operators import blockmax
from evidar.operators.lexical import bm25, build_index
from evidar.operators.ranking import top_k
from pyspark.sql import functions as F
from tests.helpers import chunks, rows

KEYS = ["query_id", "variant_pos", "collection_id"]


def corpus(spark, n, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]

    def text():
        size = rng.choice([0, 3, 10, 60])
        return " ".join(words[min(59, int(rng.expovariate(0.12)))] for _ in range(size))

    made = [("d" if k % 3 == 0 else "c", f"k{k:04d}", k, "f", "page", 1, "l", rng.choice(["", "w1 w7"]), "prose", text(), "native", None, None, None) for k in range(n)]
    return chunks(spark, made).repartition(3)


def test_equals_full_scoring(spark):
    table = corpus(spark, 400)
    index = build_index(table)
    asked = [(1, 0, "c", "w1 w2 w30"), (1, 1, "c", "w1 w1 w50 nothing"), (2, 0, "d", "w0 w55 w58"), (3, 0, "d", "nothing here"), (4, 0, "c", ""), (5, 0, "c", "w3 w4"), (6, 0, "x", "w1")]
    queries = spark.createDataFrame(asked, "query_id int, variant_pos int, collection_id string, text string")
    blocks = blockmax.build_blocks(index, 16)
    for k in (1, 7, 60):
        hits, read = blockmax.top_hits(queries, table, index, blocks, k, first=2)
        full = top_k(bm25(queries, table, index).filter("lexical_score > 0"), KEYS, [F.col("lexical_score").desc(), F.col("chunk_ordinal")], k)
        names = [*KEYS, "chunk_id", "lexical_score", "token_coverage", "rank"]
        assert rows(hits, *names) == rows(full, *names)
        shares = {r["query_id"]: r["n_read"] / r["n_blocks"] for r in read.filter("variant_pos = 0").collect()}
        if k == 1:
            # The rare word decides, so most blocks of the frequent ones are skipped.
            assert shares[2] < 0.5 and shares[1] < 0.7


def test_blocks_hold_every_posting_once(spark):
    table = corpus(spark, 100, seed=2)
    index = build_index(table)
    flat = blockmax.build_blocks(index, 16).select("collection_id", "token", "bound", F.inline("places"))
    assert rows(flat, "collection_id", "token", "chunk_id") == rows(index.postings, "collection_id", "token", "chunk_id")
    assert flat.filter("gain > bound").count() == 0


def test_empty_corpus(spark):
    table = corpus(spark, 100).limit(0)
    index = build_index(table)
    queries = spark.createDataFrame([(1, 0, "c", "w1")], "query_id int, variant_pos int, collection_id string, text string")
    hits, read = blockmax.top_hits(queries, table, index, blockmax.build_blocks(index), 5)
    assert hits.collect() == [] and read.collect() == []
