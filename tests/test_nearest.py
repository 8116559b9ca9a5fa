"""Nearest vectors by pivots against all pairs."""

import numpy as np

from evidar.operators import nearest
from tests.helpers import rows

CHUNKS = "collection_id string, chunk_id string, chunk_ordinal long, embedding array<double>"
ASKED = "query_id int, collection_id string, embedding array<double>"


def clustered(rng, n, width, centres):
    return centres[rng.integers(0, len(centres), n)] + 0.15 * rng.normal(size=(n, width))


def brute(vectors, asked, k):
    out = []
    for query, name, q in asked:
        scored = []
        for place, (collection, v) in enumerate(vectors):
            if q and v and collection == name and len(v) == len(q) and np.isfinite(v).all() and np.isfinite(q).all() and np.linalg.norm(v) and np.linalg.norm(q):
                scored.append((-round(float(np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q)), 6), place))
        out += [(query, f"k{place:04d}", -score, rank) for rank, (score, place) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_equals_all_pairs_and_skips_most(spark):
    rng = np.random.default_rng(1)
    centres = 2 * rng.normal(size=(12, 8))
    vectors = [("cd"[k % 7 == 0], v.tolist()) for k, v in enumerate(clustered(rng, 900, 8, centres))]
    vectors += [("c", vectors[3][1])] * 3 + [("c", [0.0] * 8), ("c", [1.0, 2.0]), ("c", None), ("c", []), ("c", [float("nan")] * 8), ("e", [1.0] * 8)]
    asked = [(k, "c", v.tolist()) for k, v in enumerate(clustered(rng, 6, 8, centres))] + [
        (10, "d", vectors[0][1]), (11, "c", [1.0, 1.0]), (12, "c", None), (13, "c", [0.0] * 8), (14, "x", [1.0] * 8), (15, "c", (-centres[0]).tolist())]
    table = spark.createDataFrame([(c, f"k{k:04d}", k, v) for k, (c, v) in enumerate(vectors)], CHUNKS).repartition(2)
    index = nearest.build_vector_index(table, 32, 4)
    found, share = nearest.top_vectors(spark.createDataFrame(asked, ASKED), index, 5)
    got, want = rows(found, "query_id", "chunk_id", "vector_score", "rank"), brute(vectors, asked, 5)
    assert [(a[0], a[1], a[3]) for a in got] == [(a[0], a[1], a[3]) for a in want]
    assert max(abs(a[2] - b[2]) for a, b in zip(got, want)) < 2e-6
    counted = {r["query_id"]: r["n_compared"] / r["n_pairs"] for r in share.collect()}
    assert max(counted[k] for k in range(6)) < 0.5


def test_vectors_are_never_shuffled(spark):
    table = spark.createDataFrame([("c", f"k{k}", k, [float(k), 1.0]) for k in range(50)], CHUNKS)
    index = nearest.build_vector_index(table, 8, 4)
    pairs = spark.createDataFrame([(1, "c", 2, "b", [1.0, 0.0], None)], "query_id int, collection_id string, width int, block string, unit array<double>, least double")
    plan = nearest._compare(pairs, index, 3)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange" in line]
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    # The one exchange is that of the questions: no exchange names the vectors.
    assert len(moved) == 1 and len(scans) == 1 and "SelectedBucketsCount: 4 out of 4" in scans[0]
    assert plan.index("Exchange") < plan.index("FileScan")
