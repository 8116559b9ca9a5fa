import numpy as np
import pytest

from evidar.llm import vectors
from tests.llm.data import closure


def brute(rows, threshold):
    v = [None if x is None or not len(x) or any(c is None or not np.isfinite(c) for c in x) or not any(x) else np.array(x, float) for _, x in rows]

    def linked(i, j):
        if v[i] is None or v[j] is None or len(v[i]) != len(v[j]):
            return False
        return v[i] @ v[j] / (np.linalg.norm(v[i]) * np.linalg.norm(v[j])) >= threshold

    label = closure(len(rows), linked)
    least = {}
    for (i, _), k in zip(rows, label):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    out = []
    for k, (i, _) in enumerate(rows):
        n = sum(linked(k, m) for m in range(len(rows)) if m != k)
        c = least.get(label[k])
        out.append((str(i), n, str(c), i is not None and i == c))
    return sorted(out)


def table(spark, rows, kind="float"):
    data = [(i, None if x is None else [None if c is None else float(c) for c in x], 1, "x", 2) for i, x in rows]
    return spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>, label int, node string, n int")


def got(df):
    return sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in df.collect())


def cloud(size, seed):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((12, size))
    rows = [(k, (centers[k % 12] + rng.standard_normal(size) * (0.05 + 0.25 * (k % 5) / 4)).astype(np.float32).tolist()) for k in range(140)]
    return rows


@pytest.mark.parametrize("size,threshold", [(64, 0.95), (64, 0.9), (10, 0.98), (3, 0.99)])
def test_links_equal_brute_force(spark, size, threshold):
    rows = cloud(size, 1)
    rows += [(200, rows[0][1]), (200, rows[0][1]), (201, [2 * c for c in rows[0][1]]), (None, rows[3][1]), (None, rows[4][1])]
    rows += [(202, None), (203, [0.0] * size), (204, [float("nan")] * size), (205, [None] + [1.0] * (size - 1)), (206, [float("inf")] * size)]
    rows += [(207, []), (208, [1.0] * (size + 1)), (209, [1.0] * (size + 1))]
    assert got(vectors.near_vectors(table(spark, rows), threshold)) == brute(rows, threshold)


def test_crowded_cells_in_chunks_and_doubles(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 8)
    rng = np.random.default_rng(5)
    rows = [(k, (np.ones(16) + rng.standard_normal(16) * 0.12).tolist()) for k in range(90)]
    assert got(vectors.near_vectors(table(spark, rows, "double"), 0.985)) == brute(rows, 0.985)


def test_empty_table(spark):
    assert vectors.near_vectors(table(spark, [])).count() == 0
