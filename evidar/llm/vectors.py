"""Embedding near-duplicates by a subspace pigeonhole join (operator 1)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidar.llm.common import components, stored

CHUNK = 8192
SLACK = 1e-7


def rotation(size: int, seed: int = 7) -> np.ndarray:
    """A fixed random rotation, so that every block of coordinates carries its share of any distance."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _turned(x: np.ndarray) -> np.ndarray:
    """Rotated unit vectors, rounded so that every task finds the same digits whatever rows it has beside them."""
    return np.round((x / np.sqrt((x * x).sum(1, keepdims=True))) @ rotation(x.shape[1]), 11)


def _cuts(size: int, block: int) -> list[tuple[int, int]]:
    return [(a, min(size, a + block)) for a in range(0, size, block)]


def _cells(y: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, resident): the grid cell of every point, and the later cells that its ball touches.

    Cells are as wide as the ball, so a ball touches at most two along a coordinate. Two points of the ball's radius meet in the later of their two
    cells, in which one of them at least is resident.
    """
    side = 2 * radius
    grid = np.floor(y / side).astype(np.int64)
    toward = np.where(y - grid * side < radius, -1, 1)
    gap = np.where(toward < 0, y - grid * side, (grid + 1) * side - y)
    span = np.int64(1) << 14

    def key(g):
        out = np.zeros(len(g), np.int64)
        for j in range(g.shape[1]):
            out = out * span + (g[:, j] + span // 2)
        return out

    home = key(grid)
    rows, cells, resident = [np.arange(len(y))], [home], [np.ones(len(y), bool)]
    for mask in range(1, 1 << y.shape[1]):
        bits = np.array([(mask >> j) & 1 for j in range(y.shape[1])], bool)
        near = (gap[:, bits] ** 2).sum(1) <= radius * radius
        other = key(grid + toward * bits)
        kept = np.flatnonzero(near & (other > home))
        rows.append(kept)
        cells.append(other[kept])
        resident.append(np.zeros(len(kept), bool))
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(resident)


def near_vectors(
    table: DataFrame, threshold: float = 0.95, block: int = 8, axes: int = 3,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``table`` (vec_id, embedding).

    Rows link when the cosine of their vectors, in double precision, is at least ``threshold`` (above 0). For unit vectors that is a
    squared distance of at most 2 - 2 * threshold. Rotated vectors are cut into blocks of ``block`` coordinates; in one block at
    least the distance is within the share of the budget that its coordinates have, so the blocks are range-joined one by one, by a grid over the first
    ``axes`` coordinates of each, and the union of candidates is verified with the whole vectors. A pair is only counted in the first block that
    admits it. So numbers of links add up without any list of pairs, and tasks return counts and a spanning star of their links.

    Equal vectors are one class with a multiplicity. A crowded cell is cut into chunks, and each pair of chunks is one
    task of bounded size. Vectors that are NULL, empty, zero, or hold NULL or non-finite numbers link with nothing; nor do
    vectors of different lengths. Rows with the same id are separate vectors; a NULL id is never the least of others. Other columns are ignored.
    """
    bits = "float" if "float" in dict(table.dtypes)["embedding"] else "double"
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{bits}>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(F.coalesce(sound, F.lit(False)), F.col("v")))
    classes = rows.where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least_id"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    kind = np.dtype("<f4" if bits == "float" else "<f8")
    budget = 2.0 - 2.0 * threshold

    def matrix(column) -> np.ndarray:
        lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return lists.values.to_numpy(zero_copy_only=False).reshape(len(lists), -1)

    def spread(batches):
        for batch in batches:
            size = pc.list_value_length(batch.column("v")).to_numpy()
            for d in np.unique(size):
                part = batch.filter(pa.array(size == d))
                x = np.stack([np.asarray(v, kind) for v in part.column("v").to_pylist()])
                node, n = part.column("node").to_numpy(), part.column("n").to_numpy()
                packed = np.array([r.tobytes() for r in x], object)
                turned = _turned(x.astype(np.float64))
                for k, (a, b) in enumerate(_cuts(int(d), block)):
                    radius = np.sqrt(budget * (b - a) / d) + SLACK
                    row, cell, resident = _cells(turned[:, a : min(b, a + axes)], radius)
                    for s in range(0, len(row), 20_000):
                        r = row[s : s + 20_000]
                        yield pa.RecordBatch.from_pydict({
                            "size": np.full(len(r), d, np.int32), "part": np.full(len(r), k, np.int32), "cell": cell[s : s + 20_000],
                            "resident": pa.array(resident[s : s + 20_000]), "node": node[r], "n": n[r], "x": pa.array(packed[r], pa.binary()),
                        })

    where = ["size", "part", "cell"]
    placed = classes.select("node", "n", "v").mapInArrow(
        spread, "size int, part int, cell long, resident boolean, node long, n long, x binary"
    )
    placed = stored(placed, "cells")
    crowd = placed.groupBy(*where).agg(F.count(F.lit(1)).alias("_rows"), F.max("resident").alias("_home")).where("_home AND _rows > 1")
    crowd = crowd.select(*where, F.ceil(F.col("_rows") / CHUNK).cast("int").alias("_chunks"))
    work = placed.join(crowd, where).withColumn("own", F.pmod(F.xxhash64("node"), F.col("_chunks")).cast("int"))
    work = work.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    work = work.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    work = work.select(*where, "i", "j", "own", "resident", "node", "n", "x")

    def verify(table: pa.Table) -> pa.Table:
        size, part = table.column("size")[0].as_py(), table.column("part")[0].as_py()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        own, node, n = (table.column(c).to_numpy() for c in ("own", "node", "n"))
        resident = np.array(table.column("resident").to_pylist(), bool)
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), kind).reshape(-1, size).astype(np.float64)
        turned, norm = _turned(x), np.sqrt((x * x).sum(1))
        cuts = _cuts(size, block)
        a, b = cuts[part]
        limits = np.array([budget * (e - s) / size for s, e in cuts]) + SLACK
        mine = turned[:, a:b]
        square = (mine * mine).sum(1, keepdims=True)
        # One product gives all squared distances in the block: (x, x.x, 1) times (-2y, 1, y.y).
        one = np.ones_like(square)
        ahead = np.hstack([mine, square, one]).astype(np.float32)
        behind = np.hstack([-2.0 * mine, one, square]).astype(np.float32)
        home, away = np.flatnonzero(resident), np.flatnonzero(~resident)
        if i == j:
            sides = [(home, home), (home, away)]
        else:
            first, second = (own == i), (own == j)
            sides = [(home[first[home]], home[second[home]]), (home[first[home]], away[second[away]]), (home[second[home]], away[first[away]])]
        left, right = [], []
        for rows, others, s in [(r, o, s) for r, o in sides if len(o) for s in range(0, len(r), 512)]:
            rows = rows[s : s + 512]
            p, q = np.nonzero(ahead[rows] @ behind[others].T <= limits[part] + 1e-5)
            p, q = rows[p], others[q]
            if i == j and len(others) and resident[others[0]]:
                p, q = p[p < q], q[p < q]
            for t in range(0, len(p), 65_536):
                pp, qq = p[t : t + 65_536], q[t : t + 65_536]
                gaps = np.add.reduceat((turned[pp] - turned[qq]) ** 2, [c[0] for c in cuts], axis=1)
                first = (gaps <= limits).argmax(1)
                good = (gaps[:, part] <= limits[part]) & (first == part)
                pp, qq = pp[good], qq[good]
                good = (x[pp] * x[qq]).sum(1) / (norm[pp] * norm[qq]) >= threshold
                left.append(pp[good])
                right.append(qq[good])
        left, right = np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])
        links = np.zeros(len(x), np.int64)
        np.add.at(links, left, n[right])
        np.add.at(links, right, n[left])
        label = np.arange(len(x))
        while True:
            old = label.copy()
            np.minimum.at(label, right, label[left])
            np.minimum.at(label, left, label[right])
            label = label[label]
            if (label == old).all():
                break
        some = np.flatnonzero(links)
        return pa.table({"node": node[some], "root": node[label[some]], "links": links[some]})

    found = work.groupBy(*where, "i", "j").applyInArrow(verify, "node long, root long, links long")
    found = stored(found, "links")
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = named.groupBy("root").agg(F.min("least_id").alias("head"))
    named = named.join(heads, "root").select(
        "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("head").alias("component_id")
    )
    out = rows.join(named, "v", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 1 over all vectors."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
