"""Embedding whitening by mixed-precision refinement of eigenvectors (operator 13).

Entries become integers, so sums and products of the distributed covariance are exact whatever the order of the tasks.
The driver only ever holds one number per pair of dimensions. Its eigenvectors are found in single precision and
corrected in extended precision by matrix products (Ogita and Aishima); eigenvalues too close to be told apart
are solved again inside their own subspace.

Rules: a vector that is NULL, empty, holds NULL or non-finite entries or one of 2**30 or more in size is dropped; so are vectors of
another width than the most common one (ties: the wider). Repeated rows count as often as they occur, other columns
(of any name) are not read, ids may be NULL or repeated. An empty table gives no rows. A component whose eigenvalue is not above
rounding has no whitened value (NULL). ``deviation`` is exact as decimal(38, 0), NULL beyond it; the query's long is NULL beyond a long.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = float(1 << 30)
SCALE, SHIFT = 1024.0, 100_000
EXACT = 1 << 53


def extended(top: int, below: int) -> np.longdouble:
    """A quotient of integers, rounded once to extended precision."""
    whole, rest = divmod(top << 80, below)
    high = float(whole)
    low = float(whole - int(high)) + rest / below
    return (np.longdouble(high) + np.longdouble(low)) / np.longdouble(2.0) ** 80


def eigenvectors(a: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix in extended precision.

    Starts from single precision. A round forms R = I - X'X and S = X'AX; eigenvalues further apart than what R and S
    still leave open get first-order corrections, closer ones only an orthogonal basis. Such a cluster is solved
    in double precision inside its subspace, shifted by its mean, so that its small gaps are resolved.
    """
    a = a.astype(np.longdouble)
    size = np.abs(a).max(initial=0)
    n = len(a)
    if n == 0 or size == 0:
        return np.zeros(n, np.longdouble), np.eye(n, dtype=np.longdouble)
    a = a / size
    unit = np.eye(n, dtype=np.longdouble)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    norm = np.sqrt((a * a).sum())
    last = np.inf
    for _ in range(rounds):
        r = unit - x.T @ x
        s = x.T @ (a @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2
        value = np.diag(s) / (1 - np.diag(r))
        open_ = 2 * (np.sqrt(((s - np.diag(value)) ** 2).sum()) + norm * np.sqrt((r * r).sum()))
        gap = value[None, :] - value[:, None]
        apart = np.abs(gap) > open_
        step = np.where(apart, (s + value[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ step
        change = float(np.abs(step).max())
        order = np.argsort(-value, kind="stable")
        x, value = x[:, order], value[order]
        ends = [*np.flatnonzero(value[:-1] - value[1:] > open_) + 1, n]
        turned = False
        for begin, end in zip([0, *ends], ends):
            if end - begin == 1:
                continue
            basis = x[:, begin:end]
            inner = basis.T @ (a @ basis) - value[begin:end].mean() * (basis.T @ basis)
            width = np.abs(inner).max()
            if np.abs(inner - np.diag(np.diag(inner))).max() > 2.0**-58:
                turn = np.linalg.eigh(((inner + inner.T) / (2 * width)).astype(np.float64))[1][:, ::-1]
                x[:, begin:end] = basis @ turn
                turned = True
        # A turned basis is orthogonal to double precision only, so another round follows.
        if not turned and (change < 2.0**-58 or (change >= last and change < 2.0**-40)):
            break
        last = change
    s = x.T @ (a @ x)
    value = np.diag(s) / (x * x).sum(0)
    order = np.argsort(-value, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(0))
    return value[order] * size, x


@dataclass(frozen=True)
class Whitening:
    """What the fit list determines: exact sums of x - centre, eigenvalues and eigenvectors (columns)."""

    n: int
    centre: np.ndarray
    rest: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray


def integers(column, width: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, x) of the usable vectors of an Arrow list column, one pair per width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0), np.int64)
    entries = pa.compute.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    begin = np.cumsum(size) - size
    found = []
    for w in np.unique(size[size > 0]) if width is None else [width]:
        rows = np.flatnonzero(size == w)
        values = entries[begin[rows][:, None] + np.arange(w)[None, :]]
        good = (np.abs(values) < LIMIT).all(1)
        found.append((rows[good], np.floor(SCALE * values[good]).astype(np.int64) + SHIFT))
    return found


def products(d: np.ndarray) -> np.ndarray:
    """Exact d'd as Python integers; matrix products of doubles stay below 2**53."""
    total = np.zeros((d.shape[1],) * 2, object)
    most = int(np.abs(d).max(initial=1)) ** 2 or 1
    if most >= EXACT:
        wide = d.astype(object)
        return wide.T @ wide + total
    step = max(1, EXACT // most - 1)
    for k in range(0, len(d), step):
        part = d[k : k + step].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def fit(vectors: DataFrame, column: str = "embedding") -> Whitening | None:
    """Mean and covariance of all usable vectors, and its eigenvectors; None without any vector.

    Two passes over the vectors: sums, then products about the integer next to the mean. Every task sends one number per (pair of) dimensions.
    """
    rows = vectors.select(F.col(column).alias("v"))

    def sums(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for at, x in integers(batch.column("v")):
                n, s = total.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object)])
                total[x.shape[1]] = [n + len(at), s + x.sum(0).astype(object)]
        for w, (n, s) in total.items():
            if n:
                yield pa.RecordBatch.from_pydict({
                    "w": np.full(w, w, np.int32), "k": np.arange(w, dtype=np.int32), "n": np.full(w, n, np.int64), "s": pa.array([str(v) for v in s]),
                })

    parts = rows.mapInArrow(sums, "w int, k int, n long, s string")
    found = parts.groupBy("w", "k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    if not found:
        return None
    n, width = max((int(r["n"]), int(r["w"])) for r in found)
    total = [0] * width
    for r in found:
        if r["w"] == width:
            total[r["k"]] = int(r["s"])
    centre = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    rest = [s - n * int(c) for s, c in zip(total, centre)]
    upper = np.triu_indices(width)

    def squares(batches):
        gram = np.zeros((width, width), object)
        for batch in batches:
            for at, x in integers(batch.column("v"), width):
                gram = gram + products(x - centre)
        yield pa.RecordBatch.from_pydict({
            "i": upper[0].astype(np.int32), "j": upper[1].astype(np.int32), "g": pa.array([str(v) for v in gram[upper]]),
        })

    parts = rows.mapInArrow(squares, "i int, j int, g string")
    grams = parts.groupBy("i", "j").agg(F.sum(F.col("g").cast("decimal(38,0)")).alias("g")).collect()
    cov = np.zeros((width, width), np.longdouble)
    trace = 0
    for r in grams:
        i, j = r["i"], r["j"]
        exact = n * int(r["g"]) - rest[i] * rest[j]
        cov[i, j] = cov[j, i] = extended(exact, n * n)
        trace += exact if i == j else 0
    values, x = eigenvectors(cov)
    x = x * np.where(x[np.abs(x).argmax(0), np.arange(width)] < 0, -1, 1)
    return Whitening(n, centre, rest, float(Fraction(trace, n * n)), values.astype(np.float64), x.astype(np.float64))


def whiten(vectors: DataFrame, model: Whitening | None, components: int = 8, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row per usable vector: id, exact ``deviation``, and ``whitened``, an array of up to ``components`` coordinates."""
    kind = vectors.schema[id_column].dataType.simpleString()
    rows = vectors.select(F.col(id_column).alias("id"), F.col(column).alias("v"))
    schema = f"id {kind}, deviation decimal(38,0), whitened array<double>"
    if model is None:
        return rows.limit(0).select("id", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    width = len(model.centre)
    k = min(components, width)
    floor = width * 2.0**-52 * max(float(model.values[0]), 0.0)
    good = model.values[:k] > floor
    turn = model.vectors[:, :k] / np.sqrt(np.where(good, model.values[:k], 1.0))
    mean = np.array([float(Fraction(r, model.n)) for r in model.rest])
    rest = np.array(model.rest, np.int64)

    def run(batches):
        for batch in batches:
            at, x = integers(batch.column("v"), width)[0]
            if not len(at):
                continue
            d = x - model.centre
            reach = model.n * (int(np.abs(d).max(initial=0)) + 1)
            if reach * reach * width < 1 << 62:
                deviation = pa.array(((model.n * d - rest) ** 2).sum(1)).cast(pa.decimal128(38, 0))
            else:
                exact = ((model.n * d.astype(object) - rest.astype(object)) ** 2).sum(1)
                deviation = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
            w = ((d - mean) @ turn).ravel()
            entries = pa.array(w, mask=np.tile(~good, len(at)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(w) + 1, k, dtype=np.int32)), entries)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), deviation, lists], ["id", "deviation", "whitened"])

    return rows.mapInArrow(run, schema)


def identity_error(whitened: DataFrame) -> float | None:
    """Largest entry, by size, of the covariance of the ``whitened`` arrays minus the identity; components without values are left out."""
    def moments(batches):
        n, one, two = 0, 0.0, 0.0
        for batch in batches:
            lists = batch.column("whitened")
            if len(lists):
                w = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
                n, one, two = n + len(w), one + w.sum(0), two + w.T @ w
        if n:
            k = len(one)
            yield pa.RecordBatch.from_pydict({
                "i": np.repeat(np.arange(k + 1, dtype=np.int32), k), "j": np.tile(np.arange(k, dtype=np.int32), k + 1),
                "n": np.full(k * (k + 1), n, np.int64), "s": np.concatenate([two, one[None, :]]).ravel(),
            })

    found = whitened.select("whitened").mapInArrow(moments, "i int, j int, n long, s double")
    cells = found.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    if not cells:
        return None
    k = max(r["j"] for r in cells) + 1
    s = np.zeros((k + 1, k))
    for r in cells:
        s[r["i"], r["j"]] = r["s"] / r["n"]
    error = np.abs(s[:k] - np.outer(s[k], s[k]) - np.eye(k))
    return float(np.nanmax(error)) if np.isfinite(error).any() else None


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 13: eight components of all usable vectors of ``embeddings``."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = fit(vectors)
    found = whiten(vectors, model)
    error = identity_error(found)
    share = [float(e) / model.trace if model.trace else 0.0 for e in model.values[:8]] if model else []
    return found.select(
        F.col("id").alias("vec_id"), F.posexplode("whitened").alias("_k", "whitened"), F.lit(model.n if model else 0).cast("long").alias("n"),
        F.expr("try_cast(deviation AS bigint)").alias("deviation"),
    ).select(
        "vec_id", (F.col("_k") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
        F.get(F.array(*[F.lit(v) for v in share]).cast("array<double>"), F.col("_k")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
