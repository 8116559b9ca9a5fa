"""Exact nearest vectors by cosine with pivots: blocks and vectors that the triangle inequality rules out are not compared."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidar.operators.ranking import top_k
from evidar.session import saved, shared_folder

#: Scores have six digits; bounds are given that much room.
SLACK = 2e-6
KEY = ["collection_id", "width", "block"]
SCHEMA = (
    "collection_id string, width int, block string, pivots array<double>, reach array<double>, "
    "chunk_ids array<string>, ordinals array<long>, angles array<double>, vectors binary"
)


def units(lists) -> tuple[np.ndarray, np.ndarray, list]:
    """Row numbers and unit vectors of the usable lists, by width; vectors that are empty, zero or not finite are left out."""
    widths: dict[int, list] = {}
    for k, v in enumerate(lists):
        if v is not None and len(v):
            widths.setdefault(len(v), []).append(k)
    out = []
    for width, at in sorted(widths.items()):
        x = np.array([lists[k] for k in at], np.float64).reshape(len(at), width)
        norm = np.linalg.norm(x, axis=1)
        good = np.isfinite(norm) & (norm > 0)
        out.append((width, np.array(at)[good], x[good] / norm[good, None]))
    return out


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def build_vector_index(chunks: DataFrame, size: int = 128, buckets: int = 64) -> DataFrame:
    """Vectors in blocks of at most ``size`` neighbours: one row per block with two pivots and every member's angle to them.

    Each task groups the vectors it reads around members far from each other, so nothing is shuffled to build a block. The table is
    bucketed by block: later joins bring questions to the blocks and never move a vector.
    """
    rows = chunks.where("embedding IS NOT NULL").select(
        F.col("collection_id").cast("string").alias("collection_id"), F.col("chunk_id").cast("string").alias("chunk_id"),
        F.col("chunk_ordinal").cast("long").alias("chunk_ordinal"), F.col("embedding").cast("array<double>").alias("embedding"),
    ).sortWithinPartitions("collection_id")

    def cut(batches):
        for batch in batches:
            table = batch.to_pydict()
            names = np.array(table["collection_id"], object)
            for name in dict.fromkeys(table["collection_id"]):
                own = np.flatnonzero(names == name)
                for width, at, x in units([table["embedding"][k] for k in own]):
                    if not len(at):
                        continue
                    at = own[at]
                    ids, ordinals = [table["chunk_id"][k] for k in at], np.array([table["chunk_ordinal"][k] for k in at], np.int64)
                    for members in groups(x, size):
                        part = x[members]
                        centre = part.mean(0)
                        centre = centre / np.linalg.norm(centre) if np.linalg.norm(centre) > 0 else part[0]
                        far = part[np.argmin(part @ centre)]
                        pivots = np.stack([centre, far])
                        angles = angle(part @ pivots.T)
                        yield pa.RecordBatch.from_pylist([{
                            "collection_id": name, "width": width, "block": uuid.uuid5(uuid.NAMESPACE_OID, f"{name} {ids[members[0]]} {ordinals[members[0]]}").hex,
                            "pivots": pivots.ravel(), "reach": np.concatenate([angles.min(0), angles.max(0)]),
                            "chunk_ids": [ids[m] for m in members], "ordinals": ordinals[members], "angles": angles.ravel(), "vectors": part.tobytes(),
                        }], schema=ARROW)

    spark = chunks.sparkSession
    name = f"evidar_vectors_{uuid.uuid4().hex}"
    blocks = rows.mapInArrow(cut, SCHEMA)
    path = f"{shared_folder(spark)}/evidar/{name}"
    blocks.write.bucketBy(buckets, *KEY).option("path", path).saveAsTable(name)
    return spark.table(name)


ARROW = pa.schema([
    ("collection_id", pa.string()), ("width", pa.int32()), ("block", pa.string()), ("pivots", pa.list_(pa.float64())), ("reach", pa.list_(pa.float64())),
    ("chunk_ids", pa.list_(pa.string())), ("ordinals", pa.list_(pa.int64())), ("angles", pa.list_(pa.float64())), ("vectors", pa.binary()),
])


def groups(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers in groups of at most ``size``: each row goes to the nearest of a few rows far from each other, then by angle."""
    n = max(1, min(64, -(-len(x) // size)))
    seeds, best = [0], x @ x[0]
    while len(seeds) < n:
        seeds.append(int(np.argmin(best)))
        best = np.maximum(best, x @ x[seeds[-1]])
    near = x @ x[seeds].T
    home = near.argmax(1)
    order = np.lexsort((-near[np.arange(len(x)), home], home))
    out = []
    for _, members in pd.Series(order).groupby(home[order], sort=True):
        members = members.to_numpy()
        out += [members[k : k + size] for k in range(0, len(members), size)]
    return out


def _bounds(queries: DataFrame, index: DataFrame, first: int | None) -> DataFrame:
    """(query, block) pairs whose best possible cosine reaches ``least``; only the ``first`` best blocks per task if given.

    Only pivots meet questions here, a hundredth of the vectors.
    """
    asks = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(16)))
    summary = index.select(*KEY, "pivots", "reach").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    kind = dict(queries.dtypes)["query_id"]

    def compare(asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(blocks):
            q = np.stack(asked["unit"])
            pivots = np.stack(blocks["pivots"]).reshape(len(blocks), 2, -1)
            reach = np.stack(blocks["reach"]).reshape(len(blocks), 2, 2)
            least = asked["least"].fillna(-2.0).to_numpy()
            for k in range(0, len(q), 64):
                to = angle(np.einsum("qd,bpd->qbp", q[k : k + 64], pivots))
                gap = np.maximum(np.maximum(reach[None, :, 0] - to, to - reach[None, :, 1]), 0).max(2)
                bound = np.cos(gap)
                take = bound + SLACK >= least[k : k + 64, None]
                if first is not None:
                    # Nearest by the first pivot, the centre.
                    rank = np.argsort(to[:, :, 0], axis=1, kind="stable")[:, :first]
                    take = np.zeros_like(take)
                    np.put_along_axis(take, rank, True, axis=1)
                i, j = np.nonzero(take)
                found.append(pd.DataFrame({
                    "query_id": asked["query_id"].to_numpy()[k + i], "collection_id": blocks["collection_id"].to_numpy()[j], "width": blocks["width"].to_numpy()[j],
                    "block": blocks["block"].to_numpy()[j], "near": to[i, j, 0],
                }))
        return pd.concat(found) if found else pd.DataFrame(columns=["query_id", "collection_id", "width", "block", "near"])

    on = ["collection_id", "width", "part"]
    out = f"query_id {kind}, collection_id string, width int, block string, near double"
    return asks.groupBy(*on).cogroup(summary.groupBy(*on)).applyInPandas(compare, out)


def _compare(pairs: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Best ``k`` members of each asked block; the questions travel, the blocks stay in their buckets. A row without chunk_id counts the pairs."""
    kind = dict(pairs.dtypes)["query_id"]

    def best(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "collection_id", "chunk_id", "chunk_ordinal", "cosine", "compared"]
        if asked.empty or block.empty:
            return pd.DataFrame(columns=columns)
        row = block.iloc[0]
        q = np.stack(asked["unit"])
        x = np.frombuffer(row["vectors"]).reshape(-1, q.shape[1])
        pivots, angles = np.asarray(row["pivots"]).reshape(2, -1), np.asarray(row["angles"]).reshape(-1, 2)
        ids, ordinals = np.asarray(row["chunk_ids"], object), np.asarray(row["ordinals"])
        to, least = angle(q @ pivots.T), asked["least"].fillna(-2.0).to_numpy()
        found = []
        for i in range(len(q)):
            near = np.abs(angles - to[i]).max(1)
            open_ = np.flatnonzero(np.cos(near) + SLACK >= least[i])
            cosine = np.round(x[open_] @ q[i], 6)
            order = np.lexsort((ordinals[open_], -cosine))[:k]
            found.append(pd.DataFrame({
                "query_id": asked["query_id"].iloc[i], "collection_id": row["collection_id"], "chunk_id": [None, *ids[open_][order]],
                "chunk_ordinal": np.append(-1, ordinals[open_][order]), "cosine": np.append(np.nan, cosine[order]), "compared": np.append(len(open_), np.zeros(len(order), int)),
            }))
        return pd.concat(found)

    out = f"query_id {kind}, collection_id string, chunk_id string, chunk_ordinal long, cosine double, compared long"
    return pairs.groupBy(*KEY).cogroup(index.groupBy(*KEY)).applyInPandas(best, out)


def top_vectors(queries: DataFrame, index: DataFrame, k: int, first: int = 2) -> tuple[DataFrame, DataFrame]:
    """The best ``k`` chunks of a question's collection by cosine (six digits; ties by chunk order), exactly.

    The ``first`` blocks nearest to a question give a k-th score; a block or vector whose angles to the pivots rule that score out is skipped.
    Returns (query_id, collection_id, chunk_id, chunk_ordinal, vector_score, rank) and (query_id, n_pairs, n_compared), where n_compared counts
    the products that were formed. Questions without a usable vector have no rows.
    """
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, e: s + e * e))
    vector = F.col("embedding").cast("array<double>")
    asked = saved(
        queries.select("query_id", F.col("collection_id").cast("string").alias("collection_id"), vector.alias("embedding"))
        .where("embedding IS NOT NULL AND size(embedding) > 0").withColumn("_n", norm).where("_n > 0 AND _n < double('inf')")
        .select("query_id", "collection_id", F.size("embedding").alias("width"), F.transform("embedding", lambda e: e / F.col("_n")).alias("unit")), "asked")
    none = F.lit(None).cast("double").alias("least")
    begin = top_k(_bounds(asked.select("*", none), index, first), ["query_id", "collection_id"], [F.col("near"), F.col("block")], first, "_place").drop("near", "_place")
    begin = saved(begin, "first_blocks")
    own = ["query_id", "collection_id", "width"]
    known = saved(_compare(begin.join(asked, own).select("*", none), index, k), "first_found")
    ranked = top_k(known.where("chunk_id IS NOT NULL"), ["query_id", "collection_id"], [F.col("cosine").desc(), F.col("chunk_ordinal")], k, "_place")
    least = ranked.where(F.col("_place") == k).select("query_id", "collection_id", F.col("cosine").alias("least"))
    limited = asked.join(least, ["query_id", "collection_id"], "left")
    others = _bounds(limited, index, None).drop("near").join(begin, [*own, "block"], "left_anti")
    rest = saved(_compare(others.join(limited, own), index, k), "found")
    found = known.unionByName(rest)
    hits = top_k(found.where("chunk_id IS NOT NULL"), ["query_id", "collection_id"], [F.col("cosine").desc(), F.col("chunk_ordinal")], k)
    sizes = index.groupBy("collection_id", "width").agg(F.sum(F.size("ordinals")).alias("n_pairs"))
    share = asked.join(sizes, ["collection_id", "width"]).join(found.groupBy("query_id").agg(F.sum("compared").alias("n_compared")), "query_id")
    return hits.select("query_id", "collection_id", "chunk_id", "chunk_ordinal", F.col("cosine").alias("vector_score"), "rank"), share.select("query_id", "n_pairs", "n_compared")
