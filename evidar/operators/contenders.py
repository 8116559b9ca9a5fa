"""Pairs of a question variant and a chunk that can still reach a ranked list, found where the chunk is.

Most matching pairs lose: they share a frequent word and nothing else. Two readings of the forward index score all pairs of a task as one
bounded matrix at a time and let only the best of every variant leave the task, so that what is written or shuffled grows with the questions and
the tasks, not with all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidar.config import DEFAULT, Config
from evidar.operators.lexical import PLACE, LexicalIndex, query_terms
from evidar.operators.ranking import top_k

#: Cells of a matrix, and rows that a list has to spare for sums that round the other way.
CELLS, SPARE = 2_000_000, 16


def asked_of(variants: DataFrame, index: LexicalIndex) -> dict:
    """What tasks need of the variants, by collection; ``variants`` is of checked size, like a broadcast table."""
    terms = query_terms(variants).join(index.frequencies, ["collection_id", "token"], "left").join(index.stats, "collection_id").withColumn(
        "idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    # A variant whose words the collection lacks may still occur inside longer words of it.
    lists = terms.groupBy("query_id", "variant_pos", "collection_id").agg(
        F.collect_list(F.when(F.col("df").isNotNull(), F.struct("token", "idf"))).alias("terms"), F.max("n_query_tokens").alias("n"), F.max("avg_len").alias("avg_len"))
    kept = variants.dropDuplicates(["query_id", "variant_pos"]).select("query_id", "variant_pos", "want_type", "want_page", F.col("embedding").cast("array<double>").alias("embedding"))
    found: dict = {}
    for row in lists.join(kept, ["query_id", "variant_pos"]).collect():
        found.setdefault(row["collection_id"], []).append(row)
    return {c: _Asked(rows) for c, rows in found.items()}


class _Asked:
    """The variants of one collection as arrays."""

    def __init__(self, rows: list):
        self.ids = [(r["query_id"], r["variant_pos"]) for r in rows]
        self.number = {i: v for v, i in enumerate(self.ids)}
        self.n = np.array([r["n"] for r in rows], np.float64)
        self.avg_len = max(rows[0]["avg_len"], 1.0)
        self.kind = np.array([r["want_type"] or "" for r in rows], object)
        self.page = np.array([-1 if r["want_page"] is None else r["want_page"] for r in rows], np.int64)
        self.own = np.array([r["variant_pos"] == 0 for r in rows])
        self.has = np.array([r["embedding"] is not None for r in rows])
        self.vectors = [None if r["embedding"] is None else _unit(r["embedding"]) for r in rows]
        words: dict = {}
        flat = [(words.setdefault(t["token"], len(words)), v, t["idf"]) for v, r in enumerate(rows) for t in r["terms"]]
        flat.sort(key=lambda x: x[0])
        number = np.array([x[0] for x in flat], np.int64)
        self.words = pa.array(list(words), pa.string())
        self.begin = np.searchsorted(number, np.arange(len(words) + 1))
        self.variant = np.array([x[1] for x in flat], np.int64)
        self.idf = np.array([x[2] for x in flat], np.float64)


def _unit(values) -> np.ndarray:
    v = np.array(values, np.float64)
    size = np.linalg.norm(v)
    return np.nan_to_num(v / size) if size > 0 else np.zeros(len(v))


def _scores(asked: _Asked, rows: pa.Table, at: np.ndarray, n: int, cfg: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lexical score, matched tokens, title hit and whether anything matched, of ``n`` chunks and all variants; ``at``: chunk of every row."""
    lists = rows.column("terms").combine_chunks()
    flat, sizes = lists.flatten(), pc.list_value_length(lists).fill_null(0).to_numpy()
    word = pc.fill_null(pc.index_in(flat.field("token"), value_set=asked.words), -1).to_numpy()
    hit = np.flatnonzero(word >= 0)
    word, owner = word[hit], np.repeat(np.arange(len(at)), sizes)[hit]
    tf = flat.field("tf").to_numpy()[hit].astype(np.float64)
    title = flat.field("in_title").to_numpy(zero_copy_only=False)[hit].astype(np.float64)
    length = rows.column("n_tokens").to_numpy()[owner] / asked.avg_len
    gain = tf * (cfg.k1 + 1) / (tf + cfg.k1 * ((1 - cfg.b) + cfg.b * length))
    many = asked.begin[word + 1] - asked.begin[word]
    post = np.repeat(np.arange(len(word)), many)
    entry = np.arange(len(post)) - np.repeat(np.cumsum(many) - many, many) + asked.begin[word][post]
    cell = asked.variant[entry] * n + at[owner[post]]
    shape = (len(asked.ids), n)
    sums = [np.bincount(cell, w, shape[0] * n).reshape(shape) for w in (asked.idf[entry] * gain[post], None, title[post])]
    held = rows.column("phrases").to_pylist()
    cell = np.array([asked.number[p["query_id"], p["variant_pos"]] * n + at[k] for k, own in enumerate(held) for p in own or []], np.int64)
    whole = np.bincount(cell, None, shape[0] * n).reshape(shape)
    return np.round(sums[0] + cfg.phrase_bonus * whole, 6), sums[1], sums[2] > 0, sums[1] + whole > 0


def _near(asked: _Asked, vectors: list, n: int) -> np.ndarray:
    """Largest cosine of a variant's vector with the vectors of each of ``n`` chunks, zero where one is missing."""
    near = np.zeros((len(asked.ids), n))
    flat = [(k, _unit(v)) for k, found in enumerate(vectors) for v in found or [] if v is not None]
    for width in {len(v) for v in asked.vectors if v is not None}:
        ask = [k for k, v in enumerate(asked.vectors) if v is not None and len(v) == width]
        doc = [(k, v) for k, v in flat if len(v) == width]
        if doc:
            cos = np.stack([asked.vectors[k] for k in ask]) @ np.stack([v for _, v in doc]).T
            part = np.full((len(ask), n), -np.inf)
            np.maximum.at(part, (slice(None), np.array([k for k, _ in doc])), cos)
            near[ask] = np.where(np.isfinite(part), part, 0.0)
    return np.round(near, 6)


def _best(value: np.ndarray, may: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(variant, chunk) of the best ``k`` cells of every row that ``may`` count; equal values keep ``order``."""
    key = np.where(may, (-np.round(np.nan_to_num(value) * 1e6)).astype(np.int64) * len(order) + order, np.iinfo(np.int64).max)
    if key.shape[1] > k:
        chunk = np.argpartition(key, k - 1, axis=1)[:, :k]
    else:
        chunk = np.broadcast_to(np.arange(key.shape[1]), key.shape)
    variant = np.repeat(np.arange(len(key)), chunk.shape[1])
    chunk = chunk.ravel()
    fits = may[variant, chunk]
    return variant[fits], chunk[fits]


def _blocks(batches, most: int):
    """Tables of about ``most`` rows; rows of one chunk stay together."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        while table.num_rows > most:
            change = np.flatnonzero(_starts(table))
            cut = change[np.searchsorted(change, most, side="right") - 1] or (change[1] if len(change) > 1 else 0)
            if not cut:
                break
            yield table.slice(0, int(cut))
            table = table.slice(int(cut))
        rest = table
    if rest is not None and rest.num_rows:
        yield rest


def _starts(table: pa.Table) -> np.ndarray:
    """Where rows of another place begin."""
    first = np.zeros(table.num_rows, bool)
    first[0] = True
    for name in PLACE:
        codes = pc.dictionary_encode(table.column(name).combine_chunks(), null_encoding="encode").indices.to_numpy()
        first[1:] |= codes[1:] != codes[:-1]
    return first


def scan(index: LexicalIndex, asked: dict, phrases: DataFrame, cfg: Config = DEFAULT, best: dict | None = None, keep: int = 0, vectors: DataFrame | None = None, id_type: str = "bigint") -> DataFrame:
    """The best pairs of every variant, by the lists of every task: query_id, variant_pos, collection_id, chunk_id, value.

    Without ``best``: the chunk of the largest lexical score of every variant. With the largest scores (by query_id, variant_pos): the best
    ``rrf_depth`` chunks of every variant by hybrid score, and the best ``keep`` of the question itself with a positive score and through the gate.
    """
    hits = phrases.groupBy("collection_id", "chunk_id").agg(F.collect_list(F.struct("query_id", "variant_pos")).alias("phrases"))
    rows = index.forward.join(hits, ["collection_id", "chunk_id"], "left")
    if vectors is not None and best is not None:
        held = vectors.groupBy("collection_id", "chunk_id").agg(F.collect_list(F.col("embedding").cast("array<double>")).alias("vectors"))
        rows = rows.join(held, ["collection_id", "chunk_id"], "left")
    rows = rows.repartition("collection_id", "chunk_id").sortWithinPartitions(*PLACE)
    most = max(64, CELLS // max([len(a.ids) for a in asked.values()] + [1]))

    def lists_of(a: _Asked, block: pa.Table, c) -> list:
        first = _starts(block)
        at, begin = np.cumsum(first) - 1, np.flatnonzero(first)
        n = len(begin)
        place = block.select([x for x in PLACE if x != "collection_id"]).take(pa.array(begin))
        order = np.argsort(np.argsort(pc.fill_null(place.column("chunk_ordinal"), -1).to_numpy(), kind="stable"))
        lexical, count, title, may = _scores(a, block, at, n, cfg)
        if best is None:
            return [("top", lexical, *_best(lexical, may, order, 1), 1, place)]
        top = np.array([best.get(i, 0.0) for i in a.ids])[:, None]
        share = np.divide(lexical, top, out=np.zeros_like(lexical), where=top > 0)
        kind = np.array([x or "" for x in place.column("content_type").to_pylist()], object)
        page = pc.fill_null(place.column("number"), -2).to_numpy()
        boost = cfg.title_boost * title + cfg.type_boost * ((kind == a.kind[:, None]) & (kind != "")) + cfg.page_boost * (page == a.page[:, None])
        held = block.column("vectors").take(pa.array(begin)).to_pylist() if "vectors" in block.column_names else [None] * n
        near = _near(a, held, n)
        raw = np.where(a.has[:, None], share * cfg.lexical_weight + np.maximum(near, 0) * cfg.vector_weight + boost, share + boost)
        hybrid = np.round(raw * np.nan_to_num(place.column("reliability").to_numpy(zero_copy_only=False).astype(np.float64)), 6)
        found = [("depth", hybrid, *_best(hybrid, may, order, cfg.rrf_depth + SPARE), cfg.rrf_depth + SPARE, place)]
        blend = np.round(hybrid * cfg.hybrid_blend, 6)
        gate = ((lexical >= cfg.gate_lexical) & (np.round(count / a.n[:, None], 6) >= cfg.gate_coverage)) | (near >= cfg.gate_vector)
        for name, passes in (("positive", hybrid > 0), ("gated", gate)):
            found.append((name, blend, *_best(blend, passes & may & a.own[:, None], order, keep + SPARE), keep + SPARE, place))
        return found

    def run(batches):
        kept: dict = {}
        for block in _blocks(batches, most):
            for c in pc.unique(block.column("collection_id")).to_pylist():
                if c not in asked:
                    continue
                own = block.filter(pc.equal(block.column("collection_id"), c))
                for name, value, variant, chunk, k, place in lists_of(asked[c], own, c):
                    new = {"variant": variant, "value": value[variant, chunk], "ordinal": pc.fill_null(place.column("chunk_ordinal"), -1).to_numpy()[chunk],
                           "chunk": np.array(place.column("chunk_id").to_pylist(), object)[chunk]}
                    old = kept.get((c, name))
                    both = new if old is None else {x: np.concatenate([old[x], new[x]]) for x in new}
                    order = np.lexsort((both["ordinal"], -both["value"], both["variant"]))
                    sorted_variant = both["variant"][order]
                    place_in = np.arange(len(order)) - np.searchsorted(sorted_variant, sorted_variant)
                    kept[c, name] = {x: both[x][order[place_in < k]] for x in both}
        for (c, name), part in kept.items():
            ids = asked[c].ids
            yield pa.RecordBatch.from_pydict({
                "query_id": [ids[v][0] for v in part["variant"]], "variant_pos": pa.array([ids[v][1] for v in part["variant"]], pa.int32()),
                "collection_id": [c] * len(part["variant"]), "chunk_id": pa.array(list(part["chunk"]), pa.string()), "list": [name] * len(part["variant"]), "value": part["value"], "ordinal": part["ordinal"].astype(np.int64)})

    local = rows.mapInArrow(run, f"query_id {id_type}, variant_pos int, collection_id string, chunk_id string, list string, value double, ordinal bigint")
    most_of = 1 if best is None else max(cfg.rrf_depth, keep) + SPARE
    return top_k(local, ["query_id", "variant_pos", "list"], [F.col("value").desc(), F.col("ordinal")], most_of, "_at").select(
        "query_id", "variant_pos", "collection_id", "chunk_id", "value")
