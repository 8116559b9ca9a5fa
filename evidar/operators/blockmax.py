"""Exact BM25 top-k that skips blocks of postings whose best possible score is too low."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidar.config import DEFAULT, Config
from evidar.functions.expr import r6
from evidar.functions.text import tokenize
from evidar.operators.lexical import LexicalIndex, phrase_hits, query_terms
from evidar.operators.ranking import top_k
from evidar.session import saved

ASKED = ["query_id", "variant_pos", "collection_id"]
#: Scores have six digits; a bound may be off by the order of its sum.
SLACK = 2e-6
BLOCK_SCHEMA = "collection_id string, block long, token string, bound double, places array<struct<chunk_id:string,chunk_ordinal:long,gain:double>>"


def build_blocks(index: LexicalIndex, size: int = 32, cfg: Config = DEFAULT) -> DataFrame:
    """Posting lists in blocks of at most ``size`` chunks: one row per (collection, block, token) with its largest gain.

    A block holds chunks of one collection that one task reads, with the same commonest token (so mostly one language or subject) and of similar
    length: its bounds are tight for few questions at a time, and no posting is shuffled. The number of a block is its first chunk's ordinal. Written to the shared folder: the bounds are read without the lists.
    """
    rows = index.forward.join(index.stats, "collection_id").select(
        F.col("collection_id").cast("string").alias("collection_id"), F.col("chunk_id").cast("string").alias("chunk_id"),
        F.col("chunk_ordinal").cast("long").alias("chunk_ordinal"), "n_tokens", "avg_len",
        F.col("terms.token").alias("tokens"), F.col("terms.tf").alias("tfs"),
        F.array_max(F.transform("terms", lambda w: F.struct(w["tf"], w["token"])))["token"].alias("commonest"),
    ).sortWithinPartitions("collection_id", "commonest", "n_tokens", "chunk_ordinal")

    def blocks_of(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            at = 0
            keys = table.column("collection_id").to_pylist()
            while at < len(keys):
                end = at
                while end < len(keys) and end - at < size and keys[end] == keys[at]:
                    end += 1
                if end == len(keys) and end - at < size:
                    break
                yield lists(table.slice(at, end - at))
                at = end
            rest = table.slice(at)
        if rest is not None and rest.num_rows:
            yield lists(rest)

    def lists(block):
        flat = block.column("tokens").combine_chunks()
        words = pc.dictionary_encode(flat.flatten())
        code = words.indices.to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(flat).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(block.num_rows), sizes)
        tf = block.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        length = block.column("n_tokens").to_numpy() / np.maximum(block.column("avg_len").to_numpy(), 1.0)
        gain = tf * (cfg.k1 + 1) / (tf + cfg.k1 * ((1 - cfg.b) + cfg.b * length[owner]))
        order = np.argsort(code, kind="stable")
        begin = np.flatnonzero(np.diff(code[order], prepend=-1))
        at = pa.array(owner[order])
        places = pa.StructArray.from_arrays([
            block.column("chunk_id").combine_chunks().take(at), block.column("chunk_ordinal").combine_chunks().take(at), pa.array(gain[order]),
        ], ["chunk_id", "chunk_ordinal", "gain"])
        ends = np.append(begin, len(code)).astype(np.int32)
        n = len(begin)
        return pa.RecordBatch.from_arrays([
            pa.array([block.column("collection_id")[0].as_py()] * n, pa.string()),
            pa.array(np.full(n, min(block.column("chunk_ordinal").to_pylist()), np.int64)),
            words.dictionary.take(pa.array(code[order][begin])),
            pa.array(np.maximum.reduceat(gain[order], begin) if n else np.zeros(0)),
            pa.ListArray.from_arrays(pa.array(ends), places),
        ], ["collection_id", "block", "token", "bound", "places"])

    return saved(rows.mapInArrow(blocks_of, BLOCK_SCHEMA), "blocks")


def _scores(terms: DataFrame, blocks: DataFrame, chosen: DataFrame) -> DataFrame:
    """Scores of all chunks in the chosen (question, block) pairs."""
    wanted = chosen.select(*ASKED, "block").join(terms, ASKED)
    parts = wanted.join(blocks, ["collection_id", "block", "token"]).select(*ASKED, "n_query_tokens", "idf", F.inline("places"))
    return parts.groupBy(*ASKED, "chunk_id", "chunk_ordinal").agg(
        F.sum(F.col("idf") * F.col("gain")).alias("score"), F.count(F.lit(1)).alias("n_found"), F.max("n_query_tokens").alias("n_query_tokens"))


def top_hits(
    queries: DataFrame, chunks: DataFrame, index: LexicalIndex, blocks: DataFrame, k: int, first: int = 4, cfg: Config = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """A2: the best ``k`` chunks of every question, as full scoring gives them, and how many blocks were read for it.

    A block's bound is the sum of its largest gains for the question's tokens. The ``first`` blocks by bound are scored; of the others, those
    whose bound reaches the k-th score found there. Chunks that hold the whole phrase are scored apart, as their bonus is in no bound.
    Returns (query_id, variant_pos, collection_id, chunk_id, chunk_ordinal, lexical_score, token_coverage, rank) and
    (query_id, variant_pos, collection_id, n_blocks, n_read).
    """
    statistics = query_terms(queries).join(index.frequencies, ["collection_id", "token"]).join(index.stats, "collection_id")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = saved(statistics.select(*ASKED, "token", "n_query_tokens", idf.alias("idf")), "terms")
    bounds = saved(
        blocks.select("collection_id", "block", "token", "bound").join(terms, ["collection_id", "token"])
        .groupBy(*ASKED, "block").agg(F.sum(F.col("idf") * F.col("bound")).alias("bound")), "bounds")
    asked = queries.filter(F.size(tokenize("text")) > 0)
    held = saved(phrase_hits(asked, chunks, index, cfg).distinct(), "phrases")

    best = top_k(bounds, ASKED, [F.col("bound").desc(), F.col("block")], first, "_place")
    begun = saved(_scores(terms, blocks, best), "scores")

    # Few chunks hold a whole phrase; they are scored from their own rows.
    rows = index.forward.join(held, ["collection_id", "chunk_id"])
    length = F.col("n_tokens") / F.greatest(F.col("avg_len"), F.lit(1.0))
    gain = (F.col("tf") * (cfg.k1 + 1)) / (F.col("tf") + cfg.k1 * ((1 - cfg.b) + cfg.b * length))
    pairs = rows.join(index.stats, "collection_id").select(*ASKED, "chunk_id", "chunk_ordinal", "n_tokens", "avg_len", F.inline_outer("terms"))
    whole = pairs.join(terms, [*ASKED, "token"], "left").groupBy(*ASKED, "chunk_id", "chunk_ordinal").agg(
        (F.coalesce(F.sum(F.col("idf") * gain), F.lit(0.0)) + cfg.phrase_bonus).alias("score"),
        F.count("idf").alias("n_found"), F.max("n_query_tokens").alias("n_query_tokens"))

    key = [*ASKED, "chunk_id"]
    known = begun.join(held, key, "left_anti").unionByName(whole)
    ranked = top_k(known, ASKED, [r6(F.col("score")).desc(), F.col("chunk_ordinal")], k, "_place")
    least = ranked.where(F.col("_place") == k).select(*ASKED, r6(F.col("score")).alias("least"))
    others = bounds.join(best.select(*ASKED, "block"), [*ASKED, "block"], "left_anti").join(least, ASKED, "left")
    needed = others.where(F.col("least").isNull() | (F.col("bound") + SLACK >= F.col("least")))
    rest = _scores(terms, blocks, needed).join(held, key, "left_anti")
    scored = known.unionByName(rest)
    hits = top_k(scored.withColumn("lexical_score", r6(F.col("score"))), ASKED, [F.col("lexical_score").desc(), F.col("chunk_ordinal")], k)
    read = bounds.groupBy(*ASKED).agg(F.count(F.lit(1)).alias("n_blocks")).join(
        best.select(*ASKED).unionByName(needed.select(*ASKED)).groupBy(*ASKED).agg(F.count(F.lit(1)).alias("n_read")), ASKED)
    return hits.select(
        *key, "chunk_ordinal", "lexical_score", r6(F.coalesce(F.col("n_found") / F.col("n_query_tokens"), F.lit(0.0))).alias("token_coverage"), "rank",
    ), read
