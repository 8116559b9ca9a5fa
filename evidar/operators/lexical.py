"""Forward index, corpus statistics and BM25."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidar.config import DEFAULT, Config
from evidar.functions.expr import let, one_of, r6
from evidar.functions.text import LATIN_TOKEN, STOP_WORDS, evidence_reliability, normalize_ws, tokenize
from evidar.operators.joins import hint_small, is_small, join_hot
from evidar.operators.ranking import top_k
from evidar.session import saved

#: Characters of a posting of phrases without a whole word, and bits of the map of asked ones (4 KB).
GRAM, GRAM_BITS = 3, 1 << 15
PLACE = ["collection_id", "chunk_id", "chunk_ordinal", "content_type", "number", "reliability"]


@dataclass(frozen=True)
class LexicalIndex:
    """One row per chunk with its term counts; every statistic derives from it."""

    forward: DataFrame
    frequencies: DataFrame
    stats: DataFrame

    @property
    def postings(self) -> DataFrame:
        return postings_of(self.forward)


def postings_of(forward: DataFrame) -> DataFrame:
    return forward.select(*PLACE, "n_tokens", F.inline("terms"))


TERMS = "array<struct<token:string,tf:int,in_title:boolean>>"


def count_terms(batches):
    """Distinct tokens of every row of ``_tokens``, sorted, with their count and whether ``_title`` has them: no shuffle."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists, titles = batch.column("_tokens"), batch.column("_title")
        words = pc.dictionary_encode(pa.concat_arrays([lists.flatten(), titles.flatten()]))
        rank = np.empty(len(words.dictionary), np.int64)
        rank[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(len(rank))
        code = rank[words.indices.to_numpy()]
        n = max(len(rank), 1)
        sizes = [pc.list_value_length(x).to_numpy() for x in (lists, titles)]
        owners = [np.repeat(np.arange(batch.num_rows, dtype=np.int64), x) for x in sizes]
        cut = len(owners[0])
        found, tf = np.unique(owners[0] * n + code[:cut], return_counts=True)
        in_title = np.isin(found, owners[1] * n + code[cut:])
        sorted_words = words.dictionary.take(pc.sort_indices(words.dictionary))
        ends = np.searchsorted(found, np.arange(batch.num_rows + 1, dtype=np.int64) * n).astype(np.int32)
        terms = pa.StructArray.from_arrays(
            [sorted_words.take(pa.array(found % n)), pa.array(tf.astype(np.int32)), pa.array(in_title)], ["token", "tf", "in_title"])
        kept = [batch.column(c) for c in PLACE]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(sizes[0].astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), terms)], [*PLACE, "n_tokens", "terms"])


def build_index(chunks: DataFrame, materialize: bool = True) -> LexicalIndex:
    """A1: tokenise every chunk once; the result is written to the shared folder."""
    title = F.coalesce(F.col("title"), F.lit(""))
    tokenised = chunks.select(
        "collection_id", "chunk_id", "chunk_ordinal", "content_type", "number",
        evidence_reliability("evidence_weight", "text_origin", "ocr_confidence").alias("reliability"),
        tokenize(F.concat(title, F.lit("\n"), F.col("text"))).alias("_tokens"),
        tokenize(title).alias("_title"),
    )
    types = dict(tokenised.dtypes)
    forward = tokenised.mapInArrow(count_terms, ", ".join(f"{c} {types[c]}" for c in PLACE) + f", n_tokens int, terms {TERMS}")
    if materialize:
        forward = saved(forward, "forward")
    frequencies = postings_of(forward).groupBy("collection_id", "token").agg(F.count(F.lit(1)).alias("df"))
    stats = forward.groupBy("collection_id").agg(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("avg_len"))
    if materialize:
        # Read by every scoring step; far smaller than the postings.
        frequencies, stats = saved(frequencies, "frequencies"), saved(stats, "stats")
    return LexicalIndex(forward, frequencies, stats)


def corpus_stats(chunks: DataFrame, materialize: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A1: postings, document frequencies and collection statistics."""
    index = build_index(chunks, materialize)
    return index.postings.select("collection_id", "chunk_id", "token", "tf"), index.frequencies, index.stats


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct tokens of every query with their number."""
    with_tokens = queries.withColumn("_tokens", F.array_distinct(tokenize("text")))
    return with_tokens.select(
        "query_id", "variant_pos", "collection_id",
        F.size("_tokens").alias("n_query_tokens"), F.explode("_tokens").alias("token"),
    )


def score_postings(queries: DataFrame, index: LexicalIndex, cfg: Config = DEFAULT, pairs: DataFrame | None = None) -> DataFrame:
    """BM25 contribution of every matching (query token, chunk), or of those in ``pairs`` (query_id, variant_pos, collection_id, chunk_id).

    Query terms of a checked size are broadcast: postings then stay where their
    chunk is, and its contributions are summed before any shuffle. A frequent
    token of a large collection is a hot key otherwise, so postings are salted.
    """
    asked = query_terms(queries)
    small = is_small(asked)
    terms = (
        asked.join(index.frequencies, ["collection_id", "token"])
        .join(index.stats, "collection_id")
        .withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        .select("query_id", "variant_pos", "collection_id", "token", "n_query_tokens", "idf", "avg_len")
    )
    length = F.col("n_tokens") / F.greatest(F.col("avg_len"), F.lit(1.0))
    gain = (F.col("tf") * (cfg.k1 + 1)) / (F.col("tf") + cfg.k1 * ((1 - cfg.b) + cfg.b * length))
    if pairs is None:
        matched = join_hot(index.postings, terms, ["collection_id", "token"], "chunk_id", cfg.salts, small)
    else:
        key = ["query_id", "variant_pos", "collection_id"]
        words = asked.groupBy(*key).agg(F.collect_set("token").alias("_asked"))
        wanted = pairs.select(*key, F.col("chunk_id").alias("_chunk")).distinct().withColumnRenamed("collection_id", "_collection")
        rows = index.forward.join(
            hint_small(wanted, is_small(wanted)), (F.col("collection_id") == F.col("_collection")) & F.col("chunk_id").eqNullSafe(F.col("_chunk")))
        rows = rows.drop("_chunk", "_collection").join(hint_small(words, small), key)
        few = rows.select("query_id", "variant_pos", *PLACE, "n_tokens", F.inline(F.filter("terms", lambda w: F.array_contains(F.col("_asked"), w["token"]))))
        matched = few.join(hint_small(terms, small), [*key, "token"])
    return matched.select(
        "query_id", "variant_pos", *PLACE, "n_query_tokens", "token", "in_title",
        (F.col("idf") * gain).alias("part"),
    )


def phrase_hits(queries: DataFrame, chunks: DataFrame, index: LexicalIndex, cfg: Config = DEFAULT) -> DataFrame:
    """Chunks whose lower-cased text contains the whole normalised query.

    A word with a separator on both sides inside the query must be a token of
    every chunk that contains the query, so the postings of the rarest such word
    are a complete candidate list. Queries without such a word (one or two words,
    or parts of words) use the postings of their rarest three characters.
    """
    inner = rf"(?<=[^a-z0-9._+-])({LATIN_TOKEN})(?=[^a-z0-9._+-])"
    phrases = (
        queries.select("query_id", "variant_pos", "collection_id", F.lower(normalize_ws("text")).alias("phrase"))
        .filter(F.length("phrase") >= cfg.phrase_min_chars)
        .withColumn(
            "anchors",
            F.array_distinct(F.filter(
                F.regexp_extract_all("phrase", F.lit(inner), F.lit(1)),
                lambda w: (F.length(w) > 1) & ~one_of(w, STOP_WORDS),
            )),
        )
    )
    anchored = phrases.filter(F.size("anchors") > 0).withColumn("token", F.explode("anchors"))
    # A word missing from the collection rules the phrase out, which an inner
    # join would hide, so missing words count as frequency zero and win.
    rarest = top_k(
        anchored.join(index.frequencies, ["collection_id", "token"], "left").fillna(0, ["df"]),
        ["query_id", "variant_pos"], [F.col("df"), F.col("token")], 1, "_rarest",
    ).filter(F.col("df") > 0).select("query_id", "variant_pos", "collection_id", "token", "phrase")
    texts = chunks.select("collection_id", "chunk_id", F.lower("text").alias("_text"))
    postings = index.postings.select("collection_id", "chunk_id", "token")
    by_word = (
        join_hot(postings, rarest, ["collection_id", "token"], "chunk_id", cfg.salts, is_small(phrases))
        .join(texts, ["collection_id", "chunk_id"])
        .filter(F.contains("_text", "phrase"))
        .select("query_id", "variant_pos", "collection_id", "chunk_id")
    )
    rest = phrases.filter(F.size("anchors") == 0).drop("anchors")
    return by_word.unionByName(gram_hits(rest, texts))


def grams(text: str, size: int = GRAM) -> Column:
    """Distinct runs of ``size`` characters of a text column."""
    none = F.array().cast("array<int>")
    return let(F.split(text, ""), lambda letters: F.array_distinct(F.transform(
        F.when(F.size(letters) >= size, F.sequence(F.lit(0), F.size(letters) - size)).otherwise(none),
        lambda i: F.concat(*[F.get(letters, i + k) for k in range(size)]))))


def with_grams(df: DataFrame, text: str, size: int = GRAM) -> DataFrame:
    return df.withColumn("gram", F.explode(grams(text, size)))


def gram_hits(phrases: DataFrame, texts: DataFrame) -> DataFrame:
    """Chunks whose ``_text`` contains a ``phrase``, by postings of the phrase's rarest three characters.

    ``phrases``: query_id, variant_pos, collection_id, phrase. Only grams that some phrase asks for leave a chunk: a bit
    map of fixed size, found before the texts are read, holds them (a chance hit in it is sorted out by the join). Without phrases no
    gram is formed at all. A text is read again only for the chunks that hold the rarest gram.
    """
    asked = with_grams(phrases, "phrase").withColumn("_bit", gram_bit())
    words = asked.groupBy(F.shiftright("_bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit & 63 AS int))")).alias("bits"))
    found = words.agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m")).where("size(m) > 0")
    mask = found.select(F.transform(F.sequence(F.lit(0), F.lit(GRAM_BITS // 64 - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))))
    wanted = texts.withColumn("_mask", mask.scalar()).where("_mask IS NOT NULL")
    held = with_grams(wanted, "_text").withColumn("_bit", gram_bit()).where("getbit(get(_mask, cast(shiftright(_bit, 6) AS int)), cast(_bit & 63 AS int)) = 1")
    postings = saved(held.select("collection_id", "chunk_id", "gram"), "grams")
    key = ["collection_id", "gram"]
    counts = postings.join(asked.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("df"))
    # A gram that no chunk holds rules its phrase out: it counts as zero and wins.
    rarest = top_k(
        asked.join(counts, key, "left").fillna(0, ["df"]), ["query_id", "variant_pos"], [F.col("df"), F.col("gram")], 1, "_rarest",
    ).select("query_id", "variant_pos", *key, "phrase")
    near = postings.join(rarest, key).join(texts, ["collection_id", "chunk_id"])
    return near.filter(F.contains("_text", "phrase")).select("query_id", "variant_pos", "collection_id", "chunk_id")


def gram_bit() -> Column:
    """Place of (collection_id, gram) in the bit map of asked grams."""
    return F.pmod(F.xxhash64("collection_id", "gram"), F.lit(GRAM_BITS)).cast("int")


def bm25(
    queries: DataFrame, chunks: DataFrame, index: LexicalIndex, cfg: Config = DEFAULT, also: DataFrame | None = None,
    pairs: DataFrame | None = None, phrases: DataFrame | None = None,
) -> DataFrame:
    """A2: lexical score and token coverage of every matching chunk.

    ``also`` names further (query, chunk) pairs to keep with a score of zero. ``pairs`` names the pairs whose words count, all without it; it has
    to hold those of ``also`` and ``phrases``, the phrase hits where they are known.
    """
    words = score_postings(queries, index, cfg, pairs)
    answerable = queries.filter(F.size(tokenize("text")) > 0)
    pair = ["query_id", "variant_pos", *PLACE]
    phrases = (
        (phrase_hits(answerable, chunks, index, cfg) if phrases is None else phrases)
        .join(index.forward.select(*PLACE), ["collection_id", "chunk_id"])
        .select(*pair, F.lit(cfg.phrase_bonus).alias("part"))
    )
    rows = words.unionByName(phrases, allowMissingColumns=True)
    if also is not None:
        rows = rows.unionByName(also.select(*pair, F.lit(0.0).alias("part")), allowMissingColumns=True)
    return rows.groupBy(*pair).agg(
        r6(F.sum("part")).alias("lexical_score"),
        r6(F.coalesce(F.count("token") / F.max("n_query_tokens"), F.lit(0.0))).alias("token_coverage"),
        F.coalesce(F.max("in_title"), F.lit(False)).alias("title_hit"),
    )
