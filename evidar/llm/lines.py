"""Line deduplication by prefix doubling over line sequences (operator 2)."""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidar.llm.common import stored, text_bytes

NO_ID = -(1 << 63)
DOC = ["id", "body_hash"]


def _documents(docs: DataFrame) -> DataFrame:
    """Internal keys and bytes; a NULL id becomes the least number and so comes first."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text_bytes().alias("body"))
    return rows.withColumn("body_hash", F.xxhash64("body"))


def _reach(weights: list[int], least: int) -> list[int]:
    """For every line, how many lines from it on hold at least ``least`` words (0: never)."""
    out, end, total = [0] * len(weights), 0, 0
    for start, own in enumerate(weights):
        while end < len(weights) and total < least:
            total += weights[end]
            end += 1
        out[start] = end - start if total >= least else 0
        total -= own
    return out


def _sequence(docs: DataFrame, least: int) -> DataFrame:
    """(id, body_hash, line, mark, ahead, behind): lines with words, numbered from 0, a 128-bit mark of their bytes, and the shortest
    runs of at least ``least`` words that begin and end with them."""

    def run(batches):
        names = [*DOC, "line", "mark", "ahead", "behind"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
        for batch in batches:
            owner, columns = [], [[], [], [], []]
            for k, text in enumerate(batch.column("body")):
                lines = [(line, len(line.split())) for line in text.as_py().split(b"\n")]
                lines = [(line, n) for line, n in lines if n]
                weights = [n for _, n in lines]
                owner += [k] * len(lines)
                columns[0] += range(len(lines))
                columns[1] += [xxhash.xxh3_128_digest(line) for line, _ in lines]
                columns[2] += _reach(weights, least)
                columns[3] += _reach(weights[::-1], least)[::-1]
                if len(owner) > 200_000:
                    yield make(batch, owner, columns, names, kinds)
                    owner, columns = [], [[], [], [], []]
            yield make(batch, owner, columns, names, kinds)

    def make(batch, owner, columns, names, kinds):
        at = pa.array(owner, pa.int32())
        keys = [batch.column(c).take(at) for c in DOC]
        return pa.RecordBatch.from_arrays([*keys, *[pa.array(c, t) for c, t in zip(columns, kinds[2:])]], names)

    found = _documents(docs).mapInArrow(run, "id long, body_hash long, line int, mark binary, ahead int, behind int")
    return stored(found.dropDuplicates([*DOC, "line"]), "lines")


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs at more than one place, ranked by the first place that has it."""
    place = F.struct(*DOC, "line")
    buckets = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("rank")).where("_n > 1").drop("_n")
    return rows.join(buckets, keys).select(*DOC, "line", "rank")


def later_runs(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """(id, body_hash, line, size): runs of ``size`` lines that occur earlier too; their union is every maximal repeated run of at
    least ``min_words`` words, in all places but its first.

    Prefix doubling: the rank of a suffix of a document's lines by its first 2^k lines is the first place that has these lines. Ranks of twice
    the length come from pairs of ranks at a distance, and only suffixes that share their prefix with another go on. A run of any
    size up to the last doubling is the bucket of two overlapping ranks, that is an interval of suffixes with a common prefix of
    that size. A maximal repeated run is the union of the shortest runs of ``min_words`` words that begin or end in it, and those have at
    most ``min_words`` lines, so no doubling beyond that is needed. Counts and first places are combined before each shuffle.
    """
    lines = _sequence(docs, min_words)
    ranks = [stored(_ranked(lines.select(*DOC, "line", "mark"), ["mark"]), "rank0")]
    while 2 ** len(ranks) <= min_words:
        half = ranks[-1]
        ahead = half.select(*DOC, (F.col("line") - 2 ** (len(ranks) - 1)).alias("line"), F.col("rank").alias("tail"))
        pairs = half.withColumnRenamed("rank", "head").join(ahead, [*DOC, "line"])
        ranks.append(stored(_ranked(pairs, ["head", "tail"]), f"rank{len(ranks)}"))
    tree = ranks[0].withColumn("level", F.lit(0))
    for k, level in enumerate(ranks[1:], 1):
        tree = tree.unionByName(level.withColumn("level", F.lit(k)))

    # Only runs that begin and end with repeated lines can be repeated.
    repeated = ranks[0].select(*DOC, "line")
    near = lines.join(repeated, [*DOC, "line"], "left_semi")
    runs = near.where("ahead > 0").select(*DOC, "line", F.col("ahead").alias("size"))
    ends = near.where("behind > 0").select(*DOC, (F.col("line") - F.col("behind") + 1).cast("int").alias("line"), F.col("behind").alias("size"))
    runs = runs.unionByName(ends).distinct()
    runs = runs.withColumn("level", F.floor(F.log2("size")).cast("int"))
    runs = runs.withColumn("second", (F.col("line") + F.col("size") - F.expr("shiftleft(1, level)")).cast("int"))
    first = tree.withColumnRenamed("rank", "head")
    second = tree.select(*DOC, F.col("line").alias("second"), F.col("rank").alias("tail"), "level")
    runs = runs.join(first, [*DOC, "line", "level"]).join(second, [*DOC, "second", "level"])
    runs = stored(runs.select(*DOC, "line", "size", "head", "tail"), "runs")
    place = F.struct(*DOC, "line")
    heads = runs.groupBy("size", "head", "tail").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("start")).where("_n > 1")
    later = runs.join(heads, ["size", "head", "tail"]).where(place > F.col("start"))
    return later.select(*DOC, "line", "size")


def remove_lines(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """``docs`` with ``text`` rid of later copies of repeated line runs, plus _n_lines and _n_removed.

    Lines are cut at line feeds and compared byte by byte; lines without words never count and stay. A run is one or more consecutive lines with words,
    of at least ``min_words`` words together. Places are ordered by doc_id (NULL first), text hash and line; the first copy of a
    run stays, also within one document. Rows equal in id and text are one place: what goes in one goes in all. A text of
    which nothing was removed is passed on unchanged, NULL included. All other columns are kept; names of this function's own columns are
    prefixed and must not occur in ``docs``.
    """
    gone = later_runs(docs, min_words).groupBy(*DOC).agg(F.collect_list(F.struct("line", "size")).alias("_runs"))
    gone = gone.withColumnsRenamed({"id": "_id", "body_hash": "_body_hash"})
    body = text_bytes()
    keyed = docs.withColumns({"_own_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_own_hash": F.xxhash64(body)})
    joined = keyed.join(gone, (F.col("_own_id") == F.col("_id")) & (F.col("_own_hash") == F.col("_body_hash")), "left")
    joined = joined.withColumn("text", F.col("text").cast("string")).select(*docs.columns, "_runs")
    schema = T.StructType([f for f in joined.schema.fields if f.name != "_runs"]).add("_n_lines", "long").add("_n_removed", "long")
    at = joined.columns.index("text")

    def rebuild(batches):
        for batch in batches:
            texts, counts, removed = [], [], []
            for text, runs in zip(batch.column("text"), batch.column("_runs")):
                text, runs = text.as_py(), runs.as_py()
                lines = (text or "").split("\n")
                full = [k for k, line in enumerate(lines) if line.encode("utf-8", "surrogatepass").split()]
                counts.append(len(full))
                drop = {full[k] for r in runs or [] for k in range(r["line"], r["line"] + r["size"])}
                removed.append(len(drop))
                texts.append("\n".join(line for k, line in enumerate(lines) if k not in drop) if drop else text)
            columns = [batch.column(c) for c in batch.schema.names if c != "_runs"]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], schema.names)

    return joined.mapInArrow(rebuild, schema)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Operator 2 over all documents: doc_id, n_lines, n_removed, kept_md5 of the remaining text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = remove_lines(docs)
    kept = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), kept.alias("kept_md5"))


WORDS_SQL = r"len(regexp_extract_all({}, '[^\x20\x09-\x0D]+'))"
#: The same rule without ranks: texts of the shortest runs are compared as they are.
OP2_SQL = rf"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
counted AS (SELECT *, {WORDS_SQL.format('line')} AS n FROM raw),
full_lines AS (SELECT doc_id, line, pos, n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM counted WHERE n > 0),
ahead AS (
  SELECT a.doc_id, a.k AS s, b.k AS e, sum(c.n) AS words
  FROM full_lines a JOIN full_lines b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 4
  JOIN full_lines c ON c.doc_id = a.doc_id AND c.k BETWEEN a.k AND b.k GROUP BY ALL HAVING sum(c.n) >= 5),
shortest AS (
  SELECT doc_id, s, min(e) AS e FROM ahead GROUP BY ALL UNION SELECT doc_id, max(s) AS s, e FROM ahead GROUP BY doc_id, e),
runs AS (
  SELECT r.doc_id, r.s, r.e, string_agg(f.line, chr(10) ORDER BY f.k) AS content
  FROM shortest r JOIN full_lines f ON f.doc_id = r.doc_id AND f.k BETWEEN r.s AND r.e GROUP BY ALL),
later AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY content, e - s ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT f.doc_id, f.pos FROM later r JOIN full_lines f ON f.doc_id = r.doc_id AND f.k BETWEEN r.s AND r.e),
kept AS (
  SELECT c.doc_id, count(*) FILTER (WHERE c.n > 0) AS n_lines, count(g.pos) AS n_removed,
         coalesce(string_agg(c.line, chr(10) ORDER BY c.pos) FILTER (WHERE g.pos IS NULL), '') AS rest
  FROM counted c LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.pos = c.pos GROUP BY c.doc_id)
SELECT doc_id, n_lines, n_removed, md5(rest) AS kept_md5 FROM kept
"""
