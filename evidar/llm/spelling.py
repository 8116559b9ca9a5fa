"""Spelling variant grouping by permuterm rotations (operator 11).

A word with a terminator has one rotation per split into a begin A and an end B: ``B$A``. Replacing, inserting or deleting the letter
between A and B changes only what follows ``B$A``, so all words that differ there are the prefix range of ``B$A``: the word AB
itself and the words A + letter + B. Rotations are dealt by that prefix, sorted, and each range is scanned once. A range holds
one word per letter of the alphabet at most and its words are all neighbours of each other, so a count and the two best words say everything:
no pair is ever written.

Rules: words are distinct, not empty, without ``$``; a NULL word or count is left out, and counts of a repeated word add up. Ties of a form go to the
smaller word in code-point order. Other columns are not read. A NULL text has no words, a NULL id counts as empty text. No words: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidar.llm.common import stored

END = "$"
RUN = "[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, n_near, near, near_n) of the (word, n) of ``words``.

    ``n_near`` words differ from it by exactly one inserted, deleted or replaced code point; ``near`` is the one with the largest n.
    """
    # Rows grow twentyfold here, so tasks are dealt by count, not by the few bytes of the words.
    dealt = words.where("word IS NOT NULL AND n IS NOT NULL AND word <> ''").repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    base = dealt.groupBy("word").agg(F.sum("n").alias("n"))
    size = F.char_length("word")

    def rotation(a, b):
        return F.concat(b, F.lit(END), a)

    # Every split gives the whole rotation; every letter gives the rotation that ends before it.
    splits = F.transform(
        F.sequence(F.lit(0), size),
        lambda i: F.struct(rotation(F.substring("word", F.lit(1), i), F.substring("word", i + 1, size)).alias("prefix"), F.lit("").alias("letter")),
    )
    letters = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.struct(
            rotation(F.substring("word", F.lit(1), i), F.substring("word", i + 2, size)).alias("prefix"),
            F.substring("word", i + 1, F.lit(1)).alias("letter"),
        ),
    )
    rotations = base.select("n", F.inline(F.concat(splits, letters)))
    ranges = rotations.groupBy("prefix").agg(F.collect_list(F.struct("letter", "n")).alias("range")).where(F.size("range") > 1)

    # In a range: rank by n, then word. The same word can also lose a letter elsewhere in a run of equal letters;
    # that pair counts at the first letter of the run only.
    begin, end = F.substring_index("prefix", END, -1), F.substring_index("prefix", END, 1)
    ranked = F.array_sort(F.transform("range", lambda m: F.struct((-m["n"]).alias("less"), F.concat(begin, m["letter"], end).alias("word"), m["letter"].alias("letter"))))
    last = F.right(begin, F.lit(1))
    scanned = ranges.select(
        ranked.alias("range"), last.alias("last"),
        F.size(F.filter("range", lambda m: m["letter"] != "")).alias("replaced"),
        F.size(F.filter("range", lambda m: (m["letter"] != "") & (m["letter"] != last))).alias("first"),
    ).where("replaced > 1 OR replaced < size(range)")
    whole = F.col("replaced") < F.size("range")
    found = scanned.select(F.inline(F.transform(
        "range",
        lambda m, k: F.struct(
            m["word"].alias("word"), F.lit(None).cast("long").alias("n"),
            F.when(m["letter"] == "", F.col("first")).otherwise(F.col("replaced") - 1 + (whole & (m["letter"] != F.col("last"))).cast("int")).cast("long").alias("near"),
            F.get("range", F.when(k == 0, 1).otherwise(0)).dropFields("letter").alias("best"),
        ),
    )))
    none = F.lit(None).cast(found.schema["best"].dataType)
    together = found.unionByName(base.select("word", "n", F.lit(0).cast("long").alias("near"), none.alias("best")))
    summed = together.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return summed.select("word", "n", "n_near", F.col("best.word").alias("near"), (-F.col("best.less")).alias("near_n"))


def grouped(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root): the near word that is at least ``ratio`` (2 or more) times as frequent, and where forms lead.

    Counts grow along forms, so a chain has a logarithmic number of words; pointers are doubled until none moves, each round written
    to the shared folder.
    """
    near = neighbours(words)
    far = F.col("near_n") >= ratio * F.col("n")
    table = stored(near.select("word", "n", "n_near", F.when(far, F.col("near")).alias("form"), F.when(far, F.col("near_n")).alias("form_n")), "forms")
    links = stored(table.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = links.join(onward, "root", "left")
        following = stored(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = following.select("word", "root")
        if not following.where("moved").limit(1).count():
            break
    return table.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def noted_words(docs: DataFrame, divisor: int = 97, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): lower-cased letter runs of all texts, one code point deleted where the crc32 of id and run is divisible by ``divisor``."""
    run = F.col("run")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    # lower() knows more letters than A-Z; it serves where all are ASCII.
    plain = F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, UPPER.lower()))
    hashed = runs.select("id", plain.alias("run")).select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % divisor == 0, cut).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 11 over all words of ``documents``."""
    words = stored(noted_words(spark.read.parquet(f"{sf_dir}/documents.parquet")), "words")
    return grouped(words).select("word", "form", "root", "n", "n_near", "form_n")


#: The same by deletion neighbourhoods. SQL has no crc32, so its table comes from the polynomial and runs are read letter by letter.
OP11_SQL = f"""
WITH RECURSIVE fold AS (
  SELECT i AS b, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM fold WHERE k < 8
), crc AS (SELECT b, c FROM fold WHERE k = 8),
found AS (
  SELECT doc_id, translate(run, '{UPPER}', '{UPPER.lower()}') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
  GROUP BY ALL
), bytes AS (
  SELECT doc_id, run, n, list_concat(
    list_transform(string_split(doc_id || ':', ''), lambda x: unicode(x)),
    flatten(list_transform(string_split(run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END))) AS b
  FROM found
), hashing AS (
  SELECT doc_id, run, n, b, 4294967295::BIGINT AS c, 1 AS k FROM bytes
  UNION ALL
  SELECT h.doc_id, h.run, h.n, h.b, xor(h.c >> 8, t.c), h.k + 1
  FROM hashing h JOIN crc t ON t.b = xor(h.c, h.b[h.k]::BIGINT) & 255 WHERE h.k <= len(h.b)
), hashed AS (
  SELECT run, n, xor(c, 4294967295) AS h FROM hashing WHERE k = len(b) + 1
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), less AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, range(1, 100000) t(i) WHERE i <= length(word)
), pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), walk AS (
  SELECT word, word AS at, form AS next FROM forms
  UNION ALL
  SELECT w.word, w.next, f.form FROM walk w JOIN forms f ON f.word = w.next
)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk w ON w.word = f.word AND w.next IS NULL
"""
