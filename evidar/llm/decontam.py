"""Benchmark decontamination by template windows (operator 9). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidar.functions.expr import let
from evidar.llm.common import stored

WINDOW = 8
SHORTEST = 5
#: Most words of an anchor.
GRAM = 3
PART = "struct<kind:string,n:int,rank:int,w:array<string>>"
#: Unit words that count as a unit after a number.
UNITS = (
    "km m cm mm mi miles mile feet ft inches inch kg g mg lb lbs pounds oz l ml liters litres hours hour h minutes min seconds sec s days "
    "day weeks week months month years year dollars euros pounds cents percent degrees mph kmh kw w v hz gb mb kb tb"
).split()
#: Marks of a number, a name and a unit; each stands before the value it replaces. They are private characters, blanked in the input.
NUMBER, NAME, UNIT = "\uE000", "\uE001", "\uE002"
#: Mark of any other capitalised word, which may be a name: a plain word in one template, a name in the other.
BEGIN = "\uE003"
NAME_RULE = r"([\p{L}\p{N},;:] )(\p{Lu}\p{Ll}+)"
BEGIN_RULE = r"(?=\p{Lu})(?<![\p{L}\p{N}\uE001])(\p{Lu}\p{Ll}+)"
NUMBER_RULE = r"([0-9]+(?:[.,:/][0-9]+)*)"
UNIT_WORDS = "|".join(sorted(set(UNITS), key=lambda u: (-len(u), u)))
UNIT_RULE = rf"({NUMBER}[0-9.,:/]+)\s*({UNIT_WORDS})([^\p{{L}}]|$)"
#: As the SQL has it: only a unit joined to its number.
SQL_UNIT_RULE = rf"({NUMBER}[0-9.,:/]+)\s?({UNIT_WORDS})([^\p{{L}}]|$)"
SQL_TOKEN_RULE = rf"{NUMBER}[0-9.,:/]+|[{NAME}{UNIT}]?\p{{L}}+"
#: Letters of scripts that put no blanks between words; each is a token.
UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"
TOKEN_RULE = rf"{NUMBER}[0-9.,:/]+|[{NAME}{BEGIN}{UNIT}]?\p{{L}}+"


def marked(text: Column) -> Column:
    """Text in lower case with numbers, names and units marked by type, values kept behind the marks.

    A name is a capitalised word after a word, comma, semicolon or colon and one blank, so not at a sentence's begin. Two
    passes find names that follow each other. All other capitalised words are marked as possible names.
    """
    clean = F.translate(F.coalesce(text.cast("string"), F.lit("")), NUMBER + NAME + UNIT + BEGIN, "    ")
    clean = F.when(text.rlike(UNSPACED), F.regexp_replace(clean, UNSPACED, " $1 ")).otherwise(clean)
    for _ in range(2):
        clean = F.regexp_replace(clean, NAME_RULE, f"$1{NAME}$2")
    clean = F.regexp_replace(clean, BEGIN_RULE, f"{BEGIN}$1")
    numbers = F.regexp_replace(clean, NUMBER_RULE, f" {NUMBER}$1 ")
    numbers = F.regexp_replace(numbers, UNIT_RULE, f"$1 {UNIT}$2$3")
    return F.lower(F.when(text.rlike("[0-9]"), numbers).otherwise(clean))


def tokens(marked_text: Column) -> Column:
    return F.regexp_extract_all(marked_text, F.lit(TOKEN_RULE), F.lit(0))


def template(token: Column) -> Column:
    """A marked value as its mark alone, any other token as it is; a possible name is a plain word."""
    head = F.substring(token, 1, 1)
    return F.when(head.isin(NUMBER, NAME, UNIT), head).when(head == BEGIN, F.substr(token, F.lit(2))).otherwise(token)


def named(token: Column) -> Column:
    """The template in which a possible name is a name."""
    return template(F.translate(token, BEGIN, NAME))


def verbatim(token: Column) -> Column:
    """A token with its value, told from every template."""
    return F.concat(F.lit("="), F.translate(token, NUMBER + NAME + UNIT + BEGIN, ""))


def _windows(hashes: Column, size: Column) -> Column:
    """Hash of every run of ``size`` token hashes; NULL when there are fewer."""
    def cut(h: Column) -> Column:
        return F.when(F.size(h) >= size, F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(F.slice(h, i + 1, size))))

    return let(hashes, cut)


def _items(benchmark: DataFrame, window: int, shortest: int) -> DataFrame:
    """(item_id, size, start, key, words, cut): windows of every item; an item shorter than a window is one window.

    Windows with names or possible names have a second template, in which possible names are names. A window of templates needs as many plain words as half its size, so that lists of numbers or names are no question. Any other window,
    and an item of fewer than ``shortest`` tokens, is searched for word by word with its values.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(marked(F.col("text"))).alias("t"))
    rows = rows.where(F.size("t") > 0).withColumn("size", F.least(F.size("t"), F.lit(window))).withColumn("short", F.size("t") < shortest)
    spread = rows.select("item_id", "size", "short", "t", F.explode(F.sequence(F.lit(0), F.size("t") - F.col("size"))).alias("start"))
    spread = spread.select("item_id", "size", "short", "start", F.slice("t", F.col("start") + 1, F.col("size")).alias("words"))
    listed = lambda cut: F.size(F.filter(cut, lambda t: ~t.isin(NUMBER, NAME, UNIT))) * 2 < F.col("size")
    one = spread.withColumn("cut", F.transform("words", template))
    one = one.withColumn("rule", F.when(F.col("short") | listed("cut"), F.lit("verbatim")).otherwise(F.lit("template")))
    one = one.withColumn("cut", F.when(F.col("rule") == "verbatim", F.transform("words", verbatim)).otherwise(F.col("cut")))
    two = spread.withColumn("cut", F.transform("words", named)).where(~F.col("short") & ~listed("cut"))
    two = two.where(F.exists("words", lambda t: F.substring(t, 1, 1).isin(NAME, BEGIN))).withColumn("rule", F.lit("named"))
    return one.unionByName(two).withColumn("key", F.xxhash64(F.transform("cut", lambda t: F.xxhash64(t)))).drop("short")


def _runs(text: Column) -> Column:
    """The letter runs of a text in lower case: the tokens without numbers, whatever their marks."""
    clean = F.when(text.rlike(UNSPACED), F.regexp_replace(text, UNSPACED, " $1 ")).otherwise(text)
    return F.regexp_extract_all(F.lower(clean), F.lit(r"\p{L}+"), F.lit(0))


def _anchors(items: DataFrame) -> DataFrame:
    """(kind, n, key), one for each window of ``_items``: every text that holds the window has the key among its ``_anchor_keys``.

    Numbers aside, the tokens of a window are letter runs that follow each other, and those that are no marks are known. The key is a hash
    of up to ``GRAM`` known ones in a row (ties: the longest, as rare ones mostly are); where no two follow each other, of the closest two and their
    distance; else of the one that is known; of a window without any, of the first digits of its first number.
    """
    known = lambda w, c: F.when(F.col("rule") == "verbatim", F.translate(w, NUMBER + NAME + UNIT + BEGIN, "")).when(~c.isin(NAME, UNIT), c)
    both = F.filter(F.arrays_zip("words", "cut"), lambda p: F.substring(p["words"], 1, 1) != NUMBER)
    runs = items.select(F.transform(both, lambda p: known(p["words"], p["cut"])).alias("r"), F.regexp_extract(F.array_join("words", " "), "[0-9]+", 0).alias("digits"))
    runs = runs.withColumn("i", F.explode(F.sequence(F.lit(-1), F.size("r") - 1))).withColumn("j", F.explode(F.sequence(F.col("i"), F.size("r") - 1)))
    i, j = F.col("i"), F.col("j")
    between = F.when(i >= 0, F.slice("r", F.greatest(i, F.lit(0)) + 1, j - i + 1))
    one, two = F.get("r", i), F.get("r", j)
    gram = (j > i) & (j - i < GRAM) & F.forall(between, lambda w: w.isNotNull())
    pair = (i >= 0) & (j > i) & one.isNotNull() & two.isNotNull()
    single = (i >= 0) & (j == i) & one.isNotNull()
    number = (i == -1) & (j == -1) & (F.col("digits") != "")

    def as_(kind: str, n: Column, rank: Column, words: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("n"), rank.cast("int").alias("rank"), words.alias("w")).cast(PART)

    found = (
        F.when(gram & (i >= 0), as_("gram", j - i + 1, GRAM - (j - i), between)).when(pair, as_("pair", j - i, 100 + j - i, F.array(one, two)))
        .when(single, as_("gram", F.lit(1), F.lit(1_000_000), F.array(one))).when(number, as_("digits", F.lit(1), F.lit(2_000_000), F.array("digits")))
    )
    made = runs.select("r", "digits", found.alias("p")).where("p IS NOT NULL")
    long = -F.length(F.array_join("p.w", ""))
    best = made.groupBy("r", "digits").agg(F.min(F.struct(F.col("p.rank"), long, F.col("p"))).alias("b"))
    # Words that are not there are NULL, which a hash passes over.
    hashed = [F.xxhash64(F.get("b.p.w", F.lit(k))) for k in range(GRAM)]
    hashed = [F.when(F.get("b.p.w", F.lit(k)).isNotNull(), h) for k, h in enumerate(hashed)]
    return best.select("b.p.kind", "b.p.n", F.xxhash64("b.p.kind", "b.p.n", *hashed).alias("key")).distinct()


def _anchor_keys(text: Column, kinds: list[tuple[str, int]]) -> Column:
    """Hashes of all grams of n letter runs, of pairs n apart, and of digits, as ``kinds`` asks for."""
    def of_runs(h: Column, kind: str, n: int) -> Column:
        others = range(1, n) if kind == "gram" else [n]
        return F.transform(h, lambda w, i: F.xxhash64(F.lit(kind), F.lit(n), w, *[F.get(h, i + k) for k in others]))

    none = F.array().cast("array<bigint>")
    hashes = F.transform(_runs(text), lambda w: F.xxhash64(w))
    parts = [let(hashes, lambda h: F.concat(none, *[of_runs(h, kind, n) for kind, n in kinds if kind != "digits"]))]
    if ("digits", 1) in kinds:
        parts.append(F.transform(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), lambda w: F.xxhash64(F.lit("digits"), F.lit(1), F.xxhash64(w))))
    return F.concat(*parts)


def _judged(met: DataFrame) -> DataFrame:
    """(doc_id, body_hash, item_id, n_windows, n_slots, exact) of the matched windows whose slots are consistent."""
    met = met.withColumn("same", F.forall("slots", lambda p: p["own"] == p["words"]))
    flat = lambda slots: F.array_distinct(F.flatten(F.collect_list(slots)))
    aligned = met.groupBy("doc_id", "body_hash", "item_id", "shift").agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if("same").alias("n_same"), flat(F.col("slots")).alias("slots"), flat(F.when(F.col("same"), F.col("slots"))).alias("unchanged")
    )
    mapped = F.array_distinct(F.transform("slots", lambda p: F.struct(p["own"], p["words"])))
    fits = F.size(F.array_distinct(F.transform("slots", lambda p: p["words"]))) == F.size(mapped)
    aligned = aligned.withColumn("n_windows", F.when(fits, F.col("n_all")).otherwise(F.col("n_same"))).where("n_windows > 0")
    aligned = aligned.withColumn("exact", ~fits | (F.col("n_same") == F.col("n_all")))
    aligned = aligned.withColumn("slots", F.when(fits, F.col("slots")).otherwise(F.col("unchanged")))
    return aligned.groupBy("doc_id", "body_hash", "item_id").agg(
        F.sum("n_windows").alias("n_windows"), F.max(F.size(F.array_distinct(F.filter("slots", lambda p: p["counts"])))).cast("long").alias("n_slots"), F.max("exact").alias("exact")
    )


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, body_hash, item_id, n_windows, n_slots, exact): benchmark items found in documents, re-parameterised ones too.

    Both sides become templates: numbers, names and units are typed marks. Windows of ``window`` template tokens are hash-joined. Matched windows of
    one document and item that have the same distance between their places are one alignment; its slots are consistent when every item value
    maps to one document value (5 .. 5 to 7 .. 7, not to 7 .. 9; 3 .. 5 to 4 .. 4 is). All windows of a consistent alignment count, and
    of any other those with all their own values unchanged; ``exact`` says that a consistent alignment or such a window has all values unchanged.
    Items found by the first template are judged by its windows alone, others by those of both.

    The first pass only tells which documents hold the anchor of a window: a few of its words in a row. The benchmark's anchors are
    written first; Spark broadcasts them when that table is under its limit and shuffles otherwise. Texts are marked and cut into windows, slots
    and alignments only for those documents. NULL texts and items without a token match nothing; items of fewer than ``shortest`` tokens and windows of
    mostly values match only word by word with their values. Rows equal in id and text are one document.
    Alignments hold at most one row per window of an item, whatever the document's length.
    """
    items = stored(_items(benchmark, window, shortest), "items")
    rules = {"template": template, "named": named, "verbatim": verbatim}
    sizes = [(r["size"], r["rule"]) for r in items.select("size", "rule").distinct().collect()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where("text IS NOT NULL").withColumn("body_hash", F.xxhash64("text"))
    empty = rows.select("doc_id", "body_hash", F.lit(None).cast("long").alias("item_id")).where("false")
    if not sizes:
        counts = [F.lit(0).cast("long").alias("n_windows"), F.lit(0).cast("long").alias("n_slots"), F.lit(True).alias("exact")]
        return empty.select("*", *counts)

    hashes = lambda t, rule: F.transform(t, lambda w: F.xxhash64(rule(w)))
    of = {name for _, name in sizes}
    anchors = stored(_anchors(items).coalesce(1), "anchors")
    kinds = [(r["kind"], r["n"]) for r in anchors.select("kind", "n").distinct().collect()]
    found = rows.select("doc_id", "body_hash", F.explode(_anchor_keys(F.col("text"), kinds)).alias("key")).join(anchors.select("key").distinct(), "key", "left_semi")
    suspects = stored(found.select("doc_id", "body_hash").distinct(), "suspects").withColumnsRenamed({"doc_id": "_id", "body_hash": "_hash"})

    near = rows.join(suspects, rows.doc_id.eqNullSafe(suspects._id) & (rows.body_hash == suspects._hash), "left_semi")
    near = near.dropDuplicates(["doc_id", "body_hash"]).select("doc_id", "body_hash", tokens(marked(F.col("text"))).alias("t"))
    near = stored(near, "near")
    # Places of matching windows first; tokens join them afterwards, so no list of tokens is repeated per window.
    keys = stored(items.select("size", "key").distinct().coalesce(1), "keys")
    places = None
    for size, name in sizes:
        made = near.select("doc_id", "body_hash", F.posexplode(_windows(hashes("t", rules[name]), F.lit(size))).alias("at", "key"))
        made = made.select("doc_id", "body_hash", "at", "key", F.lit(size).alias("size"), F.lit(name).alias("by"))
        places = made if places is None else places.unionByName(made)
    places = stored(places.join(keys, ["size", "key"], "left_semi"), "places").withColumnsRenamed({"doc_id": "at_id", "body_hash": "at_hash"})
    own = near.join(places, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("body_hash") == F.col("at_hash")))
    own = own.select("doc_id", "body_hash", "at", "key", "size", "by", F.slice("t", F.col("at") + 1, F.col("size")).alias("own"))
    own_cut = F.when(F.col("by") == "template", F.transform("own", template)).when(F.col("by") == "named", F.transform("own", named)).otherwise(F.transform("own", verbatim))
    met = own.withColumn("own_cut", own_cut).join(items.select("size", "key", "item_id", "start", "words", "cut", "rule"), ["size", "key"])
    # Equal templates, not only equal hashes; then the values behind the marks, side by side.
    same = F.col("own_cut") == F.col("cut")
    # A possible name counts as a slot where it differs.
    kind = lambda w: F.translate(F.substring(w, 1, 1), BEGIN, NAME)
    bare = lambda w: F.translate(w, NUMBER + NAME + UNIT + BEGIN, "")
    pairs = F.filter(F.arrays_zip("own", "words"), lambda p: kind(p["own"]).isin(NUMBER, NAME, UNIT) | kind(p["words"]).isin(NUMBER, NAME, UNIT))
    mark = lambda p: F.when(kind(p["words"]).isin(NUMBER, NAME, UNIT), kind(p["words"])).otherwise(NAME)
    pairs = F.transform(pairs, lambda p: F.struct(F.concat(mark(p), bare(p["own"])).alias("own"), F.concat(mark(p), bare(p["words"])).alias("words"), (
        F.substring(p["own"], 1, 1).isin(NUMBER, NAME, UNIT) | F.substring(p["words"], 1, 1).isin(NUMBER, NAME, UNIT) | (bare(p["own"]) != bare(p["words"]))).alias("counts")))
    met = met.where(same).select(
        "doc_id", "body_hash", "item_id", (F.col("at") - F.col("start")).alias("shift"), "start", pairs.alias("slots"),
        ((F.col("by") == F.col("rule")) & (F.col("by") != "named")).alias("first"),
    )
    if "named" not in of:
        return _judged(met)
    met = stored(met, "met")
    found = _judged(met.where("first"))
    # Items that only the second template finds, by the windows of both.
    known = found.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "body_hash", "item_id")])
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("body_hash") == F.col("_body_hash")) & F.col("item_id").eqNullSafe(F.col("_item_id"))
    return found.unionByName(_judged(met.join(known, same, "left_anti").dropDuplicates(["doc_id", "body_hash", "item_id", "shift", "start"])))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` without those that hold a benchmark item, exact or re-parameterised; all columns are kept."""
    gone = leaks(docs, benchmark, window, shortest).select(F.col("doc_id").alias("gone_id"), F.col("body_hash").alias("gone_hash")).distinct()
    # The row travels as one column, so its own columns may have any name.
    rows = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(F.col("text").cast("string")).alias("own_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(gone, F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_hash") == F.col("gone_hash")), "left_anti").select("row.*")


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Operator 9 over all documents and items: one row per document and benchmark item found in it."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return leaks(docs, benchmark).select("doc_id", "item_id", "n_windows", "n_slots", "exact")


def _sql_text() -> str:
    x = f"translate(coalesce(text, ''), '{NUMBER}{NAME}{UNIT}', '   ')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '{NAME_RULE}', '\1{NAME}\2', 'g')"
    x = rf"regexp_replace({x}, '{NUMBER_RULE}', ' {NUMBER}\1 ', 'g')"
    return rf"lower(regexp_replace({x}, '{SQL_UNIT_RULE}', '\1 {UNIT}\2\3', 'g'))"


MARKS = f"('{NUMBER}', '{NAME}', '{UNIT}')"
#: The rule with windows as texts instead of hashes and slots one to one, without units written apart, verbatim windows and possible names.
OP9_SQL = rf"""
WITH item_tokens AS (SELECT item_id AS id, regexp_extract_all({_sql_text()}, '{SQL_TOKEN_RULE}') AS t FROM benchmark),
doc_tokens AS (SELECT doc_id AS id, regexp_extract_all({_sql_text()}, '{SQL_TOKEN_RULE}') AS t FROM documents WHERE text IS NOT NULL),
items AS (
  SELECT id, t, list_transform(t, lambda w: CASE WHEN w[1] IN {MARKS} THEN w[1] ELSE w END) AS c, least(len(t), {WINDOW}) AS size
  FROM item_tokens WHERE len(t) >= {SHORTEST}),
docs AS (SELECT id, t, list_transform(t, lambda w: CASE WHEN w[1] IN {MARKS} THEN w[1] ELSE w END) AS c FROM doc_tokens),
item_places AS (SELECT id, t, c, size, unnest(range(0, len(t) - size + 1)) AS start FROM items),
item_windows AS (
  SELECT id AS item_id, size, start, t[start + 1 : start + size] AS words, array_to_string(c[start + 1 : start + size], ' ') AS k
  FROM item_places WHERE 2 * len(list_filter(c[start + 1 : start + size], lambda w: w NOT IN {MARKS})) >= size),
doc_places AS (
  SELECT d.id, d.t, d.c, s.size, unnest(range(0, len(d.t) - s.size + 1)) AS pos
  FROM docs d, (SELECT DISTINCT size FROM item_windows) s WHERE len(d.t) >= s.size),
doc_windows AS (
  SELECT id AS doc_id, size, pos, t[pos + 1 : pos + size] AS own, array_to_string(c[pos + 1 : pos + size], ' ') AS k FROM doc_places),
met AS (
  SELECT doc_id, item_id, pos - start AS shift,
         list_filter(list_zip(own, words), lambda p: p[1][1] IN {MARKS}) AS slots
  FROM doc_windows JOIN item_windows USING (size, k)),
aligned AS (
  SELECT doc_id, item_id, shift, count(*) AS n_windows, list_distinct(flatten(list(slots))) AS slots FROM met GROUP BY ALL),
fitting AS (
  SELECT *, len(list_filter(slots, lambda p: p[1] <> p[2])) = 0 AS same FROM aligned
  WHERE len(list_distinct(list_transform(slots, lambda p: p[1]))) = len(slots)
    AND len(list_distinct(list_transform(slots, lambda p: p[2]))) = len(slots))
SELECT doc_id, item_id, CAST(sum(n_windows) AS BIGINT) AS n_windows, CAST(max(len(slots)) AS BIGINT) AS n_slots, bool_or(same) AS exact
FROM fitting GROUP BY doc_id, item_id
"""
