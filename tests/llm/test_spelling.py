"""Spelling variants against all pairs, plainly compared."""

import random

import pytest

from evidar.llm import catalog, spelling
from tests.llm.data import docs, empty


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words):
    """word -> (n, n_near, form, form_n, root)"""
    found = {w: [b for b in words if near(w, b)] for w in words}
    best = {w: min(found[w], key=lambda b: (-words[b], b)) if found[w] else None for w in words}
    form = {w: b if b and words[b] >= 2 * words[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (words[w], len(found[w]), form[w], words[form[w]] if form[w] else None, root(w)) for w in words}


def answer(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.mark.parametrize("letters", ["ab", "aàö", "abcdefgh"])
def test_equals_all_pairs(spark, letters):
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))): 1 << rng.randint(0, 9) for _ in range(250)}
    df = spark.createDataFrame([(w, n, "x") for w, n in words.items()], "word string, n long, form string")
    assert answer(spelling.grouped(df)) == brute(words)


def test_runs_of_equal_letters_count_once(spark):
    words = {"aaaa": 9, "aaaaa": 4, "aaaaaa": 1, "aabaa": 2, "aaba": 30}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert answer(spelling.grouped(df)) == brute(words)


def test_awkward_words(spark):
    df = spark.createDataFrame([(None, 3), ("word", None), ("", 4), ("other", 1), ("other", 2), ("othor", 3)], "word string, n long")
    assert answer(spelling.grouped(df)) == {"other": (3, 1, None, None, "other"), "othor": (3, 1, None, None, "othor")}
    assert spelling.grouped(df.limit(0)).collect() == []


def test_words_of_texts(spark):
    import re
    import zlib

    texts = ["Straße ÀÉ colour Colour COLOUR", None, "", "colour×colour ÷÷÷÷÷ KelvinKkelvin" + " favour" * 5000, "favour " * 3000, "12 34"]
    want = {}
    for k, text in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{k}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 7 == 0 else run
            if len(run) >= 5:
                want[run] = want.get(run, 0) + 1
    got = {r["word"]: r["n"] for r in spelling.noted_words(docs(spark, texts, clashes=True), 7, 5, 1).collect()}
    assert got == want
    assert spelling.noted_words(empty(spark)).collect() == []


def test_query_equals_sql(spark):
    import duckdb

    db = duckdb.connect()
    db.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = sorted(db.execute(catalog.ORACLES["op11_spelling_variants"]).fetchall())
    got = sorted(tuple(r) for r in catalog.QUERIES["op11_spelling_variants"](spark, "/root/testdata/sf0.01").collect())
    assert [r[0] for r in got] == [r[0] for r in want] and got == want
