"""Edit distance against the plain table."""

import random
import time

import pytest
from pyspark.sql import functions as F

from evidar.functions.distance import edit_distance, edit_steps, within
from evidar.operators.evaluation import char_accuracy
from tests.helpers import rows


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(text, rng, n, letters):
    text = list(text)
    for _ in range(n):
        at, what = rng.randrange(len(text) + 1), rng.randrange(3)
        text[at : at + (what > 0)] = [rng.choice(letters)] if what < 2 else []
    return "".join(text)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "aé漢😀"])
def test_equals_plain_table(letters):
    rng = random.Random(len(letters))
    for _ in range(250):
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 130)))
        b = edited(a, rng, rng.randint(0, 60), letters) if rng.random() < 0.7 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 130)))
        assert edit_steps(a, b) == plain(a, b)


def test_narrow_bands_are_exact_or_refused():
    import numpy as np

    rng = random.Random(2)
    for _ in range(400):
        a = [rng.randrange(3) for _ in range(rng.randint(1, 40))]
        b = [rng.randrange(3) for _ in range(rng.randint(1, len(a)))]
        k = rng.randint(max(1, len(a) - len(b)), len(a)) if len(a) - len(b) < len(a) else len(a)
        want = plain(a, b)
        assert within(np.array(a, np.uint32), np.array(b, np.uint32), k) == (want if want <= k else None)


def test_long_texts_with_few_errors_are_quick():
    rng = random.Random(3)
    a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(128_000))
    b = edited(a, rng, 1280, "abc")
    began = time.time()
    found = edit_steps(a, b)
    assert time.time() - began < 2
    assert 1150 < found <= 1280
    assert edit_steps(b, a) == found


def test_strips_join_without_a_seam(monkeypatch):
    monkeypatch.setattr("evidar.functions.distance.STRIP", 64)
    rng = random.Random(4)
    a = "".join(rng.choice("ab") for _ in range(1500))
    b = edited(a, rng, 20, "ab")
    assert edit_steps(a, b) == plain(a, b)


def test_column(spark):
    pairs = [("kitten", "sitting"), ("", "abc"), ("same", "same"), (None, "x"), ("x", None), ("é" * 300, "e" * 299)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", edit_distance(F.col("a"), F.col("b")).alias("d"), F.levenshtein("a", "b").cast("long").alias("want")).collect()
    assert [r["d"] for r in got] == [r["want"] for r in got] == [3, 3, 0, None, None, 300]


def test_char_accuracy(spark):
    cases = [("c", "control", "contr0l"), ("e", "", ""), ("f", "", "x"), ("g", "x", ""), ("h", "a b", "AB"), ("l", "word " * 9000, "word " * 8999 + "wird ")]
    got = rows(char_accuracy(spark.createDataFrame(cases, "id string, expected string, actual string")), "id", "accuracy")
    assert got == [("c", 1 - 1 / 7), ("e", 1.0), ("f", 0.0), ("g", 0.0), ("h", 1.0), ("l", 1 - 1 / 36000)]
