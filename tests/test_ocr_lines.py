"""The index of known lines against a test of every line."""

import random

from pyspark.sql import functions as F

from evidar.operators.ocr import KnownLines, merge_native_ocr


def test_related_equals_every_line():
    rng = random.Random(5)
    for _ in range(200):
        lines = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(0, 6))]
        held = KnownLines()
        for line in lines:
            held.add(line)
        for _ in range(20):
            text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 16)))
            want = text in lines or (len(text) >= 8 and any(text in k or k in text for k in lines))
            assert held.related(text) == want


def test_long_pages_are_quick(spark):
    """Thousands of lines a side: a test of every line against every line would take minutes."""
    native = "\n".join(f"line number {k} of the page" for k in range(6_000))
    ocr = "\n".join(f"LINE NUMBER {k} OF THE PAGE" if k % 3 else f"another line {k} that is new" for k in range(6_000))
    row = spark.createDataFrame([(native, ocr), (None, None), ("a", None), (None, "b")], "n string, o string").select(merge_native_ocr("n", "o").alias("m")).select("m.*").collect()
    assert row[0].origin == "mixed" and row[0].text.count("\n") == 5_999 + 2 + 1_999
    assert [tuple(r) for r in row[1:]] == [("", "ocr"), ("a", "native"), ("b", "ocr")]


def test_column_inside_a_filter(spark):
    df = spark.createDataFrame([("same line here", "SAME line here"), ("one line", "one line\nand another line")], "n string, o string")
    assert [r.x for r in df.select(merge_native_ocr("n", "o").alias("m")).filter(F.col("m.origin") == "mixed").select(F.col("m.text").alias("x")).collect()] == ["one line\n\nand another line"]
