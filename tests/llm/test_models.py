"""Operators that learn: language identification, quality and lattice scores."""

import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from evidar.llm import langid, lattice, quality
from evidar.llm.common import remainder
from tests.llm.data import docs, empty, prose

SF = "/root/testdata/sf0.01"


# ---- language identification ----------------------------------------------------
def code_length(text, counts, order=3):
    """Bits of a text under counts {bytes of 4: n} by escapes from order 3 down, without exclusion."""
    levels = []
    for k in range(order, -1, -1):
        by = {}
        for gram, n in counts.items():
            tail = gram[3 - k :]
            by.setdefault(tail[:-1], Counter())[tail[-1]] += n
        levels.append((k, by))
    bits, data = 0.0, b"   " + text.encode().lower()
    for i in range(3, len(data)):
        for k, by in levels:
            seen = by.get(data[i - k : i])
            if seen is None:
                continue
            whole = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits += math.log2(whole / seen[data[i]])
                break
            bits += math.log2(whole / len(seen))
        else:
            bits += 8
    return bits


def language_docs(spark):
    rng = random.Random(1)
    en, fr = ("the", "ing", "er", "on", "th"), ("le", "aux", "é", "que", "oi")
    rows = [(k, prose(k, 12, en if k % 2 else fr), "en" if k % 2 else "fr", "s", 1) for k in range(30)]
    rows += [(40, None, "en", "s", 0), (41, "", "fr", "s", 0), (42, "123 !!", "en", "s", 0), (43, prose(9, 5), None, "s", 0), (None, "the", "en", "s", 0)]
    rows += [(44, "Ж中 the", None, "s", 0), (44, "Ж中 the", None, "s", 0), (45, "q", None, "s", 0)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_code_lengths_and_predictions(spark, monkeypatch):
    rows, df = language_docs(spark)
    monkeypatch.setattr(langid, "BLOCK", 64)  # texts are then costed in parts
    learned = {"en": Counter(), "fr": Counter()}
    for _, text, lang, *_ in rows:
        if lang and text:
            data = b"   " + text.encode().lower()
            learned[lang].update(data[i - 3 : i + 1] for i in range(3, len(data)))
    counts = langid.train(df)
    got = {(str(r["doc_id"]), r["text"]): r for r in langid.predict(df, counts).collect()}
    assert len(langid.predict(df, counts).collect()) == len(rows)
    for i, text, *_ in rows:
        r = got[str(i), text]
        if not text or not re.search(r"[^\W\d_]", text):
            assert (r["_lang"], r["_score"]) == ("und", 0.0)
            continue
        bits = {name: code_length(text, c) for name, c in learned.items()}
        best = min(sorted(bits), key=lambda name: bits[name])
        assert r["_lang"] == best
        assert r["_score"] == pytest.approx(1 / sum(2 ** (bits[best] - b) for b in bits.values()), rel=1e-9)


def test_language_edge_tables(spark):
    assert langid.predict(empty(spark), langid.train(empty(spark))).count() == 0
    nothing = langid.predict(docs(spark, ["abc"], clashes=True), langid.train(empty(spark))).collect()
    assert [(r["_lang"], r["_score"]) for r in nothing] == [("und", 0.0)]
    full = docs(spark, ["abc", None], clashes=True)
    assert langid.predict(full, langid.train(docs(spark, ["abc abc"]))).columns == [*full.columns, "_lang", "_score"]


def test_language_held_out_accuracy(spark):
    found = langid.op4_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, all_rows = found.where("held_out").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / all_rows > 0.97


# ---- quality ---------------------------------------------------------------------
def auc(rows):
    rows = sorted(rows)
    good = sum(label for _, label in rows)
    wins = sum(k for k, (_, label) in enumerate(rows, 1) if label) - good * (good + 1) / 2
    return wins / (good * (len(rows) - good))


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    found = quality.op7_quality(spark, SF).where("held_out").join(labels, "doc_id").collect()
    assert auc([(r["score"], r["quality"]) for r in found]) > 0.9


def test_quality_features_and_edges(spark):
    bucket, value, at = quality.features([b"a b a", b"", b"b***"], 16)
    assert list(at) == [0, 4, 4, 7] and value[:4].dot(value[:4]) == pytest.approx(1)
    one = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate([("good words here", 1), ("bad*** junk***", 0), (None, 1), ("x", None)] * 5)], "doc_id long, text string, label int")
    model = quality.train(one.drop("label"), one.select("doc_id", "label"))
    rows = docs(spark, ["good words here", "bad*** junk***", "", None, "good words here"], clashes=True)
    got = {}
    for r in quality.score(rows, model).collect():
        got.setdefault(r["doc_id"], r["score"])
    assert got[0] == got[4] > 0.5 > got[1] and got[2] == got[3] and 0 <= got[2] <= 1
    none = quality.train(one.drop("label"), one.select("doc_id", "label").where("false"))
    assert [r["score"] for r in quality.score(docs(spark, ["a"]), none).collect()] == [0.5]
    assert quality.score(empty(spark), model).count() == 0


# ---- lattice ----------------------------------------------------------------------
def test_lattice_sums_all_segmentations():
    import numpy as np

    pieces = sorted({b" ", b"a", b"b", b"ab", b" a", b"ba", b"aba", b" ab"})
    weights = np.log(np.arange(1, len(pieces) + 1) / 100)
    price = dict(zip(pieces, weights))

    def total(word):
        if not word:
            return 1.0
        return sum(math.exp(price[word[:n]]) * total(word[n:]) for n in range(1, len(word) + 1) if word[:n] in price)

    model = lattice.Lattice(pieces, weights)
    words = [b"a", b"ab", b"aba", b"abab", b"b", b"bbab", b"a", b"abababababab"]
    counts, expected = np.ones(len(words)), np.zeros(len(pieces))
    for rows, raw in model.by_length(words):
        found = model.log_probability(raw, counts[rows], expected)
        assert np.exp(found) == pytest.approx([total(b" " + words[k]) for k in rows])
    assert (expected * [len(p) for p in pieces]).sum() == pytest.approx(sum(len(w) + 1 for w in words))


def test_scores_of_documents(spark):
    texts = [prose(k, 30) for k in range(12)] + [None, "", "Ünique Ж " + "z" * 3000, prose(3, 30)]
    rows = list(enumerate(texts)) + [(None, "the the"), (5, "the of")]
    df = docs(spark, rows, clashes=True)
    got = lattice.score_documents(df, remainder("doc_id", 5) == 1, public_tokenizers.path("piece_bpe_32k.model")).collect()
    tokens = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    seen = Counter(w for ts, h in zip(tokens, held) if not h for w in ts)
    ends = held.count(False)
    n, v = sum(seen.values()) + ends, len(seen) + 1
    want = sorted(
        (str(i), h, len(ts) + 1, sum(seen[w] > 0 for w in ts) + 1, n, round(sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in [*(seen[w] for w in ts), ends]), 6))
        for (i, _), ts, h in zip(rows, tokens, held)
    )
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r["score"])
    assert by[12] == by[13] > by[None]
    assert lattice.score_documents(empty(spark), F.lit(False), public_tokenizers.path("piece_bpe_32k.model")).count() == 0
