"""Notices against a plain edit-distance search over every place."""

import random
import re

from evidar.llm import catalog, notices
from tests.llm.data import docs, prose


def norm(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)


def ends(text, begin, side):
    """end -> least edits that turn text[begin:end] into ``side``."""
    row = {begin: 0}
    cost = list(range(len(side) + 1))
    row = {begin: cost[-1]}
    for k in range(begin, min(len(text), begin + len(side) + 20)):
        new = [cost[0] + 1]
        for j, c in enumerate(side):
            new.append(min(cost[j] + (c != text[k]), cost[j + 1] + 1, new[j] + 1))
        cost = new
        row[k + 1] = cost[-1]
    return row


def brute(text, notice):
    """Least edits of a place of ``notice``, or None."""
    before, after = notice.sides
    starts = [0] + [m.end() for m in re.finditer(" ", text)]
    best = None
    for s in starts if text else []:
        for mid, one in ends(text, s, before).items():
            if one <= notices.allowed(before) and text.startswith(notice.name, mid):
                for end, two in ends(text, mid + len(notice.name), after).items():
                    if two <= notices.allowed(after) and (end == len(text) or text[end] == " "):
                        best = min(best if best is not None else 99, one + two)
    return best


def edited(text, rng, n):
    for _ in range(n):
        k = rng.randrange(len(text))
        text = rng.choice([text[:k] + text[k + 1 :], text[:k] + rng.choice("abé ") + text[k:], text[:k] + rng.choice("xyz") + text[k + 1 :]])
    return text


def test_labels_equal_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for k in range(220):
        notice = rng.choice(notices.NOTICES)
        texts.append(f"{prose(k, rng.randint(0, 8))} {edited(notice.words, rng, rng.randint(0, 9))} {prose(k + 1, rng.randint(0, 5))}")
    found = {r["doc_id"]: r for r in notices.scan(docs(spark, texts, clashes=True)).collect()}
    hits = 0
    for k, text in enumerate(texts):
        joined = " ".join(norm(text))
        want = {n.words for n in notices.NOTICES if brute(joined, n) is not None}
        assert {s["notice"] for s in found[k]["spans"]} == want, text
        hits += len(want)
        for s in found[k]["spans"]:
            inside = " ".join(norm(text[s["begin"] : s["end"]]))
            assert inside == " ".join(norm(text)[s["first_word"] : s["last_word"] + 1])
            assert brute(inside, next(n for n in notices.NOTICES if n.words == s["notice"])) <= s["edits"]
    assert 60 < hits


def test_exact_places_and_awkward_texts(spark):
    texts = [None, "", " .,;", "MIT License", "the mit\nLICENSE, mit license mit license", "admit license", "mit licence", "GNU  General-Public\tLicense", "apache license " * 4000, "mit license é", "É mit license"]
    got = {r["doc_id"]: r for r in notices.scan(docs(spark, texts, clashes=True)).collect()}
    for k, text in enumerate(texts):
        words = norm(text)
        places = [(label, i) for phrase, label in notices.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        assert got[k]["n_words"] == len(words)
        assert sorted((p["label"], p["first_word"]) for p in got[k]["phrases"]) == sorted(places)
    assert notices.scan(docs(spark, ["x"]).limit(0)).collect() == []


def test_wrapped_and_misspelt_notice_is_found(spark):
    text = "Text.\n* Relesed under\n* the MIT Licence.\nMore text"
    span = notices.scan(docs(spark, [text])).first()["spans"][0]
    assert (span["label"], text[span["begin"] : span["end"]], span["edits"]) == ("mit", "Relesed under\n* the MIT Licence", 2)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in catalog.QUERIES["op12_license_notices"](spark, sf).collect()}
    labels = {"MIT License": "mit", "Apache License": "apache", "General Public License": "gpl", "CC BY": "cc"}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        got, words = rows[r["doc_id"]], norm(r["text"])
        at = [(label, i) for phrase, label in notices.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        assert (got["n_words"], got["n_base"], got["base_labels"]) == (len(words), len(at), ",".join(sorted({x for x, _ in at})))
        assert (got["first_word"], got["last_word"]) == ((min(i for _, i in at), max(i for _, i in at)) if at else (None, None))
        assert got["labels"] == ",".join(sorted({x for key, x in labels.items() if key in (r["text"] or "")}))
        assert got["score"] == (1.0 if got["labels"] else 0.0)
