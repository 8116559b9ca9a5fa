import random
import re

import pytest
import xxhash

from evidar.llm import simhash
from tests.llm.data import closure, docs, empty, prose


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def texts():
    base = prose(1, 300)
    words = base.split()
    near = [" ".join(words[:k] + [w] + words[k + 1 :]) for k, w in ((5, "x"), (90, "y"), (200, "z"))]
    rest = [prose(s, 40) for s in range(2, 30)]
    return [base, base, *near, *rest, rest[3], None, "", " \t\n", "one", "One", "two words", prose(50, 20_000)]


@pytest.mark.parametrize("parts", [1, 2])
def test_components_equal_brute_force(spark, parts):
    rows = list(enumerate(texts())) + [(None, "no id at all"), (7, prose(8, 40)), (7, prose(8, 40))]
    got = simhash.near_duplicates(docs(spark, rows, clashes=True), parts=parts).collect()
    prints = [fingerprint(t) for _, t in rows]
    assert sorted(r["fp"] & (2**64 - 1) for r in got) == sorted(prints)
    label = closure(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    least = {}
    for (i, _), k in zip(rows, label):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    want = sorted((str(i), str(least.get(k))) for (i, _), k in zip(rows, label))
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == want


def test_dense_near_fingerprints_in_chunks(spark, monkeypatch):
    """Many fingerprints around one, so that variants are crowded and cut into chunks."""
    rng = random.Random(3)
    center = rng.getrandbits(64)
    prints = {center}
    while len(prints) < 300:
        x = rng.choice(sorted(prints)[:40])
        for _ in range(rng.randint(1, 6)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    monkeypatch.setattr(simhash, "CHUNK", 16)
    links = simhash.ball_links(spark.createDataFrame(signed, "fp long"))
    found = {(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in links.collect()}
    want = closure(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    at = {p: k for k, p in enumerate(prints)}
    linked = {(at[a], at[b]) for a, b in found} | {(at[b], at[a]) for a, b in found}
    assert closure(len(prints), lambda i, j: (i, j) in linked) == want


def test_one_of_each_and_empty_table(spark):
    rows = [(3, prose(1, 60)), (1, prose(1, 60)), (2, prose(2, 60)), (None, prose(1, 60)), (2, prose(2, 60)), (None, prose(4, 60))]
    kept = simhash.one_of_each(docs(spark, rows, clashes=True))
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([("1", prose(1, 60)), ("2", prose(2, 60)), ("None", prose(4, 60))])
    assert kept.columns == docs(spark, rows, clashes=True).columns
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.one_of_each(empty(spark)).count() == 0
