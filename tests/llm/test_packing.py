import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evidar.llm import packing
from tests.llm.data import docs, empty, prose

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def check(rows, limit):
    """Places are gapless, within the limit, and no sequence is left that best fit would have filled."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limit
    return len(by)


def best_fit(lengths, limit):
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, r in enumerate(room) if r >= n]
        if fit:
            room[min(fit, key=lambda k: room[k])] -= n
        else:
            room.append(limit - n)
    return len(room)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_item_by_item(seed):
    rng = random.Random(seed)
    limit = rng.choice([10, 64, 500])
    lengths = [rng.randint(1, limit) for _ in range(rng.randint(1, 400))] + [limit] * (seed % 3)
    histogram = {n: lengths.count(n) for n in lengths}
    runs = packing.plan(histogram, limit)
    rows = []
    for k in range(len(runs["length"])):
        same = np.flatnonzero((runs["length"] == runs["length"][k]) & (runs["rank"] > runs["rank"][k]))
        end = min(runs["rank"][same], default=histogram[runs["length"][k]])
        for step in range(end - runs["rank"][k]):
            rows.append({
                "sequence_id": runs["sequence"][k] + step // runs["each"][k], "length": runs["length"][k],
                "offset": runs["offset"][k] + step % runs["each"][k] * runs["length"][k],
            })
    assert len(rows) == len(lengths)
    assert check(rows, limit) == best_fit(lengths, limit)


def test_pieces_hold_the_tokenizers_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALT_ROWS", 3)
    texts = [
        prose(1, 200), prose(1, 200), "", None, " \n\t", "It's 3.5 KM, isn't it?? I'll... été ÉTÉ  x\x1cy", "İstanbul क़ á 가 中文 <|endoftext|>z",
        "a,.b ,. ...", "x" * 5000, prose(2, 4000), "ſ ŉ ß ĳ ꭰ", prose(5, 30),
    ]
    rows = list(enumerate(texts)) + [(None, "no id"), (4, texts[0])]
    got = packing.packed_documents(docs(spark, rows, clashes=True), VOCABULARY, 500).collect()
    check(got, 500)
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = []
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(str(i), k // 500, k, len(ids[k : k + 500]), zlib.crc32(ids[k : k + 500].tobytes())) for k in range(0, len(ids), 500)]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)


def test_forgotten_words_are_encoded_anew(monkeypatch):
    monkeypatch.setattr(packing._Words, "MOST", 60)
    words = packing._Words(open(VOCABULARY, encoding="utf-8").read(), 1)
    tokenizer = Tokenizer.from_file(VOCABULARY)
    for k in range(12):
        texts = [prose(k % 5, 60), "", prose(k + 100, 30) + ", 3.5 km?!", " \n"][: k % 5]
        want = [tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]
        ids, lengths = words.texts(t.encode() for t in texts)
        assert ids.tolist() == sum(want, []) and lengths.tolist() == [len(w) for w in want]
        assert len(words.known) <= 60


def test_empty_table(spark):
    assert packing.packed_documents(empty(spark), VOCABULARY).count() == 0
