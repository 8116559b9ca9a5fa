"""Phrases against a plain substring test."""

import random

from evidar.operators.lexical import build_index, phrase_hits
from tests.helpers import chunks

ASKED = "query_id int, variant_pos int, collection_id string, text string"


def found(spark, texts, phrases):
    df = chunks(spark, [(("d" if k % 5 == 4 else "c"),) + ("k%04d" % k, k, "f", "page", 1, "l", "", "prose", t, "native", None, None, None) for k, t in enumerate(texts)])
    asked = spark.createDataFrame([(q, 0, c, p) for q, (c, p) in enumerate(phrases)], ASKED)
    return sorted((r["query_id"], int(r["chunk_id"][1:])) for r in phrase_hits(asked, df, build_index(df)).collect())


def want(texts, phrases):
    return sorted(
        (q, k) for q, (c, p) in enumerate(phrases) for k, t in enumerate(texts)
        if len(" ".join(p.split())) >= 4 and ("d" if k % 5 == 4 else "c") == c and " ".join(p.split()).lower() in t.lower())


def test_phrases_inside_words_equal_brute_force(spark):
    rng = random.Random(6)
    words = ["able", "table", "tablet", "stable cat", "unstable", "日本語処理", "naïve", "x😀yz", "ab", "the"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(60)] + ["", "abl", "ABLE", "tabl e"]
    phrases = [(rng.choice("cd"), p) for p in ["able", "tabl", "tablet", "stab", "able t", "日本語処", "x😀yz", "zzzz", "abl", "le the ta", "the table the", "ï e", "naïv", "  able  ", "unstable cat the able"] for _ in range(2)]
    assert found(spark, texts, phrases) == want(texts, phrases)


def test_no_phrase_and_no_chunk(spark):
    assert found(spark, ["some text"], []) == []
    assert found(spark, [], [("c", "able")]) == []
    assert found(spark, ["one long phrase of words here"], [("c", "long phrase of words")]) == [(0, 0)]


def test_no_join_on_the_collection_alone(spark):
    df = chunks(spark, [("c", "k0", 0, "f", "page", 1, "l", "", "prose", "a table", "native", None, None, None)])
    asked = spark.createDataFrame([(1, 0, "c", "able")], ASKED)
    plan = phrase_hits(asked, df, build_index(df))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join " in line]
    assert joins and all("gram" in j or "chunk_id" in j or "token" in j or "query_id" in j for j in joins)
    assert "collect_list" not in plan
