"""Similar token sets against all pairs."""

import random

import pytest

from evidar.operators.similar import token_jaccard_pairs

CHUNK = "collection_id string, chunk_id string, text string, token string, size int"


@pytest.mark.parametrize("min_sim", [0.3, 0.5, 0.8, 1.0])
def test_equals_all_pairs(spark, min_sim):
    rng = random.Random(int(min_sim * 10))
    words = [f"w{k}" for k in range(40)] + ["common", "words"]
    texts = []
    for k in range(120):
        text = rng.sample(words, rng.randint(0, 12)) + ["common", "words"] * (k % 3)
        texts.append(" ".join(text))
        if k % 4 == 0:
            changed = list(text)
            if changed:
                changed[rng.randrange(len(changed))] = rng.choice(words)
            texts += [" ".join(changed), " ".join(reversed(text))]
    texts += [None, "", "the", "common", "common common"]
    made = [("cd"[k % 9 == 0], f"k{k:04d}", t, "x", 1) for k, t in enumerate(texts)]
    classes, pairs = token_jaccard_pairs(spark.createDataFrame(made, CHUNK), min_sim)
    sets = {}
    for c, i, t, *_ in made:
        tokens = frozenset(w for w in (t or "").split() if w != "the")
        if tokens:
            sets[c, i] = tokens
    least = {}
    for (c, i), tokens in sorted(sets.items()):
        least.setdefault((c, tokens), i)
    assert {(r.collection_id, r.chunk_id): r.class_id for r in classes.collect()} == {k: least[k[0], v] for k, v in sets.items()}
    reps = sorted((c, i, tokens) for (c, tokens), i in least.items())
    want = {(c, i, j) for n, (c, i, x) in enumerate(reps) for d, j, y in reps[n + 1 :] if c == d and len(x & y) / len(x | y) >= min_sim}
    got = pairs.collect()
    assert {(r.collection_id, r.left_id, r.right_id) for r in got} == want and len(got) == len(want)
    assert want or min_sim == 1.0


def test_no_chunks_and_bad_bound(spark):
    empty = spark.createDataFrame([], CHUNK)
    assert [df.collect() for df in token_jaccard_pairs(empty, 0.5)] == [[], []]
    with pytest.raises(ValueError):
        token_jaccard_pairs(empty, 0.0)


def test_only_first_tokens_leave_a_set(spark):
    """Sets are read whole for partners only; what is joined are the first tokens of each set."""
    from evidar.operators import similar

    words = [f"t{k}" for k in range(100)]
    made = [("c", f"k{n}", " ".join([*words[:90], f"own{n}", *(f"x{n}y{k}" for k in range(9))]), "x", 1) for n in range(6)]
    written = []
    keep = similar.saved
    try:
        similar.saved = lambda df, name: (written.append((name, df.columns)), keep(df, name))[1]
        _, pairs = similar.token_jaccard_pairs(spark.createDataFrame(made, CHUNK), 0.8)
        assert pairs.count() == 15
    finally:
        similar.saved = keep
    # Token texts are written nowhere, and a class table holds no tokens.
    assert {name: columns for name, columns in written}["classes"] == ["collection_id", "chunk_id", "class_id"]
    assert all("tokens" not in columns and "ranked" not in columns for _, columns in written)


def test_pairs_out_of_reach_are_not_written(spark):
    """Sets that share rare tokens but are far apart are sorted out where they meet; near pairs of large sets with few shared first tokens stay."""
    from evidar.operators import similar

    rng = random.Random(3)
    vocabulary = [f"v{k}" for k in range(4000)]
    texts = []
    for n in range(40):
        own = rng.sample(vocabulary, 300 if n % 2 else 1500)
        texts += [" ".join(own)] + [" ".join(own[len(own) // 6 :] + ["x" + w for w in own[: len(own) // 50]])] * (n % 5 == 0)
    made = [("c", f"k{n:03d}", t, "x", 1) for n, t in enumerate(texts)]
    sets = [set(t.split()) for t in texts]
    want = {(f"k{i:03d}", f"k{j:03d}") for i in range(len(sets)) for j in range(i + 1, len(sets)) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    written = {}
    keep = similar.saved
    try:
        similar.saved = lambda df, name: written.setdefault(name, keep(df, name))
        _, pairs = similar.token_jaccard_pairs(spark.createDataFrame(made, CHUNK), 0.8)
        assert {(r.left_id, r.right_id) for r in pairs.collect()} == want and len(want) == 8
    finally:
        similar.saved = keep
    assert written["pairs"].count() <= 100 < len(sets) * (len(sets) - 1) // 2
