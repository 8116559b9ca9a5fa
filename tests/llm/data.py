"""Small tables with the awkward cases that every operator must bear."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; as extra columns they must do no harm.
CLASHES = "fp long, body string, body_hash string, n long, a string, b string, line int, rank int, items string, h string, key string, node int"


def prose(seed, words, alphabet=("the", "of", "ther", "ing", "an", "tion", "blen", "oush", "ere")):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4))) for _ in range(words))


def docs(spark, texts, clashes=False):
    """``texts``: list of texts or of (doc_id, text) pairs."""
    rows = [(t if isinstance(t, tuple) else (k, t)) for k, t in enumerate(texts)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    if not clashes:
        return spark.createDataFrame(rows, DOCS)
    extra = tuple(1 if part.split()[1] in ("long", "int") else "x" for part in CLASHES.split(", "))
    return spark.createDataFrame([r + extra for r in rows], f"{DOCS}, {CLASHES}")


def empty(spark):
    return spark.createDataFrame([], DOCS)


def closure(n, linked):
    """Least member of the component of each of n rows, by plain union."""
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
