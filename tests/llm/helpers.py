"""Brute-force counterparts and fixtures shared by the operators' tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, f string, text_key long, h1 long, spans string"


def frame(spark, texts, start=0, lang="en"):
    """Documents with extra columns whose names clash with those that operators use inside."""
    rows = [(start + i, t, lang, "s", len(t or ""), "x", 7, 9, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(n, seed=0, kinds=400):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) for _ in range(kinds)]
    return [r.choice(vocabulary) for _ in range(n)]


def text(n, seed=0, line=12):
    w = words(n, seed)
    return "\n".join(" ".join(w[i : i + line]) for i in range(0, n, line))


EDGE = [None, "", " ", "\n\n", "a", "x" * 5000, "é ü 日本 😀", "a  b\t c\x0bd", "same text here", "same text here"]


def union_find(n, links):
    lab = list(range(n))

    def root(x):
        while lab[x] != x:
            lab[x] = lab[lab[x]]
            x = lab[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        lab[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]
