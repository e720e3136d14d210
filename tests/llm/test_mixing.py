import re

import numpy as np
from pyspark.sql import functions as F

from cartulary.llm import mixing

from .helpers import EDGE, frame


def corpus(spark):
    r = np.random.default_rng(0)
    make = lambda letters, n: " ".join("".join(r.choice(list(letters), 5)) for _ in range(n))
    a = frame(spark, [make("abcde", int(r.integers(5, 60))) for _ in range(300)], 0, "xx")
    b = frame(spark, [make("vwxyz", int(r.integers(5, 60))) for _ in range(100)], 300, "yy")
    docs = a.unionByName(b)
    return docs, docs.filter("doc_id % 2 = 0").select("doc_id")


def test_rates_meet_targets(spark):
    docs, labelled = corpus(spark)
    _, members, mix = mixing.fit_mixture(docs, labelled, weights={"xx": 0.5, "yy": 0.5}, budget=6000.0)
    rows = mixing.rated(members, mix).collect()
    n = {"xx": 0.0, "yy": 0.0}
    for r in rows:
        n[r["domain"]] += r["n_tokens"] * r["rate"]
        assert r["rate"] >= 0
        assert r["copies"] in (int(r["rate"]), int(r["rate"]) + 1)
    assert all(abs(v - 3000) < 60 for v in n.values())
    true = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert np.mean([r["domain"] == true[r["doc_id"]] for r in rows]) > 0.98
    drawn = {"xx": 0, "yy": 0}
    for r in rows:
        drawn[r["domain"]] += r["n_tokens"] * r["copies"]
    assert all(abs(v - 3000) < 500 for v in drawn.values())


def test_projection_equals_brute_force_least_squares(spark):
    """Bounded least squares has one optimal vector of totals; a long plain projected gradient finds it."""
    docs, labelled = corpus(spark)
    model, members, mix = mixing.fit_mixture(docs, labelled, weights={"xx": 0.9, "yy": 0.1}, budget=20_000.0, max_rate=1.5)
    rows = members.collect()
    n, p = np.array([r["n_tokens"] for r in rows], float), np.array([r["p"] for r in rows])
    a = p * n[:, None]
    s = 1 / np.sqrt((n[:, None] * p * p).sum(0))
    r = np.ones(len(n))
    step = 0.5 / max(np.linalg.eigvalsh((a * s).T @ (a * s / n[:, None])).max(), 1e-9)
    for _ in range(3000):
        r = np.clip(r - step * (p * s) @ (s * (r @ a - mix.targets)), 0, 1.5)
    assert np.allclose(mix.totals, r @ a, rtol=0.02)


def test_whole_texts_words_and_edges(spark):
    texts = [*EDGE, "one two  three\n\tfour "]
    docs, labelled = corpus(spark)
    every = docs.unionByName(frame(spark, texts, 1000, None))
    model, members, mix = mixing.fit_mixture(every, labelled.unionByName(labelled))
    got = {r["doc_id"]: r for r in mixing.rated(members, mix).collect()}
    for i, t in enumerate(texts):
        assert got[1000 + i]["n_tokens"] == len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    out = mixing.mixed(every, model, mix).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in out} == {i: r["copies"] for i, r in got.items() if r["copies"]}


def test_totals_are_those_of_the_rates_and_domains_keep_their_names(spark, monkeypatch):
    docs, labelled = corpus(spark)
    for rounds in (0, 3, 40):
        _, members, mix = mixing.fit_mixture(docs, labelled, weights={"xx": 0.5, "yy": 0.5}, budget=6000.0, rounds=rounds)
        rows = members.collect()
        p, n = np.array([r["p"] for r in rows]), np.array([r["n_tokens"] for r in rows], float)
        assert len(mix.history) <= rounds and np.allclose(mix.totals, n @ (p * mix.rates(p)[:, None]))
    third = frame(spark, ["zzz zzq " * 9] * 3, 900, "zz")
    monkeypatch.setattr(mixing, "MAX_DOMAINS", 3)
    assert mixing.train_classifier(docs.unionByName(third), docs.unionByName(third)).domains == ["xx", "yy", "zz"]
    monkeypatch.setattr(mixing, "MAX_DOMAINS", 2)
    assert mixing.train_classifier(docs.unionByName(third), docs.unionByName(third)).domains == ["other", "xx"]


def test_no_labels_and_empty_table(spark):
    docs, labelled = corpus(spark)
    _, members, mix = mixing.fit_mixture(docs, labelled.limit(0))
    assert {(r["rate"], r["copies"]) for r in mixing.rated(members, mix).collect()} == {(1.0, 1)}
    _, members, mix = mixing.fit_mixture(docs.limit(0), labelled)
    assert mixing.rated(members, mix).count() == 0
    assert members.select(F.size("p")).count() == 0


def test_pipeline_runs_whole(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and all(r["round_trip"] for r in out)
    assert {r["doc_id"] for r in out} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
