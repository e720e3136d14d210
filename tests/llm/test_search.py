import numpy as np
from pyspark.sql import functions as F

from cartulary.llm import vp_search


def vectors(spark, x, start=0):
    return spark.createDataFrame([(start + i, v, 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, shard int")


def brute(x, k):
    out = {}
    x = [None if v is None else np.asarray(v, np.float32).astype(np.float64) for v in x]
    for q, a in enumerate(x):
        if q % 20 == 0 and a is not None:
            s = sorted((-float((a * b).sum()), i) for i, b in enumerate(x) if b is not None and i != q)
            out[q] = [(i, -v) for v, i in s[:k]]
    return out


def test_factor_one_is_exact_and_the_default_recalls(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 8)) * rng.uniform(0.2, 3, (700, 1))
    x[300:340] = x[0]
    want = brute(x.tolist(), 20)
    df = vectors(spark, [list(map(float, v)) for v in x])
    for factor, least in ((1.0, 1.0), (vp_search.FACTOR, 0.9)):
        got = {}
        for r in vp_search.nearest(df, F.col("vec_id") % 20 == 0, factor=factor, shard_rows=250, block_rows=10).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        hits = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
        assert hits >= least
        if factor == 1:
            assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
            assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q], strict=True))


def test_recall_on_the_data(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    got = {}
    for r in vp_search.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=700).collect():
        got.setdefault(r["query_id"], []).append(r["score"])
    recall = []
    for q in got:
        s = x @ x[ids == q][0]
        kth = np.sort(s[ids != q])[-20]
        recall.append(np.mean(np.array(got[q]) >= kth - 1e-12))
    assert np.mean(recall) >= 0.9


def test_unusable_vectors_and_few_candidates(spark):
    x = [[1.0, 0.0], None, [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [0.5, 0.5], [], [1.0, 0.0, 0.0]]
    df = vectors(spark, x).unionByName(vectors(spark, x))  # repeated rows
    got = [tuple(r) for r in vp_search.nearest(df, F.col("vec_id") % 20 == 0).collect()]
    assert got == [(0, 1, 6, 0.5)]
    assert vp_search.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
