"""Sweeps of k-means: all fits share their passes, and what they say holds."""

import numpy as np
import pytest
from pyspark.errors import PythonException

from cartulary.operators import model, sweep


def knots(n, kinds=4, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, 6)) * 0.3 + np.eye(6)[np.arange(n) % kinds] * 4


def frame(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")


def standard(x):
    std = x.std(0, ddof=1)
    return (x - x.mean(0)) / np.where(std > 0, std, np.inf)


def silhouette(x, label):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    said = []
    for i in range(len(x)):
        own = label == label[i]
        a = d[i, own].sum() / max(1, own.sum() - 1)
        b = min(d[i, label == c].mean() for c in set(label.tolist()) - {label[i]})
        said.append((b - a) / max(a, b) if own.sum() > 1 and max(a, b) > 0 else 0.0)
    return float(np.mean(said))


def test_sweep_shares_its_passes(spark):
    df = frame(spark, knots(200))
    sc = spark.sparkContext
    sc.setJobGroup("sweep", "sweep")
    got = {r["k"]: r for r in model.kmeans_sweep(df, "id", "v", [2, 3, 4, 5], restarts=10).collect()}
    jobs = len(sc.statusTracker().getJobIdsForGroup("sweep"))
    sc.setJobGroup("after", "after")
    # 40 fits: one after the other they took 10 jobs and more each.
    assert jobs < 150
    x, kind = standard(knots(200)), np.arange(200) % 4
    means = np.stack([x[kind == k].mean(0) for k in range(4)])
    assert got[4]["cost"] == pytest.approx(((x - means[kind]) ** 2).sum())
    assert got[4]["silhouette"] == pytest.approx(silhouette(x, kind))
    assert (got[4]["smallest"], [k for k in got if got[k]["recommended"]]) == (50, [4])
    assert got[2]["cost"] > got[3]["cost"] > got[4]["cost"] > got[5]["cost"]


def test_sweep_is_no_worse_than_fits_one_by_one(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = np.random.default_rng(8).normal(size=(300, 5))
    got = model.kmeans_sweep(frame(spark, x), "id", "v", [6], restarts=8).first()
    rows = frame(spark, standard(x)).select(array_to_vector("v").alias("features")).cache()
    fits = [KMeans(k=6, seed=s, maxIter=30).fit(rows).summary.trainingCost for s in range(8)]
    assert got["cost"] <= 1.02 * min(fits)


def test_sweep_does_not_follow_how_rows_are_dealt(spark):
    df = frame(spark, np.random.default_rng(9).normal(size=(400, 4)))
    one, many = (model.kmeans_sweep(d, "id", "v", [3, 7], restarts=4).collect() for d in (df.coalesce(1), df.repartition(7)))
    for a, b in zip(one, many, strict=True):
        assert (a["k"], a["smallest"], a["recommended"]) == (b["k"], b["smallest"], b["recommended"])
        assert a["cost"] == pytest.approx(b["cost"]) and a["silhouette"] == pytest.approx(b["silhouette"])


def test_silhouettes_equal_the_definition(spark):
    x = np.random.default_rng(10).normal(size=(120, 3))
    x[0] = 50
    rows = sweep.Rows(frame(spark, x), "id", "v", len(x), np.zeros(3), np.ones(3))
    # One cluster of a single row, and one without any.
    models = {0: np.array([[0, 0, 1.0], [0, 1.0, 0], [50, 50, 50], [-900, 0, 0]]), 1: np.array([[0, 0, 0.0], [-900, 0, 0]])}
    found = rows.assigned(models)
    said = rows.silhouettes(models, found)
    label = ((x[:, None] - models[0][None]) ** 2).sum(2).argmin(1)
    assert found[0][0][:, 3].tolist() == np.bincount(label, minlength=4).tolist() and found[0][0][2, 3] == 1
    assert found[0][1] == pytest.approx(((x - models[0][label]) ** 2).sum())
    assert said[0] == pytest.approx(silhouette(x, label)) and said[1] is None


def test_sweep_of_odd_rows(spark):
    same = model.kmeans_sweep(frame(spark, np.ones((30, 3))), "id", "v", [2, 3], restarts=2).collect()
    assert [(r["k"], r["cost"], r["silhouette"], r["smallest"]) for r in same] == [(2, 0, None, 30), (3, 0, None, 30)]
    few = model.kmeans_sweep(frame(spark, np.repeat(np.eye(3), 12, axis=0)), "id", "v", [2, 5], restarts=2).collect()
    assert [(r["k"], r["smallest"]) for r in few] == [(2, 12), (5, 12)] and few[1]["cost"] == pytest.approx(0) and few[1]["recommended"]
    assert model.kmeans_sweep(frame(spark, np.ones((1, 3))).limit(0), "id", "v", [2]).count() == 0
    for bad in ([1.0, None], [1.0, float("nan")], [1.0]):
        rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, bad)], "id long, v array<double>")
        with pytest.raises(Exception):
            model.kmeans_sweep(rows, "id", "v", [2], restarts=1).collect()
        with pytest.raises(PythonException, match="finite"):
            sweep.Rows(rows, "id", "v", 2, np.zeros(2), np.ones(2))
