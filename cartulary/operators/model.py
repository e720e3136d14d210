"""Regression with robust errors, k-means sweeps, PCA, TF-IDF: sums in Spark, small algebra on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.storage import stash

from .sweep import kmeans_sweep  # noqa: F401


def ols_hc1(df: DataFrame, y: Column, numeric: dict[str, Column], factors: dict[str, Column] | None = None, max_levels: int = 64) -> DataFrame:
    """term, estimate, std_error (HC1), z, p, ci_low, ci_high, n, r2 of a linear model.

    Factors are dummy coded, first level (alphabetical) dropped.  Two passes: the
    normal equations, then the squared residuals' outer products; each reduces
    to (terms x terms) numbers.  Rank deficiency is met by the pseudo-inverse.
    """
    terms: list[tuple[str, Column]] = [("intercept", F.lit(1.0))] + [(n, c.cast("double")) for n, c in numeric.items()]
    for name, c in (factors or {}).items():
        levels = sorted(str(r[0]) for r in df.select(c.cast("string")).distinct().limit(max_levels + 1).collect() if r[0] is not None)
        if len(levels) > max_levels:
            raise ValueError(f"{name} has more than {max_levels} levels")
        terms += [(f"{name}[{v}]", (c.cast("string") == v).cast("double")) for v in levels[1:]]
    k = len(terms)
    rows = df.select(y.cast("double").alias("y"), *[c.alias(f"x{i}") for i, (_, c) in enumerate(terms)]).dropna()
    x = [F.col(f"x{i}") for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    first = rows.agg(F.count("*"), F.sum("y"), F.sum(F.col("y") * F.col("y")), *[F.sum(a * F.col("y")) for a in x], *[F.sum(x[i] * x[j]) for i, j in pairs]).first()
    n, sy, syy = first[0], first[1] or 0.0, first[2] or 0.0
    if n <= k:
        raise ValueError(f"{n} rows for {k} terms")

    def square(values) -> np.ndarray:
        m = np.zeros((k, k))
        for (i, j), v in zip(pairs, values, strict=True):
            m[i, j] = m[j, i] = v
        return m

    inverse = np.linalg.pinv(square(first[3 + k :]))
    beta = inverse @ np.array(first[3 : 3 + k])
    residual = F.col("y") - sum((float(b) * a for b, a in zip(beta, x, strict=True)), F.lit(0.0))
    second = rows.withColumn("e2", residual * residual).agg(F.sum("e2"), *[F.sum(F.col("e2") * x[i] * x[j]) for i, j in pairs]).first()
    cov = inverse @ square(second[1:]) @ inverse * n / (n - k)
    r2 = 1 - second[0] / max(syy - sy * sy / n, 1e-300)
    out = []
    for (name, _), b, v in zip(terms, beta, np.diag(cov), strict=True):
        se = math.sqrt(max(float(v), 0.0))
        z = float(b) / se if se else 0.0
        out.append((name, float(b), se, z, math.erfc(abs(z) / math.sqrt(2)), float(b) - 1.959963984540054 * se, float(b) + 1.959963984540054 * se, n, float(r2)))
    return df.sparkSession.createDataFrame(out, "term string, estimate double, std_error double, z double, p double, ci_low double, ci_high double, n long, r2 double")


def kmeans_assign(df: DataFrame, item: str, vector: str, k: int, seed: int = 0) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select(item, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=30).fit(rows).transform(rows).select(item, F.col("prediction").alias("cluster"))


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings, from their contingency table."""
    t = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    two = lambda c: c * (c - 1) / 2
    ra = t.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sa"), F.sum("n").alias("total"))
    rb = t.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sb"))
    s = t.agg(F.sum(two(F.col("n"))).alias("s")).crossJoin(ra).crossJoin(rb)  # one row each
    expected = F.col("sa") * F.col("sb") / two(F.col("total"))
    return s.select(F.coalesce(F.try_divide(F.col("s") - expected, (F.col("sa") + F.col("sb")) / 2 - expected), F.lit(1.0)).alias("ari"))


def tfidf(df: DataFrame, item: str, text: str, vocabulary: int = 8000) -> DataFrame:
    """item, features: L2-normalised counts of words and word pairs times ln((1 + n) / (1 + df)) + 1."""
    from pyspark.ml.feature import CountVectorizer, NGram, Normalizer, StopWordsRemover

    words = F.filter(F.split(F.lower(F.col(text)), "[^a-z0-9]+"), lambda w: F.length(w) >= 2)
    rows = df.select(item, words.alias("w"))
    rows = StopWordsRemover(inputCol="w", outputCol="kept").transform(rows)
    rows = NGram(n=2, inputCol="kept", outputCol="pairs").transform(rows).select(item, F.concat("kept", "pairs").alias("terms"))
    rows = stash(rows, "tfidf-terms")
    counted = CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=vocabulary).fit(rows)
    n = rows.count()
    seen = rows.select(F.explode(F.array_distinct("terms")).alias("t")).groupBy("t").count()
    index = {t: i for i, t in enumerate(counted.vocabulary)}
    known = df.sparkSession.createDataFrame([(t,) for t in index], "t string")
    weight = np.ones(len(index))
    for r in seen.join(F.broadcast(known), "t").collect():  # at most ``vocabulary`` rows
        weight[index[r["t"]]] = math.log((1 + n) / (1 + r["count"])) + 1
    from pyspark.ml.feature import ElementwiseProduct
    from pyspark.ml.linalg import Vectors

    scaled = ElementwiseProduct(scalingVec=Vectors.dense(weight), inputCol="tf", outputCol="weighted").transform(counted.transform(rows))
    return Normalizer(inputCol="weighted", outputCol="features").transform(scaled).select(item, "features")


def pca(df: DataFrame, item: str, vector: str, k: int = 2) -> DataFrame:
    """item, coords: centred principal components; a component's largest loading is positive."""
    dim = df.select(F.size(vector).alias("d")).first()["d"]
    long = df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    mean = [r["m"] for r in long.groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()]
    v = F.zip_with(F.col(vector).cast("array<double>"), F.array(*map(F.lit, mean)), lambda a, b: a - b)

    def outer(batches):
        import pyarrow as pa

        total, n = np.zeros((dim, dim)), 0
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(-1, dim)
            total, n = total + x.T @ x, n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel()), pa.array(np.full(dim * dim, n))], ["at", "s", "n"])

    # Tasks' matrices are added up by Spark: one of them reaches the driver, whatever the number of partitions.
    sums = df.select(v.alias("v")).mapInArrow(outer, "at long, s double, n long").groupBy("at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("at").toArrow()
    cov = sums.column("s").to_numpy().reshape(dim, dim) / max(1, int(sums.column("n")[0].as_py()) - 1)
    _, vectors = np.linalg.eigh(cov)
    axes = vectors[:, ::-1][:, : min(k, dim)].T
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    coords = [F.aggregate(F.zip_with(v, F.array(*map(F.lit, a.tolist())), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for a in axes]
    return df.select(item, F.array(*coords, *[F.lit(0.0)] * (k - len(axes))).alias("coords"))


def logit(df: DataFrame, outcome: str, features: list[str], key: str, folds: int = 5) -> DataFrame:
    """term, estimate, and the folds' mean auc and brier of a binomial model whose folds never split a key.

    Rows belong to the fold of their key's hash; each fold is scored by the model of the others.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = df.select(F.col(outcome).cast("double").alias("label"), F.pmod(F.xxhash64(key), F.lit(folds)).alias("fold"), *[F.col(f).cast("double").alias(f) for f in features])
    rows = stash(VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(rows).select("label", "fold", "features"), "logit-rows")
    fit = lambda x: LogisticRegression(maxIter=50, tol=1e-9, standardization=False).fit(x)
    auc, brier = [], []
    for k in range(folds):
        train, test = rows.filter(F.col("fold") != k), rows.filter(F.col("fold") == k)
        seen, held = (x.agg(F.countDistinct("label")).first()[0] for x in (train, test))
        if seen == 2 and held == 2:
            said = fit(train).transform(test)
            auc.append(BinaryClassificationEvaluator().evaluate(said))
            p = vector_to_array("probability")[1]
            brier.append(said.agg(F.avg((p - F.col("label")) ** 2)).first()[0])
    m = fit(rows)
    mean = lambda x: float(np.mean(x)) if x else None
    out = [(t, float(b), mean(auc), mean(brier)) for t, b in zip(["intercept", *features], [m.intercept, *m.coefficients.toArray()], strict=True)]
    return df.sparkSession.createDataFrame(out, "term string, estimate double, auc double, brier double")


def ols_outcomes(df: DataFrame, outcomes: dict, numeric: dict, categorical: dict, **how) -> DataFrame:
    """``ols_hc1`` for every outcome (name: column), with the column outcome."""
    out = None
    for name, y in outcomes.items():
        one = ols_hc1(df, y, numeric, categorical, **how).withColumn("outcome", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
