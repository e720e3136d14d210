"""Vectors: centroids, exemplars, neighbours, neighbour graphs, cluster diagnostics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartulary.functions.text import cosine, entropy

from cartulary.storage import stash

from .graph import connected_components


def centroids(df: DataFrame, group: str, vector: str, weight: str | None = None) -> DataFrame:
    """group, centroid, n: (weighted) mean vectors; every dimension is summed map-side."""
    w = F.col(weight) if weight else F.lit(1.0)
    long = df.select(group, w.alias("w"), F.posexplode(vector).alias("i", "x"))
    mean = long.groupBy(group, "i").agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("m"), F.count("*").alias("n"))
    return mean.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centroid"), F.max("n").alias("n"))


def to_centroid(df: DataFrame, item: str, group: str, vector: str) -> DataFrame:
    """item, group, sim: cosine of each vector to its group's centroid."""
    c = centroids(df, group, vector).select(group, "centroid")
    return df.join(c, group).select(item, group, cosine(F.col(vector), F.col("centroid")).alias("sim"))


def exemplars(df: DataFrame, item: str, group: str, vector: str, k: int = 5, far: bool = False) -> DataFrame:
    """The k nearest (or farthest) items of each group's centroid; ties by item."""
    order = Window.partitionBy(group).orderBy(F.asc("sim") if far else F.desc("sim"), item)
    return to_centroid(df, item, group, vector).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _block_pairs(df: DataFrame, item: str, vector: str, run, schema: str, block: int = 4096) -> DataFrame:
    """``run(ids a, unit vectors a, ids b, unit vectors b)`` on every pair of blocks of bounded size: a block of rows a against all rows."""
    unit = df.select(F.col(item).cast("long").alias("item"), F.col(vector).cast("array<double>").alias("v"))
    parts = max(1, -(-unit.count() // block))
    dealt = unit.withColumn("p", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = dealt.withColumn("q", every)
    right = dealt.select("item", "v", F.col("p").alias("q")).withColumn("p", every)

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        x = np.stack([np.asarray(a, np.float64) for a in t.column("v").to_pylist()])
        s = np.linalg.norm(x, axis=1, keepdims=True)
        return t.column("item").to_numpy(), x / np.where(s > 0, s, 1)

    def call(a: pa.Table, b: pa.Table) -> pa.Table:
        columns = run(*matrix(a), *matrix(b)) if a.num_rows and b.num_rows else [[] for _ in names]
        return pa.table({n: pa.array(c, k) for (n, k), c in zip(names, columns, strict=True)})

    kinds = {"long": pa.int64(), "double": pa.float64()}
    names = [(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))]
    return left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInArrow(call, schema)


def neighbours(df: DataFrame, item: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """item, neighbour, sim, place: exact k nearest by cosine, ties by the smaller neighbour, all rows against all in blocks of bounded size."""

    def run(ia: np.ndarray, xa: np.ndarray, ib: np.ndarray, xb: np.ndarray) -> tuple[list, list, list]:
        out: tuple[list, list, list] = ([], [], [])
        at = max(0, len(ib) - k - 1)  # the item itself may be among them
        for begin in range(0, len(ia), 512):
            s = xa[begin : begin + 512] @ xb.T
            for i, row in zip(ia[begin : begin + 512].tolist(), s, strict=True):
                near = np.flatnonzero(row >= np.partition(row, at)[at] - 1e-9)  # with all ties
                near = near[ib[near] != i]
                sim = np.round(row[near], 12)
                best = np.lexsort((ib[near], -sim))[:k]
                out[0].extend([i] * len(best))
                out[1].extend(ib[near][best].tolist())
                out[2].extend(sim[best].tolist())
        return out

    found = _block_pairs(df, item, vector, run, "item long, neighbour long, sim double", block)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("sim"), "neighbour"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def graph_components(df: DataFrame, item: str, vector: str, k: int, least: float) -> DataFrame:
    """item, component: k-NN edges of similarity ``least`` or more, symmetric, joined; a lone item is its own."""
    edges = neighbours(df, item, vector, k).filter(F.col("sim") >= least).select(F.col("item").alias("u"), F.col("neighbour").alias("v"))
    parts = connected_components(edges)
    return df.select(F.col(item).cast("long").alias(item)).join(parts.withColumnRenamed("node", item), item, "left").select(item, F.coalesce("component", item).alias("component"))


def purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """cluster, n, top_share, entropy of the labels in it."""
    n = df.groupBy(cluster, label).agg(F.count("*").alias("n")).groupBy(cluster).agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.collect_list("n").alias("each"))
    return n.select(cluster, F.col("total").alias("n"), (F.col("top") / F.col("total")).alias("top_share"), entropy(F.transform("each", lambda x: x / F.col("total"))).alias("entropy"))


def hierarchical(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Average-linkage clusters by cosine distance under a threshold (driver, for bounded inputs)."""
    s = np.linalg.norm(vectors, axis=1, keepdims=True)
    x = vectors / np.where(s > 0, s, 1)
    d = 1 - x @ x.T
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(len(x)), np.arange(len(x))
    while len(x) > 1:
        i, j = divmod(int(d.argmin()), len(d))
        if not d[i, j] <= threshold:
            break
        i, j = min(i, j), max(i, j)
        merged = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def cluster_hierarchical(df: DataFrame, item: str, vector: str, threshold: float, row_limit: int = 20_000, seeds: int = 2_000) -> DataFrame:
    """item, cluster: average linkage; past ``row_limit`` rows the centroids of ``seeds`` k-means cells are linked instead."""
    from .model import kmeans_assign

    spark = df.sparkSession
    if df.count() <= row_limit:
        t = df.select(F.col(item).alias("i"), F.col(vector).cast("array<double>").alias("v")).orderBy("i").toArrow()
        label = hierarchical(np.array(t.column("v").to_pylist()), threshold)
        return spark.createDataFrame(list(zip(t.column("i").to_pylist(), label.tolist(), strict=True)), f"{item} {df.schema[item].dataType.simpleString()}, cluster long")
    cells = kmeans_assign(df, item, vector, seeds).join(df.select(item, vector), item)
    c = centroids(cells, "cluster", vector).orderBy("cluster").toArrow()
    label = hierarchical(np.array(c.column("centroid").to_pylist()), threshold)
    names = spark.createDataFrame(list(zip(c.column("cluster").to_pylist(), label.tolist(), strict=True)), "cluster int, meta long")
    return cells.join(F.broadcast(names), "cluster").select(item, F.col("meta").alias("cluster"))


def density_clusters(df: DataFrame, item: str, vector: str, min_cluster: int, min_samples: int, reach: float, block: int = 4096) -> DataFrame:
    """item, cluster (-1 noise): density clustering at one reachability level.

    Core items have ``min_samples`` others within ``reach`` (cosine distance), all
    of which are counted; cores within reach are joined, clusters of fewer than
    ``min_cluster`` cores are noise.  A pair of blocks returns counts, and then a
    spanning forest of its cores, so a dense knot costs no more rows than it has items.
    """
    least = 1 - reach - 1e-12

    def count(ia: np.ndarray, xa: np.ndarray, ib: np.ndarray, xb: np.ndarray) -> tuple[list, list]:
        n = np.concatenate([((xa[k : k + 512] @ xb.T >= least) & (ia[k : k + 512, None] != ib[None, :])).sum(1) for k in range(0, len(ia), 512)])
        return ia.tolist(), n.tolist()

    def join(ia: np.ndarray, xa: np.ndarray, ib: np.ndarray, xb: np.ndarray) -> tuple[list, list]:
        part, links = np.arange(len(ib)), ([], [])
        for k in range(0, len(ia), 512):
            for i, near in zip(ia[k : k + 512].tolist(), xa[k : k + 512] @ xb.T >= least, strict=True):
                roots, first = np.unique(part[near], return_index=True)
                hit = np.flatnonzero(near)
                for j in hit[first].tolist():
                    if int(ib[j]) != i:
                        links[0].append(i)
                        links[1].append(int(ib[j]))
                if len(roots) > 1:
                    part[np.isin(part, roots)] = roots[0]
        return links

    near = _block_pairs(df, item, vector, count, "item long, n long", block).groupBy("item").agg(F.sum("n").alias("n"))
    core = stash(near.filter(F.col("n") >= min_samples).select("item"), "density-cores")
    cores = stash(df.select(item, vector).join(core.withColumnRenamed("item", "_core"), F.col(item).cast("long") == F.col("_core"), "left_semi"), "density-core-vectors")
    parts = connected_components(stash(_block_pairs(cores, item, vector, join, "u long, v long", block), "density-links"))
    parts = core.select(F.col("item").alias("node")).join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    kept = parts.groupBy("component").count().filter(F.col("count") >= min_cluster).select("component")
    return df.select(F.col(item).cast("long").alias("node")).join(parts.join(kept, "component"), "node", "left").select(F.col("node").alias(item), F.coalesce("component", F.lit(-1)).alias("cluster"))


def weighted_documents(segments: DataFrame, doc: str, index: str, expected: str, chars: str, vector: str) -> DataFrame:
    """doc, centroid: character-weighted means of documents whose segments are complete (0..expected-1, each once)."""
    ok = segments.groupBy(F.col(doc).alias("_doc")).agg(F.count("*").alias("_n"), F.countDistinct(index).alias("_d"), F.min(index).alias("_lo"), F.max(index).alias("_hi"), F.max(expected).alias("_e"))
    ok = ok.filter("_n = _e and _d = _e and _lo = 0 and _hi = _e - 1").select(F.col("_doc").alias(doc))
    return centroids(segments.join(ok, doc, "left_semi"), doc, vector, chars).select(doc, "centroid")


