"""Operator 3: approximate nearest neighbours with vantage-point trees per shard.

Nearness is the largest inner product.  Giving every vector one more component,
``sqrt(M^2 - |x|^2)`` with ``M`` the longest norm of all, makes it a Euclidean
metric: ``d(q, x)^2 = |q|^2 + M^2 - 2 q.x``, so vantage-point trees apply.

Every vector is indexed.  Shards are regions: a vector belongs to the nearest of
at most ``CENTERS`` centres (a sample of the vectors, taken in the order of a
hash), and a region of more than ``shard_rows`` vectors is dealt to several
shards, so one holds a bounded number whatever lies there.  A task holds one
shard, builds its tree over the distinct vectors once and streams queries
through it.  A query first asks its own region; the k-th best score it finds
there is the bound with which it asks only those other regions that may hold
something better: all whose ring of distances around their centre comes within
``factor`` times the distance of that k-th best.  In a tree, too, a subtree is
skipped when the query's distance to the vantage point differs from the
splitting radius by more than ``factor`` times the distance of its k-th best so
far: factor 1 is the triangle inequality and gives exact search, a smaller one
skips more.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, neither as queries nor as candidates; only vectors of
a query's own length are its candidates; rows that repeat an id count once
(the smallest vector of them); equal vectors are one point of the tree and tie
by vec_id; fewer than ``k`` candidates are all returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

K = 20
SHARD_ROWS = 16_384
#: Queries that share a copy of a shard.
BLOCK_ROWS = 65_536
CENTERS = 1_024
LEAF = 192
#: Chosen by recall against brute force (README).
FACTOR = 0.55
#: Points kept beyond k, against rounding in the matrix products that rank them.
SPARE = 4


class Tree:
    """A vantage-point tree over the rows of ``points`` (float64, one component added)."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 11):
        self.points, self.leaf, self.rng = points, leaf, np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        tried = self.rng.choice(rows, min(6, len(rows)), replace=False)
        seen = self.points[self.rng.choice(rows, min(256, len(rows)), replace=False)]
        spread = [np.std(np.sqrt(((seen - self.points[t]) ** 2).sum(1))) for t in tried]
        vantage = self.points[tried[int(np.argmax(spread))]]
        d = np.sqrt(((self.points[rows] - vantage) ** 2).sum(1))
        radius = float(np.median(d))
        inside = d <= radius
        if inside.all():  # more than half lie at the same distance
            inside = d < radius
            if not inside.any():
                return rows
            radius = float(d[inside].max())
        return vantage, radius, self._build(rows[inside]), self._build(rows[~inside])

    def search(self, queries: np.ndarray, keep: int, factor: float, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ``keep`` points of largest inner product found: (scores, rows), unordered, -1 where none.

        What scores below a query's ``floor`` needn't be found.
        """
        floor = np.full(len(queries), -np.inf) if floor is None else floor
        best = np.full((len(queries), keep), -np.inf)
        rows = np.full((len(queries), keep), -1, np.int64)
        top2 = (queries**2).sum(1) + (float((self.points**2).sum(1).max()) if len(self.points) else 0.0)

        def scan(leaf: np.ndarray, q: np.ndarray) -> None:
            s = np.concatenate([best[q], queries[q] @ self.points[leaf].T], axis=1)
            r = np.concatenate([rows[q], np.broadcast_to(leaf, (len(q), len(leaf)))], axis=1)
            at = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
            best[q], rows[q] = np.take_along_axis(s, at, 1), np.take_along_axis(r, at, 1)

        def visit(node, q: np.ndarray) -> None:
            if not len(q):
                return
            if isinstance(node, np.ndarray):
                scan(node, q)
                return
            vantage, radius, inside, outside = node
            d = np.sqrt(np.maximum(((queries[q] - vantage) ** 2).sum(1), 0))
            near = d <= radius
            visit(inside, q[near])
            visit(outside, q[~near])
            reach = np.sqrt(np.maximum(top2[q] - 2 * np.maximum(best[q].min(1), floor[q]), 0)) * factor + 1e-9
            more = np.abs(d - radius) <= reach
            visit(outside, q[near & more])
            visit(inside, q[~near & more])

        visit(self.root, np.arange(len(queries)))
        return best, rows


class Shard:
    """A tree over the distinct vectors of some (id, vector) rows; rows that repeat an id count once (the smallest vector)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, longest: float):
        order = np.lexsort((*x.T[::-1], ids))
        ids, x = ids[order], x[order]
        first = np.r_[True, ids[1:] != ids[:-1]][: len(ids)]
        self.ids = ids[first]
        self.points, of = np.unique(x[first], axis=0, return_inverse=True)
        self.order = np.argsort(of.ravel(), kind="stable")  # ids stay ascending within a point
        self.ends = np.cumsum(np.bincount(of.ravel(), minlength=len(self.points)))
        added = np.sqrt(np.maximum(longest - (self.points**2).sum(1), 0))
        self.tree = Tree(np.c_[self.points, added])

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int, factor: float) -> tuple[list, list, list]:
        """query_id, vec_id, score of the best ``k`` of the shard for each query."""
        out: tuple[list, list, list] = ([], [], [])
        _, rows = self.tree.search(np.c_[queries, np.zeros(len(queries))], min(len(self.points), k + 1 + SPARE), factor, floor)
        for own, q, least, found in zip(query_ids.tolist(), queries, floor.tolist(), rows, strict=True):
            found = found[found >= 0]
            score = (self.points[found] * q).sum(1)
            pairs = []
            for p, s in zip(found.tolist(), score.tolist(), strict=True):
                if s >= least:
                    begin = self.ends[p - 1] if p else 0
                    pairs += [(-s, int(i)) for i in self.ids[self.order[begin : min(self.ends[p], begin + k + 1)]] if i != own]
            pairs.sort()
            for s, i in pairs[:k]:
                out[0].append(own)
                out[1].append(i)
                out[2].append(-s)
        return out


def _vectors(column: pa.Array) -> np.ndarray:
    """The rows of a list column, all of one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


@dataclass
class Regions:
    """Centres by length of the vectors; the origin is a centre of any length, in the last place."""

    centers: dict[int, np.ndarray]
    longest: float

    def of(self, dim: int) -> np.ndarray:
        return np.concatenate([self.centers.get(dim, np.zeros((0, dim))), np.zeros((1, dim))])

    def point_distances(self, x: np.ndarray) -> np.ndarray:
        """(rows, centres) distances of vectors as points."""
        c = self.of(x.shape[1])
        add = lambda v: np.sqrt(np.maximum(self.longest - (v * v).sum(1), 0))
        return np.sqrt(np.maximum(2 * self.longest - 2 * (x @ c.T + add(x)[:, None] * add(c)[None, :]), 0))

    def query_distances(self, x: np.ndarray) -> np.ndarray:
        c = self.of(x.shape[1])
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + self.longest - 2 * x @ c.T, 0))


def _by_dim(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    dim = batch.column(column).value_lengths().to_numpy()
    for d in np.unique(dim):
        yield batch.filter(pa.array(dim == d))


def usable(vector: Column) -> Column:
    """No null or non-finite component, and not all of them zero."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True)) & F.exists(vector, lambda c: c != 0)


def _ask(shards: DataFrame, queries: DataFrame, sizes: DataFrame, longest: float, k: int, factor: float, block_rows: int) -> DataFrame:
    """query_id, vec_id, score: what the shards (dim, region, sub, vec_id, v) hold for the queries (query_id, v, dim, region, floor).

    A shard's vectors come first and its queries are streamed; more than
    ``block_rows`` queries of a region share further copies of its shards.
    """
    asked = queries.groupBy("dim", "region").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    subs = sizes.select("dim", "region", "subs").join(asked, ["dim", "region"])
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    held = shards.join(subs.select("dim", "region", "blocks"), ["dim", "region"]).withColumn("block", every("blocks"))
    held = held.select("dim", "region", "sub", "block", F.lit(0).alias("kind"), "vec_id", "v", F.lit(0.0).alias("floor"))
    sent = queries.join(subs, ["dim", "region"]).withColumn("sub", every("subs")).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    sent = sent.select("dim", "region", "sub", "block", F.lit(1).alias("kind"), F.col("query_id").alias("vec_id"), "v", "floor")
    keys = ["dim", "region", "sub", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held_, shard = None, [], None
        for batch in batches:
            names = np.stack([batch.column(c).to_numpy() for c in (*keys, "kind")], axis=1)
            cuts = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)], strict=True):
                key, kind = tuple(names[begin, :-1]), names[begin, -1]
                part = batch.slice(begin, end - begin)
                ids, x = part.column("vec_id").to_numpy(), _vectors(part.column("v"))
                if key != now:
                    now, held_, shard = key, [], None
                if not kind:
                    held_.append((ids, x))
                    continue
                if shard is None and held_:
                    shard = Shard(*(np.concatenate(c) for c in zip(*held_, strict=True)), longest)
                    held_ = []
                if shard is not None:
                    for at in range(0, len(ids), 512):
                        q, v, s = shard.nearest(ids[at : at + 512], x[at : at + 512], part.column("floor").to_numpy()[at : at + 512], k, factor)
                        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.unionByName(sent).repartition(n, *keys).sortWithinPartitions(*keys, "kind")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row that ``is_query`` picks."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    size = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)).alias("m")).first()
    longest, centers = float(size["m"] or 0), min(CENTERS, math.ceil(size["n"] / shard_rows) - 1)
    sample: dict[int, list] = {}
    for r in rows.select("v", "vec_id").orderBy(F.xxhash64("vec_id"), "v").limit(max(0, centers)).collect():  # CENTERS rows at most
        sample.setdefault(len(r["v"]), []).append(r["v"])
    regions = Regions({d: np.array(x, np.float64) for d, x in sample.items()}, longest)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_dim(batch, "v"):
                x = _vectors(part.column("v"))
                d = regions.point_distances(x)
                home = d.argmin(1)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), part.column("asks"), pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(x)), home])], ["vec_id", "v", "asks", "dim", "region", "away"])

    placed = stash(rows.mapInArrow(assign, "vec_id long, v array<double>, asks boolean, dim int, region int, away double"), "vp-placed")
    sizes = placed.groupBy("dim", "region").agg(F.min("away").alias("lo"), F.max("away").alias("hi"), F.ceil(F.count("*") / shard_rows).cast("int").alias("subs"))
    sizes = stash(sizes, "vp-regions")
    rings: dict[int, dict[int, tuple[float, float]]] = {}
    for r in sizes.collect():  # one row per centre and length of vectors
        rings.setdefault(r["dim"], {})[r["region"]] = (r["lo"], r["hi"])
    shards = placed.join(sizes.select("dim", "region", "subs"), ["dim", "region"]).select("dim", "region", F.pmod(F.xxhash64("vec_id"), F.col("subs")).cast("int").alias("sub"), "vec_id", "v")

    def visits(batches: Iterator[pa.RecordBatch], others: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_dim(batch, "v"):
                x = _vectors(part.column("v"))
                d, ring = regions.query_distances(x), rings[x.shape[1]]
                known = np.array(sorted(ring))
                lo, hi = np.array([ring[r] for r in known.tolist()]).T
                home = known[d[:, known].argmin(1)]
                floor = part.column("floor").to_numpy()
                if others:
                    reach = np.sqrt(np.maximum((x * x).sum(1) + longest - 2 * floor, 0)) * factor + 1e-9
                    gap = np.maximum(np.maximum(d[:, known] - hi, lo - d[:, known]), 0)
                    q, at = np.nonzero((gap <= reach[:, None]) & (known[None, :] != home[:, None]))
                    region = known[at]
                else:
                    q, region = np.arange(len(x)), home
                yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(q)), part.column("v").take(pa.array(q)), pa.array(np.full(len(q), x.shape[1], np.int32)), pa.array(region.astype(np.int32)), pa.array(floor[q])], ["query_id", "v", "dim", "region", "floor"])

    schema = "query_id long, v array<double>, dim int, region int, floor double"
    asks = placed.filter("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    own = asks.withColumn("floor", F.lit(float("-inf"))).mapInArrow(lambda b: visits(b, False), schema)
    first = stash(_best(_ask(shards, own, sizes, longest, k, factor, block_rows), k).select("query_id", "vec_id", "score"), "vp-first")
    # A little lower than the k-th score found, so that ties and rounding lose nothing.
    least = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score") - 1e-9 - 1e-12 * F.abs(F.min("score"))).otherwise(float("-inf")).alias("floor"))
    rest = asks.join(least, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))).mapInArrow(lambda b: visits(b, True), schema)
    found = first.unionByName(_ask(shards, stash(rest, "vp-visits"), sizes, longest, k, factor, block_rows)) if sum(map(len, rings.values())) > len(rings) else first
    return _best(found, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def query_op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


SQL_OP3 = """
WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.query_id, e.vec_id, list_dot_product(CAST(q.a AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score
      FROM q JOIN embeddings e ON e.vec_id <> q.query_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
