"""K-means for many numbers of clusters and restarts at once: a pass over the rows serves all fits.

Fits one after the other cost a Spark job for every iteration of each, whatever
the rows.  Here the rows are packed once into blocks, and each pass compares a
block with the centres of all fits that still move.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.storage import drop_stash, stash

#: Rows that are compared with all centres at once, and blocks of a file (32 MB, if rows are 64 doubles).
BLOCK, FILE_BLOCKS = 1024, 64
#: Iterations at most, and the move (Euclidean) from which a fit goes on.
ITERATIONS, MOVE = 30, 1e-4
#: Rounds of sampling that choose candidates, and at most so many while there are fewer than clusters.
ROUNDS, MOST_ROUNDS = 2, 12
_U = np.uint64


def _chance(ids: np.ndarray, *salt: int) -> np.ndarray:
    """A number from 0 to 1 for every id, which doesn't depend on how rows are dealt."""
    h = ids ^ np.random.SeedSequence(salt).generate_state(1, np.uint64)[0]
    for odd in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h ^= h >> _U(33)
        h *= _U(odd)
    h ^= h >> _U(33)
    return (h >> _U(11)) * 2.0**-53


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row (the first of equals) and the squared distance, by fit; ``centres``: cluster, fit, number."""
    k, fits, dim = centres.shape
    flat = centres.reshape(-1, dim)
    d = flat @ x.T
    d *= -2
    d += (flat**2).sum(1)[:, None]
    d = d.reshape(k, fits, len(x))
    best, label = d[0].copy(), np.zeros((fits, len(x)), np.int32)
    for j in range(1, k):
        closer = d[j] < best
        np.copyto(best, d[j], where=closer)
        label[closer] = j
    best += (x**2).sum(1)
    return label, np.maximum(best, 0)


def _shapes(models: dict[int, np.ndarray]) -> list[tuple[list[int], np.ndarray]]:
    """Fits with equal numbers of centres together: their names and the centres as ``nearest`` takes them."""
    by: dict[int, list[int]] = {}
    for m, c in models.items():
        by.setdefault(len(c), []).append(m)
    return [(names, np.stack([models[m] for m in names], axis=1)) for names in by.values()]


def weighted_start(points: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres of a few weighted points: k-means++, then iterations on the points; all points, if there are no more than k."""
    if len(points) <= k:
        return points
    chosen = [int(rng.choice(len(points), p=weight / weight.sum()))]
    d = ((points - points[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        p = np.where(d > 0, d * weight, 0.0)
        p = p if p.sum() > 0 else d
        chosen.append(int(rng.choice(len(points), p=p / p.sum())))
        d = np.minimum(d, ((points - points[chosen[-1]]) ** 2).sum(1))
    centres, before = points[chosen], None
    for _ in range(ITERATIONS):
        label = nearest(points, centres[:, None])[0][0]
        if before is not None and (label == before).all():
            break
        before = label
        mine = (label == np.arange(k)[:, None]) * weight
        n = mine.sum(1, keepdims=True)
        centres = np.where(n > 0, mine @ points / np.where(n > 0, n, 1), centres)
    return centres


class Rows:
    """Standardised vectors, packed: what passes over all of them sum up and select."""

    def __init__(self, df: DataFrame, item: str, vector: str, n: int, mean: np.ndarray, std: np.ndarray):
        self.dim, self.mean, self.scale = len(mean), mean, np.divide(1.0, std, out=np.zeros(len(std)), where=std > 0)
        narrow = df.schema[vector].dataType.simpleString() == "array<float>"
        self.kind = np.float32 if narrow else np.float64
        dim, kind = self.dim, self.kind

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, BLOCK):
                    ids, v = batch.slice(k, BLOCK).columns
                    x = v.flatten()
                    if v.null_count or x.null_count or (v.value_lengths().to_numpy() != dim).any() or not np.isfinite(x := x.to_numpy()).all():
                        raise ValueError(f"vectors must hold {dim} finite numbers")
                    yield pa.RecordBatch.from_arrays([pa.array([c.astype(t).tobytes()], pa.binary()) for c, t in ((ids.to_numpy(), np.int64), (x, kind))], ["ids", "block"])

        v = F.col(vector) if narrow else F.col(vector).cast("array<double>")
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // (BLOCK * FILE_BLOCKS))
        packed = df.select(F.xxhash64(F.col(item), v).alias("id"), v.alias("v")).mapInArrow(pack, "ids binary, block binary")
        self.blocks = stash(packed.repartition(parts), "sweep-rows")

    def each(self, run: Callable[[Iterator[tuple[np.ndarray, np.ndarray]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """``run`` gets the ids and the standardised vectors of a task's blocks."""
        dim, kind, mean, scale = self.dim, self.kind, self.mean, self.scale

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for ids, x in zip(*batch.columns, strict=True):
                    x = np.frombuffer(x.as_buffer(), kind).reshape(-1, dim)
                    yield np.frombuffer(ids.as_buffer(), np.uint64), (x - mean) * scale

        return self.blocks.mapInArrow(lambda batches: run(blocks(batches)), schema)

    def totals(self, run: Callable[[np.ndarray, object], Iterator[tuple[int, np.ndarray]]], value: object) -> dict[int, np.ndarray]:
        """The sums over all blocks of what ``run(vectors, value)`` returns by name; one of each name reaches the driver."""
        shipped = self.blocks.sparkSession.sparkContext.broadcast(value)

        def added(found: Iterator[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            total: dict[int, np.ndarray] = {}
            for name, x in found:
                total[name] = total[name] + x if name in total else x
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.ascontiguousarray(x).tobytes() for x in total.values()], pa.binary())], ["name", "total"])

        def first(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            yield added(f for _, x in blocks for f in run(x, shipped.value))

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield added((n, np.frombuffer(x.as_buffer())) for b in batches for n, x in zip(b.column(0).to_pylist(), b.column(1), strict=True))

        try:
            t = self.each(first, "name int, total binary").repartition("name").mapInArrow(again, "name int, total binary").toArrow()
        finally:
            shipped.destroy()
        return {n: np.frombuffer(x) for n, x in zip(t.column("name").to_pylist(), t.column("total").to_pylist(), strict=True)}

    def starts(self, ks: list[int], restarts: int, seed: int) -> dict[tuple[int, int], np.ndarray]:
        """First centres by k and restart (k-means||): points drawn by their distance from those drawn before, weighted by the rows nearest to them.

        The candidates of a restart serve every k; they are as many as the largest needs.
        """
        dim, most = self.dim, max(ks)

        def some(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            best: list[tuple[float, bytes]] = [(2.0, b"")] * restarts
            for ids, x in blocks:
                for r in range(restarts):
                    u = _chance(ids, seed + r, 0)
                    k = int(u.argmin())
                    best[r] = min(best[r], (float(u[k]), x[k].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(range(restarts), pa.int32()), pa.array([u for u, _ in best]), pa.array([x for _, x in best], pa.binary())], ["r", "u", "x"])

        drawn = self.each(some, "r int, u double, x binary").groupBy("r").agg(F.min(F.struct("u", "x"))["x"].alias("x")).toArrow()
        points = {r: np.frombuffer(x)[None] for r, x in zip(drawn.column("r").to_pylist(), drawn.column("x").to_pylist(), strict=True)}

        def apart(x: np.ndarray, c: np.ndarray) -> np.ndarray:
            d = nearest(x, c[:, None])[1][0]
            return np.where(d > 1e-12 * (x**2).sum(1), d, 0.0)  # less is rounding

        def cost(x: np.ndarray, held: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
            return ((r, apart(x, c).sum(keepdims=True)) for r, c in held.items())

        for turn in range(1, MOST_ROUNDS + 1):
            open_ = points if turn <= ROUNDS else {r: c for r, c in points.items() if len(c) < most}
            whole = {r: float(t[0]) for r, t in self.totals(cost, open_).items() if t[0] > 0} if open_ else {}
            if not whole:
                break

            def draw(blocks: Iterator[tuple[np.ndarray, np.ndarray]], held=open_, whole=whole, turn=turn) -> Iterator[pa.RecordBatch]:
                for ids, x in blocks:
                    for r, t in whole.items():
                        at = np.flatnonzero(_chance(ids, seed + r, turn) * t < 2 * most * apart(x, held[r]))
                        if len(at):
                            yield pa.RecordBatch.from_arrays([pa.array([r] * len(at), pa.int32()), pa.array([y.tobytes() for y in x[at]], pa.binary())], ["r", "x"])

            # Equal rows are one candidate; about 2 * most of a restart are drawn in a round, whatever the number of rows.
            drawn = self.each(draw, "r int, x binary").distinct().orderBy("r", "x").toArrow()
            names = np.array(drawn.column("r").to_pylist(), np.int64)
            new = np.frombuffer(b"".join(drawn.column("x").to_pylist())).reshape(-1, dim)
            points = {r: np.concatenate([c, new[names == r]]) for r, c in points.items()}

        def weigh(x: np.ndarray, held: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
            return ((r, np.bincount(nearest(x, c[:, None])[0][0], minlength=len(c)).astype(float)) for r, c in held.items())

        weight = self.totals(weigh, points)
        return {(k, r): weighted_start(c, weight[r], k, np.random.default_rng((seed + r, k))) for k in ks for r, c in points.items()}

    def assigned(self, models: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, float]]:
        """By fit: sums of the vectors, number and sum of squared lengths of each cluster, and the cost."""

        def run(x: np.ndarray, shapes: list[tuple[list[int], np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
            more = np.column_stack([x, np.ones(len(x)), (x**2).sum(1)])
            for names, c in shapes:
                label, d = nearest(x, c)
                mine = (label == np.arange(len(c))[:, None, None]).astype(np.float64)
                sums = (mine.reshape(-1, len(x)) @ more).reshape(len(c), len(names), -1)
                for i, m in enumerate(names):
                    yield m, np.append(sums[:, i].ravel(), d[i].sum())

        return {m: (t[:-1].reshape(-1, self.dim + 2), float(t[-1])) for m, t in self.totals(run, _shapes(models)).items()}

    def fitted(self, models: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Lloyd's iterations of all fits; one that has come to rest takes no further part."""
        models, moving = dict(models), dict(models)
        for _ in range(ITERATIONS):
            if not moving:
                break
            found = self.assigned(moving)
            for m, c in list(moving.items()):
                n = found[m][0][:, self.dim : self.dim + 1]
                # A cluster without rows keeps its centre.
                models[m] = np.where(n > 0, found[m][0][:, : self.dim] / np.where(n > 0, n, 1), c)
                moving[m] = models[m]
                if ((models[m] - c) ** 2).sum(1).max() <= MOVE**2:
                    del moving[m]
        return models

    def silhouettes(self, models: dict[int, np.ndarray], found: dict[int, tuple[np.ndarray, float]]) -> dict[int, float | None]:
        """Mean silhouette by squared Euclidean distance, from each cluster's sums; none where all rows are one cluster."""
        dim = self.dim

        def run(x: np.ndarray, held: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
            xx = (x**2).sum(1)
            for m, (c, sums) in held.items():
                label, n, at = nearest(x, c[:, None])[0][0], sums[:, dim], np.arange(len(x))
                full = np.where(n > 0, n, 1)
                d = np.maximum(xx[:, None] - 2 * (x @ (sums[:, :dim] / full[:, None]).T) + sums[:, dim + 1] / full, 0)
                own = n[label]
                a = d[at, label] * own / np.where(own > 1, own - 1, 1)
                d[at, label] = np.inf
                d[:, n == 0] = np.inf
                b = d.min(1)
                top = np.maximum(a, b)
                yield m, np.where((own > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0).sum(keepdims=True)

        many = {m: (models[m], s) for m, (s, _) in found.items() if (s[:, dim] > 0).sum() > 1}
        sums = self.totals(run, many) if many else {}
        return {m: float(sums[m][0] / s[:, dim].sum()) if m in sums else None for m, (s, _) in found.items()}


def kmeans_sweep(df: DataFrame, item: str, vector: str, ks: list[int], restarts: int = 3, seed: int = 0) -> DataFrame:
    """k, cost, silhouette, smallest cluster, recommended: the best silhouette with clusters of 10 rows or more.

    Each k is fitted ``restarts`` times on standardised vectors, of which the fit with the least cost counts.
    """
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    schema = "k int, cost double, silhouette double, smallest int, recommended boolean"
    n = df.count()
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("raw")))
    rows = Rows(df, item, vector, n, scaler.mean.toArray(), scaler.std.toArray())
    try:
        starts = rows.starts(ks, restarts, seed)
        names = list(starts)
        models = rows.fitted({m: starts[name] for m, name in enumerate(names)})
        found = rows.assigned(models)
        best = {k: min((m for m, (own, _) in enumerate(names) if own == k), key=lambda m: found[m][1]) for k in ks}
        silhouette = rows.silhouettes(models, {m: found[m] for m in best.values()})
    finally:
        drop_stash(rows.blocks)
    out = [(k, found[m][1], silhouette[m], int(found[m][0][:, rows.dim].min())) for k, m in best.items()]
    good = [r for r in out if r[3] >= 10] or out
    pick = max(good, key=lambda r: -2.0 if r[2] is None else r[2])[0]
    return df.sparkSession.createDataFrame([(*r, r[0] == pick) for r in out], schema)
