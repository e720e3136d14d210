"""Operator 4: SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are 64 majority bits over the XXH64 hashes (seed 42) of a text's
4-word shingles.  Distinct fingerprints, each standing for its smallest doc_id,
are joined at Hamming distance ``distance``:

1. The 64 bits are cut into ``blocks`` > ``distance`` blocks; two fingerprints
   within the distance agree on all bits of some choice of
   ``blocks - distance`` blocks, so rows are dealt by (choice, those bits) and no
   link is lost.  More blocks are used for more fingerprints.
2. A task sorts its fingerprints by those shared bits and Gray rank and builds a
   hierarchy over the order: an upper node holds the bits that all fingerprints
   below it share (a masked pattern), each level below only adds bits.  A
   search adds up differing bits from the top and drops a whole group once they
   exceed the distance, or once the group is known to be the searcher's
   component already, so a dense group costs no pairs.
3. A task emits one edge per member to the least member of its component;
   distributed connected components join the tasks' findings.

A group of more than ``GROUP_ROWS`` fingerprints is split into pieces and every
pair of pieces is searched by its own task.

Defined results: null and empty texts have fingerprint zero and are linked like
any other; repeated doc_ids give repeated rows; rows with a null doc_id get
the component of their fingerprint.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cartulary.operators.graph import connected_components

from .common import stash, table, texts_of

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Children of a node of the index.
FAN = 16
GROUP_ROWS = 65_536
_words = re.compile(rb"[^\x20\x09-\x0D]+").findall


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    import xxhash

    words = _words(text.encode("utf-8").lower())
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = (end - size)[:n].tolist()
    stop = end[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        h = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(begin[k : k + (1 << 16)], stop[k : k + (1 << 16)], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, f: the fingerprint of every row as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f)], ["doc_id", "f"])

    rows = texts_of(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, f long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Where a bit pattern stands in the reflected Gray order."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """The hierarchy over fingerprints that are sorted by (run, Gray rank); only members of one run are compared."""

    def __init__(self, f: np.ndarray, run: np.ndarray):
        self.f, n = f, len(f)
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        self.top = np.repeat(np.arange(len(first)), np.diff(np.r_[first, n]))
        offset = np.arange(n) - first[self.top]
        self.starts, self.value, self.mask = [np.arange(n)], [f], [np.full(n, ~np.uint64(0))]
        width = 1
        while width <= offset.max(initial=0):
            width *= FAN
            starts = np.flatnonzero(offset % width == 0)
            every, some = np.bitwise_and.reduceat(f, starts), np.bitwise_or.reduceat(f, starts)
            self.starts.append(starts)
            self.value.append(every)
            self.mask.append(~(every ^ some))
        self.ends = [np.r_[s[1:], n] for s in self.starts]

    def components(self, distance: int, side: np.ndarray | None = None) -> np.ndarray:
        """For each member the least position it is linked to, directly or through others.

        ``side``: with two values only links between the two sides are looked for.
        """
        n = len(self.f)
        comp, at, block = np.arange(n), 0, 64
        while at < n:
            q = np.arange(at, min(n, at + block))
            a, b = self._search(q, comp, distance, side)
            if len(a):
                _unite(comp, a, b)
            at += block
            block = min(4096, block * 2)
        return comp

    def _search(self, q: np.ndarray, comp: np.ndarray, distance: int, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        level = len(self.starts) - 1
        node = self.top[q] if level else q
        seen = np.zeros(len(q), np.uint64)
        diff = np.zeros(len(q), np.int64)
        while True:
            starts, ends = self.starts[level], self.ends[level]
            low, high = np.minimum.reduceat(comp, starts), np.maximum.reduceat(comp, starts)
            diff = diff + np.bitwise_count((self.f[q] ^ self.value[level][node]) & self.mask[level][node] & ~seen)
            keep = (diff <= distance) & (ends[node] > q + 1) & ~((low[node] == high[node]) & (low[node] == comp[q]))
            q, node, diff = q[keep], node[keep], diff[keep]
            if not level:
                ok = node > q
                if side is not None:
                    ok &= side[q] != side[node]
                return q[ok], node[ok]
            seen = self.mask[level][node]
            below = self.starts[level - 1]
            begin, stop = np.searchsorted(below, starts[node]), np.searchsorted(below, ends[node])
            n = stop - begin
            child = np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            q, diff, seen, node = np.repeat(q, n), np.repeat(diff, n), np.repeat(seen, n), child
            level -= 1


def _unite(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of a[i] and b[i]; labels stay the least position."""
    while True:
        x, y = comp[a], comp[b]
        if (x == y).all():
            return
        np.minimum.at(comp, np.maximum(x, y), np.minimum(x, y))
        while (comp[comp] != comp).any():
            comp[:] = comp[comp]


def block_choices(n: int, distance: int = DISTANCE) -> list[int]:
    """Masks of the bits that rows are dealt by; each is all but ``distance`` of the blocks."""
    blocks = distance + 1
    while blocks < 16 and n / 2 ** (64 * (blocks - distance) // blocks) > 64:
        blocks += 1
    edges = [64 * k // blocks for k in range(blocks + 1)]
    each = [sum(1 << i for i in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(each, blocks - distance)]


def link_edges(reps: DataFrame, distance: int = DISTANCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """u, v: edges between representatives (columns f, rep) that together connect all within the distance."""
    spark = reps.sparkSession
    n = reps.count()
    masks = block_choices(n, distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    # So many runs share a task's group that a group is worth a call.
    groups = max(1, min(1 << 16, -(-n // 8192)))
    dealt = reps.select("f", "rep", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("f").bitwiseAND(F.lit(m)).alias("shared")) for i, m in enumerate(signed)])).alias("x"))
    dealt = dealt.select("f", "rep", "x.choice", "x.shared", F.pmod(F.xxhash64("x.shared"), F.lit(groups)).cast("int").alias("part"))
    sizes = dealt.groupBy("choice", "shared").count().filter(F.col("count") > group_rows)
    big = stash(sizes.select("choice", "shared", F.ceil(F.col("count") / group_rows).cast("int").alias("pieces")), "simhash-large")
    whole = dealt.withColumn("piece", F.lit(-1)).withColumn("other", F.lit(-1)).withColumn("mine", F.lit(0))
    if not big.isEmpty():
        whole = whole.join(big, ["choice", "shared"], "left_anti")
        mine = F.pmod(F.xxhash64("f"), F.col("pieces")).cast("int")
        cut = dealt.join(big, ["choice", "shared"]).withColumn("mine", mine)
        cut = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        cut = cut.select("f", "rep", "choice", "shared", F.pmod(F.xxhash64("shared"), F.lit(1 << 30)).cast("int").alias("part"), F.least("mine", "with").alias("piece"), F.greatest("mine", "with").alias("other"), "mine")
        whole = whole.unionByName(cut)

    def run(t: pa.Table) -> pa.Table:
        f, shared, rep, mine = (t.column(c).to_numpy() for c in ("f", "shared", "rep", "mine"))
        f = f.view(np.uint64)
        order = np.lexsort((gray_rank(f), shared))
        f, shared, rep, mine = f[order], shared[order], rep[order], mine[order]
        comp = GrayIndex(f, shared).components(distance, mine if mine.min() != mine.max() else None)
        least = rep.copy()
        np.minimum.at(least, comp, rep)
        u, v = rep, least[comp]
        return pa.table({"u": pa.array(u[u != v], pa.int64()), "v": pa.array(v[u != v], pa.int64())})

    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return whole.repartition(n_parts, "choice", "part", "piece", "other").groupBy("choice", "part", "piece", "other").applyInArrow(run, "u long, v long").distinct()


def components(found: DataFrame, distance: int = DISTANCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """f, component (a fingerprint), component_id (its smallest doc_id, null if it has none) of every fingerprint."""
    each = stash(found.groupBy("f").agg(F.min("doc_id").alias("least")), "simhash-representatives")
    parts = connected_components(stash(link_edges(each.select("f", F.col("f").alias("rep")), distance, group_rows), "simhash-edges"))
    each = stash(each.join(parts, F.col("f") == F.col("node"), "left").select("f", "least", F.coalesce("component", "f").alias("component")), "simhash-components")
    # Written first: the join is then of plain tables, which are split where one component is very large.
    named = stash(each.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-names")
    return each.join(named, "component").select("f", "component", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, f, component_id of every row."""
    found = stash(fingerprints(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")), "simhash-fingerprints")
    return found.join(components(found, distance, group_rows), "f").select("doc_id", "f", "component_id")


def query_op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the smallest doc_id; of rows that repeat that id any one.

    Rows without a doc_id are documents too: they go if their component has a
    document with one, and one of them stays if it has none.
    """
    found = stash(fingerprints(docs).withColumn("doc_id", F.col("doc_id").cast("long")), "simhash-fingerprints")
    named = stash(components(found), "simhash-named")
    kept = found.join(named, "f").filter("doc_id = component_id").select("doc_id").distinct()
    known = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    nameless = _with_fingerprint(docs.filter("doc_id is null")).join(named.filter("component_id is null").select("f", "component").withColumnsRenamed({"f": "_f", "component": "_component"}), "_f")
    return known.unionByName(nameless.dropDuplicates(["_component"]).select(docs.columns))


def _with_fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, and _f."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([fingerprint(t.as_py() or "") for t in batch.column(at)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(f)], [*batch.schema.names, "_f"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_f", LongType())]))
