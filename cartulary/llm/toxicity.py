"""Operator 8: toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and the first characters of longer words, hashed
into ``DIM`` slots.  The machine scores
``w0 + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)`` over a text's distinct
terms, so pairs of terms (an insult and a group mention) weigh in beyond their
linear weights.

Scores are those of balanced classes, not of the corpus's share of toxic texts.

Learning uses a bounded, documented sample of labelled rows: at most
``sample_rows`` distinct texts of each class, taken in the order of a hash of
the text, never from held-out rows (crc32 of doc_id as text mod 3 is 1).  The
``slots`` hashed terms that tell the classes apart best enter the machine, and
so do the members of pairs of the ``PAIR_TERMS`` most frequent terms that stand
together unlike in the two classes, even if neither tells anything alone.
Scoring covers every whole text.  Labels, language, source and doc_id are never
inputs of a score.

Defined results: null and empty texts score the machine's bias; without labels
of both classes every score is the share of toxic labels with one pseudo-count
each way; null doc_ids are not held out; repeated label rows count once and a
document labelled both ways is toxic; repeated documents are scored each.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, stash, table, texts_of

DIM = 1 << 20
PREFIX = 4
THRESHOLD = 0.7
SAMPLE_ROWS = 6_000
SLOTS = 1_024
#: The most frequent terms whose pairs are screened, and from which z a pair tells the classes apart.
PAIR_TERMS, PAIR_Z = 1_024, 6.0
FACTORS = 8
MEMO = 150_000
_words = re.compile(r"\w+").findall


def slots_of(word: str) -> tuple[int, ...]:
    own = zlib.crc32(word.encode("utf-8")) % DIM
    return (own, zlib.crc32(b"^" + word[:PREFIX].encode("utf-8")) % DIM) if len(word) > PREFIX else (own,)


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


@dataclass
class FactorizationMachine:
    bias: float
    slots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    v: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS)))

    def score(self, rows: np.ndarray) -> float:
        """Probability of label 1 for the places (in ``slots``) of a text's distinct terms."""
        z = self.bias
        if len(rows):
            v = self.v[rows]
            z += self.w[rows].sum() + 0.5 * float((v.sum(0) ** 2 - (v * v).sum(0)).sum())
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def fit(terms: list[np.ndarray], toxic: np.ndarray, rate: float, slots: int = SLOTS, factors: int = FACTORS, epochs: int = 20, seed: int = 7) -> FactorizationMachine:
    """Train on distinct hashed terms per row; both classes weigh the same, ``rate`` is the share of label 1."""
    prior = math.log(rate / (1 - rate))  # only where nothing can be learnt
    n1, n0 = int(toxic.sum()), int(len(toxic) - toxic.sum())
    if not n1 or not n0:
        return FactorizationMachine(prior)
    flat = np.concatenate(terms).astype(np.int32) if terms else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(terms), dtype=np.int32), [len(t) for t in terms])
    in1, in0 = (np.bincount(flat[toxic[row] == k], minlength=DIM).astype(np.float32) for k in (1, 0))
    p1, p0 = (in1 + 0.5) / (n1 + 1), (in0 + 0.5) / (n0 + 1)
    p = (in1 + in0 + 1) / (n1 + n0 + 2)
    z = np.where(in1 + in0 >= min(4, n1), (p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)), 0)
    alone = np.argsort(-np.abs(z), kind="stable")[:slots]
    alone = alone[np.abs(z[alone]) > 3]
    chosen = np.union1d(alone, telling_pairs(flat, row, toxic, np.argsort(-(in1 / n1 + in0 / n0), kind="stable")[:PAIR_TERMS], slots))
    if not len(chosen):
        return FactorizationMachine(prior)
    place = np.full(DIM, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    at = place[flat]
    x = np.zeros((len(terms), len(chosen)), np.uint8)
    x[row[at >= 0], at[at >= 0]] = 1

    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(len(chosen), np.float32), rng.normal(0, 0.01, (len(chosen), factors)).astype(np.float32), 0.0
    weight = np.where(toxic == 1, 0.5 / n1, 0.5 / n0) * len(toxic)
    gw, gv, gb = np.full(len(chosen), 1e-6, np.float32), np.full(v.shape, 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(terms))
        for k in range(0, len(order), 512):
            rows = order[k : k + 512]
            xb = x[rows].astype(np.float32)
            s = xb @ v
            y = b + xb @ w + 0.5 * ((s * s).sum(1) - xb @ (v * v).sum(1))
            g = (1 / (1 + np.exp(-np.clip(y, -60, 60))) - toxic[rows]) * weight[rows] / len(rows)
            g = g.astype(np.float32)
            dw = xb.T @ g + 1e-4 * w
            dv = xb.T @ (g[:, None] * s) - v * (xb.T @ g)[:, None] + 1e-3 * v
            db = g.sum()
            gw += dw * dw
            gv += dv * dv
            gb += db * db
            w -= 0.3 * dw / np.sqrt(gw)
            v -= 0.03 * dv / np.sqrt(gv)
            b -= 0.3 * db / math.sqrt(gb)
    return FactorizationMachine(float(b), chosen.astype(np.int64), w, v)


def telling_pairs(flat: np.ndarray, row: np.ndarray, toxic: np.ndarray, often: np.ndarray, slots: int) -> np.ndarray:
    """The members of pairs of frequent terms whose association differs between the classes.

    A pair's log odds ratio is compared between toxic and other texts: it is the
    same where the terms only add up, however much each tells alone, so a high z
    means an interaction that no single term shows.
    """
    often = often[np.bincount(flat, minlength=DIM)[often] > 0]
    place = np.full(DIM, -1, np.int32)
    place[often] = np.arange(len(often))
    at = place[flat]
    row, at = row[at >= 0], at[at >= 0]
    starts = np.searchsorted(row, np.arange(0, len(toxic) + 512, 512))
    both = np.zeros((2, len(often), len(often)), np.float32)
    for k, (begin, end) in enumerate(zip(starts, starts[1:], strict=False)):  # few rows at once, so that memory stays small
        kinds = toxic[512 * k : 512 * (k + 1)]
        x = np.zeros((len(kinds), len(often)), np.float32)
        x[row[begin:end] - 512 * k, at[begin:end]] = 1
        for kind in (0, 1):
            part = x[kinds == kind]
            both[kind] += part.T @ part
    z, spread = np.zeros(both.shape[1:], np.float32), np.zeros(both.shape[1:], np.float32)
    for kind, b in enumerate(both):
        one, n = np.diag(b).copy(), np.float32((toxic == kind).sum())
        for sign, cell in ((1, lambda: b), (-1, lambda: one[:, None] - b), (-1, lambda: one[None, :] - b), (1, lambda: n - one[:, None] - one[None, :] + b)):  # noqa: B023
            c = cell() + np.float32(0.5)
            spread += 1 / c
            z += np.float32(sign if kind else -sign) * np.log(c)
    z = np.triu(np.abs(z) / np.sqrt(spread), 1)
    i, j = np.nonzero(z > PAIR_Z)
    order = np.argsort(-z[i, j], kind="stable")[: slots // 2]
    return often[np.union1d(i[order], j[order])]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """A machine from a bounded sample of labelled rows that are not held out."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    keyed = texts_of(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("key")).join(known, "doc_id")
    keyed = keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    keyed = stash(keyed, "toxicity-labelled")
    totals = {r["toxic"]: r["count"] for r in keyed.groupBy("toxic").count().collect()}
    picked = None
    for c in (0, 1):
        part = keyed.filter(F.col("toxic") == c).orderBy("key").limit(sample_rows)
        picked = part if picked is None else picked.unionByName(part)
    picked = stash(picked.select("doc_id", "toxic"), "toxicity-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted({s for w in set(_words(t.lower())) for s in slots_of(w)}) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.list_(pa.int32())), batch.column(1)], ["terms", "toxic"])

    # The sample is bounded by 2 * sample_rows ids, so it may be broadcast.
    rows = texts_of(docs, id_col, text_col).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    found = rows.select("text", "toxic").mapInArrow(run, "terms array<int>, toxic int").toArrow()
    held = found.column("terms").combine_chunks() if found.num_rows else None
    terms = np.split(held.flatten().to_numpy(), np.cumsum(held.value_lengths().to_numpy())[:-1]) if held is not None else []
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    machine = fit(terms, np.asarray(found.column("toxic"), np.int64), (n1 + 1) / (n1 + n0 + 2))
    del found, held, terms
    release(docs.sparkSession)
    return machine


class _Scorer:
    """A machine with a bounded memo of the places of words."""

    def __init__(self, machine: FactorizationMachine):
        self.machine, self.place, self.memo = machine, {int(s): k for k, s in enumerate(machine.slots)}, {}

    def __call__(self, text: str) -> float:
        memo, place, rows = self.memo, self.place, set()
        for w in set(_words(text.lower())):
            got = memo.get(w)
            if got is None:
                got = tuple(place[s] for s in slots_of(w) if s in place)
                if len(memo) >= MEMO:
                    memo.clear()
                memo[w] = got
            if got:
                rows.update(got)
        return self.machine.score(np.fromiter(sorted(rows), np.int64, len(rows)))


def score_documents(docs: DataFrame, machine: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; the machine is of fixed size whatever the corpus."""
    shipped = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shipped.value)
        for batch in batches:
            score = np.array([scorer(t.as_py()) for t in batch.column(2)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = texts_of(docs, id_col, text_col).select("doc_id", held_out("doc_id").alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, machine: FactorizationMachine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold."""
    shipped, at = docs.sparkSession.sparkContext.broadcast(machine), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shipped.value)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                yield batch.filter(pa.array([scorer(t.as_py() or "") < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query_op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, train(docs, table(spark, sf_dir, "labels")))
