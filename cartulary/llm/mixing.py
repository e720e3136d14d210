"""Operator 10: mixing sources to target weights by soft membership.

1. A softmax classifier over hashed byte bigrams learns domains from the rows of
   a labelled table: documents that have a row in ``labels``, with ``domain_col``
   as the domain.  It sees a bounded sample (``sample_rows`` distinct texts over
   all domains, in the order of a text hash); its inputs are texts only.
2. Every whole text gets posteriors ``p`` and a token count ``n`` (white-space
   words) in one pass.
3. Rates ``r >= min_rate >= 0`` minimise ``sum_d s_d^2 (sum_i n_i p_id r_i - t_d)^2``
   by projected gradient from ``r = 1``.  A round is one distributed sum of the
   ``domains`` expected totals; the driver only keeps the history of gradients,
   from which any row's rate follows by folding, so no per-row state moves.
   Steps are scaled per row by ``1 / n_i``: documents with equal posteriors get
   equal rates whatever their lengths.

Targets are ``weights`` (by domain) or natural shares to the power
``temperature``; ``budget`` tokens are shared out by them, by default as many as
let the most plentiful domain keep all it has.  ``copies`` rounds a rate up or
down by a hash of the document's id, so that expectations hold.

Defined results: null and empty texts have no tokens, the classifier's prior as
posterior, and a rate like any other; null domains and null ids aren't learnt
from; past ``MAX_DOMAINS`` the smaller domains are one, named "other"; without
any labelled row all rates are 1; a target domain without tokens is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, stash, table, texts_of

DIM = 2_048
SAMPLE_ROWS = 3_000
MAX_DOMAINS = 32
PIECE = 1 << 21
TEMPERATURE = 0.7
MAX_RATE = 8.0
ROUNDS = 40
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True


def _slots(data: np.ndarray) -> np.ndarray:
    """The slot of the byte bigram that starts at each place (the last place has none: DIM)."""
    pair = data[:-1].astype(np.uint32) * np.uint32(257) + data[1:]
    return np.append((pair * np.uint32(2654435761) >> np.uint32(21)).astype(np.int64) % DIM, DIM)


@dataclass
class DomainClassifier:
    domains: list[str] = field(default_factory=list)
    weight: np.ndarray = field(default_factory=lambda: np.zeros((DIM + 1, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def posteriors(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, domains) posteriors and word counts of whole texts."""
        logits, words = np.zeros((len(texts), len(self.domains))), np.zeros(len(texts), np.int64)
        k = 0
        while k < len(texts):
            end, held = k + 1, len(texts[k])
            while end < len(texts) and held + len(texts[end]) <= PIECE:
                held += len(texts[end])
                end += 1
            self._add(texts[k:end], logits[k:end], words[k:end])
            k = end
        logits = logits + self.bias
        p = np.exp(logits - logits.max(1, keepdims=True, initial=-np.inf)) if len(self.domains) else logits
        return p / np.maximum(p.sum(1, keepdims=True), 1e-300), words

    def _add(self, texts: list[bytes], logits: np.ndarray, words: np.ndarray) -> None:
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        full = np.flatnonzero(size)
        if not len(full):
            return
        data = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.r_[0, np.cumsum(size[full])[:-1]]
        slots = _slots(data)
        slots[begin[1:] - 1] = DIM
        space = _space[data]
        starts = ~space
        starts[1:] &= space[:-1]
        starts[begin] = ~space[begin]
        words[full] = np.add.reduceat(starts.astype(np.int64), begin)
        for d in range(len(self.domains)):
            sums = np.add.reduceat(self.weight[:, d][slots], begin, dtype=np.float64)
            logits[full, d] = sums / np.maximum(size[full] - 1, 1)


def train_classifier(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DomainClassifier:
    ids = labelled.select(F.col(id_col).alias("doc_id")).filter("doc_id is not null").distinct()
    rows = texts_of(docs, id_col, text_col, domain_col).select("doc_id", F.col(domain_col).cast("string").alias("domain"), F.xxhash64("text").alias("key")).filter("domain is not null")
    rows = stash(rows.join(ids, "doc_id").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("domain").alias("domain")), "mixing-labelled")
    names = [r["domain"] for r in rows.groupBy("domain").count().orderBy(F.desc("count"), "domain").limit(MAX_DOMAINS + 1).collect()]
    if not names:
        return DomainClassifier()
    if len(names) > MAX_DOMAINS:
        names = names[: MAX_DOMAINS - 1]
        rows = rows.withColumn("domain", F.when(F.col("domain").isin(names), F.col("domain")).otherwise("other"))
        names = [*names, "other"]
    picked = None
    for name in sorted(set(names)):
        part = rows.filter(F.col("domain") == name).orderBy("key").limit(max(1, sample_rows // len(names)))
        picked = part if picked is None else picked.unionByName(part)
    picked = stash(picked.select("doc_id", "domain"), "mixing-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for t in batch.column(0).to_pylist():
                data = np.frombuffer(t.encode("utf-8"), np.uint8)
                counts.append(np.bincount(_slots(data), minlength=DIM + 1)[:DIM].astype(np.int32).tobytes() if len(data) > 1 else bytes(4 * DIM))
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.binary()), batch.column(1)], ["counts", "domain"])

    # The sample's ids are bounded by sample_rows, so they may be broadcast.
    sample = texts_of(docs, id_col, text_col).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text"))
    found = sample.select("text", "domain").mapInArrow(run, "counts binary, domain string").toArrow()
    domains = sorted(set(found.column("domain").to_pylist()))
    y = np.array([domains.index(d) for d in found.column("domain").to_pylist()])
    parts = [np.frombuffer(c.buffers()[2], np.int32, len(c) * DIM, offset=c.offset * 4 * DIM).reshape(-1, DIM) for c in found.column("counts").chunks if len(c)]
    x = np.empty((len(y), DIM), np.float32)
    if parts:
        np.concatenate(parts, out=x, casting="unsafe")
    del found, parts
    release(docs.sparkSession)
    model = fit_classifier(x, y, domains)
    del x
    release(docs.sparkSession)
    return model


def fit_classifier(counts: np.ndarray, y: np.ndarray, domains: list[str], steps: int = 150) -> DomainClassifier:
    z = np.asarray(counts, np.float32)
    z /= np.maximum(z.sum(1, keepdims=True), 1)
    mean, scale = z.mean(0), 1 / (z.std(0) + 1e-4)
    z -= mean
    z *= scale
    w, b = np.zeros((DIM, len(domains)), np.float32), np.zeros(len(domains))
    hot = np.eye(len(domains), dtype=np.float32)[y]
    step = 0.5 / max(1.0, float(np.einsum("ij,ij->i", z, z).mean()))
    for _ in range(steps):
        s = z @ w + b
        p = np.exp(s - s.max(1, keepdims=True))
        g = ((p / p.sum(1, keepdims=True)) - hot) / len(z)
        w -= step * 4 * (z.T @ g + 1e-3 * w).astype(np.float32)
        b -= step * 4 * g.sum(0)
    folded = w * scale[:, None]
    return DomainClassifier(domains, np.vstack([folded, np.zeros((1, len(domains)))]).astype(np.float32), b - mean @ folded)


def memberships(docs: DataFrame, model: DomainClassifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, p (array, by the model's domains) of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, n = shipped.value.posteriors([t.encode("utf-8") for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), _lists(p)], ["doc_id", "n_tokens", "p"])

    rows = texts_of(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, p array<double>")


def _lists(p: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, max(1, p.shape[1]), dtype=np.int32) if p.shape[1] else np.zeros(len(p) + 1, np.int32)), pa.array(p.ravel()))


@dataclass
class Mixture:
    """What a row's rate follows from: the gradients of all rounds, scaled."""

    domains: list[str]
    history: np.ndarray
    min_rate: float = 0.0
    max_rate: float = MAX_RATE
    targets: np.ndarray = field(default_factory=lambda: np.zeros(0))
    totals: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def rates(self, p: np.ndarray) -> np.ndarray:
        r = np.clip(np.ones(len(p)), self.min_rate, self.max_rate)
        for g in self.history:
            r = np.clip(r - p @ g, self.min_rate, self.max_rate)
        return r


def fit_rates(members: DataFrame, domains: list[str], weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, budget: float | None = None, min_rate: float = 0.0, max_rate: float = MAX_RATE, rounds: int = ROUNDS, tolerance: float = 1e-4) -> Mixture:
    d = len(domains)
    mix = Mixture(domains, np.zeros((0, d)), min_rate, max_rate)
    if not d:
        return mix

    def gather(what) -> np.ndarray:
        """The sum over all rows of ``what(n, p)``, a vector of fixed length."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                v = what(batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64), p)
                total = v if total is None else total + v
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "v"])

        rows = members.select("n_tokens", "p").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(max([r["k"] for r in rows], default=-1) + 1)
        for r in rows:
            out[r["k"]] = r["v"]
        return out

    first = gather(lambda n, p: np.concatenate([n @ p, (p.T @ (p * n[:, None])).ravel()]))
    if not len(first) or first[:d].sum() <= 0:
        return mix
    natural, gram = first[:d], first[d:].reshape(d, d)
    share = np.array([max(0.0, weights.get(x, 0.0)) for x in domains]) if weights else natural**temperature
    share = np.where(natural > 1e-9 * natural.sum(), share, 0)
    share = share / share.sum()
    budget = budget if budget is not None else float((natural[share > 0] / share[share > 0]).max())
    mix.targets = share * budget
    scale = np.where(np.diag(gram) > 0, 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300)), 0)
    step = 1 / max(float(np.linalg.eigvalsh(gram * np.outer(scale, scale)).max()), 1e-12)
    best = np.inf
    for k in range(rounds + 1):
        if k % 8 == 7:
            release(members.sparkSession)
        totals = gather(lambda n, p: n @ (p * mix.rates(p)[:, None]))
        miss = totals - mix.targets
        error = float((np.abs(miss) / max(budget, 1e-12)).max())
        loss = float(((scale * miss) ** 2).sum())
        if loss > best:  # the last step led away and is taken back
            mix.history = mix.history[:-1]
            break
        mix.totals = totals  # always those of the history
        if k == rounds or error < tolerance or loss > best * (1 - 1e-4):
            break
        best = loss
        mix.history = np.vstack([mix.history, step * scale * scale * miss])
    return mix


def fit_mixture(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", **how) -> tuple[DomainClassifier, DataFrame, Mixture]:
    model = train_classifier(docs, labelled, id_col, text_col, domain_col)
    members = stash(memberships(docs, model, id_col, text_col), "mixing-members")
    return model, members, fit_rates(members, model.domains, **how)


def _copies(rates: np.ndarray, ids: list) -> np.ndarray:
    import xxhash

    draw = np.array([xxhash.xxh64_intdigest(str(i)) for i in ids], np.uint64).astype(np.float64) / 2.0**64
    whole = np.floor(rates + 1e-9)
    return (whole + (draw < rates - whole)).astype(np.int64)


def rated(members: DataFrame, mix: Mixture) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), rate, copies."""
    shipped, d = members.sparkSession.sparkContext.broadcast(mix), len(mix.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = shipped.value
            p = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
            r = m.rates(p)
            top = [m.domains[k] for k in p.argmax(1)] if d else [None] * len(r)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(top, pa.string()), pa.array(r), pa.array(_copies(r, batch.column(0).to_pylist()))], ["doc_id", "n_tokens", "domain", "rate", "copies"])

    kind = members.schema["doc_id"].dataType.simpleString()
    return members.select("doc_id", "n_tokens", "p").mapInArrow(run, f"doc_id {kind}, n_tokens long, domain string, rate double, copies long")


def mixed(docs: DataFrame, model: DomainClassifier, mix: Mixture, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each row as often as its copies say; posteriors are worked out again, so nothing is shuffled."""
    shipped = docs.sparkSession.sparkContext.broadcast((model, mix))
    at, key = docs.columns.index(text_col), docs.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):  # copies multiply a batch
                batch = whole.slice(k, 256)
                m, x = shipped.value
                p, _ = m.posteriors([(t or "").encode("utf-8") for t in batch.column(at).to_pylist()])
                n = _copies(x.rates(p), batch.column(key).to_pylist())
                yield batch.take(pa.array(np.repeat(np.arange(batch.num_rows), n)))

    return docs.mapInArrow(run, docs.schema)


def query_op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, members, mix = fit_mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated(members, mix)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No document is lost: rates start at 1 and scarce domains are repeated up to their targets."""
    model, _, mix = fit_mixture(docs, table(spark, sf_dir, "labels"), min_rate=1.0)
    return mixed(docs, model, mix)
