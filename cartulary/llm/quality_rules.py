"""Operator 5: quality rules with risk-controlled thresholds.

``measure`` computes the base counts of every whole text.  On top of the fixed
base rules, one-sided rules (share of symbols, capitals, repeated words,
duplicate lines) get their cutoffs per stratum from labelled holdout rows: a
cutoff is certified only when the exact binomial test says that its false
rejection rate among good rows is at most ``max_false_rejection / rules``, with
a Bonferroni correction over strata and rules and a fixed testing sequence
(loosest cutoff first, stop at the first failure) within a rule.  So, with
probability 1 - ``error``, no stratum loses more than ``max_false_rejection``
of its good rows to all rules together.  Among certified cutoffs the loosest
one with 95 % of the best net gain (bad rows rejected less five times the good
ones) is taken, if that gain is worth a rule at all (10 rows and 1 % of the bad
ones).

Holdout rows with equal texts count once, because copies are no independent
evidence.  In a stratum whose own labels certify nothing for a rule, the rule
rejects nothing: what holds for all strata together says nothing about one of
them.  Strata with too few good rows to certify any cutoff aren't tested and
take no share of the correction; there is no other limit on their number.
Nothing is trained, so every labelled row is holdout.

Defined results: null text counts as empty (all counts 0, base_failed true);
null strata form one stratum; labels for unknown documents, null labels and
repeated label rows are ignored or counted once; without labels only the base
rules decide; repeated document rows are judged each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stash, table, texts_of

WINDOW = 8
#: Cutoff grids, loosest first; fixed before any label is seen.
GRIDS = {
    "symbol_rate": [round(4.0 * 0.93**k, 4) for k in range(80)],
    "caps_share": [round(0.99 * 0.955**k, 4) for k in range(80)],
    "repeat_share": [round(0.99 * 0.95**k, 4) for k in range(80)],
    "dup_line_share": [round(0.99 * 0.95**k, 4) for k in range(80)],
}
_words = re.compile(WORD).findall
_symbols = re.compile(r"[#*$%&|<>]")
_letters = re.compile(r"[^\W\d_]")
_mix = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) ** 3 % 2**64 | 1 for k in range(WINDOW)], dtype=np.uint64)


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more, exact."""
    m = len(words) - window + 1
    if m < 2:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words))
    if len(seen) > len(words) - 2:
        return 0
    h = np.zeros(m, np.uint64)
    for k in range(window):
        h += (ids[k : k + m] + np.uint64(1)) * _mix[k % WINDOW]
    _, of, n = np.unique(h, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(n[of] > 1)
    if not len(hit):
        return 0
    # Equal windows have equal hashes; the few that share one are compared as they are.
    _, of, n = np.unique(np.lib.stride_tricks.sliding_window_view(ids, window)[hit], axis=0, return_inverse=True, return_counts=True)
    hit = hit[n[of.ravel()] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: str) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    return len(lines), len(lines) - len(set(lines))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum, text_key and the counts of every row, in one pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                out: list[list[int]] = [[] for _ in range(9)]
                for value in part.column(1):
                    t = value.as_py()
                    words = _words(t)
                    lines, dup = duplicate_lines(t)
                    letters = len(_letters.findall(t)) if t.upper() != t else 0
                    caps = sum(map(str.isupper, t)) if letters else 0
                    if not letters and t:  # nothing in lower case: every cased letter is a capital
                        letters = caps = sum(map(str.isupper, t))
                    row = (xxhash.xxh3_64_intdigest(t.encode("utf-8")) - 2**63, len(words), sum(map(len, words)), len(_symbols.findall(t)), dup, repeated_words(words), lines, letters, caps)
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(c, pa.int64()) for c in out)], names)

    names = ["doc_id", "stratum", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_caps"]
    rows = texts_of(docs, id_col, text_col, stratum_col).select("doc_id", "text", F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, stratum string, " + ", ".join(f"{n} long" for n in names[2:]))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rule_values() -> dict[str, Column]:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"symbol_rate": share("n_symbols", "n_words"), "caps_share": share("n_caps", "n_letters"), "repeat_share": share("n_repeat_words", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines")}


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p): the exact p-value of 'the false rejection rate is above p'."""
    if k >= n:
        return 1.0
    upper = k > n * p  # the shorter tail is summed: its terms shrink fast from its edge on
    i, step = (k + 1, 1) if upper else (k, -1)
    term = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    total = 0.0
    while 0 <= i <= n and term > total * 1e-17:
        total += term
        term *= (n - i) / (i + 1) * p / (1 - p) if upper else i / (n - i + 1) * (1 - p) / p
        i += step
    return min(1.0, max(0.0, 1 - total if upper else total))


def choose_cutoff(good: list[int], bad: list[int], n_good: int, n_bad: int, limit: float, error: float) -> int | None:
    """Index of the certified cutoff to use, or None.

    ``good[i]`` and ``bad[i]`` count holdout rows that cutoff ``i`` rejects; both grow with ``i``.
    """
    gains: list[int] = []
    for g, b in zip(good, bad, strict=True):
        if g > limit * n_good or binomial_tail(g, n_good, limit) > error:
            break
        gains.append(b - 5 * g)
    best = max(gains, default=0)
    if best < max(10, n_bad / 100):
        return None
    return next(i for i, x in enumerate(gains) if x >= 0.95 * best)


def _at_least(value: Column):
    return lambda cutoff: cutoff >= value


def fit_cutoffs(measures: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_false_rejection: float = 0.05, error: float = 0.05) -> dict[str, dict[str, float]]:
    """{rule: {stratum: cutoff}}; only counts per stratum, rule and grid step reach the driver."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("good")).filter("doc_id is not null and good in (0, 1)").groupBy("doc_id").agg(F.max("good").alias("good"))
    rules = rule_values()
    step = {r: F.size(F.filter(F.array(*map(F.lit, GRIDS[r])), _at_least(v))) for r, v in rules.items()}
    rows = measures.filter(~base_failed()).join(known, "doc_id").select("stratum", "text_key", "good", *[s.alias(r) for r, s in step.items()])
    rows = rows.groupBy("text_key", "stratum").agg(F.max("good").alias("good"), *[F.first(r).alias(r) for r in rules])
    counts = rows.unpivot(["stratum", "good"], list(rules), "rule", "step").groupBy("stratum", "good", "rule", "step").count()
    # With fewer good rows not even a cutoff without a rejection passes, whatever the number of strata.
    limit, rule = max_false_rejection / len(rules), next(iter(rules))
    least = math.log(error / len(rules)) / math.log1p(-limit)
    n_good = F.sum(F.when((F.col("good") == 1) & (F.col("rule") == rule), F.col("count"))).over(Window.partitionBy("stratum"))
    held: dict[tuple[str, str], np.ndarray] = {}
    for x in counts.withColumn("n_good", n_good).filter(F.col("n_good") >= least).toLocalIterator():
        # Rejected by cutoff i when the value is above it: i >= step.
        held.setdefault((x["stratum"], x["rule"]), np.zeros((2, len(GRIDS[x["rule"]]) + 1), np.int64))[x["good"], x["step"]] += x["count"]
    share, out = error / max(1, len(held)), {r: {} for r in rules}
    for (s, r), h in sorted(held.items()):
        above = np.cumsum(h[:, :-1], axis=1)
        i = choose_cutoff(above[1].tolist(), above[0].tolist(), int(h[1].sum()), int(h[0].sum()), limit, share)
        if i is not None:
            out[r][s] = GRIDS[r][i]
    return out


def verdict(cutoffs: dict[str, dict[str, float]]) -> Column:
    """True for a row that no certified rule rejects."""
    rejected = F.lit(False)
    for rule, value in rule_values().items():
        if by := cutoffs.get(rule):
            cut = F.try_element_at(F.create_map(*[F.lit(x) for kv in by.items() for x in kv]), F.col("stratum"))
            rejected = rejected | F.coalesce(value > cut, F.lit(False))
    return ~rejected


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", max_false_rejection: float = 0.05, error: float = 0.05) -> DataFrame:
    measures = stash(measure(docs, id_col, text_col, stratum_col), "quality-measures")
    cutoffs = fit_cutoffs(measures, labels, id_col, label_col, max_false_rejection, error)
    return measures.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & verdict(cutoffs)).alias("kept"))


def query_op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
