"""The pipeline against plain loops over the smallest tables, and its stages on unusual tables."""

import hashlib
import math
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cartulary.llm import byte_bpe, mixing, toxicity

from .helpers import union_find
from .test_duplicates import brute_lines, reference_fingerprint


def loop_toxic(machine, text):
    place = {int(s): k for k, s in enumerate(machine.slots)}
    rows = sorted({place[s] for w in set(toxicity._words(text.lower())) for s in toxicity.slots_of(w) if s in place})
    z = machine.bias + sum(machine.w[i] for i in rows) + sum(float(machine.v[i] @ machine.v[j]) for i in rows for j in rows if i < j)
    return 1 / (1 + math.exp(-z)) >= toxicity.THRESHOLD


def loop_posterior(model, text):
    data = text.encode()
    logits = np.array(model.bias, float)
    slots = [((data[i] * 257 + data[i + 1]) * 2654435761 % 2**32 >> 21) % mixing.DIM for i in range(len(data) - 1)]
    if slots:
        logits = logits + model.weight[slots].astype(float).mean(0)
    e = np.exp(logits - logits.max())
    return e / e.sum()


def loop_copies(mix, p, doc_id):
    rate = min(max(1.0, mix.min_rate), mix.max_rate)
    for g in mix.history:
        rate = min(max(rate - float(p @ g), mix.min_rate), mix.max_rate)
    whole = math.floor(rate + 1e-9)
    return whole + (xxhash.xxh64_intdigest(str(doc_id)) / 2.0**64 < rate - whole)


def test_pipeline_equals_loops(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r["doc_id"], r["text"] or "", r["lang"]) for r in docs.orderBy("doc_id").collect()]
    machine = toxicity.train(docs, labels)
    rows = [r for r in rows if not loop_toxic(machine, r[1])]
    # brute_lines calls the first place of a list the smallest id.
    rows = [(i, t, lang) for (i, _, lang), t in zip(rows, brute_lines([t for _, t, _ in rows]), strict=True)]
    f = [reference_fingerprint(t) for _, t, _ in rows]
    links = [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 4]
    rows = [r for k, (r, c) in enumerate(zip(rows, union_find(len(f), links), strict=True)) if k == c]
    kept = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, _, mix = mixing.fit_mixture(kept, labels, min_rate=1.0)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = Counter()
    for i, t, _ in rows:
        ids = enc.encode_ordinary(t)
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += loop_copies(mix, loop_posterior(model, t), i)
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want and len(got) > 100


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables_and_rows_without_ids(spark, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 40").withColumn("spans", F.lit("extra"))
    assert stage(spark, docs.limit(0), sf).count() == 0
    odd = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), *docs.columns[2:])
    alone = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit("quite alone in what it says of yards and signs").alias("text"), *docs.columns[2:])
    out = stage(spark, docs.unionByName(odd).unionByName(alone), sf)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
    assert out.filter("doc_id is null").count() >= 2 if name != "near_duplicates" else out.filter("doc_id is null and text is not null").count() == 1
