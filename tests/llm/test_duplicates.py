import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cartulary.llm import line_dedup, simhash
from cartulary.operators.graph import connected_components

from .helpers import EDGE, frame, text, union_find, words


def reference_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def texts_with_copies():
    base = [text(60, s) for s in range(12)]
    near = [b.replace(b.split()[k], "changed", 1) for b in base[:4] for k in (3, 17, 30, 44)]
    return [*EDGE, *base, *base[:3], *near, base[0].upper()]


def test_fingerprints_and_components_equal_brute_force(spark):
    texts = texts_with_copies()
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    f = [reference_fingerprint(t) for t in texts]
    assert [got[i]["f"] % 2**64 for i in range(len(f))] == f
    links = [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 4]
    assert [got[i]["component_id"] for i in range(len(f))] == union_find(len(f), links)


def test_index_and_split_groups_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    f = np.unique(np.array([int(base[rng.integers(6)]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 8), replace=False)) for _ in range(400)], np.uint64))
    rng.shuffle(f)
    links = [(i, j) for i, j in zip(*np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4), strict=True) if j < i]
    want = union_find(len(f), links)
    rows = spark.createDataFrame([(int(v.view(np.int64)), i) for i, v in enumerate(f)], "f long, rep long")
    for group_rows in (65_536, 5):
        parts = dict(connected_components(simhash.link_edges(rows, 4, group_rows)).collect())
        assert [parts.get(i, i) for i in range(len(f))] == want
    order = np.argsort(simhash.gray_rank(f))
    at = np.argsort(order)
    want_sorted = union_find(len(f), [(at[i], at[j]) for i, j in links])
    assert simhash.GrayIndex(f[order], np.zeros(len(f), int)).components(4).tolist() == want_sorted


def test_block_choices_cover_all_distances():
    for n in (10, 10**7):
        masks = simhash.block_choices(n)
        rng = np.random.default_rng(1)
        for _ in range(300):
            d = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(d & m == 0 for m in masks)


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    texts = texts_with_copies()
    docs = frame(spark, texts)
    got = simhash.near_duplicates(docs).collect()
    kept = [r["doc_id"] for r in simhash.stage_near_duplicates(spark, docs.unionByName(docs.limit(3)), "").select("doc_id").collect()]
    assert sorted(kept) == sorted({r["component_id"] for r in got})
    assert simhash.stage_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_near_duplicate_stage_keeps_rows_without_an_id(spark):
    texts = texts_with_copies()
    docs = frame(spark, texts)
    alone = frame(spark, [text(70, 900), text(70, 901), text(70, 900)], 500).withColumn("doc_id", F.lit(None).cast("long"))
    copies = docs.limit(5).withColumn("doc_id", F.lit(None).cast("long"))
    out = simhash.stage_near_duplicates(spark, docs.unionByName(alone).unionByName(copies), "")
    assert out.columns == docs.columns
    assert sorted(r["text"] for r in out.filter("doc_id is null").collect()) == sorted([text(70, 900), text(70, 901)])
    assert out.filter("doc_id is not null").count() == simhash.stage_near_duplicates(spark, docs, "").count()


def brute_lines(texts, similarity=0.8, least=1):
    where = defaultdict(list)
    for d, t in enumerate(texts):
        for i, x in enumerate((t or "").split("\n")):
            y = line_dedup.normalise(x)
            if len(y) >= least:
                where[y].append((d, i))
    lines = list(where)
    sets = [line_dedup.shingles(x) for x in lines]
    links = [(i, j) for i in range(len(lines)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    comp = defaultdict(list)
    for i, c in enumerate(union_find(len(lines), links)):
        comp[c] += where[lines[i]]
    gone = defaultdict(set)
    for places in comp.values():
        for d, i in sorted(places)[1:]:
            gone[d].add(i)
    return ["\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) if t is not None else None for d, t in enumerate(texts)]


def lines_fixture():
    shared = " ".join(words(40, 99))
    near = [shared.replace(w, "zz", 1) for w in shared.split()[:6]]
    return [*EDGE, text(80, 1), text(80, 1), text(50, 2) + "\n" + shared, *[text(24, 10 + i) + "\n" + n for i, n in enumerate(near)], shared.upper() + "\nshort\nshort\n" + shared, "x y\n" * 5]


def test_line_dedup_equals_brute_force(spark):
    texts = lines_fixture()
    for group_rows in (4096, 2):
        out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, texts), group_rows=group_rows).collect()}
        assert [out[i] for i in range(len(texts))] == brute_lines(texts)


def test_line_dedup_on_the_data(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id")
    rows = docs.collect()
    assert [r["doc_id"] for r in rows] == list(range(len(rows)))
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    want = brute_lines([r["text"] for r in rows])
    assert [out[i] for i in range(len(rows))] == want


def test_line_dedup_empty_table_and_columns(spark):
    docs = frame(spark, ["a"])
    assert line_dedup.stage_line_dedup(spark, docs, "").columns == docs.columns
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_band_keys_travel_short_and_complete(spark):
    shared = " ".join(words(40, 99))
    lines = [" ".join(words(20, 300 + i)) for i in range(40)] + [shared, shared + " zz", shared.replace("a", "e", 1)]
    names = line_dedup._keys(lines)[:, 0]
    for parts in (1, 5):
        blocks = line_dedup.scan_lines(frame(spark, lines).coalesce(1), "doc_id", "text", 1, parts)
        sizes = [len(r["block"]) for r in blocks.collect() if r["part"] < parts]
        keys, at = line_dedup.band_keys(lines)
        assert sum(sizes) <= 13 * len(keys)  # 16 with whole keys
        found = {(r["lead"], r["h1"]) for r in line_dedup.found_lines(blocks, parts).filter("lead is not null").collect()}
        buckets = defaultdict(set)
        for k, i in zip(keys.tolist(), at.tolist(), strict=True):
            buckets[k].add(int(names[i]))
        want = {(min(b), x) for b in buckets.values() if len(b) > 1 for x in b}
        assert want and found == want


def test_bloom_has_no_false_negatives(spark):
    rng = np.random.default_rng(0)
    h, d = rng.integers(-(2**63), 2**63 - 1, 5000), rng.integers(0, 2**40, 5000)
    b = line_dedup.bloom(spark.createDataFrame([(int(x), int(y)) for x, y in zip(h, d, strict=True)], "h1 long, owner long"), len(h))
    assert line_dedup.in_bloom(b, h, d).all()
    assert line_dedup.in_bloom(b, h, d + 1).mean() < 0.05
    assert line_dedup.in_bloom(b, rng.integers(-(2**63), 2**63 - 1, 5000), d).mean() < 0.05


def test_lines_at_the_threshold_share_a_band():
    rng = np.random.default_rng(5)
    for n in (30, 70, 100, 160, 400):
        found = pairs = 0
        for _ in range(400):
            a = "".join(rng.choice(list("abcdefghijklmnop"), n))
            b = list(a)
            for p in rng.choice(n, max(1, n // 55), replace=False):
                b[p] = "z"
            b = "".join(b)
            x, y = line_dedup.shingles(a), line_dedup.shingles(b)
            if 0.8 <= len(x & y) / len(x | y) < 0.86:
                keys, at = line_dedup.band_keys([a, b])
                pairs += 1
                found += bool(set(keys[at == 0].tolist()) & set(keys[at == 1].tolist()))
        assert pairs == 0 or found >= 0.985 * pairs, (n, found, pairs)


def test_linker_equals_brute_force_for_small_and_large_groups():
    base = [" ".join(words(30, s)) for s in range(3)]
    lines = sorted({b.replace(x, "q", 1).replace(y, "zz", 1) for b in base for x in b.split()[:6] for y in b.split()[8:12]} | set(base))
    sets = [line_dedup.shingles(x) for x in lines]
    want = union_find(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert len(lines) > line_dedup.LARGE
    for size in (len(lines), 2):
        linker = line_dedup.Linker(lines, 0.8)
        groups = [list(range(len(lines)))] if size > 2 else [[i, j] for i in range(len(lines)) for j in range(i)]
        for g in groups:
            linker.link(sorted(g))
        assert [linker.root(i) for i in range(len(lines))] == want
