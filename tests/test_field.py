"""Operators that SQL can't check, against plain loops, and their defined failures."""

import difflib
import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cartulary.functions import text as fx
from cartulary.operators import dedup, embed, join, model, panel, segment


def test_oracles_are_statements():
    con = duckdb.connect()
    for name, sql in __spark_entry__.oracle_sql().items():
        assert isinstance(sql, str), name
        assert len(con.extract_statements(sql)) == 1, name


def loop_simhash(text, digest):
    tokens, weights = text.split(), [0] * 64
    for t in tokens:
        h = hashlib.blake2b(t.encode(), digest_size=8).digest() if digest == "blake2b" else hashlib.md5(t.encode()).digest()[:8]
        v = int.from_bytes(h, "big")
        weights = [w + (1 if v >> i & 1 else -1) for i, w in enumerate(weights)]
    return sum(1 << i for i, w in enumerate(weights) if w >= 0) if tokens else 0


def test_simhash_equals_a_loop(spark):
    texts = ["", "a", "a b", "the board shall hear each appeal " * 9, "x y z w", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for digest in ("blake2b", "md5"):
        got = {r["i"]: r["h"] % 2**64 for r in df.select("i", dedup.simhash64(F.col("t"), digest).alias("h")).collect()}
        assert got == {i: loop_simhash(t or "", digest) for i, t in enumerate(texts)}


def test_candidates_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63 - 1, 5)
    rows = []
    for i in range(300):
        f = int(base[rng.integers(5)])
        for b in rng.choice(64, rng.integers(0, 11), replace=False):
            f ^= 1 << int(b) if b < 63 else -(2**63)
        rows.append((i, "ab"[i % 2], int(rng.integers(10, 400)), ["", "t1", "t2"][int(rng.integers(3)) if i % 9 == 0 else 0], f))
    df = spark.createDataFrame(rows, "id long, block string, n long, title string, f long")
    got = {tuple(r) for r in dedup.near_candidates(df, "id", ["block"], "n", "title", "f").collect()}
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    want = set()
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            if a[1] == b[1] and b[2] - a[2] <= max(20, int(0.03 * b[2])) and ((a[3] and a[3] == b[3]) or ((a[4] ^ b[4]) % 2**64).bit_count() <= 8):
                want.add((a[0], b[0]))
    assert got == want and want


def test_near_groups_find_copies_by_title_and_whole_texts(spark):
    # difflib anchors matches at rare letters only.
    body = "the owner of any lot may appeal to the board of adjustment within thirty days " * 6 + "jury quiz fixed " + "so that each lot has its own yard and light " * 9
    rows = [
        (1, "x", "sign rules", body),
        (2, "x", "sign rules", "page seven " + body),  # another opening
        (3, "x", "", body),  # an equal text
        (4, "x", "sign rules", body[: len(body) // 2] + "none of this is alike at all to what it stands for here " * 9),
        (5, "y", "sign rules", body),
        (6, "x", None, None),
    ]
    df = spark.createDataFrame([(i, b, t, x, len((x or "").split())) for i, b, t, x in rows], "id long, block string, title string, t string, n long")
    got = {r["id"]: r["group"] for r in dedup.near_groups(df, "id", ["block"], "n", "t", 0.97, title="title").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}


def test_reprints_equal_a_loop(spark):
    base = "An ordinance on signs, yards and parking in the city; the council so orders, year " * 6
    rows = [
        ("p", 1, "1950-01-01", base + "one"), ("p", 2, "1950-01-20", base + "one two"), ("p", 3, "1950-02-25", base + "three four"),
        ("p", 4, "1951-01-01", base + "one"), ("q", 5, "1950-01-01", base + "one"), ("p", 6, "1950-01-10", "quite other words of no such kind at all " * 5),
        ("", 7, "1950-01-01", base), ("", 8, "1950-01-01", base), ("p", 9, "1950-01-02", None),
    ]
    df = spark.createDataFrame(rows, "place string, id long, day string, t string")
    got = {r["item"]: r for r in dedup.reprint_groups(df, "place", "id", "day", "t").collect()}
    name = "reprint_" + hashlib.sha1(b"1|2|3").hexdigest()[:12]
    assert {i: (r["status"], r["group"], r["group_size"], r["canonical"], r["days_from_canonical"]) for i, r in got.items()} == {
        1: ("duplicate", name, 3, 3, 55), 2: ("duplicate", name, 3, 3, 36), 3: ("canonical", name, 3, 3, 0),
        4: ("unique", "", 1, 4, 0), 5: ("unique", "", 1, 5, 0), 6: ("unique", "", 1, 6, 0), 7: ("unique", "", 1, 7, 0), 8: ("unique", "", 1, 8, 0), 9: ("unique", "", 1, 9, 0),
    }
    norm = lambda t: re.sub(r"[^a-z0-9]+", " ", t.lower()).strip()
    assert got[2]["similarity"] == pytest.approx(difflib.SequenceMatcher(None, norm(rows[1][3]), norm(rows[2][3])).ratio())
    assert got[1]["similarity"] is None  # 55 days: not compared with the canonical one


def loop_chunks(text, limit):
    text = text.strip(" \t\n\r\x0b\x0c")
    out, now = [], ""
    for p in [x.strip(" \t\n\r\x0b\x0c") for x in re.split(r"\n\s*\n", text)]:
        if not p:
            continue
        if len(joined := f"{now}\n\n{p}" if now else p) <= limit:
            now = joined
            continue
        out += [now] if now else []
        while len(p) > limit:
            at = p.rfind(" ", 0, limit)
            at = limit if at < limit // 2 else at
            out += [x] if (x := p[:at].strip()) else []
            p = p[at:].strip()
        now = p
    return (out + ([now] if now else [])) or [text]


def test_embedding_chunks_equal_a_loop(spark):
    rng = np.random.default_rng(3)
    texts = ["", " \n\n ", "a b c", "x" * 95, "word " * 60, "one two\n\nthree four\n \nfive " + "y" * 50 + " z", "a" * 19 + " " + "b" * 40]
    texts += ["".join(rng.choice(list("ab  \n"), 300)) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for limit in (20, 33):
        got = {r["i"]: r["c"] for r in df.select("i", segment.embedding_chunks(F.col("t"), limit).alias("c")).collect()}
        assert got == {i: loop_chunks(t, limit) for i, t in enumerate(texts)}


def test_linguistic_measures_equal_a_loop(spark):
    texts = ["", "A simple table. Apple's style! rhythm; me, the", "'''", "ééé re-use eye. by?", "Little people owe the 3 queue's e le ale"]

    def loop(t):
        words = re.findall("[a-z']+", t.lower())
        sent = [n for n in (len(re.findall("[A-Za-z']+", s)) for s in re.split("[.!?]+", t)) if n]
        syl = 0
        for w in words:
            b = re.sub("[^a-z]", "", w)
            g = len(re.findall("[aeiouy]+", b))
            syl += max(1, g - (b.endswith("e") and g > 1) + bool(re.search("[^aeiouy]le$", b))) if b else 0
        n = max(1, len(words))
        return (float(len(sent)), sum(sent) / max(1, len(sent)), sum(map(len, words)) / n, sum(len(w) >= 7 for w in words) / n, syl / n)

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    m = fx.linguistic("t")
    names = ["sentence_count", "avg_sentence_words", "avg_word_chars", "long_word_share", "syllables_per_word"]
    for r in df.select("i", *[m[n].alias(n) for n in names]).collect():
        assert tuple(r)[1:] == pytest.approx(loop(texts[r["i"]])), texts[r["i"]]


def test_gaps_near_the_edges(spark):
    long = "x" * 20_000
    texts = ["continued from page 3 " + long, long + " continued from page 3 " + long, long + " Continued  to page 9", "[missing text: page 4]", "[MISSING TEXT]", long, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    a = fx.gap_audit(F.col("t"))
    got = {r["i"]: tuple(r)[1:] for r in df.select("i", *a.values()).collect()}
    sure, unclear, none = "high_confidence_missing_other_pages", "incomplete_text_cause_unclear", "no_direct_gap_clue"
    assert got == {0: (0, 0, 1, 0, sure), 1: (0, 0, 0, 0, none), 2: (0, 0, 0, 1, sure), 3: (1, 1, 0, 0, sure), 4: (1, 0, 0, 0, unclear), 5: (0, 0, 0, 0, none), 6: (0, 0, 0, 0, none)}


def test_best_prior_follows_any_number_of_ranks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(int(rng.integers(3)), i, f"2000-{1 + int(rng.integers(12)):02d}-{1 + int(rng.integers(28)):02d}", int(rng.integers(90))) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, i long, d string, r int")
    many = sorted(map(tuple, join.best_prior(df, ["k"], "i", "d", "r", 60).select("i", "prior", "gap", "status").collect()))
    monkeypatch.setattr(join, "RANK_COLUMNS", 100)
    assert many == sorted(map(tuple, join.best_prior(df, ["k"], "i", "d", "r", 60).select("i", "prior", "gap", "status").collect()))


def test_ties_and_knots_of_vectors(spark):
    x = [[1.0, 0.0]] * 30 + [[0.0, 1.0]] * 3 + [[-1.0, 0.001]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id long, v array<double>")
    for block in (4096, 7):
        near = {(r["item"], r["neighbour"]) for r in embed.neighbours(df, "id", "v", 3, block).collect()}
        assert {n for i, n in near if i == 25} == {0, 1, 2} and {n for i, n in near if i == 0} == {1, 2, 3}
        got = {r["id"]: r["cluster"] for r in embed.density_clusters(df, "id", "v", 10, 3, 0.35, block).collect()}
        assert got == {i: 0 if i < 30 else -1 for i in range(34)}


def test_coverage_sample_equals_a_loop(spark):
    rng = np.random.default_rng(2)
    rows = [("ab"[i % 2], i, int(rng.integers(3)), int(rng.integers(4)), float(rng.integers(50)) / 100) for i in range(80)]
    df = spark.createDataFrame(rows, "g string, id long, level int, quartile int, bonus double")
    got = {(r["g"], r["place"]): r["id"] for r in panel.coverage_sample(df, "g", "id", {"level": 4.0, "quartile": 3.0}, "bonus", 9).collect()}
    for g in "ab":
        left, seen = [r for r in rows if r[0] == g], {}
        for place in range(1, 10):
            n = lambda r: (seen.get(("l", r[2]), 0), seen.get(("q", r[3]), 0))  # noqa: B023, E731
            score = lambda r: ((4 if not n(r)[0] else 1 / (1 + n(r)[0])) + (3 if not n(r)[1] else 1 / (1 + n(r)[1])) + r[4], -n(r)[0], -n(r)[1], r[1])  # noqa: B023, E731
            best = max(left, key=score)
            left.remove(best)
            seen[("l", best[2])], seen[("q", best[3])] = n(best)[0] + 1, n(best)[1] + 1
            assert got[(g, place)] == best[1]


def test_logit_equals_newton_steps(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 2))
    y = rng.random(600) < 1 / (1 + np.exp(-(0.3 + x @ [1.2, -0.7])))
    df = spark.createDataFrame([(int(i % 40), float(a), float(b), bool(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "k int, a double, b double, y boolean")
    got = {r["term"]: r for r in model.logit(df, "y", ["a", "b"], "k").collect()}
    z, w = np.c_[np.ones(600), x], np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z, z.T @ (y - p))
    assert [got[t]["estimate"] for t in ("intercept", "a", "b")] == pytest.approx(w.tolist(), abs=1e-4)
    assert 0.7 < got["a"]["auc"] < 0.95 and got["a"]["brier"] < 0.25


def test_failures_are_loud(spark):
    found = spark.createDataFrame([(1, "none", None, "unresolved")], "input_id long, tier string, entity_id long, status string")
    catalog, wrong = spark.createDataFrame([(7,)], "entity_id long"), spark.createDataFrame([(1, 8)], "input_id long, entity_id long")
    for df in (
        join.with_overrides(found, wrong, catalog),
        join.require_all(found.select("input_id"), "input_id", {"page": catalog.select(F.col("entity_id").alias("input_id"))}),
        panel.union_unique([catalog, catalog], "entity_id"),
        spark.createDataFrame([("long text",)], "t string").select(fx.bounded(F.col("t"), 3)),
    ):
        with pytest.raises(Exception, match="override without|no row for|repeated key|text over"):
            df.collect()


def test_section_repair_statuses(spark):
    rows = [("ok", 1, 4, 9), ("ok", 5, 9, 9), ("fix", 3, 4, 9), ("fix", 6, 8, 9), ("over", 1, 5, 9), ("over", 5, 9, 9), ("gap", 1, 3, 9), ("gap", 6, 9, 9), ("back", 4, 2, 9), ("tail", 1, 5, 9)]
    df = spark.createDataFrame(rows, "k string, s int, e int, last int")
    got = {}
    for r in segment.repair_specs(df, "k", "s", "e", "last").orderBy("k", "number").collect():
        got.setdefault((r["k"], r["status"]), []).append((r["start"], r["end"]))
    assert got[("ok", "ok")] == [(1, 4), (5, 9)] and got[("fix", "repaired")] == [(1, 5), (6, 9)]
    assert {k for k, s in got if s == "rejected"} == {"over", "gap", "back", "tail"}


def test_density_hierarchy(spark):
    from cartulary.operators import hierarchy

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, s, (n, 2)) for c, s, n in (((0, 0), 0.1, 40), ((5, 5), 0.4, 60), ((-6, 4), 0.2, 30))] + [rng.uniform(-30, 30, (12, 2))])
    core = hierarchy.core_distances(x, 4)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert core == pytest.approx(np.sort(d, axis=1)[:, 3], abs=1e-6)
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    # Kruskal's tree has the same weights.
    lab, want = list(range(len(x))), []
    for i, j in sorted(((i, j) for i in range(len(x)) for j in range(i)), key=lambda p: reach[p]):
        if lab[i] != lab[j]:
            want.append(reach[i, j])
            old, new = lab[i], lab[j]
            lab = [new if v == old else v for v in lab]
    tree = hierarchy.spanning_tree(x, core)
    assert np.sort(tree[:, 2]) == pytest.approx(np.array(want), abs=1e-6)
    label = hierarchy.cluster(x, 12, 4)
    for begin, end in ((0, 40), (40, 100), (100, 130)):
        names, n = np.unique(label[begin:end], return_counts=True)
        assert n.max() >= 0.9 * (end - begin) and names[n.argmax()] >= 0
    assert len(set(label.tolist()) - {-1}) == 3 and (label[130:] == -1).mean() > 0.6
    df = spark.createDataFrame([(g, i, v.tolist()) for g in "ab" for i, v in enumerate(x)] + [("a", 999, None), ("c", 1, [0.0, 0.0])], "g string, id long, v array<double>")
    got = {(r["g"], r["id"]): r["cluster"] for r in hierarchy.hdbscan(df, "id", "v", 12, 4, "g").collect()}
    assert [got["b", i] for i in range(len(x))] == label.tolist() and got["a", 999] == got["c", 1] == -1
    with pytest.raises(Exception, match="the limit is 10"):
        hierarchy.hdbscan(df, "id", "v", 12, 4, "g", row_limit=10).collect()
    same = hierarchy.cluster(np.array([[0.0, 0.0]] * 20 + [[9.0, 9.0]] * 20), 5, 2)
    assert same.tolist() == [0] * 20 + [1] * 20
