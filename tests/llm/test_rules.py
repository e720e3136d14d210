import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from cartulary.llm import chat_format, pii, quality_rules, queries, toxicity

from .helpers import EDGE, frame, text, words


# Quality -----------------------------------------------------------------------
def brute_repeats(w):
    seen, hit = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            hit |= {i + k for i in places for k in range(8)}
    return len(hit)


def test_measures_equal_brute_force(spark):
    w = words(60, 4)
    texts = [*EDGE, " ".join(w + w[:20]), "a b " * 40, "x\nx\n \nx\ny y", "#a $b %c& d|e <f>", " ".join(words(500, 5, 3))]
    got = {r["doc_id"]: r for r in quality_rules.measure(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), brute_repeats(ws))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, t


def test_binomial_tail_is_exact():
    from math import comb

    for k, n, p in ((0, 50, 0.05), (3, 40, 0.1), (7, 20, 0.3)):
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(quality_rules.binomial_tail(k, n, p) - want) < 1e-12


def test_cutoffs_are_certified_and_useful(spark):
    good = [text(40, s) for s in range(900)]
    bad = [" ".join(w + "%%%" for w in words(40, 5000 + s)) for s in range(100)]
    docs = frame(spark, good + bad)
    labels = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") < 900).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    labels = labels.unionByName(labels.limit(5))
    out = {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(docs, labels).collect()}
    assert all(out[i] for i in range(900)) and not any(out[i] for i in range(900, 1000))
    few = quality_rules.fit_cutoffs(quality_rules.measure(docs), labels.filter("doc_id < 50"))
    assert not any(few.values())  # too few holdout rows certify nothing
    assert quality_rules.apply_rules(docs.limit(0), labels.limit(0)).count() == 0


def test_a_small_unusual_stratum_keeps_its_good_rows(spark):
    odd = lambda s: " ".join(w + "%%%" for w in words(40, s))
    docs = frame(spark, [text(60, s) for s in range(900)] + [odd(5000 + s) for s in range(100)]).union(frame(spark, [odd(6000 + s) for s in range(40)], 1000, "xx"))
    labels = spark.range(1002).select(F.col("id").alias("doc_id"), (~F.col("id").between(900, 999)).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    kept = {r["doc_id"] for r in quality_rules.apply_rules(docs, labels).filter("kept").collect()}
    assert kept == {*range(900), *range(1000, 1040)}


def test_rows_without_a_stratum_are_one_stratum_and_rows_without_text_fail(spark):
    good = [text(40, s) for s in range(700)]
    bad = [" ".join(w + "%%%" for w in words(40, 5000 + s)) for s in range(80)]
    docs = frame(spark, good + bad + [None, None], lang=None)
    labels = spark.range(790).select(F.col("id").alias("doc_id"), (F.col("id") < 700).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    cutoffs = quality_rules.fit_cutoffs(quality_rules.measure(docs), labels)
    assert {s for by in cutoffs.values() for s in by} == {""}
    out = quality_rules.apply_rules(docs.unionByName(docs.filter("doc_id < 3")), labels).collect()
    assert len(out) == 785 and {r["doc_id"] for r in out if r["kept"]} == set(range(700))
    assert all(r["base_failed"] and not r["n_words"] for r in out if r["doc_id"] >= 780)


def test_choose_cutoff_stops_at_the_first_failure():
    assert quality_rules.choose_cutoff([0, 0, 40, 0], [0, 50, 60, 90], 1000, 100, 0.02, 0.01) == 1
    assert quality_rules.choose_cutoff([0, 0], [50, 50], 30, 100, 0.02, 0.01) is None


# PII ---------------------------------------------------------------------------
def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def brute_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    )
    found = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, t or "") if ok(m[0])]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_spans_equal_brute_force(spark):
    r = np.random.default_rng(1)
    bits = ["a", "b", "@", ".", "1", "25", "300", "+1", "-", " ", "é", "x@y.co", "1.2.3.4", "4111111111111111", "😀", "(", ")", "555-0100"]
    texts = [*EDGE, *["".join(r.choice(bits, 40)) for _ in range(300)], "7" * 9000 + " " + "a" * 9000 + "@b.c " + "1 " * 5000, "a@b.c_d@e.f", "+1 (386) 555-3733"]
    out = pii.detect(frame(spark, texts))
    for row in out.select("doc_id", pii.written(F.col("spans")).alias("s")).collect():
        assert row["s"] == brute_spans(texts[row["doc_id"]]), texts[row["doc_id"]]
    assert pii.detect(frame(spark, ["a"]).limit(0)).count() == 0


def test_disclosing_terms_are_found_and_common_ones_left(spark):
    secret = [f"{text(9, s)} ask drXenophanes at jo@x.org today {s} and {text(9, 50 + s)}" for s in range(6)]
    plain = [text(30, 200 + s) + " today ask and at" for s in range(60)]
    rows = pii.detect(frame(spark, secret + plain)).select("doc_id", pii.sanitise(F.col("text"), F.concat("spans", "more")).alias("out"), F.size("spans").alias("n"), F.size("more").alias("m")).collect()
    for r in rows:
        if r["doc_id"] < 6:
            assert "[EMAIL]" in r["out"] and "Xenophanes" not in r["out"] and " ask " in r["out"] and "today" in r["out"]
        else:
            assert (r["n"], r["m"]) == (0, 0)


def test_terms_near_rare_values_are_found(spark):
    once = "we met Quorvantha at ol@one.org again " + text(30, 1)
    pooled = [f"{text(9, 100 + s)} from Zelbrookia by u{s}@zb.org again {text(9, 150 + s)}" for s in range(4)]
    plain = [text(30, 200 + s) + " today from again met" for s in range(2000)]
    rows = pii.detect(frame(spark, [once, *pooled, *plain])).filter("doc_id < 5").select("doc_id", pii.sanitise(F.col("text"), F.concat("spans", "more")).alias("out")).collect()
    out = {r["doc_id"]: r["out"] for r in rows}
    assert "Quorvantha" not in out[0] and " again " in out[0]
    for i in range(1, 5):
        assert "Zelbrookia" not in out[i] and " again " in out[i] and " from " in out[i]


def brute_terms(texts, threshold=0.9, support=3, window=80):
    """The disclosing terms of every text, straight from the definition."""
    import math
    from collections import Counter, defaultdict

    import regex

    term = regex.compile(pii.TERM)
    digits = lambda x: re.sub("[^0-9]", "", x)
    valid = (lambda m: True, lambda m: all(len(x.lstrip("0") or "0") <= 3 and int(x) <= 255 for x in m.split(".")), lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m)), lambda m: 10 <= len(digits(m)) <= 15)
    pools = (lambda v: v.split("@")[-1], lambda v: ".".join(x.lstrip("0") or "0" for x in v.split(".")[:3]), lambda v: digits(v)[:6], lambda v: digits(v)[:-4])
    rows = Counter(t or "" for t in texts)
    entities, near = defaultdict(set), defaultdict(set)  # text: entities; (entity, term): texts
    for t in rows:
        for kind, name in enumerate(pii.KINDS):
            found = list(regex.finditer(pii.PATTERNS[name], t))
            for k, m in enumerate(found):
                if not valid[kind](m[0]):
                    continue
                left = t[found[k - 1].end() if k else 0 : m.start()][-(window + 1) :]
                right = t[m.end() : found[k + 1].start() if k + 1 < len(found) else None][: window + 1]
                left = re.sub(r"^\S+", "", left) if len(left) > window else left
                right = re.sub(r"\S+$", "", right) if len(right) > window else right
                words = set(term.findall((left + "\n" + right).lower()))
                for e in (f"{kind}:{m[0].lower()}", f"pool:{kind}:{pools[kind](m[0].lower())}"):
                    entities[t].add(e)
                    for w in words | {"^" + w[: pii.STEM] for w in words}:
                        near[e, w].add(t)
    n, n_t, n_c = sum(rows.values()), Counter(), Counter()
    for t, c in rows.items():
        words = set(term.findall(t.lower()))
        for w in words | {"^" + w[: pii.STEM] for w in words}:
            n_t[w] += c
        for e in entities[t]:
            n_c[e] += c
    reveal = defaultdict(set)
    for (e, w), where in near.items():
        n_ct = sum(rows[t] for t in where)
        m = n_ct / len(where)
        p = n_ct / n_t[w] if len(where) >= support else (n_ct + m * n_c[e] / n) / (n_t[w] + m)
        if math.log2(p * n / n_c[e]) >= threshold * math.log2(n / n_c[e]):
            reveal[e].add(w)
    out = []
    for t in texts:
        said = {}
        for e in entities[t or ""]:
            for w in reveal[e]:
                if not w.startswith("^"):
                    said[w] = said.get(w, True) and "^" + w[: pii.STEM] not in reveal[e]
        out.append(",".join(f"{'general' if said[m[0].lower()] else 'term'}:{m.start()}:{m.end()}" for m in regex.finditer(pii.TERM, t or "") if m[0].lower() in said))
    return out


def test_terms_equal_brute_force(spark):
    r = np.random.default_rng(8)
    names, plain = ["Quorvantha", "Zelbrookia", "drXenophanes", "Dubber", "Ölmann", "Trask", "Vintner", "Quorum", "Yeoman"], words(40, 3)
    values = ["ol@one.org", "u1@zb.org", "u2@zb.org", "10.0.0.7", "10.0.0.9", "+1 386 555 3733", "+1 386 555 9911", "4111111111111111", "jo@x.org jo@x.org"]
    texts = [*EDGE]
    for i in range(400):
        w = r.choice(plain, 30).tolist()
        if i % 4 == 0:
            k = int(r.integers(len(values)))
            w[int(r.integers(20))] = f"{names[k % len(names)] if r.random() < 0.8 else 'met'} {values[k]} {names[(k + 1) % len(names)].lower() if r.random() < 0.3 else 'and'}"
        elif i % 9 == 0:
            w[3] = "quorate"
        texts.append(" ".join(w))
    texts += texts[10:60:4] * 2  # copies are rows, but one piece of evidence
    got = {x["doc_id"]: x["s"] for x in pii.detect(frame(spark, texts)).select("doc_id", pii.written(F.col("more")).alias("s")).collect()}
    want = brute_terms(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert any("general" in x for x in want) and any("term" in x for x in want)


def test_repeated_ids_are_judged_each(spark):
    docs = frame(spark, ["write to a@b.co now", "a@b.co", None])
    again = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    rows = pii.detect(again).select("doc_id", F.size("spans").alias("n")).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(i, n) for i, n in ((0, 1), (1, 1), (2, 0)) for _ in (0, 1)] + [(None, 1), (None, 1), (None, 0)], key=str)


def test_statements_are_text():
    assert all(isinstance(x, str) for x in queries.ORACLES.values())


# Chat --------------------------------------------------------------------------
def test_round_trip_of_control_strings(spark):
    said = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "[/INST", "", None, "é😀\n\n", "<<s>>", "[INST][INST]"]
    rows = [(1, i, ("assistant" if i % 2 else "user") if i < 8 else None, t, "x") for i, t in enumerate(said)] + [(None, None, "assistant", "z", "x"), (2, 0, "<s>[INST]", "b", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(chat_format.canonical_turns(df))).collect()}
    turns = [(r or "", t or "") for _, _, r, t, _ in rows[: len(said)]]
    assert got[1]["n_turns"] == len(said)
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    learnt = "".join(t for r, t in turns if r == "assistant")
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert got[None]["n_turns"] == 1 and got[2]["n_turns"] == 1
    assert chat_format.read_back(chat_format.format_conversations(chat_format.canonical_turns(df.limit(0)))).count() == 0


def test_fingerprints_select_mappings(spark):
    records = [
        (1, '{"messages":[{"role":"human","content":"q <s>"},{"role":"assistant","content":"a"}],"x":1}', "messages", [("user", "q <s>"), ("assistant", "a")]),
        (2, '{"completion":"c","prompt":"p"}', "prompt_completion", [("user", "p"), ("assistant", "c")]),
        (3, '{"instruction":"i","input":"n","output":"o","meta":{"a":1}}', "instruction_input_output", [("user", "i"), ("user", "n"), ("assistant", "o")]),
        (4, '{"conversations":[{"from":"gpt","value":null}]}', "from_value", [("assistant", "")]),
        (5, '{"foo":1}', "unknown", None),
        (6, None, "unknown", None),
        (7, "not json", "unknown", None),
        (8, '{"messages":[]}', "messages_empty", []),
    ]
    df = spark.createDataFrame([r[:2] for r in records], "i int, r string")
    got = {r["conv_id"]: r for r in chat_format.canonical_records(df, "i", "r").collect()}
    for i, _, layout, turns in records:
        assert got[i]["layout"] == layout
        assert (got[i]["turns"] is None) == (turns is None)
        if turns is not None:
            assert [(t["role"], t["text"]) for t in got[i]["turns"]] == turns


# Toxicity ------------------------------------------------------------------------
def toxic_fixture(spark, n=600):
    texts, toxic = [], []
    for s in range(n):
        w = words(30, s)
        if s % 5 == 0:
            w[s % 30] = ("scumface", "scumhead", "scummost")[s % 3]
        texts.append(" ".join(w))
        toxic.append(int(s % 5 == 0))
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    return frame(spark, texts), labels, toxic


def test_held_out_accuracy(spark):
    docs, labels, toxic = toxic_fixture(spark)
    rows = toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == toxic[r["doc_id"]] for r in out]) > 0.98
    kept = {r["doc_id"] for r in toxicity.reject_toxic(docs, toxicity.train(docs, labels)).collect()}
    assert kept == {r["doc_id"] for r in rows if not r["predicted"]}


def test_pairs_count_beyond_single_terms():
    """Neither term is toxic alone, both together are: linear weights can't say so."""
    rng = np.random.default_rng(0)
    a, b = toxicity.slots_of("aa")[0], toxicity.slots_of("bb")[0]
    noise = [toxicity.slots_of(f"n{i}")[0] for i in range(40)]
    terms, y = [], []
    for i in range(1600):
        t = set(rng.choice(noise, 4).tolist()) | ({a} if i % 2 else set()) | ({b} if i // 2 % 2 else set())
        terms.append(np.array(sorted(t)))
        y.append(int(a in t and b in t))
    m = toxicity.fit(terms, np.array(y), 0.25, epochs=120)
    place = {int(s): k for k, s in enumerate(m.slots)}
    score = lambda *s: m.score(np.array([place[x] for x in s if x in place]))
    assert score(a, b) > 0.7 > score(a) and score(b) < 0.7


def test_exclusive_pairs_are_learnt_with_production_settings():
    """Toxic is either term without the other: each alone is as frequent in both classes, so only the pair screen can find them."""
    rng = np.random.default_rng(0)
    a, b = toxicity.slots_of("aa")[0], toxicity.slots_of("bb")[0]
    noise = [toxicity.slots_of(f"n{i}")[0] for i in range(300)]
    terms, y = [], []
    for i in range(6000):
        t = set(rng.choice(noise, 20).tolist()) | ({a} if i % 2 else set()) | ({b} if i // 2 % 2 else set())
        terms.append(np.array(sorted(t)))
        y.append(int((a in t) != (b in t)))
    m = toxicity.fit(terms, np.array(y), 0.5)
    place = {int(s): k for k, s in enumerate(m.slots)}
    score = lambda *s: m.score(np.array([place[x] for x in s], np.int64))
    assert score(a) > 0.7 < score(b) and score() < 0.3 > score(a, b)


def test_score_equals_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    m = toxicity.FactorizationMachine(-0.3, np.arange(9), rng.normal(0, 1, 9), rng.normal(0, 0.5, (9, toxicity.FACTORS)))
    for n in range(9):
        rows = rng.choice(9, n, replace=False)
        z = m.bias + sum(m.w[i] for i in rows) + sum(m.v[i] @ m.v[j] for i in rows for j in rows if i < j)
        assert abs(m.score(rows) - 1 / (1 + np.exp(-z))) < 1e-9


def test_null_and_repeated_ids_are_scored_each(spark):
    docs, labels, toxic = toxic_fixture(spark, 200)
    nulls = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    every = docs.unionByName(nulls).unionByName(docs.limit(2))
    rows = toxicity.score_documents(every, toxicity.train(every, labels.unionByName(labels.limit(9)))).collect()
    assert len(rows) == 205 and not any(r["held_out"] for r in rows if r["doc_id"] is None)
    kept = toxicity.reject_toxic(every, toxicity.train(every, labels))
    assert kept.columns == every.columns and kept.filter("doc_id is null").count() == sum(1 for r in rows if r["doc_id"] is None and not r["predicted"])


def test_labels_of_one_class_or_none(spark):
    docs = frame(spark, EDGE)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r["score"], 6) for r in toxicity.score_documents(docs, toxicity.train(docs, none)).collect()} == {0.5}
    assert toxicity.score_documents(docs.limit(0), toxicity.train(docs.limit(0), none)).count() == 0
