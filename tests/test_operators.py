import numpy as np
import pytest
from pyspark.sql import functions as F

from cartulary.functions import text as fx
from cartulary.operators import aggregate, dedup, embed, graph, join, model, panel, requests, segment
from cartulary.sources import readers, writers
from cartulary.streaming import windows


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (fx.clean_str, "  NaN ", ""),
        (fx.clean_str, None, ""),
        (fx.slugify, " --Old  Mill & Co.-- ", "old-mill-co"),
        (fx.slugify, "null", "unknown"),
        (fx.normalize_place, "The City of Village of Elm Grove Township, ", "Elm Grove"),
        (fx.normalize_place, "town of of Park & Hill city", "Park and Hill"),
        (fx.region_of_state, " OH ", "midwest"),
        (fx.region_of_state, "zz", "unknown"),
        (fx.collapse, " a \t b\r\n\r\n\r\n\r\nc ", "a b\n\nc"),
        (fx.fingerprint_text, "It’s  “A-1”!\nB", "it s a 1 b"),
        (fx.title_line, "\n  \n Head \nx", "Head"),
        (fx.to_float, "6,000", 0.0),
        (fx.parse_number, "6,000", 6000.0),
        (lambda c: fx.zero_filled_id(c, 5), "12.0", "00012"),
        (fx.syllables, "table", 2),
        (fx.syllables, "make", 1),
        (fx.modality, "No building shall be built", "must_not"),
        (fx.modality, "The owner shall build", "must"),
        (fx.word_count, "", 0),
        (fx.line_count, "a\nb\n", 3),
        (fx.lenient_object, '```json\n{"a": [1,2,],}\n```', '{"a": [1,2]}'),
        (fx.display_name, "old-mill", "Old Mill"),
    ],
)
def test_scalars(spark, f, value, want):
    assert one(spark, value, f) == want


def test_place_names_are_a_fixpoint(spark):
    once = one(spark, "County of the City of X County Borough", fx.normalize_place)
    assert one(spark, once, fx.normalize_place) == once


def test_motives_and_roles(spark):
    top = one(spark, "to protect health and safety from fire; tax", fx.motives)
    assert (top[0]["motive"], -top[0]["minus"]) == ("public_health_safety", 3)
    assert one(spark, "nothing", fx.motives)[0]["motive"] == "unclear"
    found = one(spark, "minimum lot area 6,000 sq. ft. and height 35 feet", fx.numbers_found)
    assert {(n["feature"], n["raw"]) for n in found} >= {("minimum_lot_area", "6,000"), ("height_limit", "35")}


def test_entropy_bins_and_vectors(spark):
    assert one(spark, [0.5, 0.5], fx.entropy, "array<double>") == pytest.approx(1)
    assert one(spark, [1.0, 0.0], fx.entropy, "array<double>") == 0
    b = lambda c: fx.histogram_bin(c, [0, 5, 15, 100], 0, 100)
    assert [one(spark, v, b, "double") for v in (0.0, 5.0, 100.0, 150.0, -3.0)] == [0, 1, 2, 2, 0]
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert df.select(fx.cosine(F.col("a"), F.col("b")).alias("c")).first()["c"] == pytest.approx(2**-0.5)


def test_sections_cover_every_line_once(spark):
    text = "Title Of Code\n\nSECTION 1. Purpose\nThe purpose is health.\n\nARTICLE II\nSigns shall not be lit; see map.\nEND NOTE\n\nlast"
    got = segment.sections(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).filter("doc_id = 1").orderBy("section_index").collect()
    assert [(r["start_line"], r["end_line"]) for r in got][0][0] == 1
    assert all(a["end_line"] + 1 == b["start_line"] for a, b in zip(got, got[1:], strict=False))
    assert got[-1]["end_line"] == len(text.split("\n"))
    assert [r["section_kind"] for r in got if r["heading"].startswith("SECTION")] == ["purpose"]


def test_clauses_and_chunks(spark):
    c = one(spark, "1. The owner shall keep the lot clean.\nand dry.\n2. No sign may be placed here at all.\n3. short", lambda x: segment.clauses(x))
    assert c == ["The owner shall keep the lot clean. and dry.", "No sign may be placed here at all."]
    text = "\n\n".join(["a" * 30, "b" * 30, "c" * 150, "d"])
    chunks = one(spark, text, lambda x: segment.packed_chunks(x, 70))
    assert all(len(x) <= 70 for x in chunks)
    assert "".join(chunks).replace("\n", "") == text.replace("\n", "")


def test_spec_problems(spark):
    df = spark.createDataFrame([("a", 1, 3, 9), ("a", 4, 9, 9), ("b", 2, 3, 9), ("b", 5, 8, 9)], "k string, s int, e int, last int")
    got = {r["k"]: r for r in segment.spec_problems(df, "k", "s", "e", "last").collect()}
    assert (got["a"]["gaps"], got["a"]["bad_start"], got["a"]["bad_end"]) == (0, False, False)
    assert (got["b"]["gaps"], got["b"]["bad_start"], got["b"]["bad_end"]) == (1, True, True)


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    got = dict(graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert {got[i] for i in range(61)} == {0} and {got[1000 + i] for i in range(200)} == {1000}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_groups_modes(spark):
    base = "the board shall hear each appeal within thirty days of notice given to the owner " * 3
    rows = [(1, "x", base, 40), (2, "x", base.replace("thirty", "thirtt", 1), 40), (3, "x", "other words entirely " * 12, 40), (4, "y", base, 40)]
    df = spark.createDataFrame(rows, "id long, block string, t string, n long")
    for mode, least in (("compat", 0.985), ("robust", 0.8)):
        got = {r["id"]: r["group"] for r in dedup.near_groups(df, "id", ["block"], "n", "t", least, mode).collect()}
        assert got == {1: 1, 2: 1, 3: 3, 4: 4}, mode


def test_standardised_mean_equals_raw_when_mixes_match(spark):
    df = spark.createDataFrame([(g, s, float(s + (g == "a"))) for g in "ab" for s in (1, 2, 2)], "g string, s int, v double")
    for r in aggregate.standardized_mean(df, "g", "s", F.col("v")).collect():
        assert r["adjusted"] == pytest.approx(r["raw"]) and r["coverage"] == pytest.approx(1)


def test_quartiles_match_linear_edges(spark):
    for n in (1, 2, 5, 10, 13):
        got = [r["quartile"] for r in panel.rank_quartile(spark.range(n).withColumn("g", F.lit(1)), ["g"], [F.asc("id")]).orderBy("id").collect()]
        edges = np.quantile(np.arange(1, n + 1), [0.25, 0.5, 0.75])
        assert got == [1 + int((edges < i).sum()) for i in range(1, n + 1)]


def test_batches_number_rows_globally(spark):
    got = panel.batches(spark.range(103).select((103 - F.col("id")).alias("x")), [F.asc("x")], 10, parts=7).orderBy("x").collect()
    assert [(r["batch"], r["place"]) for r in got] == [(i // 10, i % 10) for i in range(103)]


def test_best_prior_statuses(spark):
    rows = [("k", 1, "2020-01-01", "a"), ("k", 2, "2020-02-01", "b"), ("k", 3, "2020-03-01", "a"), ("k", 4, "2023-01-01", "a"), ("k", 5, "2020-03-01", "a")]
    df = spark.createDataFrame(rows, "k string, i long, d string, r string")
    got = {r["i"]: (r["prior"], r["status"]) for r in join.best_prior(df, ["k"], "i", "d", "r", 365).collect()}
    assert got == {1: (None, "no_prior"), 2: (1, "matched"), 3: (1, "matched"), 4: (None, "outside_window"), 5: (1, "matched")}


def test_ols_hc1_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x, g = rng.normal(size=300), rng.integers(0, 3, 300)
    y = 1 + 2 * x + 0.5 * (g == 1) - (g == 2) + rng.normal(size=300) * (1 + np.abs(x))
    df = spark.createDataFrame([(float(a), str(b), float(c)) for a, b, c in zip(x, g, y, strict=True)], "x double, g string, y double")
    got = {r["term"]: r for r in model.ols_hc1(df, F.col("y"), {"x": F.col("x")}, {"g": F.col("g")}).collect()}
    m = np.c_[np.ones(300), x, g == 1, g == 2].astype(float)
    inv = np.linalg.inv(m.T @ m)
    b = inv @ m.T @ y
    e = y - m @ b
    se = np.sqrt(np.diag(inv @ (m.T * e**2) @ m @ inv) * 300 / 296)
    for k, t in enumerate(("intercept", "x", "g[1]", "g[2]")):
        assert got[t]["estimate"] == pytest.approx(b[k]) and got[t]["std_error"] == pytest.approx(se[k])


def test_models_and_clusters(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=4) * 0.05 + np.eye(4)[i % 3] * 3).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    sweep = model.kmeans_sweep(df, "id", "v", [2, 3, 5], restarts=2).collect()
    assert [r["k"] for r in sweep if r["recommended"]] == [3]
    for labels in (embed.cluster_hierarchical(df, "id", "v", 0.5), embed.density_clusters(df, "id", "v", 5, 3, 0.2)):
        groups = {}
        for r in labels.collect():
            groups.setdefault(r["id"] % 3, set()).add(r["cluster"])
        assert all(len(s) == 1 for s in groups.values()) and len(set().union(*groups.values())) == 3
    same = df.select((F.col("id") % 3).alias("a"), (F.col("id") % 3 + 7).alias("b"))
    assert model.adjusted_rand(same, "a", "b").first()["ari"] == pytest.approx(1)
    coords = np.array([r["coords"] for r in model.pca(df, "id", "v", 2).orderBy("id").collect()])
    x = np.array([v for _, v in rows])
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert np.allclose(np.linalg.norm(coords, axis=0), s[:2])


def test_tfidf_is_normalised(spark):
    df = spark.createDataFrame([(1, "zoning map map"), (2, "zoning board"), (3, "")], "id long, t string")
    got = {r["id"]: r["features"].toArray() for r in model.tfidf(df, "id", "t", 50).collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1) and np.linalg.norm(got[3]) == 0


def test_weighted_documents_need_complete_segments(spark):
    rows = [("a", 0, 2, 1.0, [1.0, 0.0]), ("a", 1, 2, 3.0, [0.0, 1.0]), ("b", 1, 2, 1.0, [1.0, 1.0])]
    got = embed.weighted_documents(spark.createDataFrame(rows, "d string, i int, n int, c double, v array<double>"), "d", "i", "n", "c", "v").collect()
    assert [(r["d"], r["centroid"]) for r in got] == [("a", [0.25, 0.75])]


def test_shards_keep_rows_and_budgets(spark):
    df = spark.range(500).select("id", (F.col("id") % 17 * 10).alias("bytes"))
    got = requests.shard_by_budget(df, "id", "bytes", 30, 1000).join(df, "id")
    assert got.count() == 500
    for r in got.groupBy("shard").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).collect():
        assert r["n"] <= 30 and r["b"] <= 1000


def test_requests_round_trip(spark):
    items = spark.range(5).withColumnRenamed("id", "item")
    req = requests.build_requests(items, "motive", "item", F.concat(F.lit("text "), F.col("item")), "m")
    mapping = req.select("item", "custom_id")
    said = [("motive::0", 1, '{"motive":"a","confidence":0.5}'), ("motive::0", 2, 'fine:\n```json\n{"motive":"b","confidence":0.5,}\n```'), ("motive::1", 3, ""), ("motive::2", 4, "no json"), ("motive::3", 5, '{"motive":"c","confidence":7')]
    res = spark.createDataFrame(said, "custom_id string, line int, text string")
    got = {r["item"]: r for r in requests.rehydrate(mapping, res, "struct<motive:string,confidence:double>", {"bad_confidence": "payload.confidence between 0 and 1"}).collect()}
    assert [got[i]["reason"] for i in range(5)] == ["ok", "empty", "unparsable", "bad_confidence", "missing"]
    assert got[0]["payload"]["motive"] == "b"
    left = requests.unresolved(mapping, res.filter("line < 3").select("custom_id").distinct(), res.limit(0)).collect()
    assert {r["item"] for r in left} == {1, 2, 3, 4}


def test_plans():
    assert requests.assign_longest_first({"a": 5, "b": 4, "c": 3, "d": 3}, 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    q = requests.proportional_quota({"x": 10, "y": 5, "z": 1}, 8)
    assert sum(q.values()) == 8 and all(q[k] <= n for k, n in {"x": 10, "y": 5, "z": 1}.items())


def test_sources(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n\n[1]\nnot json\n{"a": 2}\n')
    assert [tuple(r) for r in readers.read_jsonl(spark, str(p), "a int, b string").orderBy("a").collect() if r["a"]] == [(1, "x"), (2, None)]
    q = tmp_path / "ids.csv"
    q.write_text("id\n 7 \nnan\n7\n8\n")
    assert sorted(r["id"] for r in readers.read_filter_list(spark, str(q), "id").collect()) == ["7", "8"]
    page = one(spark, "daily-sun-mar-05-1931-p-12", readers.parse_page_id)
    assert (page["slug"], str(page["date"]), page["issue_id"], page["page_num"]) == ("daily-sun", "1931-03-05", "daily-sun__1931-03-05", 12)
    assert one(spark, "daily-sun-xxx-05-1931-p-12", readers.parse_page_id) is None
    boxes = [("b10", "ok", "second"), ("b2", "ok", " first "), ("b3", "error", "x"), ("b4", "ok", " ")]
    assert one(spark, boxes, readers.boxes_to_text, "array<struct<id:string,status:string,text:string>>") == "first\n\nsecond"
    assert one(spark, "SOURCE: s\nTEXT: a\nb\nNOTES: n", readers.parse_contract)["contract_ok"]
    pages = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "page_id string")
    a, b = spark.createDataFrame([("p1", "A"), ("p2", " ")], "page_id string, text string"), spark.createDataFrame([("p2", "B")], "page_id string, text string")
    assert [r["text_source"] for r in readers.best_text(pages, [("a", a), ("b", b)]).orderBy("page_id").collect()] == ["a", "b", "missing"]
    with pytest.raises(Exception, match="no details"):
        readers.join_bundle(pages, a, "page_id").collect()


def test_sinks(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") % 2).alias("shard"), F.to_json(F.struct("id")).alias("line"))
    writers.write_shards(df, "shard", "line", str(tmp_path / "s"), "id")
    back = spark.read.text(str(tmp_path / "s"))
    assert sorted(r["value"] for r in back.collect()) == sorted(r["line"] for r in df.collect())
    assert '"n": 10' in writers.summary(df.agg(F.count("*").alias("n")))
    writers.write_packet(df.select("id", "line"), "id", str(tmp_path / "packet"), ["verdict"])
    assert spark.read.json(str(tmp_path / "packet/index")).count() == 10
    with pytest.raises(ValueError, match="packet"):
        writers.write_packet(df.select("id", "line"), "id", str(tmp_path / "p2"), ["v"], max_items=5)


def test_stream_equals_batch(spark, sf, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf}/events.parquet", tmp_path / "in/a.parquet")
    batch = spark.read.parquet(f"{sf}/events.parquet")
    stream = windows.read_events(spark, str(tmp_path / "in"), batch.schema)
    q = windows.windowed(stream, "1 day", late="10 days").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda rows: sorted((r["start"], r["n"], round(r["v"], 6)) for r in rows)
    assert key(spark.table("w").collect()) == key(windows.windowed(batch, "1 day").collect())
    assert windows.once_per_id(batch.unionByName(batch), "event_id", "ts", "1 day").count() == batch.count()
    assert windows.latest_state(batch, "user_id", ["ts", "event_id"]).count() == batch.select("user_id").distinct().count()


def test_intervals_spread_a_hot_key(spark):
    rows = spark.range(2000).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") * 3).cast("int")).alias("d"))
    assert join.interval_pairs(rows, "k", "i", F.col("d"), 9).count() == sum(min(3, 1999 - i) for i in range(2000))
