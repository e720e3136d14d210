"""Queries of grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cartulary.functions import text as fx
from cartulary.operators import aggregate as ag

from .catalog import query, table

_GEO = "orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"


def geo(spark, sf_dir):
    """Orders with their region; the dimension tables are of fixed size."""
    t = lambda n: table(spark, sf_dir, n)
    places = F.broadcast(t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name"))
    return t("orders").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))


@query("cond_counts_share", f"SELECT r_name, count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS finished, count(DISTINCT o_custkey) AS customers, round(count(*) FILTER (o_orderstatus = 'F') / greatest(count(*), 1), 6) AS finished_share FROM {_GEO} GROUP BY 1")
def cond_counts_share(spark, sf_dir):
    done = F.count_if(F.col("o_orderstatus") == "F")
    return geo(spark, sf_dir).groupBy("r_name").agg(F.count("*").alias("orders"), done.alias("finished"), F.countDistinct("o_custkey").alias("customers"), F.round(done / F.greatest(F.count("*"), F.lit(1)), 6).alias("finished_share"))


@query("modal_category", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c) SELECT user_id, event_type AS mode, n FROM r WHERE k = 1")
def modal_category(spark, sf_dir):
    return ag.mode_of(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query(
    "lift_vs_overall",
    """
    WITH n AS (SELECT user_id % 7 AS cohort, event_type, count(*) AS n FROM events GROUP BY 1, 2),
    s AS (SELECT *, n / sum(n) OVER (PARTITION BY cohort) AS share, sum(n) OVER (PARTITION BY event_type) / sum(n) OVER () AS overall FROM n)
    SELECT cohort, event_type, n, round(share, 6) AS share, round(overall, 6) AS overall, round(share / overall, 6) AS lift, round(share - overall, 6) AS diff FROM s
    """,
)
def lift_vs_overall(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("cohort", F.col("user_id") % 7)
    s = ag.shares(e, ["cohort"], "event_type")
    return s.select("cohort", "event_type", "n", *[F.round(c, 6).alias(c) for c in ("share", "overall", "lift", "diff")])


@query(
    "presence_grid",
    """
    WITH u AS (SELECT lang, count(DISTINCT doc_id) AS units FROM documents GROUP BY 1), c AS (SELECT DISTINCT source FROM documents),
    p AS (SELECT lang, source, count(DISTINCT doc_id) AS present FROM documents GROUP BY 1, 2)
    SELECT u.lang, c.source, coalesce(present, 0) AS present, units, round(coalesce(present, 0) / units, 6) AS rate FROM u CROSS JOIN c LEFT JOIN p ON p.lang = u.lang AND p.source = c.source
    """,
)
def presence_grid(spark, sf_dir):
    return ag.presence_rate(table(spark, sf_dir, "documents"), "lang", "doc_id", "source").withColumn("rate", F.round("rate", 6))


@query("pivot_shares", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS status_f, count(*) FILTER (l_linestatus = 'O') AS status_o, round(coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0) / sum(l_quantity), 6) AS share_f FROM lineitem GROUP BY 1")
def pivot_shares(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")).fillna(0)
    return p.select("l_returnflag", F.col("F_n").alias("status_f"), F.col("O_n").alias("status_o"), F.round(F.col("F_q") / (F.col("F_q") + F.col("O_q")), 6).alias("share_f"))


@query("eav_pivot", "SELECT user_id, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view, max(value) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def eav_pivot(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.max("value"))


@query(
    "section_norm_share",
    """
    WITH s AS (SELECT l_orderkey, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
    w AS (SELECT *, n / sum(n) OVER (PARTITION BY l_orderkey, l_returnflag) AS share FROM s)
    SELECT l_orderkey, l_linestatus, round(avg(share), 6) AS norm_share, count(*) AS sections FROM w GROUP BY 1, 2
    """,
)
def section_norm_share(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    w = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("l_orderkey", "l_returnflag")))
    return w.groupBy("l_orderkey", "l_linestatus").agg(F.round(F.avg("share"), 6).alias("norm_share"), F.count("*").alias("sections"))


@query(
    "entropy_by_group",
    """
    WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
    SELECT user_id, count(*) AS categories, round(CASE WHEN count(*) <= 1 THEN 0 ELSE -sum(p * log2(p)) / log2(count(*)) END, 6) AS entropy FROM p GROUP BY 1
    """,
)
def entropy_by_group(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.collect_list("n").alias("n"))
    total = F.aggregate("n", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return c.select("user_id", F.size("n").cast("long").alias("categories"), F.round(fx.entropy(F.transform("n", lambda x: x / total)), 6).alias("entropy"))


@query(
    "js_similarity",
    """
    WITH k AS (SELECT DISTINCT event_type FROM events), d AS (SELECT user_id % 9 AS g, event_type, count(*) AS n FROM events GROUP BY 1, 2),
    s AS (SELECT g, event_type, n / sum(n) OVER (PARTITION BY g) AS p FROM d),
    x AS (SELECT a.g AS ga, b.g AS gb, k.event_type, coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q FROM (SELECT DISTINCT g FROM s) ga CROSS JOIN (SELECT DISTINCT g FROM s) gb CROSS JOIN k
          LEFT JOIN s a ON a.g = ga.g AND a.event_type = k.event_type LEFT JOIN s b ON b.g = gb.g AND b.event_type = k.event_type WHERE ga.g < gb.g)
    SELECT ga, gb, round(1 - sum(0.5 * (CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END)) / ln(2), 6) AS similarity FROM x GROUP BY 1, 2
    """,
)
def js_similarity(spark, sf_dir):
    """Similarity of the event mixes of nine cohorts: pairs of a fixed small set."""
    e = table(spark, sf_dir, "events")
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]
    n = e.groupBy((F.col("user_id") % 9).alias("g")).pivot("event_type", kinds).count().fillna(0)
    total = sum((F.col(f"`{k}`") for k in kinds), F.lit(0))
    p = n.select("g", F.array(*[F.col(f"`{k}`") / total for k in kinds]).alias("p"))
    a, b = p.select(F.col("g").alias("ga"), F.col("p").alias("pa")), p.select(F.col("g").alias("gb"), F.col("p").alias("pb"))
    return a.join(F.broadcast(b), F.col("ga") < F.col("gb")).select("ga", "gb", F.round(fx.js_similarity(F.col("pa"), F.col("pb")), 6).alias("similarity"))


_STD = f"""
    WITH v AS (SELECT r_name, year(o_orderdate) AS y, o_totalprice AS x, CASE WHEN o_orderpriority LIKE '1%' THEN 1.0 ELSE 0.0 END AS hit FROM {_GEO}),
    w AS (SELECT y, count(*) / (SELECT count(*) FROM v) AS w FROM v GROUP BY 1),
    c AS (SELECT r_name, y, avg(x) AS m, avg(hit) AS h, count(*) AS n FROM v GROUP BY 1, 2)
"""


@query("std_mean_by_group", _STD + "SELECT r_name, round(sum(m * w) / sum(w), 2) AS adjusted, round(sum(w), 6) AS coverage, round(sum(m * n) / sum(n), 2) AS raw, CAST(sum(n) AS BIGINT) AS n FROM c JOIN w USING (y) GROUP BY 1")
def std_mean_by_group(spark, sf_dir):
    g = geo(spark, sf_dir).withColumn("y", F.year("o_orderdate"))
    s = ag.standardized_mean(g, "r_name", "y", F.col("o_totalprice"))
    return s.select("r_name", F.round("adjusted", 2).alias("adjusted"), F.round("coverage", 6).alias("coverage"), F.round("raw", 2).alias("raw"), "n")


@query("std_presence", _STD + ", o AS (SELECT avg(hit) AS o FROM v) SELECT r_name, round(sum(h * w) / sum(w), 6) AS adjusted, round(sum(h * n) / sum(n), 6) AS raw, round(sum(h * w) / sum(w) / max(o), 6) AS adjusted_lift, round(sum(h * n) / sum(n) / max(o), 6) AS raw_lift FROM c JOIN w USING (y), o GROUP BY 1")
def std_presence(spark, sf_dir):
    g = geo(spark, sf_dir).select("r_name", F.year("o_orderdate").alias("y"), F.col("o_orderpriority").startswith("1").cast("double").alias("hit"))
    s = ag.standardized_mean(g, "r_name", "y", F.col("hit"))
    o = g.agg(F.avg("hit").alias("o"))
    return s.crossJoin(F.broadcast(o)).select("r_name", F.round("adjusted", 6).alias("adjusted"), F.round("raw", 6).alias("raw"), F.round(F.col("adjusted") / F.col("o"), 6).alias("adjusted_lift"), F.round(F.col("raw") / F.col("o"), 6).alias("raw_lift"))


@query("zscore_index", "WITH z AS (SELECT p_partkey, (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS z_size, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () AS z_price FROM part) SELECT p_partkey, round(z_size, 6) AS z_size, round(z_price, 6) AS z_price, round((z_size + z_price) / 2, 6) AS overall_index FROM z")
def zscore_index(spark, sf_dir):
    z = ag.zscored(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return z.select("p_partkey", F.round("z_p_size", 6).alias("z_size"), F.round("z_p_retailprice", 6).alias("z_price"), F.round((F.col("z_p_size") + F.col("z_p_retailprice")) / 2, 6).alias("overall_index"))


@query("corr_matrix", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem")
def corr_matrix(spark, sf_dir):
    return ag.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("r", F.round("r", 6))


@query("percentile_by_year", "SELECT year(o_orderdate) AS y, count(*) AS n, round(avg(o_totalprice), 2) AS mean, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.75), 4) AS p75, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1")
def percentile_by_year(spark, sf_dir):
    p = lambda q: F.round(F.percentile("o_totalprice", q), 4)
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"), p(0.25).alias("p25"), p(0.5).alias("p50"), p(0.75).alias("p75"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))


@query("cooccurrence", "WITH s AS (SELECT DISTINCT user_id, event_type FROM events), t AS (SELECT count(DISTINCT user_id) AS units FROM s) SELECT a.event_type AS a, b.event_type AS b, count(*) AS n, round(count(*) / max(units), 6) AS share FROM s a JOIN s b USING (user_id), t GROUP BY 1, 2")
def cooccurrence(spark, sf_dir):
    return ag.cooccurrence(table(spark, sf_dir, "events"), "user_id", "event_type").withColumn("share", F.round("share", 6))


@query("concentration", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS w, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c), u AS (SELECT user_id, count(*) AS labels, max(w) FILTER (k = 1) AS top, max(w) FILTER (k = 1) - coalesce(max(w) FILTER (k = 2), 0) AS gap FROM s GROUP BY 1) SELECT median(labels) AS labels, round(median(top), 6) AS top, round(median(gap), 6) AS gap FROM u")
def concentration(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    by = Window.partitionBy("user_id")
    s = c.withColumns({"w": F.col("n") / F.sum("n").over(by), "k": F.row_number().over(by.orderBy(F.desc("n"), "event_type"))})
    first, second = F.max(F.when(F.col("k") == 1, F.col("w"))), F.max(F.when(F.col("k") == 2, F.col("w")))
    u = s.groupBy("user_id").agg(F.count("*").alias("labels"), first.alias("top"), (first - F.coalesce(second, F.lit(0.0))).alias("gap"))
    return u.agg(F.median("labels").alias("labels"), F.round(F.median("top"), 6).alias("top"), F.round(F.median("gap"), 6).alias("gap"))


@query("trimmed_trend", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders) SELECT year(o_orderdate) AS y, count(*) AS n, round(median(o_totalprice), 4) AS p50, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.75), 4) AS p75 FROM orders, q WHERE o_totalprice BETWEEN lo AND hi GROUP BY 1")
def trimmed_trend(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("y"), "o_totalprice")
    q = o.agg(F.percentile("o_totalprice", 0.01).alias("lo"), F.percentile("o_totalprice", 0.99).alias("hi"))
    kept = o.crossJoin(F.broadcast(q)).filter(F.col("o_totalprice").between(F.col("lo"), F.col("hi")))
    p = lambda x: F.round(F.percentile("o_totalprice", x), 4)
    return kept.groupBy("y").agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.25).alias("p25"), p(0.75).alias("p75"))


@query(
    "dominant_share",
    """
    WITH d AS (SELECT c.c_mktsegment AS seg, year(o_orderdate) AS y FROM orders JOIN customer c ON o_custkey = c_custkey),
    t AS (SELECT seg FROM d GROUP BY 1 ORDER BY count(*) DESC, seg LIMIT 3),
    k AS (SELECT y, CASE WHEN seg IN (SELECT seg FROM t) THEN seg ELSE 'other' END AS seg, count(*) AS n FROM d GROUP BY 1, 2)
    SELECT y, seg, n, round(n / sum(n) OVER (PARTITION BY y), 6) AS share FROM k
    """,
)
def dominant_share(spark, sf_dir):
    d = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.year("o_orderdate").cast("long").alias("y"), F.col("c_mktsegment").alias("seg")).agg(F.count("*").alias("n"))
    top = d.groupBy("seg").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "seg").limit(3).select("seg", F.lit(True).alias("top"))
    k = d.join(F.broadcast(top), "seg", "left").groupBy("y", F.when(F.col("top"), F.col("seg")).otherwise("other").alias("seg")).agg(F.sum("n").alias("n"))
    return k.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("y")), 6))


@query("tri_state_share", "WITH s AS (SELECT source, lang, bool_or(quality = 1) AS y, bool_or(quality = 0) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2), k AS (SELECT source, CASE WHEN y AND NOT n THEN 1 WHEN n AND NOT y THEN 0 END AS v FROM s) SELECT source, count(v) AS resolved, round(avg(v), 6) AS share FROM k GROUP BY 1")
def tri_state_share(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    s = j.groupBy("source", "lang").agg(ag.three_states(F.col("quality") == 1, F.col("quality") == 0).alias("v"))
    return s.groupBy("source").agg(F.count("v").alias("resolved"), F.round(F.avg("v"), 6).alias("share"))


@query("coverage_gap", "SELECT source, count(*) AS docs, count(l.doc_id) AS labelled, round(count(l.doc_id) / count(*), 6) AS coverage, round(1 - count(l.doc_id) / count(*), 6) AS gap FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def coverage_gap(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("known"))
    j = table(spark, sf_dir, "documents").select("doc_id", "source").join(l, "doc_id", "left")
    share = F.count("known") / F.count("*")
    return j.groupBy("source").agg(F.count("*").alias("docs"), F.count("known").alias("labelled"), F.round(share, 6).alias("coverage"), F.round(1 - share, 6).alias("gap"))


@query("crosstab_bins", "WITH b AS (SELECT coalesce(quality, -1) AS quality, CASE WHEN n_chars < 200 THEN 0 WHEN n_chars < 1000 THEN 1 WHEN n_chars < 3000 THEN 2 WHEN n_chars <= 1000000 THEN 3 END AS bin FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT quality, count(*) FILTER (bin = 0) AS b0, count(*) FILTER (bin = 1) AS b1, count(*) FILTER (bin = 2) AS b2, count(*) FILTER (bin = 3) AS b3, count(*) FILTER (bin IS NULL) AS b_null FROM b GROUP BY 1")
def crosstab_bins(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    b = j.select(F.coalesce("quality", F.lit(-1)).alias("quality"), fx.histogram_bin(F.col("n_chars"), [0, 200, 1000, 3000, 1000000]).alias("bin"))
    return b.groupBy("quality").agg(*[F.count_if(F.col("bin") == k).alias(f"b{k}") for k in range(4)], F.count_if(F.col("bin").isNull()).alias("b_null"))


@query("confusion_metrics", "WITH p AS (SELECT toxic = 1 AS t, contains(lower(text), 'scum') OR contains(lower(text), 'idiot') AS s FROM documents JOIN labels USING (doc_id)), c AS (SELECT count(*) FILTER (t AND s) AS tp, count(*) FILTER (NOT t AND s) AS fp, count(*) FILTER (t AND NOT s) AS fn, count(*) FILTER (NOT t AND NOT s) AS tn FROM p) SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c")
def confusion_metrics(spark, sf_dir):
    t = F.lower("text")
    p = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select((F.col("toxic") == 1).alias("t"), (F.contains(t, F.lit("scum")) | F.contains(t, F.lit("idiot"))).alias("s"))
    out = p.agg(*ag.precision_recall(F.col("t"), F.col("s")))
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "topk_columns_other",
    """
    WITH n AS (SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY 1),
    e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, k, user_id, value FROM events JOIN n USING (event_type))
    SELECT day, count(*) FILTER (k = 1) AS top1, count(*) FILTER (k = 2) AS top2, count(*) FILTER (k > 2) AS other, count(DISTINCT user_id) AS users_n, round(sum(value), 4) AS weight,
           (SELECT string_agg(event_type, '|' ORDER BY k) FROM n WHERE k <= 2) AS top_names FROM e GROUP BY 1
    """,
)
def topk_columns_other(spark, sf_dir):
    """Counts by day of the two commonest types, in columns of their own, and of all others."""
    e = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "user_id", "value")
    counts, names = ag.topk_columns(e, "day", "event_type", 2)
    more = e.groupBy("day").agg(F.countDistinct("user_id").alias("users_n"), F.round(F.sum("value"), 4).alias("weight"))
    return counts.join(more, "day").withColumn("top_names", F.lit("|".join(names)))
