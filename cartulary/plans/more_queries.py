"""Queries of the remaining grouped, matched and reviewed measures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cartulary.functions import text as fx
from cartulary.operators import embed, model, panel

from .catalog import query, table


@query("weights_normalised", "SELECT event_id, user_id, round(CASE WHEN sum(value) OVER (PARTITION BY user_id) > 0 THEN value / sum(value) OVER (PARTITION BY user_id) ELSE 1.0 / count(*) OVER (PARTITION BY user_id) END, 9) AS weight FROM events")
def weights_normalised(spark, sf_dir):
    by = Window.partitionBy("user_id")
    total = F.sum("value").over(by)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.when(total > 0, F.col("value") / total).otherwise(1 / F.count("*").over(by)), 9).alias("weight"))


@query("coherence_share", "WITH m AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY sum(l_quantity) DESC, l_returnflag) AS k FROM lineitem GROUP BY 1, 2) SELECT l.l_orderkey, m.l_returnflag AS motive, round(sum(l_quantity) FILTER (l.l_returnflag = m.l_returnflag) / sum(l_quantity), 6) AS coherence FROM lineitem l JOIN m ON l.l_orderkey = m.l_orderkey AND k = 1 GROUP BY 1, 2")
def coherence_share(spark, sf_dir):
    """Share of an order's quantity in its heaviest category: one shuffle by order."""
    q = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    top = F.min(F.struct((-F.col("q")).alias("m"), "l_returnflag"))
    return q.groupBy("l_orderkey").agg(top.alias("t"), F.sum("q").alias("total")).select("l_orderkey", F.col("t.l_returnflag").alias("motive"), F.round(-F.col("t.m") / F.col("total"), 6).alias("coherence"))


@query("quality_gates", "SELECT source, count(*) AS reviewed, round(avg(quality), 6) AS acceptance, avg(quality) >= 0.85 AS passes FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def quality_gates(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return j.groupBy("source").agg(F.count("*").alias("reviewed"), F.round(F.avg("quality"), 6).alias("acceptance"), (F.avg("quality") >= 0.85).alias("passes"))


@query("agreement_rates", "SELECT lang, round(avg(CASE WHEN (n_chars > 500) = (quality = 1) THEN 1.0 ELSE 0.0 END), 6) AS agreement, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def agreement_rates(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return j.groupBy("lang").agg(F.round(F.avg(((F.col("n_chars") > 500) == (F.col("quality") == 1)).cast("double")), 6).alias("agreement"), F.count("*").alias("n"))


@query("aggregate_policies", "SELECT user_id, arg_max(event_type, value * 1e9 - event_id) AS best_confidence, round(median(value), 6) AS median_value FROM events GROUP BY 1")
def aggregate_policies(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.col("value") * 1e9 - F.col("event_id")).alias("best_confidence"), F.round(F.median("value"), 6).alias("median_value"))


@query("terciles", "WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_orderkey, CASE WHEN n <= 1 OR (i - 1) / (n - 1) <= 1.0 / 3 THEN 'early' WHEN (i - 1) / (n - 1) >= 2.0 / 3 THEN 'late' ELSE 'middle' END AS tercile FROM r")
def terciles(spark, sf_dir):
    by = Window.partitionBy("o_custkey")
    p = fx.position(F.row_number().over(by.orderBy("o_orderdate", "o_orderkey")), F.count("*").over(by))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(p <= 1 / 3, "early").when(p >= 2 / 3, "late").otherwise("middle").alias("tercile"))


@query("geo_mismatch", "SELECT n_name, count(*) AS pairs, count(*) FILTER (s_nationkey = c_nationkey) AS matches, round(count(*) FILTER (s_nationkey = c_nationkey) / count(*), 6) AS match_share FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def geo_mismatch(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    o = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    l = t("lineitem").select("l_orderkey", "l_suppkey").join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    same = (F.col("s_nationkey") == F.col("c_nationkey")).cast("long")
    n = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("c_nationkey").agg(F.count("*").alias("pairs"), F.sum(same).alias("matches"))
    return n.join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("pairs").alias("pairs"), F.sum("matches").alias("matches")).withColumn("match_share", F.round(F.col("matches") / F.col("pairs"), 6))


@query("neighbour_lift", "WITH u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.vec_id AS item, a.label AS la, b.label AS lb, b.vec_id AS nb, round(list_cosine_similarity(a.v, b.v), 12) AS sim FROM u a JOIN u b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY sim DESC, nb) AS k FROM s), g AS (SELECT la AS label, avg(CASE WHEN la = lb THEN 1.0 ELSE 0.0 END) AS same FROM r WHERE k <= 5 GROUP BY 1), b AS (SELECT label, count(*) / sum(count(*)) OVER () AS base FROM u GROUP BY 1) SELECT label, round(same, 6) AS same_share, round(same / base, 6) AS lift FROM g JOIN b USING (label)")
def neighbour_lift(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    n = embed.neighbours(e, "vec_id", "embedding", 5).select("item", "neighbour")
    l = e.select("vec_id", "label")
    j = n.join(l.withColumnsRenamed({"vec_id": "item"}), "item").join(l.withColumnsRenamed({"vec_id": "neighbour", "label": "other"}), "neighbour")
    same = j.groupBy("label").agg(F.avg((F.col("label") == F.col("other")).cast("double")).alias("same"))
    base = l.groupBy("label").agg(F.count("*").alias("n")).withColumn("base", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return same.join(base, "label").select("label", F.round("same", 6).alias("same_share"), F.round(F.col("same") / F.col("base"), 6).alias("lift"))


@query("residual_cases", "WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem), e AS (SELECT l_orderkey, l_linenumber, round(l_extendedprice - (a + b * l_quantity), 3) AS residual FROM lineitem, m), r AS (SELECT *, row_number() OVER (ORDER BY residual DESC, l_orderkey, l_linenumber) AS hi, row_number() OVER (ORDER BY residual, l_orderkey, l_linenumber) AS lo FROM e) SELECT l_orderkey, l_linenumber, round(residual, 2) AS residual FROM r WHERE hi <= 15 OR lo <= 15")
def residual_cases(spark, sf_dir):
    """The 15 highest and lowest residuals of a fitted model."""
    l = table(spark, sf_dir, "lineitem")
    m = {r["term"]: r["estimate"] for r in model.ols_hc1(l, F.col("l_extendedprice"), {"q": F.col("l_quantity")}).collect()}
    e = l.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") - (m["intercept"] + m["q"] * F.col("l_quantity")), 3).alias("residual"))
    keys = ["l_orderkey", "l_linenumber"]
    both = e.orderBy(F.desc("residual"), *keys).limit(15).union(e.orderBy("residual", *keys).limit(15)).distinct()
    return both.withColumn("residual", F.round("residual", 2))


@query("topic_shares_p50_p90", "WITH m AS (SELECT CAST(ts AS DATE) AS d, user_id % 5 AS region, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3), s AS (SELECT *, n / sum(n) OVER (PARTITION BY d, region) AS share FROM m) SELECT region, event_type, round(quantile_cont(share, 0.5), 6) AS p50, round(quantile_cont(share, 0.9), 6) AS p90, count(*) AS days FROM s GROUP BY 1, 2")
def topic_shares_p50_p90(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d"), (F.col("user_id") % 5).alias("region"), "event_type").agg(F.count("*").alias("n"))
    s = m.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("d", "region")))
    return s.groupBy("region", "event_type").agg(F.round(F.percentile("share", 0.5), 6).alias("p50"), F.round(F.percentile("share", 0.9), 6).alias("p90"), F.count("*").alias("days"))


@query("best_overlap", "WITH t AS (SELECT label, vec_id % 8 AS other, count(*) AS n FROM embeddings GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, other) AS k FROM t) SELECT label, other AS matched, n FROM r WHERE k = 1")
def best_overlap(spark, sf_dir):
    from cartulary.operators.aggregate import mode_of

    e = table(spark, sf_dir, "embeddings").withColumn("other", F.col("vec_id") % 8)
    return mode_of(e, ["label"], "other").withColumnRenamed("mode", "matched")


@query("feature_difference_labels", "WITH g AS (SELECT o_orderstatus AS cluster, avg(o_totalprice) AS price, avg(CASE WHEN o_orderpriority LIKE '1%' THEN 1.0 ELSE 0.0 END) AS urgent, avg(year(o_orderdate)) AS y FROM orders GROUP BY 1), a AS (SELECT avg(o_totalprice) AS price, avg(CASE WHEN o_orderpriority LIKE '1%' THEN 1.0 ELSE 0.0 END) AS urgent, avg(year(o_orderdate)) AS y FROM orders), d AS (SELECT cluster, 'price' AS feature, g.price / a.price - 1 AS diff FROM g, a UNION ALL SELECT cluster, 'urgent', g.urgent / a.urgent - 1 FROM g, a UNION ALL SELECT cluster, 'y', g.y / a.y - 1 FROM g, a), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(abs(diff), 9) DESC, feature) AS k FROM d) SELECT cluster, feature, round(diff, 6) AS diff, CAST(k AS INTEGER) AS place FROM r WHERE k <= 2")
def feature_difference_labels(spark, sf_dir):
    """The features that set a cluster apart from the whole: unpivoted relative differences, two each."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("cluster"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").startswith("1").cast("double").alias("urgent"), F.year("o_orderdate").cast("double").alias("y"))
    names = ["price", "urgent", "y"]
    g = o.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in names]).unpivot(["cluster"], names, "feature", "own")
    a = o.agg(*[F.avg(c).alias(c) for c in names]).unpivot([], names, "feature", "whole")
    d = g.join(F.broadcast(a), "feature").select("cluster", "feature", (F.col("own") / F.col("whole") - 1).alias("diff"))
    return panel.top_k(d, ["cluster"], [F.round(F.abs("diff"), 9).desc(), F.asc("feature")], 2).withColumn("diff", F.round("diff", 6))


@query("centroid_global_outliers", "WITH u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), l AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u), c AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(x) AS m FROM l GROUP BY 1)), s AS (SELECT vec_id, label, round(list_cosine_similarity(v, c), 9) AS sim FROM u, c) SELECT vec_id, label, round(sim, 6) AS sim FROM s ORDER BY s.sim, vec_id LIMIT 20")
def centroid_global_outliers(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("all", F.lit(1))
    c = embed.centroids(e, "all", "embedding").select("centroid")
    s = e.crossJoin(F.broadcast(c)).select("vec_id", "label", F.round(fx.cosine(F.col("embedding"), F.col("centroid")), 9).alias("sim"))
    return s.orderBy("sim", "vec_id").limit(20).withColumn("sim", F.round("sim", 6))


@query(
    "candidate_scores",
    """
    WITH s AS (SELECT c_custkey, s_suppkey, CASE WHEN right(c_name, 3) = right(s_name, 3) THEN 100 ELSE 0 END + CASE WHEN right(c_name, 2) = right(s_name, 2) THEN 40 WHEN contains(s_name, right(c_name, 2)) THEN 20 ELSE 0 END
                    + CASE WHEN c_custkey % 3 = s_suppkey % 3 THEN 20 ELSE 0 END + 10 AS score FROM customer JOIN supplier ON c_nationkey = s_nationkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, s_suppkey) AS k FROM s) SELECT c_custkey, s_suppkey, CAST(score AS INTEGER) AS score FROM r WHERE k = 1
    """,
)
def candidate_scores(spark, sf_dir):
    """The best candidate of the same state: slug 100, title 40 or (contained) 20, city 20, state 10."""
    from cartulary.operators.join import best_candidates

    third = (F.col("c_custkey") % 3, F.col("s_suppkey") % 3)
    return best_candidates(table(spark, sf_dir, "customer"), "c_custkey", "c_name", table(spark, sf_dir, "supplier"), "s_suppkey", "s_name", ("c_nationkey", "s_nationkey"), third)



@query("priority_tiers", "WITH g AS (SELECT l_orderkey, max(l_linenumber) AS hi, count(*) AS n FROM lineitem WHERE (l_orderkey + l_linenumber) % 4 <> 0 GROUP BY 1) SELECT l_orderkey, hi - n AS missing, CASE WHEN hi - n = 0 THEN 'P3' WHEN hi - n = 1 THEN 'P2' WHEN n >= 3 THEN 'P1' ELSE 'P0' END AS tier FROM g")
def priority_tiers(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").filter("(l_orderkey + l_linenumber) % 4 <> 0").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("hi"), F.count("*").alias("n"))
    gap = F.col("hi") - F.col("n")
    return g.select("l_orderkey", gap.alias("missing"), F.when(gap == 0, "P3").when(gap == 1, "P2").when(F.col("n") >= 3, "P1").otherwise("P0").alias("tier"))


@query("mapping_order_problems", "WITH t AS (SELECT conv_id, turn, role, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS br FROM conversations) SELECT conv_id, CAST(coalesce(sum(CASE WHEN turn <> b + 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS gaps, CAST(coalesce(sum(CASE WHEN role = br THEN 1 ELSE 0 END), 0) AS BIGINT) AS repeated_roles FROM t GROUP BY 1")
def mapping_order_problems(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("turn").over(w).alias("b"), F.lag("role").over(w).alias("br"))
    return t.groupBy("conv_id").agg(F.count_if(F.col("turn") != F.col("b") + 1).alias("gaps"), F.count_if(F.col("role") == F.col("br")).alias("repeated_roles"))


@query("survey_counts", "SELECT count(*) AS docs, count(DISTINCT text) AS texts, count(DISTINCT source) AS sources, round(avg(n_chars), 4) AS mean_chars, median(n_chars) AS median_chars, count(*) FILTER (n_chars < 200) AS short_docs, count(*) FILTER (text LIKE '%' || chr(10) || '%') AS with_lines FROM documents")
def survey_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "n_chars", "text")
    return d.agg(F.count("*").alias("docs"), F.countDistinct("text").alias("texts"), F.countDistinct("source").alias("sources"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.median("n_chars").alias("median_chars"), F.count_if(F.col("n_chars") < 200).alias("short_docs"), F.count_if(F.contains("text", F.lit("\n"))).alias("with_lines"))


@query("unpivot_measures", "SELECT p_partkey, 'p_size' AS measure, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def unpivot_measures(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return p.unpivot(["p_partkey"], ["p_size", "p_retailprice"], "measure", "value")


@query("share_crosstab", "WITH n AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_orderstatus, o_orderpriority, n, round(n / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS row_share, round(n / sum(n) OVER (PARTITION BY o_orderpriority), 6) AS column_share FROM n")
def share_crosstab(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    share = lambda c: F.round(F.col("n") / F.sum("n").over(Window.partitionBy(c)), 6)
    return n.select("*", share("o_orderstatus").alias("row_share"), share("o_orderpriority").alias("column_share"))


@query("breadth_proxy", "SELECT l_orderkey, CAST(count(*) FILTER (l_discount > 0) > 0 AS INTEGER) + CAST(count(*) FILTER (l_tax > 0) > 0 AS INTEGER) + CAST(count(*) FILTER (l_returnflag = 'R') > 0 AS INTEGER) AS active, round(CAST(count(*) FILTER (l_discount > 0) > 0 AS INTEGER) + CAST(count(*) FILTER (l_tax > 0) > 0 AS INTEGER) + CAST(count(*) FILTER (l_returnflag = 'R') > 0 AS INTEGER) + 0.75 * ln(1 + sum(l_quantity)), 6) AS breadth FROM lineitem GROUP BY 1")
def breadth_proxy(spark, sf_dir):
    flag = lambda c: F.max(c.cast("int"))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((flag(F.col("l_discount") > 0) + flag(F.col("l_tax") > 0) + flag(F.col("l_returnflag") == "R")).alias("active"), F.sum("l_quantity").alias("q"))
    return g.select("l_orderkey", "active", F.round(F.col("active") + 0.75 * F.log1p("q"), 6).alias("breadth"))


@query("tfidf_norms")
def tfidf_norms(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    t = model.tfidf(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return t.select("doc_id", F.sqrt(F.aggregate(vector_to_array("features"), F.lit(0.0), lambda s, x: s + x * x)).alias("norm"))
