"""Queries of complexity, preferences, roll-ups, overrides, fuzzy matches, checked unions, samples and filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cartulary.functions import text as fx
from cartulary.operators import aggregate, join as jn, model, panel

from .catalog import query, table


@query(
    "instrument_complexity",
    """
    WITH n AS (SELECT l_orderkey, l_returnflag AS c, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey) AS total, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, c) AS k FROM n)
    SELECT l_orderkey, CAST(count(*) AS INTEGER) AS "distinct", round(CASE WHEN count(*) <= 1 THEN 0 ELSE -sum(n / total * log2(n / total)) / log2(count(*)) END, 8) AS entropy, max(CASE WHEN k = 1 THEN c END) AS top, round(max(n / total), 8) AS top_share, CAST(max(total) AS BIGINT) AS n FROM t GROUP BY 1
    """,
)
def instrument_complexity(spark, sf_dir):
    c = aggregate.complexity(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")
    return c.withColumns({"entropy": F.round("entropy", 8), "top_share": F.round("top_share", 8)})


@query(
    "preferred_mode",
    """
    WITH n AS (SELECT o_custkey, lower(o_orderpriority) AS c, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0 OR o_custkey % 2 = 0 GROUP BY 1, 2),
    b AS (SELECT o_custkey, CASE WHEN o_custkey % 7 = 0 THEN '' ELSE c END AS c, sum(n) AS n FROM n GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN c = '' THEN 2 WHEN c IN ('2-high', '1-urgent') THEN 0 ELSE 1 END, n DESC, CASE c WHEN '2-high' THEN 1 WHEN '1-urgent' THEN 2 ELSE 0 END, c) AS k FROM b)
    SELECT o_custkey, CASE WHEN c = '' THEN 'unknown' ELSE c END AS mode FROM r WHERE k = 1
    """,
)
def preferred_mode(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 5 <> 0 or o_custkey % 2 = 0").withColumn("c", F.when(F.col("o_custkey") % 7 == 0, " ").otherwise(F.col("o_orderpriority")))
    return aggregate.preferred_mode(o, ["o_custkey"], "c", ["2-high", "1-urgent"])


@query(
    "rollup_counts",
    "SELECT r_name, n_name, CAST(grouping(r_name, n_name) AS BIGINT) AS level, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
)
def rollup_counts(spark, sf_dir):
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    n = table(spark, sf_dir, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return aggregate.rollup_counts(c, ["r_name", "n_name"], "c_custkey").drop("about")


@query(
    "tag_features",
    """
    WITH e AS (SELECT user_id % 40 AS unit, CAST(0.5 + event_id % 4 AS DOUBLE) AS w, event_id % 11 <> 0 AS relevant, event_type = 'view' AS noise, event_type, event_id % 3 AS t FROM events)
    SELECT unit, sum(w) AS total, sum(CASE WHEN relevant AND NOT noise AND t > 0 THEN w ELSE 0 END) / sum(w) AS tag_odd, sum(CASE WHEN relevant AND NOT noise AND t = 2 THEN w ELSE 0 END) / sum(w) AS tag_two,
           sum(CASE WHEN relevant AND noise THEN w ELSE 0 END) / sum(w) AS noise_share, sum(CASE WHEN relevant AND NOT noise AND t = 0 THEN w ELSE 0 END) / sum(w) AS missing_share FROM e GROUP BY 1
    """,
)
def tag_features(spark, sf_dir):
    t = F.col("event_id") % 3
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("unit"), (F.lit(0.5) + F.col("event_id") % 4).alias("w"), "event_id", "event_type", F.array_compact(F.array(F.when(t > 0, "odd"), F.when(t == 2, "two"))).alias("tags"))
    return aggregate.tag_features(e, "unit", "tags", "w", F.col("event_id") % 11 != 0, F.col("event_type") == "view", ["odd", "two"])


@query(
    "separation_score",
    """
    WITH r AS (SELECT o_custkey % 5 AS prompt, o_orderstatus AS c, o_orderkey % 3 >= 1 AS likely, o_orderkey % 3 = 2 AS sure FROM orders)
    SELECT prompt, round(2.0 * count(*) FILTER (c = 'F' AND likely) / count(*) FILTER (c = 'F') + 1.0 * count(*) FILTER (c = 'F' AND sure) / count(*) FILTER (c = 'F') - 1.5 * count(*) FILTER (c = 'O' AND likely) / count(*) FILTER (c = 'O') - 0.5 * count(*) FILTER (c = 'O' AND sure) / count(*) FILTER (c = 'O'), 8) AS score FROM r GROUP BY 1
    """,
)
def separation_score(spark, sf_dir):
    r = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("prompt"), "o_orderstatus", (F.col("o_orderkey") % 3).alias("m"))
    return aggregate.separation_score(r, "prompt", "o_orderstatus", F.col("m") == 2, F.col("m") >= 1, {"F": (2.0, 1.0), "O": (-1.5, -0.5)}).withColumn("score", F.round("score", 8))


def _names(spark, sf_dir):
    """Customers to resolve and the suppliers they may be, by the end of a name and the nation."""
    i = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("input_id"), F.right("c_name", F.lit(2)).alias("nm"), F.col("c_nationkey").alias("st"))
    e = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.right("s_name", F.lit(2)).alias("nm"), F.col("s_nationkey").alias("st"))
    return i, e


@query(
    "resolve_overrides",
    """
    WITH i AS (SELECT c_custkey AS input_id, right(c_name, 2) AS nm, c_nationkey AS st FROM customer), e AS (SELECT s_suppkey AS entity_id, right(s_name, 2) AS nm, s_nationkey AS st FROM supplier),
    g AS (SELECT input_id, count(DISTINCT entity_id) AS n, min(entity_id) AS entity_id FROM i JOIN e USING (nm, st) GROUP BY 1), o AS (SELECT c_custkey AS input_id, (SELECT min(s_suppkey) FROM supplier) AS t FROM customer WHERE c_custkey % 9 = 0)
    SELECT i.input_id, CASE WHEN t IS NOT NULL THEN 'override' WHEN n IS NULL THEN 'none' ELSE 'name_state' END AS tier, coalesce(t, CASE WHEN n = 1 THEN g.entity_id END) AS entity_id,
           CASE WHEN t IS NOT NULL OR n = 1 THEN 'resolved' WHEN n IS NULL THEN 'unresolved' ELSE 'ambiguous' END AS status FROM i LEFT JOIN g USING (input_id) LEFT JOIN o USING (input_id)
    """,
)
def resolve_overrides(spark, sf_dir):
    i, e = _names(spark, sf_dir)
    target = e.agg(F.min("entity_id").alias("entity_id"))
    overrides = i.filter("input_id % 9 = 0").select("input_id").crossJoin(F.broadcast(target))  # one row
    return jn.with_overrides(jn.resolve(i, e, [("name_state", ["nm", "st"])]), overrides, e)


@query(
    "resolve_in_passes",
    """
    WITH i AS (SELECT c_custkey AS input_id, right(c_name, 2) AS a, lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS b, c_nationkey AS st FROM customer), e AS (SELECT s_suppkey AS entity_id, right(s_name, 2) AS nm, s_nationkey AS st FROM supplier),
    p AS (SELECT input_id, count(DISTINCT entity_id) AS n, min(entity_id) AS entity_id FROM i JOIN e ON a = nm AND i.st = e.st GROUP BY 1),
    q AS (SELECT input_id, count(DISTINCT entity_id) AS n, min(entity_id) AS entity_id FROM i JOIN e ON b = nm WHERE input_id NOT IN (SELECT input_id FROM p) GROUP BY 1)
    SELECT i.input_id, CASE WHEN p.n IS NOT NULL THEN 'city' WHEN q.n IS NOT NULL THEN 'town' ELSE 'none' END AS pass, CASE WHEN coalesce(p.n, q.n) = 1 THEN coalesce(p.entity_id, q.entity_id) END AS entity_id,
           CASE WHEN coalesce(p.n, q.n) IS NULL THEN 'unresolved' WHEN coalesce(p.n, q.n) > 1 THEN 'ambiguous' ELSE 'resolved' END AS status FROM i LEFT JOIN p USING (input_id) LEFT JOIN q USING (input_id)
    """,
)
def resolve_in_passes(spark, sf_dir):
    i, e = _names(spark, sf_dir)
    i = i.withColumn("b", F.lpad((F.col("input_id") % 100).cast("string"), 2, "0"))
    e = e.withColumnRenamed("nm", "name")
    return jn.resolve_in_passes(i, e, [("city", F.col("nm"), [("name_state", ["name", "st"])]), ("town", F.col("b"), [("name", ["name"])])]).select("input_id", "pass", "entity_id", "status")


@query(
    "fuzzy_match",
    r"""
    WITH p AS (SELECT p_partkey, p_brand, p_name, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM part),
    s AS (SELECT a.p_partkey AS input_id, b.p_partkey AS entity_id, lower(a.p_name) = lower(b.p_name) AS same, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS o,
                 1 - levenshtein(lower(a.p_name), lower(b.p_name)) / greatest(length(a.p_name), length(b.p_name)) AS d FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1 AND len(list_intersect(a.w, b.w)) > 0),
    c AS (SELECT *, CASE WHEN same THEN 1.0 ELSE 0.65 * d + 0.35 * o END AS score FROM s WHERE o >= 0.3 OR same), r AS (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY same DESC, score DESC, entity_id) AS k FROM c)
    SELECT p_partkey AS input_id, entity_id, round(CAST(score AS DOUBLE), 8) AS score, CASE WHEN r.input_id IS NULL THEN 'none' WHEN same THEN 'exact' ELSE 'fuzzy' END AS how FROM (SELECT p_partkey FROM p WHERE p_partkey % 2 = 0) LEFT JOIN r ON input_id = p_partkey AND k = 1
    """,
)
def fuzzy_match(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_name").alias("name"))
    m = jn.fuzzy_match(p.filter("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "input_id"), p.filter("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "entity_id"), "p_brand", least_overlap=0.3)
    return m.withColumn("score", F.round("score", 8))


@query("required_join", "SELECT o_orderkey, c_name, n FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def required_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines.select("o_orderkey"), "o_orderkey", "left_semi")
    named = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    out = jn.require_all(jn.require_all(orders, "o_custkey", {"customer": named}), "o_orderkey", {"lines": lines})
    return out.select("o_orderkey", "c_name", "n")


@query("checked_union", "SELECT o_orderkey, o_orderstatus FROM orders")
def checked_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return panel.union_unique([o.filter(F.col("o_orderkey") % 3 == k) for k in range(3)], "o_orderkey")


@query("balanced_sample", "WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority, o_totalprice < 100000 ORDER BY o_orderkey) AS k FROM orders) SELECT o_orderkey, o_orderpriority FROM r WHERE k <= 4")
def balanced_sample(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return panel.balanced_sample(o, "o_orderpriority", F.col("o_totalprice") < 100000, 4, F.asc("o_orderkey")).drop("o_totalprice")


@query("coverage_sample")
def coverage_sample(spark, sf_dir):
    """Compared with a plain loop in the tests."""
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", "source", (F.length(F.coalesce("text", F.lit(""))) % 4).alias("quartile"), (F.col("doc_id") % 3).alias("level"), (F.length(F.coalesce("text", F.lit(""))) / 100000.0).alias("bonus"))
    return panel.coverage_sample(d, "lang", "doc_id", {"level": 4.0, "quartile": 3.0, "source": 3.0}, "bonus", 12)


@query(
    "keyword_blocks",
    r"""
    WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
    d AS (SELECT doc_id, i, CASE WHEN trim(regexp_replace(line, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(line, '\s+', ' ', 'g')), ' ')) END AS words, len(regexp_extract_all(lower(line), '\b(?:license|copyright|terms|email|call)\b')) AS hits FROM l),
    k AS (SELECT *, CAST(words >= 3 AND hits * 1000.0 / words >= 20 AS INTEGER) AS core FROM d)
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS place, core, max(core) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS kept FROM k
    """,
)
def keyword_blocks(spark, sf_dir):
    """Blocks dense in keywords, and their neighbours."""
    l = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("place", "line"))
    core = ((fx.word_count("line") >= 3) & (fx.keyword_density(F.col("line"), ["license", "copyright", "terms", "email", "call"]) >= 20)).cast("int")
    near = Window.partitionBy("doc_id").orderBy("place").rowsBetween(-1, 1)
    return l.select("doc_id", "place", core.alias("core")).select("doc_id", "place", "core", F.max("core").over(near).alias("kept"))


@query(
    "cohort_filters",
    "SELECT doc_id, lang FROM documents JOIN labels USING (doc_id) WHERE trim(coalesce(text, '')) <> '' AND quality = 1 AND lang IN ('en', 'de') AND source NOT IN ('src1', 'src2') UNION ALL SELECT event_id, 'flag' FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 10 AND 20 AND event_type IN ('view', 'click')",
)
def cohort_filters(spark, sf_dir):
    """Resolved rows with text, by membership; and rows by flags of nested JSON."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    d = table(spark, sf_dir, "documents").join(good, "doc_id")
    d = d.filter((fx.clean_str("text") != "") & F.col("lang").isin("en", "de") & ~F.col("source").isin("src1", "src2")).select("doc_id", "lang")
    k = F.from_json("props", "struct<k:bigint>")["k"]
    e = table(spark, sf_dir, "events").filter(k.between(10, 20) & F.col("event_type").isin("view", "click"))
    return d.unionByName(e.select(F.col("event_id").alias("doc_id"), F.lit("flag").alias("lang")))


@query(
    "cells_and_count_maps",
    """
    WITH c AS (SELECT o_custkey, unnest(['s' || o_orderstatus, 'p' || left(o_orderpriority, 1)]) AS item FROM orders), n AS (SELECT o_custkey, item, count(*) AS n FROM c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, item) AS k FROM n)
    SELECT o_custkey, string_agg(item || ':' || n, '|' ORDER BY k) AS top FROM r WHERE k <= 3 GROUP BY 1
    """,
)
def cells_and_count_maps(spark, sf_dir):
    """Lists in cells to rows, and counts of the items back into one cell."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("s"), "o_orderstatus", F.lit(", , p"), F.left("o_orderpriority", F.lit(1))).alias("cell"))
    n = o.select("o_custkey", F.explode(fx.split_cell("cell")).alias("item")).groupBy("o_custkey", "item").agg(F.count("*").alias("n"))
    return n.groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("item").alias("key"), "n")).alias("c")).select("o_custkey", fx.count_map(F.col("c"), 3).alias("top"))


@query(
    "label_overrides",
    "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'by hand ' || p_partkey WHEN p_brand <> 'Brand#11' THEN lower(p_brand) ELSE 'cluster ' || p_size END AS label, CASE WHEN p_partkey % 4 = 0 THEN 'reviewed' WHEN p_brand <> 'Brand#11' THEN 'model' ELSE 'rule' END AS label_source FROM part",
)
def label_overrides(spark, sf_dir):
    """The first label that is there: reviewed, then a model's, then the rule's."""
    p = table(spark, sf_dir, "part")
    reviewed = p.filter("p_partkey % 4 = 0").select("p_partkey", F.concat(F.lit("by hand "), F.col("p_partkey").cast("string")).alias("reviewed"))
    said = p.filter("p_brand <> 'Brand#11'").select("p_partkey", F.lower("p_brand").alias("model"))
    out = p.select("p_partkey", F.concat(F.lit("cluster "), F.col("p_size").cast("string")).alias("rule")).join(reviewed, "p_partkey", "left").join(said, "p_partkey", "left")
    sources = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in ("reviewed", "model", "rule")])
    return out.select("p_partkey", F.coalesce("reviewed", "model", "rule").alias("label"), sources.alias("label_source"))


@query(
    "bucket_invariants",
    "SELECT 'status_known' AS rule, count(*) FILTER (o_orderstatus NOT IN ('F', 'O', 'P')) AS broken, count(*) AS checked FROM orders UNION ALL SELECT 'finished_is_past', count(*) FILTER (o_orderstatus = 'F' AND o_orderdate > DATE '1996-01-01'), count(*) FROM orders UNION ALL SELECT 'price_positive', count(*) FILTER (o_totalprice <= 0), count(*) FROM orders",
)
def bucket_invariants(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rules = {"status_known": ~F.col("o_orderstatus").isin("F", "O", "P"), "finished_is_past": (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") > F.lit("1996-01-01").cast("date")), "price_positive": F.col("o_totalprice") <= 0}
    one = o.agg(F.count("*").alias("checked"), *[F.count_if(c).alias(n) for n, c in rules.items()])
    return one.unpivot(["checked"], list(rules), "rule", "broken").select("rule", "broken", "checked")


@query("logit_cv")
def logit_cv(spark, sf_dir):
    """Grouped cross-validation by customer; compared with Newton steps in the tests."""
    o = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").alias("done"), (F.col("o_totalprice") / 100000).alias("price"), (F.year("o_orderdate") - 1995).alias("year"))
    return model.logit(o, "done", ["price", "year"], "o_custkey")


@query("ols_outcomes")
def ols_outcomes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return model.ols_outcomes(li, {"price": F.col("l_extendedprice"), "tax": F.col("l_tax")}, {"quantity": F.col("l_quantity")}, {"flag": F.col("l_returnflag")})
