"""Queries of cluster names, feature profiles, regimes, representations and summaries by family."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cartulary.functions import rules, text as fx
from cartulary.operators import families

from .catalog import query, table
from .taxonomy_queries import TEXTS, _families, _hit, _needles, texts


def _top(name: str, items: str, k: int) -> str:
    """SQL: the k most frequent items of a cluster, in order, as a list."""
    return f"""{name}n AS (SELECT cluster, item, count(*) AS n FROM (SELECT cluster, unnest({items}) AS item FROM c) GROUP BY 1, 2),
    {name} AS (SELECT cluster, list(item ORDER BY n DESC, item)[1:{k}] AS l FROM {name}n GROUP BY 1)"""


_TAGS = {"act": rules.ACTION_TAGS, "dim": rules.DIMENSION_TAGS, "ins": rules.INSTRUMENT_TAGS}
_LABELS = f"""
    WITH {TEXTS}, k AS (SELECT p_size % 7 AS cluster, t.text, {_hit(rules.ZONING_CONTEXT)} AS ok, {_needles("text", rules.INSTRUMENTS, "general_rule")} AS kind FROM t JOIN part USING (p_partkey)),
    c AS (SELECT cluster, kind, list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS words, {", ".join(f"CASE WHEN ok THEN list_filter(string_split({_families(f)}, '|'), lambda x: x <> '') ELSE [] END AS {n}" for n, f in _TAGS.items())} FROM k),
    {_top("kw", "words", 6)}, {_top("a", "act", 5)}, {_top("d", "dim", 5)}, {_top("it", "ins", 5)}, {_top("q", "[kind]", 1)},
    j AS (SELECT u.cluster, coalesce(kw.l, []) AS kw, coalesce(a.l, []) AS a, coalesce(d.l, []) AS d, coalesce(it.l, []) AS i, coalesce(q.l, []) AS q FROM (SELECT DISTINCT cluster FROM c) u LEFT JOIN kw USING (cluster) LEFT JOIN a USING (cluster) LEFT JOIN d USING (cluster) LEFT JOIN it USING (cluster) LEFT JOIN q USING (cluster)),
    m AS (SELECT cluster, array_to_string(CASE WHEN len(d) > 0 THEN d[1:2] WHEN len(a) > 0 THEN a[1:2] ELSE kw[1:2] END, ', ') AS label, 'mechanics' AS taxonomy, kw, a, d, i FROM j
          UNION ALL SELECT cluster, array_to_string(q, ', '), 'instrument', kw, a, d, i FROM j UNION ALL SELECT cluster, array_to_string(kw[1:3], ', '), 'semantic', kw, a, d, i FROM j)
    SELECT cluster, label, trim(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '-') AS slug, taxonomy, array_to_string(kw, '|') AS keywords, array_to_string(a, '|') AS action_tags, array_to_string(d, '|') AS dimension_tags, array_to_string(i, '|') AS instrument_tags FROM m
"""


@query("cluster_labels", _LABELS)
def cluster_labels(spark, sf_dir):
    size = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 7).alias("cluster"))
    t = texts(spark, sf_dir).join(size, "p_partkey").withColumn("kind", fx.first_needle(F.col("text"), rules.INSTRUMENTS, "general_rule"))
    out = [families.cluster_labels(t, "cluster", "text", "kind", x) for x in ("mechanics", "instrument", "semantic")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "family_profiles",
    """
    WITH f AS (SELECT o_orderpriority AS family, o_totalprice AS p, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS q, CAST(o_custkey % 10 AS DOUBLE) + CASE WHEN o_orderpriority LIKE '1%' THEN 3 ELSE 0 END AS r FROM orders),
    s AS (SELECT avg(p) AS pm, stddev_pop(p) AS ps, avg(q) AS qm, stddev_pop(q) AS qs, avg(r) AS rm, stddev_pop(r) AS rs FROM f),
    z AS (SELECT family, count(*) AS n, [{'v': round((avg(p) - any_value(pm)) / any_value(ps), 9), 'k': 0, 't': 'price'}, {'v': round((avg(q) - any_value(qm)) / any_value(qs), 9), 'k': 1, 't': 'finished'}, {'v': round((avg(r) - any_value(rm)) / any_value(rs), 9), 'k': 2, 't': 'load'}] AS e FROM f, s GROUP BY 1),
    l AS (SELECT *, list_filter(list_transform(list_sort(list_transform(e, lambda x: {'m': -x.v, 'k': x.k, 't': x.t})), lambda x: CASE WHEN -x.m >= 0.55 THEN 'high ' || x.t WHEN -x.m <= -0.55 THEN 'low ' || x.t WHEN -x.m >= 0.2 THEN x.t END), lambda x: x IS NOT NULL) AS labels,
                 list_transform(list_sort(list_transform(e, lambda x: {'m': -abs(x.v), 'k': x.k, 't': CASE WHEN x.v >= 0 THEN 'high ' ELSE 'low ' END || x.t})), lambda x: x.t) AS strong FROM z)
    SELECT family, n, array_to_string(CASE WHEN len(labels) > 0 THEN labels ELSE strong END, ' | ') AS label FROM l
    """,
)
def family_profiles(spark, sf_dir):
    p = F.col("o_orderpriority")
    o = table(spark, sf_dir, "orders").select(p.alias("family"), F.col("o_totalprice").alias("p"), (F.col("o_orderstatus") == "F").cast("double").alias("q"), ((F.col("o_custkey") % 10).cast("double") + F.when(p.startswith("1"), 3).otherwise(0)).alias("r"))
    return families.family_profiles(o, "family", {"p": "price", "q": "finished", "r": "load"})


@query("regime_panel")
def regime_panel(spark, sf_dir):
    """Regimes of customers' years, fitted on years with three orders or more."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("price"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("done"))
    return families.regimes(o, "o_custkey", "y", ["price", "done"], F.col("n") >= 2, 4)


@query(
    "primary_experiment",
    "WITH e AS (SELECT o_orderpriority AS representation, o_orderstatus AS labeler, year(o_orderdate) AS experiment, count(DISTINCT o_custkey) AS clusters, count(*) AS items FROM orders GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY representation, labeler ORDER BY clusters DESC, items DESC, experiment) AS k FROM e) SELECT representation, labeler, experiment, clusters, items FROM r WHERE k = 1",
)
def primary_experiment(spark, sf_dir):
    """The experiment with the most clusters, then items, of each representation and labeler."""
    from cartulary.operators.panel import top_k

    e = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("representation"), F.col("o_orderstatus").alias("labeler"), F.year("o_orderdate").cast("long").alias("experiment")).agg(F.countDistinct("o_custkey").alias("clusters"), F.count("*").alias("items"))
    return top_k(e, ["representation", "labeler"], [F.desc("clusters"), F.desc("items"), F.asc("experiment")], 1).drop("place")


@query("representation_views", "SELECT 'ordinance' AS level, CAST(doc_id AS VARCHAR) AS item_id, length(text) AS chars, 'documents' AS source FROM documents WHERE lower(trim(coalesce(text, ''))) NOT IN ('', 'nan', 'none', 'null') UNION ALL SELECT 'clause', CAST(p_partkey AS VARCHAR), length(p_name), 'structure_clauses' FROM part WHERE trim(p_name) <> ''")
def representation_views(spark, sf_dir):
    docs = families.representation("ordinance", [("documents", table(spark, sf_dir, "documents"))], "doc_id", "text")
    clauses = families.representation("clause", [("operative_clause_semantics", None), ("clause_semantics", None), ("structure_clauses", table(spark, sf_dir, "part"))], "p_partkey", "p_name")
    return docs.unionByName(clauses).select("level", "item_id", F.length("text").cast("long").alias("chars"), "source")


@query(
    "family_coherence",
    """
    WITH c AS (SELECT l_orderkey AS k, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS aligned, avg(l_discount) AS discretion FROM lineitem GROUP BY 1),
    m AS (SELECT regr_slope(o_totalprice, year(o_orderdate)) AS b, regr_intercept(o_totalprice, year(o_orderdate)) AS a FROM orders)
    SELECT o_orderpriority AS family, count(DISTINCT o_orderkey) AS documents, round(avg(aligned), 8) AS mean_aligned, round(avg(discretion), 8) AS mean_discretion, round(avg(o_totalprice - (a + b * year(o_orderdate))), 3) AS mean_residual FROM orders, m LEFT JOIN c ON k = o_orderkey GROUP BY 1
    """,
)
def family_coherence(spark, sf_dir):
    """Families with the coherence of their documents and the residuals of a model of all documents."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("aligned"), F.avg("l_discount").alias("discretion"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", F.year("o_orderdate").alias("y"))
    m = o.agg(F.regr_slope("o_totalprice", "y").alias("b"), F.regr_intercept("o_totalprice", "y").alias("a"))
    j = o.crossJoin(F.broadcast(m)).join(c, "o_orderkey", "left")  # m: one row
    residual = F.col("o_totalprice") - (F.col("a") + F.col("b") * F.col("y"))
    return j.groupBy(F.col("o_orderpriority").alias("family")).agg(F.countDistinct("o_orderkey").alias("documents"), F.round(F.avg("aligned"), 8).alias("mean_aligned"), F.round(F.avg("discretion"), 8).alias("mean_discretion"), F.round(F.avg(residual), 3).alias("mean_residual"))


@query("spread_labels")
def spread_labels(spark, sf_dir):
    """Compared with a plain loop in the tests."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_partkey") % 37).cast("double").alias("x"), (F.col("p_size") * 1.0).alias("y"), F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"))).alias("rank"))
    return families.spread_labels(p, "p_brand", "p_partkey", "x", "y", "rank", 8)
