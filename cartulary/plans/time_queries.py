"""Queries over time: panels, windows, merges, batches, samples, streams' batch form."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cartulary.functions import text as fx
from cartulary.operators import panel

from .catalog import query, table


@query("quartile_rank", "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, CAST(CASE WHEN n = 1 THEN 1 ELSE greatest(1, ceil((i - 1) / (n - 1) * 4)) END AS INTEGER) AS quartile FROM r")
def quartile_rank(spark, sf_dir):
    return panel.rank_quartile(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), ["lang"], [F.asc("n_chars"), F.asc("doc_id")]).select("doc_id", "lang", "quartile")


@query("seq_index", "SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS seq, round(CASE WHEN count(*) OVER (PARTITION BY o_custkey) > 1 THEN (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) / (count(*) OVER (PARTITION BY o_custkey) - 1) ELSE 0 END, 6) AS position FROM orders")
def seq_index(spark, sf_dir):
    by = Window.partitionBy("o_custkey")
    seq = F.row_number().over(by.orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", seq.alias("seq"), F.round(fx.position(seq, F.count("*").over(by)), 6).alias("position"))


@query("topk_per_group", "WITH r AS (SELECT o_orderstatus, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders) SELECT * FROM r WHERE place <= 8")
def topk_per_group(spark, sf_dir):
    return panel.top_k(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice"), ["o_orderstatus"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 8)


@query("global_topn", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def global_topn(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("first_last_sig", "SELECT user_id, array_to_string(list(event_type ORDER BY ts, event_id)[1:3], '>') AS opening, array_to_string(list(event_type ORDER BY ts, event_id)[-3:], '>') AS closing FROM events GROUP BY 1")
def first_last_sig(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("s"))
    names = F.transform("s", lambda x: x["event_type"])
    return s.select("user_id", F.array_join(F.slice(names, 1, 3), ">").alias("opening"), F.array_join(F.slice(names, F.greatest(F.size("s") - 2, F.lit(1)), F.lit(3)), ">").alias("closing"))


_DAY = "WITH d AS (SELECT user_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS day, count(*) AS n, sum(value) AS v FROM events GROUP BY 1, 2) "


def _days(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.unix_date(F.to_date("ts")).alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))


@query("panel_diff", _DAY + "SELECT user_id, day, n, n - lag(n) OVER (PARTITION BY user_id ORDER BY day) AS change FROM d")
def panel_diff(spark, sf_dir):
    return panel.differences(_days(spark, sf_dir).select("user_id", "day", "n"), "user_id", "day", "n")


@query("step_fill", _DAY + ", s AS (SELECT user_id, unnest(range(min(day), max(day) + 1)) AS day FROM d GROUP BY 1) SELECT s.user_id, CAST(s.day AS INTEGER) AS day, last_value(d.n IGNORE NULLS) OVER (PARTITION BY s.user_id ORDER BY s.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n, CAST(d.n IS NOT NULL AS INTEGER) AS observed FROM s LEFT JOIN d ON d.user_id = s.user_id AND d.day = s.day")
def step_fill(spark, sf_dir):
    return panel.step_fill(_days(spark, sf_dir).select("user_id", "day", "n"), "user_id", "day", "n")


@query("event_time", _DAY + ", f AS (SELECT *, min(day) FILTER (n >= 4) OVER (PARTITION BY user_id) AS first_event FROM d) SELECT user_id, day, CAST(first_event IS NOT NULL AS INTEGER) AS treated, coalesce(CAST(day >= first_event AS INTEGER), 0) AS post, day - first_event AS event_time FROM f")
def event_time(spark, sf_dir):
    return panel.event_time(_days(spark, sf_dir), "user_id", "day", F.col("n") >= 4).select("user_id", "day", "treated", "post", "event_time")


@query("adoption_panel", _DAY + ", f AS (SELECT user_id, min(day) AS lo, max(day) AS hi, min(day) FILTER (n >= 4) AS ad FROM d GROUP BY 1), g AS (SELECT user_id, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS day, ad FROM f) SELECT user_id, day, CAST(ad IS NULL OR day <= ad AS INTEGER) AS at_risk, coalesce(CAST(day >= ad AS INTEGER), 0) AS adopted, coalesce(CAST(day = ad AS INTEGER), 0) AS event FROM g")
def adoption_panel(spark, sf_dir):
    f = _days(spark, sf_dir).groupBy("user_id").agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.min(F.when(F.col("n") >= 4, F.col("day"))).alias("ad"))
    g = f.select("user_id", F.explode(F.sequence("lo", "hi")).alias("day"), "ad")
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return g.select("user_id", "day", (F.col("ad").isNull() | (F.col("day") <= F.col("ad"))).cast("int").alias("at_risk"), flag(F.col("day") >= F.col("ad")).alias("adopted"), flag(F.col("day") == F.col("ad")).alias("event"))


@query("centred_window_stats", "WITH d AS (SELECT CAST(ts AS DATE) AS day, value FROM events), k AS (SELECT DISTINCT day FROM d) SELECT CAST(k.day AS VARCHAR) AS day, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS p50, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75 FROM k JOIN d ON d.day BETWEEN k.day - 2 AND k.day + 2 GROUP BY 1")
def centred_window_stats(spark, sf_dir):
    """Pooled values of five days around each day: every value meets the days it counts for, then one aggregate."""
    d = table(spark, sf_dir, "events").select(F.unix_date(F.to_date("ts")).alias("d"), "value")
    near = d.select(F.explode(F.sequence(F.col("d") - 2, F.col("d") + 2)).alias("day"), "value").join(F.broadcast(d.select(F.col("d").alias("day")).distinct()), "day", "left_semi")
    p = lambda q: F.round(F.percentile("value", q), 6)
    return near.groupBy(F.date_from_unix_date("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), p(0.5).alias("p50"), p(0.25).alias("p25"), p(0.75).alias("p75"))


@query("rolling_mean", _DAY + "SELECT user_id, day, round(avg(n) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS smooth FROM d")
def rolling_mean(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(-2, 0)
    return _days(spark, sf_dir).select("user_id", "day", F.round(F.avg("n").over(w), 6).alias("smooth"))


@query("amendment_delta", "WITH m AS (SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY day) AS p FROM m), j AS (SELECT coalesce(a.day, b.day + 1) AS day, coalesce(a.p, 0) AS cur, coalesce(b.p, 0) AS prior FROM p a FULL JOIN p b ON a.event_type = b.event_type AND a.day = b.day + 1) SELECT day, round(sum(greatest(0, cur - prior)), 6) AS added, round(sum(greatest(0, prior - cur)), 6) AS removed, round(sum(least(cur, prior)), 6) AS kept FROM j GROUP BY 1")
def amendment_delta(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy(F.unix_date(F.to_date("ts")).alias("day"), "event_type").agg(F.count("*").alias("n"))
    p = m.select("day", "event_type", (F.col("n") / F.sum("n").over(Window.partitionBy("day"))).alias("p"))
    j = p.withColumnRenamed("p", "cur").join(p.select((F.col("day") + 1).alias("day"), "event_type", F.col("p").alias("prior")), ["day", "event_type"], "full_outer").fillna(0.0)
    up = lambda a, b: F.round(F.sum(F.greatest(F.lit(0.0), F.col(a) - F.col(b))), 6)
    return j.groupBy("day").agg(up("cur", "prior").alias("added"), up("prior", "cur").alias("removed"), F.round(F.sum(F.least("cur", "prior")), 6).alias("kept"))


@query("precedence_merge", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, ts DESC, event_id DESC) AS k FROM events) SELECT event_id, user_id, event_type FROM r WHERE k = 1")
def precedence_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("key", F.concat_ws("|", "user_id", F.to_date("ts")))
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return panel.precedence_merge(e, "key", [rank.asc(), F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id", "event_type")


@query("latest_state", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id, event_type, value FROM r WHERE k = 1")
def latest_state(spark, sf_dir):
    last = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(last.alias("x")).select("user_id", "x.event_id", "x.event_type", "x.value")


@query("ordered_batches", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS i FROM documents) SELECT doc_id, i // 64 AS batch, i % 64 AS place FROM r")
def ordered_batches(spark, sf_dir):
    return panel.batches(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], 64, parts=8).select("doc_id", "batch", "place")


@query("byte_shards")
def byte_shards(spark, sf_dir):
    from cartulary.operators.requests import shard_by_budget

    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"))
    return shard_by_budget(d, "doc_id", "bytes", 100, 200_000)


@query("stratified_sample", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '-0'), doc_id) AS k FROM documents) SELECT doc_id, source FROM r WHERE k <= 5")
def stratified_sample(spark, sf_dir):
    order = [F.asc("h"), F.asc("doc_id")]
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.concat_ws("-", "doc_id", F.lit("0")).cast("binary")).alias("h"))
    return panel.top_k(d, ["source"], order, 5).select("doc_id", "source")


@query("tumbling_sliding", "WITH t AS (SELECT 'tumbling' AS kind, date_trunc('day', ts) AS start, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 2), s AS (SELECT 'sliding' AS kind, date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS start, count(*) AS n, round(sum(value), 4) AS v FROM events, (SELECT unnest(range(0, 5)) AS k) GROUP BY 2) SELECT kind, strftime(start, '%Y-%m-%d') AS start, n, v FROM t UNION ALL SELECT kind, strftime(start, '%Y-%m-%d'), n, v FROM s")
def tumbling_sliding(spark, sf_dir):
    from cartulary.streaming.windows import windowed

    e = table(spark, sf_dir, "events")
    out = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.date_format("start", "yyyy-MM-dd").alias("start"), "n", F.round("v", 4).alias("v"))
    return out(windowed(e, "1 day"), "tumbling").unionByName(out(windowed(e, "5 days", "1 day"), "sliding"))


@query("rank_orders_by_bucket", "SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(min(year(o_orderdate) * 12 + month(o_orderdate) - 1) AS BIGINT) AS month_index, CAST(min(floor(year(o_orderdate) / 10) * 10) AS BIGINT) AS decade, count(*) AS n FROM orders GROUP BY 1")
def rank_orders_by_bucket(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.min(fx.month_index(F.col("o_orderdate"))).alias("month_index"), F.min(F.floor(F.year("o_orderdate") / 10) * 10).cast("long").alias("decade"), F.count("*").alias("n"))
