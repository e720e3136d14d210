"""Names and families of clusters: keywords, tags, feature profiles, regimes over time, spread-out labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.functions import text as fx
from cartulary.storage import stash

from .panel import top_k


def _most_common(df: DataFrame, cluster: str, items: Column, k: int) -> DataFrame:
    """cluster, list: the k most frequent items (ties by name)."""
    n = df.select(cluster, F.explode(items).alias("item")).groupBy(cluster, "item").agg(F.count("*").alias("n"))
    best = top_k(n, [cluster], [F.desc("n"), F.asc("item")], k)
    return best.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]).alias("list"))


def cluster_labels(df: DataFrame, cluster: str, text: str, instrument: str, labeler: str, keywords: int = 6) -> DataFrame:
    """cluster, label, slug, taxonomy, keywords, action_tags, dimension_tags, instrument_tags.

    ``mechanics`` names a cluster by its commonest dimension (or else action) tags,
    ``instrument`` by its commonest instrument, ``semantic`` by its keywords: the
    words of four letters or more that most of its texts hold.
    """
    tags = fx.mechanics(F.col(text))
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z]{4,}"), F.lit(0)))
    out = df.select(cluster).distinct()
    for name, items, k in (("keywords", words, keywords), ("action_tags", tags["action_tags"], 5), ("dimension_tags", tags["dimension_tags"], 5), ("instrument_tags", tags["instrument_tags"], 5), ("_kinds", F.array(F.col(instrument)), 1)):
        out = out.join(_most_common(df, cluster, items, k).withColumnRenamed("list", name), cluster, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    first = lambda c, k: F.slice(c, F.lit(1), F.lit(k))
    some = lambda *cs: F.coalesce(*[F.when(F.size(c) > 0, F.array_join(c, ", ")) for c in cs])
    label = {
        "mechanics": F.coalesce(some(first("dimension_tags", 2), first("action_tags", 2), first("keywords", 2)), F.lit("misc")),
        "instrument": F.coalesce(some(F.col("_kinds"), first("keywords", 2)), F.lit("instrument")),
        "semantic": F.coalesce(some(first("keywords", 3)), F.lit("semantic cluster")),
    }[labeler]
    out = out.withColumn("label", label)
    return out.select(cluster, "label", fx.slugify("label").alias("slug"), F.lit(labeler).alias("taxonomy"), *[F.array_join(c, "|").alias(c) for c in ("keywords", "action_tags", "dimension_tags", "instrument_tags")])


def family_profiles(df: DataFrame, family: str, features: dict[str, str], high: float = 0.55, some: float = 0.20, most: int = 3) -> DataFrame:
    """family, n, label: which standardised features (column: name) a family's mean sets apart.

    Means from ``high`` on are "high", down from minus that "low", those from
    ``some`` on are only named; best first.  A family without any is named by its
    strongest features.  Standardised over all rows, population deviation.
    """
    names = list(features)
    stats = df.agg(*[F.avg(c).alias(f"{c}_m") for c in names], *[F.stddev_pop(c).alias(f"{c}_s") for c in names])
    by = df.groupBy(family).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in names]).crossJoin(F.broadcast(stats))  # one row
    score = {c: F.round(F.when(F.col(f"{c}_s") > 0, (F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s")).otherwise(0.0), 9) for c in names}
    each = F.array(*[F.struct((-score[c]).alias("minus"), F.lit(k).alias("place"), F.lit(features[c]).alias("name")) for k, c in enumerate(names)])
    told = lambda x: F.when(-x["minus"] >= high, F.concat(F.lit("high "), x["name"])).when(-x["minus"] <= -high, F.concat(F.lit("low "), x["name"])).when(-x["minus"] >= some, x["name"])
    labels = F.array_compact(F.transform(F.array_sort(each), told))
    strong = F.array_sort(F.transform(each, lambda x: F.struct((-F.abs(x["minus"])).alias("m"), x["place"].alias("p"), F.concat(F.when(x["minus"] <= 0, "high ").otherwise("low "), x["name"]).alias("t"))))
    chosen = F.when(F.size(labels) > 0, labels).otherwise(F.transform(strong, lambda x: x["t"]))
    return by.select(family, "n", F.array_join(F.slice(chosen, F.lit(1), F.lit(most)), " | ").alias("label"))


def regimes(df: DataFrame, unit: str, at: str, features: list[str], observed: Column, k: int, seed: int = 0) -> DataFrame:
    """unit, at, regime, changed: k-means fitted on standardised observed rows, assigned to all rows with complete features."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = df.select(unit, at, observed.alias("_observed"), *[F.col(c).cast("double").alias(c) for c in features])
    rows = stash(VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip").transform(rows), "regime-rows")
    seen = rows.filter("_observed")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(seen)
    model = KMeans(k=k, seed=seed, maxIter=50).fit(scaler.transform(seen))
    out = model.transform(scaler.transform(rows)).select(unit, at, F.col("prediction").alias("regime"))
    before = F.lag("regime").over(Window.partitionBy(unit).orderBy(at))
    return out.select("*", F.coalesce((F.col("regime") != before).cast("int"), F.lit(0)).alias("changed"))


def representation(level: str, sources: list[tuple[str, DataFrame | None]], item: str, text: str) -> DataFrame:
    """level, item_id, text, source of the first source (name, table) that is there; blank texts are left out."""
    name, df = next(((n, d) for n, d in sources if d is not None), (None, None))
    if df is None:
        raise ValueError(f"no table for {level}")
    return df.filter(fx.clean_str(text) != "").select(F.lit(level).alias("level"), F.col(item).cast("string").alias("item_id"), F.col(text).alias("text"), F.lit(name).alias("source"))


def spread_labels(df: DataFrame, group: str, item: str, x: str, y: str, rank: str, limit: int, apart: float = 0.10) -> DataFrame:
    """group, item, place: the labels, in order of rank, that are ``apart`` (of the spans) from all chosen before, ``limit`` at most.

    For bounded inputs such as centroids: a group is one task.
    """

    def pick(t):
        import pandas as pd

        t = t.sort_values([rank, item])
        spans = [max(float(t[c].max() - t[c].min()), 1e-6) for c in (x, y)]
        chosen: list[tuple] = []
        for row in t.itertuples():
            at = (getattr(row, x) / spans[0], getattr(row, y) / spans[1])
            if all(((at[0] - a) ** 2 + (at[1] - b) ** 2) ** 0.5 >= apart for _, a, b in chosen):
                chosen.append((getattr(row, item), *at))
                if len(chosen) >= limit:
                    break
        return pd.DataFrame({group: [t[group].iloc[0]] * len(chosen), item: [c[0] for c in chosen], "place": range(1, len(chosen) + 1)})

    kind = lambda c: df.schema[c].dataType.simpleString()
    return df.select(group, item, x, y, rank).groupBy(group).applyInPandas(pick, f"{group} {kind(group)}, {item} {kind(item)}, place int")
