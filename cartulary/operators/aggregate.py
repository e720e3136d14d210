"""Grouped aggregates: shares, lifts, modes, direct standardisation, composite indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.functions.text import entropy, safe_div


def shares(df: DataFrame, group: list[str], category: str) -> DataFrame:
    """n and share of each category within its group, and lift and difference against the overall share."""
    n = df.groupBy(*group, category).agg(F.count("*").alias("n"))
    whole, by, cat = Window.partitionBy(), Window.partitionBy(*group), Window.partitionBy(category)
    # The counts are a small table (groups x categories), so one-partition totals are cheap.
    return n.select(*group, category, "n", (F.col("n") / F.sum("n").over(by)).alias("share"), (F.sum("n").over(cat) / F.sum("n").over(whole)).alias("overall")).select("*", (F.col("share") / F.col("overall")).alias("lift"), (F.col("share") - F.col("overall")).alias("diff"))


def mode_of(df: DataFrame, group: list[str], category: str) -> DataFrame:
    """The most frequent category of each group; ties go to the smallest value."""
    n = df.groupBy(*group, category).agg(F.count("*").alias("n"))
    return n.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("minus"), F.col(category).alias("c"))).alias("m")).select(*group, F.col("m.c").alias("mode"), (-F.col("m.minus")).alias("n"))


def presence_rate(df: DataFrame, group: str, unit: str, category: str) -> DataFrame:
    """Distinct units with a category over distinct units of the group, for every group and category."""
    units = df.groupBy(group).agg(F.countDistinct(unit).alias("units"))
    seen = df.groupBy(group, category).agg(F.countDistinct(unit).alias("present"))
    grid = units.crossJoin(F.broadcast(df.select(category).distinct()))  # a catalogue of categories
    return grid.join(seen, [group, category], "left").select(group, category, F.coalesce("present", F.lit(0)).alias("present"), "units", safe_div(F.coalesce("present", F.lit(0)), F.col("units")).alias("rate"))


def standardized_mean(df: DataFrame, group: str, stratum: str, value: Column) -> DataFrame:
    """Mean of each group under the overall mix of strata: weights of the strata it has, renormalised."""
    cells = df.groupBy(group, stratum).agg(F.avg(value).alias("m"), F.count("*").alias("n"))
    weights = cells.groupBy(stratum).agg(F.sum("n").alias("w"))
    total = F.sum("w").over(Window.partitionBy())
    weights = weights.select(stratum, (F.col("w") / total).alias("w"))
    return cells.join(weights, stratum).groupBy(group).agg((F.sum(F.col("m") * F.col("w")) / F.sum("w")).alias("adjusted"), F.sum("w").alias("coverage"), (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("raw"), F.sum("n").alias("n"))


def zscored(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population z-scores by one aggregate that is joined back (one row), so no window holds the table."""
    stats = df.agg(*[F.avg(c).alias(f"{c}_m") for c in columns], *[F.stddev_pop(c).alias(f"{c}_s") for c in columns])
    out = df.crossJoin(F.broadcast(stats))
    z = {f"z_{c}": F.when(F.col(f"{c}_s") > 0, (F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s")).otherwise(0.0) for c in columns}
    return out.withColumns(z).drop(*[f"{c}_{x}" for c in columns for x in "ms"])


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return one.unpivot([], [f"`{a}|{b}`" for a, b in pairs], "pair", "r").select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "r")


def cooccurrence(df: DataFrame, unit: str, category: str) -> DataFrame:
    """Share of units that have both categories, for every ordered pair."""
    seen = df.select(unit, category).distinct()
    total = seen.agg(F.countDistinct(unit).alias("units"))
    sets = seen.groupBy(unit).agg(F.collect_set(category).alias("c"))
    pairs = sets.select(F.explode("c").alias("a"), "c").select("a", F.explode("c").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    return pairs.crossJoin(F.broadcast(total)).select("a", "b", "n", (F.col("n") / F.col("units")).alias("share"))


def three_states(yes: Column, no: Column) -> Column:
    """1 for yes only, 0 for no only, null for both or neither (aggregate)."""
    y, n = F.bool_or(yes), F.bool_or(no)
    return F.when(y & ~n, 1).when(n & ~y, 0)


def precision_recall(truth: Column, said: Column) -> list[Column]:
    """tp, fp, fn, tn, precision, recall, f1 of two boolean columns."""
    tp, fp, fn = F.count_if(truth & said), F.count_if(~truth & said), F.count_if(truth & ~said)
    p, r = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.count_if(~truth & ~said).alias("tn"), p.alias("precision"), r.alias("recall"), safe_div(2 * p * r, p + r).alias("f1")]


def complexity(df: DataFrame, unit: str, category: str) -> DataFrame:
    """unit, distinct, entropy, top, top_share, n: how mixed a unit's categories are; ties of the top by name."""
    n = df.groupBy(unit, category).agg(F.count("*").alias("n"))
    by = n.groupBy(unit).agg(F.collect_list("n").alias("each"), F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), F.col(category).alias("c"))).alias("first"))
    share = lambda x: x / F.col("total")
    return by.select(unit, F.size("each").alias("distinct"), entropy(F.transform("each", share)).alias("entropy"), F.col("first.c").alias("top"), (-F.col("first.m") / F.col("total")).alias("top_share"), F.col("total").alias("n"))


def preferred_mode(df: DataFrame, group: list[str], category: str, preferred: list[str], fallback: str = "unknown") -> DataFrame:
    """The most frequent preferred category of each group, ties in order of preference.

    Without a preferred one it is the most frequent of all, ties by name, and
    ``fallback`` where all are blank.
    """
    c = F.lower(F.trim(F.coalesce(F.col(category).cast("string"), F.lit(""))))
    n = df.select(*group, c.alias("_c")).groupBy(*group, "_c").agg(F.count("*").alias("_n"))
    place = F.array_position(F.array(*map(F.lit, preferred)), F.col("_c"))
    rank = F.when(F.col("_c") == "", 2).when(place > 0, 0).otherwise(1)
    best = F.min(F.struct(rank.alias("r"), (-F.col("_n")).alias("m"), place.alias("p"), F.col("_c").alias("c")))
    return n.groupBy(*group).agg(best.alias("b")).select(*group, F.when(F.col("b.r") == 2, fallback).otherwise(F.col("b.c")).alias("mode"))


def rollup_counts(df: DataFrame, levels: list[str], distinct: str, error: float = 0.02) -> DataFrame:
    """Counts at every level of a hierarchy in one pass: levels (null where rolled up), level, n, distinct estimate (HyperLogLog)."""
    out = df.rollup(*levels).agg(F.count("*").alias("n"), F.approx_count_distinct(distinct, error).alias("about"), F.grouping_id().alias("level"))
    return out.select(*levels, "level", "n", "about")


def tag_features(df: DataFrame, unit: str, tags: str, weight: str, relevant: Column, noise: Column, tag_names: list[str]) -> DataFrame:
    """unit, share of weight of each tag among relevant rows, of noise and of rows without tags, and the total weight."""
    w = F.col(weight)
    keep = relevant & ~noise
    sums = [F.sum(F.when(keep & F.array_contains(tags, t), w).otherwise(0.0)).alias(f"tag_{t}") for t in tag_names]
    untagged = keep & (F.size(tags) == 0)
    out = df.groupBy(unit).agg(F.sum(w).alias("total"), *sums, F.sum(F.when(relevant & noise, w).otherwise(0.0)).alias("noise"), F.sum(F.when(untagged, w).otherwise(0.0)).alias("missing"))
    return out.select(unit, "total", *[safe_div(F.col(f"tag_{t}"), F.col("total")).alias(f"tag_{t}") for t in tag_names], safe_div(F.col("noise"), F.col("total")).alias("noise_share"), safe_div(F.col("missing"), F.col("total")).alias("missing_share"))


def separation_score(df: DataFrame, group: str, category: str, sure: Column, likely: Column, weights: dict[str, tuple[float, float]]) -> DataFrame:
    """group, score: the rates of likely and of sure labels in each category, weighted (likely, sure) and added up."""
    score = F.lit(0.0)
    for name, (a, b) in weights.items():
        inside = F.col(category) == name
        n = F.count_if(inside)
        score = score + a * F.try_divide(F.count_if(inside & likely), n) + b * F.try_divide(F.count_if(inside & sure), n)
    return df.groupBy(group).agg(score.alias("score"))


def topk_columns(df: DataFrame, group: str, category: str, k: int) -> tuple[DataFrame, list[str]]:
    """group, top1 .. topk, other: counts of the k commonest categories (ties by name) and of all the rest; and the names."""
    names = [r[0] for r in df.groupBy(category).count().orderBy(F.desc("count"), category).limit(k).collect()]
    each = [F.count_if(F.col(category) == n).alias(f"top{i + 1}") for i, n in enumerate(names)]
    rest = F.count_if(~F.coalesce(F.col(category).isin(names), F.lit(False))) if names else F.count("*")
    return df.groupBy(group).agg(*each, rest.alias("other")), names
