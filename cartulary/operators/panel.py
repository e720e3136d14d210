"""Ordered analytics: ranks, quartiles, dense grids, differences, events, merges by precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= k)


def rank_quartile(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Quartile (1..4) of the position by linear quantile edges of 1..n, which isn't ntile when 4 doesn't divide n."""
    i, n = F.row_number().over(Window.partitionBy(*group).orderBy(*order)), F.count("*").over(Window.partitionBy(*group))
    share = (i - 1) / (n - 1)
    return df.withColumn("quartile", F.when(n == 1, 1).otherwise(F.greatest(F.lit(1), F.ceil(share * 4))).cast("int"))


def step_fill(df: DataFrame, unit: str, at: str, value: str) -> DataFrame:
    """A row for each integer ``at`` between a unit's first and last, values carried forward, ``observed`` 0/1."""
    span = df.groupBy(unit).agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    grid = span.select(unit, F.explode(F.sequence("lo", "hi")).alias(at))
    order = Window.partitionBy(unit).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(df, [unit, at], "left").select(unit, at, F.last(value, ignorenulls=True).over(order).alias(value), F.col(value).isNotNull().cast("int").alias("observed"))


def differences(df: DataFrame, unit: str, at: str, value: str) -> DataFrame:
    before = F.lag(value).over(Window.partitionBy(unit).orderBy(at))
    return df.select("*", (F.col(value) - before).alias("change"))


def event_time(df: DataFrame, unit: str, at: str, happened: Column) -> DataFrame:
    """treated (ever), post and event_time from the first ``at`` where the condition holds."""
    first = F.min(F.when(happened, F.col(at))).over(Window.partitionBy(unit))
    rows = df.withColumn("first_event", first)
    return rows.withColumns({"treated": F.col("first_event").isNotNull().cast("int"), "post": F.coalesce((F.col(at) >= F.col("first_event")).cast("int"), F.lit(0)), "event_time": F.col(at) - F.col("first_event")})


def precedence_merge(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key: the first by ``order``."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")


def batches(df: DataFrame, order: list[Column], size: int, parts: int = 256) -> DataFrame:
    """batch and place of each row in a global order of batches of ``size`` rows.

    Rows are range-partitioned and numbered within partitions; the partitions'
    sizes (``parts`` numbers) give the offsets, so nothing is ordered in one task.
    """
    ranged = df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id())
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    sizes = ranged.groupBy("_p").count()
    offset = F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_p", offset.alias("_o"))
    at = F.col("_o") + F.col("_n") - 1
    return ranged.withColumn("_n", local).join(F.broadcast(offsets), "_p").select(*df.columns, F.floor(at / size).alias("batch"), (at % size).alias("place"))


def union_unique(frames: list[DataFrame], key: str) -> DataFrame:
    """All rows of the frames; a key that occurs twice fails the job.

    Counted by a grouped aggregate with map-side sums, so a hot key shows early and moves nothing.
    """
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    twice = out.groupBy(key).agg(F.count("*").alias("_n"))
    failure = F.raise_error(F.concat(F.lit("repeated key: "), F.col(key).cast("string"))).cast("boolean")
    return out.join(twice.filter(F.when(F.col("_n") > 1, failure).otherwise(True)), key).drop("_n")


def balanced_sample(df: DataFrame, group: str, half: Column, each: int, order: Column) -> DataFrame:
    """Up to ``each`` rows of every group from each half (a condition, such as single or several pages), first by ``order``."""
    place = F.row_number().over(Window.partitionBy(group, "_half").orderBy(order))
    return df.withColumn("_half", half).withColumn("_r", place).filter(F.col("_r") <= each).drop("_half", "_r")


def coverage_sample(df: DataFrame, group: str, item: str, features: dict[str, float], bonus: str, quota: int) -> DataFrame:
    """group, item, place: rows picked one by one, each the most novel left.

    A feature value not yet picked in the group scores its weight, one picked n times
    1 / (1 + n); ``bonus`` adds a small score of its own.  Ties go to values picked
    less often, then to the larger item.  What a pick can add depends only on its
    feature values, bonus and item, so of rows with equal values only the best
    ``quota`` by bonus and item can be picked: a group's task holds at most
    ``quota`` rows per combination of values.
    """
    names = list(features)
    order = Window.partitionBy(group, *names).orderBy(F.desc(bonus), F.desc(item))
    rows = df.select(group, item, *names, bonus).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= quota).drop("_r")

    def pick(t):
        import pandas as pd

        left = t.to_dict("records")
        seen: dict[tuple, int] = {}
        out = []
        while left and len(out) < quota:
            counts = [[seen.get((f, r[f]), 0) for f in names] for r in left]
            score = [(sum(features[f] if not c else 1 / (1 + c) for f, c in zip(names, n, strict=True)) + r[bonus], *[-c for c in n], r[item]) for r, n in zip(left, counts, strict=True)]
            best = left.pop(max(range(len(left)), key=score.__getitem__))
            for f in names:
                seen[(f, best[f])] = seen.get((f, best[f]), 0) + 1
            out.append((best[group], best[item], len(out) + 1))
        return pd.DataFrame(out, columns=[group, item, "place"])

    kind = lambda c: df.schema[c].dataType.simpleString()
    return rows.groupBy(group).applyInPandas(pick, f"{group} {kind(group)}, {item} {kind(item)}, place int")
