"""Writers: Parquet, JSON lines, shards, summaries, review packets; Spark's commit protocol makes them atomic."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGES = ("corpus", "geo", "structure", "semantics", "embeddings", "clusters", "signature", "review", "story", "report")


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_shards(df: DataFrame, shard: str, line: str, path: str, order: str) -> None:
    """One folder per shard with the shard's lines in order: rows are dealt by shard and sorted within."""
    df.repartition(shard).sortWithinPartitions(shard, order).select(shard, F.col(line).alias("value")).write.mode("overwrite").partitionBy(shard).text(path)


def summary(df: DataFrame) -> str:
    """A one-row aggregate as sorted, indented JSON."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a summary is one row")
    return json.dumps(rows[0].asDict(recursive=True), indent=2, sort_keys=True, ensure_ascii=False, default=str)


def write_packet(df: DataFrame, item: str, path: str, questions: list[str], max_items: int = 200) -> None:
    """A review packet of at most ``max_items`` items: index, items, sheet with blank answers, empty event log."""
    rows = df.orderBy(item).limit(max_items + 1).cache()
    if rows.count() > max_items:
        raise ValueError(f"a packet has {max_items} items at most")
    rows.select(item).write.mode("overwrite").json(f"{path}/index")
    rows.write.mode("overwrite").partitionBy(item).json(f"{path}/items")
    rows.select(item, *[F.lit("").alias(q) for q in questions]).write.mode("overwrite").option("header", True).csv(f"{path}/sheet")
    rows.select(F.col(item), F.lit("").alias("event"), F.current_timestamp().alias("at")).limit(0).write.mode("overwrite").json(f"{path}/events")
    rows.unpersist()


def stage_path(root: str, stage: str, table: str) -> str:
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage}")
    return f"{root.rstrip('/')}/{stage}/{table}"
