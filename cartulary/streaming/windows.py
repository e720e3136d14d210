"""Event-time windows and latest state: the same code over a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """start, n, v of tumbling (or sliding) windows; ``late`` sets the watermark of a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late and events.isStreaming:
        rows = rows.withWatermark("ts", late)
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return rows.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("v")).select(F.col("w.start").alias("start"), "n", "v")


def once_per_id(rows: DataFrame, id_col: str, time_col: str, late: str) -> DataFrame:
    """Rows whose id was not seen before: resuming a stream skips what is done."""
    if rows.isStreaming:
        return rows.withWatermark(time_col, late).dropDuplicatesWithinWatermark([id_col])
    return rows.dropDuplicates([id_col])


def read_events(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def latest_state(batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: what a folded event log holds; use within foreachBatch for streams."""
    return batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("x")).select("x.*")
