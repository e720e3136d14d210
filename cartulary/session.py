"""Sessions: the settings the engine is written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | None = None, partitions: int | None = None, memory: str = "4g") -> SparkSession:
    """A session on this machine, for tests and benchmarks; on a cluster only SETTINGS matter."""
    n = cpus or os.cpu_count() or 1
    builder = SparkSession.builder.master(f"local[{n}]").config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions or n))
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
