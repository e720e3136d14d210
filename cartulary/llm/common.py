"""Shared plumbing of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.storage import drop_stash, release, stash, work_folder  # noqa: F401

#: Words as the contracts define them: maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of a batch that goes to a Python worker.
BATCH = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str, batch: int = BATCH) -> DataFrame:
    """A table of the inputs.

    Batches of whole texts would by default hold 64 MB each, several times over
    in the JVM and the worker, so the session's batches are made smaller.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator works on, with a null text as the empty one."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c) for c in more])
