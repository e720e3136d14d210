"""Corpus pipeline: five of the operators over ``documents``, each stage written and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartulary.llm.byte_bpe import stage_encode
from cartulary.llm.common import stash, table
from cartulary.llm.line_dedup import stage_line_dedup
from cartulary.llm.mixing import stage_mixing
from cartulary.llm.simhash import stage_near_duplicates
from cartulary.llm.toxicity import stage_toxicity

STAGES = [
    ("toxicity", stage_toxicity),
    ("line_dedup", stage_line_dedup),
    ("near_duplicates", stage_near_duplicates),
    ("mixing", stage_mixing),
    ("byte_bpe", stage_encode),
]

#: Learnt scores, near-duplicate components and a fitted mixture have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs, f"pipeline-{name}")
    return docs
