"""Readers: formats in, DataFrames with fixed schemas out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.functions.text import clean_str

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header and quoted line breaks; ids stay strings because the schema says so."""
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def read_csv_members(spark: SparkSession, path: str, schema: T.StructType | str, column: str, members: DataFrame) -> DataFrame:
    """Rows of a CSV whose ``column`` is among the members (a one-column table): a semi join, broadcast while the set is small."""
    key = members.columns[0]
    return read_csv(spark, path, schema).join(members.select(F.col(key).alias(column)).distinct(), column, "left_semi")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines: blank lines and lines that aren't objects are skipped; .gz is read as it is."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rows = lines.filter(F.substring(F.trim("value"), 1, 1) == "{").select(F.from_json("value", schema).alias("r"))
    return rows.filter("r is not null").select("r.*")


def read_filter_list(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Distinct clean values of a column of a parquet, csv, tsv, jsonl or json file; fails if there are none."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind in ("csv", "tsv"):
        df = spark.read.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    elif kind in ("json", "jsonl"):
        df = spark.read.option("multiLine", kind == "json").json(path)
    else:
        raise ValueError(f"unknown kind of list: {path}")
    out = df.select(clean_str(column).alias(column)).filter(F.col(column) != "").distinct()
    if out.isEmpty():
        raise ValueError(f"{path} holds no {column}")
    return out


def read_shards(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All shards of a glob with the shard number of the file name and the line's place in it."""
    rows = spark.read.schema(schema).json(pattern).select("*", F.col("_metadata.file_name").alias("_f"))
    return rows.withColumn("shard", F.regexp_extract("_f", r"(\d+)[^\d]*$", 1).try_cast("int")).drop("_f")


def join_bundle(metadata: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Metadata with its details; a row without details is an error when the result is read."""
    d = details.withColumn("_there", F.lit(True))
    j = metadata.join(d, key, "left")
    return j.filter(F.coalesce(F.col("_there"), F.raise_error(F.concat(F.lit("no details for "), F.col(key).cast("string"))).cast("boolean"))).drop("_there")


def canonical_text(status: Column, text: Column, raw: Column) -> Column:
    """Text by status: ok and repaired take the text, raw_only the raw one, else whatever there is."""
    return F.when(status == "raw_only", raw).when(status.isin("ok", "repaired", "repaired_from_raw"), text).otherwise(F.coalesce(F.when(text != "", text), raw))


def parse_page_id(page_id: Column) -> Column:
    """struct<slug, date, issue_id, page_num> of ``<slug>-<mon>-<dd>-<yyyy>-p-<n>``; null if malformed."""
    pattern = r"^(.+)-([a-z]{3})-(\d{2})-(\d{4})-p-(\d+)$"
    g = lambda k: F.regexp_extract(page_id, pattern, k)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), g(2)).cast("string")
    date = F.try_to_date(F.concat_ws("-", g(4), F.lpad(month, 2, "0"), g(3)))
    out = F.struct(g(1).alias("slug"), date.alias("date"), F.concat_ws("__", g(1), date.cast("string")).alias("issue_id"), g(5).try_cast("int").alias("page_num"))
    return F.when(page_id.rlike(pattern) & date.isNotNull(), out)


def boxes_to_text(boxes: Column) -> Column:
    """Text of array<struct<id, status, text>>: by the id's trailing number, without unreadable or blank boxes."""
    keyed = F.transform(boxes, lambda b: F.struct(F.regexp_extract(b["id"], r"(\d+)$", 1).try_cast("int").alias("n"), b["id"].alias("id"), b["status"].alias("status"), F.trim(b["text"]).alias("text")))
    good = F.filter(keyed, lambda b: (b["text"] != "") & ~F.coalesce(b["status"], F.lit("")).isin("unreadable", "error", "blank"))
    return F.array_join(F.transform(F.array_sort(good), lambda b: b["text"]), "\n\n")


def best_text(pages: DataFrame, providers: list[tuple[str, DataFrame]], key: str = "page_id") -> DataFrame:
    """Each page with the first non-blank text of the providers (name, table with key and text), in their order."""
    out = pages
    for i, (_, t) in enumerate(providers):
        out = out.join(t.groupBy(key).agg(F.max("text").alias(f"_t{i}")), key, "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    text = F.coalesce(*[F.when(~blank(F.col(f"_t{i}")), F.col(f"_t{i}")) for i in range(len(providers))])
    source = F.coalesce(*[F.when(~blank(F.col(f"_t{i}")), F.lit(n)) for i, (n, _) in enumerate(providers)], F.lit("missing"))
    return out.select(*pages.columns, text.alias("text"), source.alias("text_source"))


def parse_contract(reply: Column) -> Column:
    """struct<source, text, notes, contract_ok> of a SOURCE / TEXT / NOTES reply."""
    pattern = r"(?s)^\s*SOURCE:\s*(.*?)\n\s*TEXT:\s*(.*?)\n\s*NOTES:\s*(.*)$"
    g = lambda k: F.trim(F.regexp_extract(reply, pattern, k))
    return F.struct(g(1).alias("source"), g(2).alias("text"), g(3).alias("notes"), reply.rlike(pattern).alias("contract_ok"))
