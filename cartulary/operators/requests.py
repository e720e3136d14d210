"""Request shards, lenient parsing and validation of responses, worker plans."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shard_by_budget(df: DataFrame, item: str, size: str, max_rows: int, max_bytes: int, parts: int = 32) -> DataFrame:
    """item, shard: rows packed greedily in item order under a row and a byte budget.

    Packing is sequential within a range partition and partitions are packed side
    by side, so each starts a shard of its own; shard numbers follow item order.
    """
    rows = df.select(F.col(item).alias("item"), F.col(size).cast("long").alias("size")).repartitionByRange(parts, "item").sortWithinPartitions("item").withColumn("part", F.spark_partition_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, n, total = 0, 0, 0
        for b in batches:
            out = []
            for s in b.column(1).to_pylist():
                if n and (n >= max_rows or total + (s or 0) > max_bytes):
                    shard, n, total = shard + 1, 0, 0
                n, total = n + 1, total + (s or 0)
                out.append(shard)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.int64())], ["item", "part", "local"])

    kind = df.schema[item].dataType.simpleString()
    packed = rows.mapInArrow(pack, f"item {kind}, part int, local long")
    used = packed.groupBy("part").agg((F.max("local") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = used.select("part", before.alias("offset"))  # one row per range partition
    return packed.join(F.broadcast(offsets), "part").select(F.col("item").alias(item), (F.col("local") + F.col("offset")).alias("shard"))


def build_requests(df: DataFrame, stage: str, item: str, prompt: Column, model: str) -> DataFrame:
    """custom_id, request (JSON line) of each row; the id is stable: stage and item."""
    key = F.concat_ws("::", F.lit(stage), F.col(item).cast("string"))
    body = F.struct(F.lit(model).alias("model"), prompt.alias("input"))
    return df.select(F.col(item), key.alias("custom_id"), F.to_json(F.struct(key.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/responses").alias("url"), body.alias("body"))).alias("request"))


def rehydrate(mapping: DataFrame, responses: DataFrame, schema: str, checks: dict[str, str]) -> DataFrame:
    """Every mapped request with its parsed payload and ``reason``: ok, missing, empty, unparsable or a failed check."""
    last = responses.withColumn("_r", F.row_number().over(Window.partitionBy("custom_id").orderBy(F.desc("line")))).filter("_r = 1").select("custom_id", "text")
    j = mapping.join(last, "custom_id", "left").withColumn("payload", F.from_json(repair_json(F.col("text")), schema))
    reason = F.when(F.col("text").isNull(), "missing").when(F.trim("text") == "", "empty").when(F.col("payload").isNull(), "unparsable")
    for name, condition in checks.items():
        reason = reason.when(~F.coalesce(F.expr(condition), F.lit(False)), name)
    return j.withColumn("reason", reason.otherwise("ok"))


def _repair(text: str | None) -> str | None:
    """The largest JSON object of a text: fences, trailing commas, stray backslashes, missing ends mended."""
    if not text:
        return None
    best = None
    for begin in [m.start() for m in re.finditer(r"\{", text)][:64]:
        depth, quoted, stack, end = 0, False, [], len(text)
        k = begin
        while k < len(text):
            c = text[k]
            if quoted:
                if c == "\\":
                    k += 1
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c in "{[":
                stack.append("}" if c == "{" else "]")
                depth += 1
            elif c in "}]" and stack:
                stack.pop()
                depth -= 1
                if not depth:
                    end = k + 1
                    break
            k += 1
        body = text[begin:end]
        if stack:
            body = body.rstrip().rstrip("`").rstrip() + ('"' if quoted else "")
            body = re.sub(r"[,:]\s*$", "", body) + "".join(reversed(stack))
        for candidate in (body, re.sub(r",\s*([}\]])", r"\1", body), re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", re.sub(r",\s*([}\]])", r"\1", body))):
            try:
                found = json.loads(candidate, strict=False)
            except ValueError:
                continue
            if isinstance(found, dict) and (best is None or len(candidate) > len(best)):
                best = json.dumps(found, ensure_ascii=False)
            break
        if best is not None and len(best) >= (end - begin) // 2:
            break
    return best


@F.pandas_udf(T.StringType())
def repair_json(text: pd.Series) -> pd.Series:
    return text.map(_repair)


def unresolved(requests: DataFrame, results: DataFrame, errors: DataFrame) -> DataFrame:
    """Requests without a result; those with an error line are staged again as well."""
    done = results.select("custom_id").join(errors.select("custom_id"), "custom_id", "left_anti")
    return requests.join(done, "custom_id", "left_anti")


def assign_longest_first(sizes: dict[str, int], workers: int) -> dict[str, int]:
    """Item to worker: largest items first, each to the least loaded worker (ties: the lower number)."""
    heap = [(0, w) for w in range(workers)]
    out = {}
    for item, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, w = heapq.heappop(heap)
        out[item] = w
        heapq.heappush(heap, (load + size, w))
    return out


def proportional_quota(counts: dict[str, int], target: int) -> dict[str, int]:
    """Quota per group in proportion to its count: floors, then the largest remainders, never above the count."""
    total = sum(counts.values())
    if not total:
        return dict.fromkeys(counts, 0)
    exact = {g: min(c, target * c / total) for g, c in counts.items()}
    out = {g: int(x) for g, x in exact.items()}
    left = min(target, total) - sum(out.values())
    for g in sorted(exact, key=lambda g: (out[g] - exact[g], g)) * 2:
        if left <= 0:
            break
        if out[g] < counts[g]:
            out[g] += 1
            left -= 1
    return out
