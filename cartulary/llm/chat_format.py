"""Operator 7 [native]: chat formatting by schema fingerprint.

Records reach the operator in many layouts.  The sorted nested field paths of
a record (or of a table's schema) that any mapping knows are hashed; the hash
selects a declarative mapping that yields canonical turns (turn, role, text).
Turns are rendered with one template whose control strings are escaped inside
texts, and ``parse`` reads the turns and the loss mask back from the output.

Template of a turn: ``<s>`` role ``[INST]`` text ``</s>``; a turn to learn from
(role assistant) has ``[/INST]`` in place of ``[INST]``.  Escaping doubles each
backslash and puts one after the first character of any control string, so no
control string can occur in an escaped text, and unescaping drops the first of
every backslash pair.

Defined results: null roles and texts are empty; equal turn numbers are ordered
by role and text; null turn numbers come first; rows with a null conversation
id form one conversation; a record whose fingerprint no mapping has gets null
turns and layout ``unknown``; unknown extra fields don't change a fingerprint.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

OPEN, CLOSE, ASK, ANSWER = "<s>", "</s>", "[INST]", "[/INST]"
TURNS = "array<struct<turn:bigint,role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """A layout: its field paths and where turns are found.

    ``fixed``: (role, path) of one turn each, in order; ``listed``: path of an array with the names of its role and text fields;
    ``rows``: names of the key, turn, role and text columns of a table with a row for each turn.
    """

    name: str
    paths: tuple[str, ...]
    fixed: tuple[tuple[str, str], ...] = ()
    listed: tuple[str, str, str] | None = None
    rows: tuple[str, str, str, str] | None = None

    @property
    def fingerprint(self) -> str:
        return fingerprint_of(self.paths)


def fingerprint_of(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def _fixed(name: str, *turns: tuple[str, str]) -> Mapping:
    return Mapping(name, tuple(p for _, p in turns), fixed=turns)


def _listed(name: str, path: str, role: str, text: str) -> Mapping:
    return Mapping(name, (path, f"{path}[].{role}", f"{path}[].{text}"), listed=(path, role, text))


MAPPINGS: tuple[Mapping, ...] = (
    Mapping("turn_rows", ("conv_id", "turn", "role", "text"), rows=("conv_id", "turn", "role", "text")),
    _fixed("prompt_completion", ("user", "prompt"), ("assistant", "completion")),
    _fixed("prompt_response", ("user", "prompt"), ("assistant", "response")),
    _fixed("system_prompt_response", ("system", "system"), ("user", "prompt"), ("assistant", "response")),
    _fixed("question_answer", ("user", "question"), ("assistant", "answer")),
    _fixed("instruction_output", ("user", "instruction"), ("assistant", "output")),
    _fixed("instruction_input_output", ("user", "instruction"), ("user", "input"), ("assistant", "output")),
    _listed("messages", "messages", "role", "content"),
    Mapping("messages_empty", ("messages",), listed=("messages", "role", "content")),
    _listed("from_value", "conversations", "from", "value"),
    Mapping("from_value_empty", ("conversations",), listed=("conversations", "from", "value")),
)
#: Other names for the canonical roles.
ROLE_ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def schema_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Nested field paths of a table's schema; ``[]`` stands for the elements of an array."""
    out = []
    for f in schema.fields:
        kind, path = f.dataType, f"{prefix}{f.name}"
        out.append(path)
        while isinstance(kind, T.ArrayType):
            kind, path = kind.elementType, path + "[]"
        if isinstance(kind, T.StructType):
            out += schema_paths(kind, path + ".")
    return out


def select_mapping(schema: T.StructType, mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping | None:
    """The mapping of a table layout: the fingerprint of its known paths."""
    known = {p for m in mappings for p in m.paths}
    wanted = fingerprint_of(p for p in schema_paths(schema) if p in known)
    return next((m for m in mappings if m.fingerprint == wanted), None)


def record_fingerprint(record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """The fingerprint of a JSON record: SHA-256 of its sorted known field paths."""
    top = sorted({m.paths[0] if m.listed else p for m in mappings if not m.rows for p in m.paths if "[]" not in p})
    lists = sorted({m.listed[0] for m in mappings if m.listed})
    keys = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    paths = [F.array_intersect(keys, F.array(*map(F.lit, top)))]
    for path in lists:
        inner = F.coalesce(F.json_object_keys(F.get_json_object(record, f"$.{path}[0]")), F.array().cast("array<string>"))
        fields = sorted({f for m in mappings if m.listed and m.listed[0] == path for f in m.listed[1:]})
        held = F.filter(F.array(*map(F.lit, fields)), _among(inner))
        paths.append(F.split(F.array_join(F.concat(F.array(F.lit("")), held), f"\n{path}[]."), "\n"))
    return F.sha2(F.array_join(F.array_sort(F.array_remove(F.array_distinct(F.concat(*paths)), "")), "\n"), 256)


def canonical_records(df: DataFrame, id_col: str, record_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """id, layout, fingerprint, turns of rows that each hold one conversation as JSON."""
    rows = df.select(F.col(id_col).alias("conv_id"), F.col(record_col).alias("record"))
    rows = rows.withColumn("fingerprint", record_fingerprint(F.coalesce("record", F.lit("{}")), mappings))
    layout, turns = F.lit("unknown"), F.lit(None).cast(TURNS)
    for m in mappings:
        if m.rows:
            continue
        if m.listed:
            path, role, text = m.listed
            kind = f"array<struct<`{role}`:string,`{text}`:string>>"
            held = F.from_json("record", f"struct<`{path}`:{kind}>").getField(path)
            got = F.transform(F.coalesce(held, F.array().cast(kind)), _listed_turn(role, text))
        else:
            got = F.array(*[_turn(F.lit(i), F.lit(role), F.get_json_object("record", f"$.{path}")) for i, (role, path) in enumerate(m.fixed)])
        here = F.col("fingerprint") == m.fingerprint
        layout, turns = F.when(here, m.name).otherwise(layout), F.when(here, got).otherwise(turns)
    return rows.select("conv_id", layout.alias("layout"), "fingerprint", turns.alias("turns"))


def _among(names: Column):
    return lambda f: F.array_contains(names, f)


def _listed_turn(role: str, text: str):
    return lambda x, i: _turn(i, x.getField(role), x.getField(text))


def _turn(i: Column, role: Column, text: Column) -> Column:
    named = F.coalesce(role.cast("string"), F.lit(""))
    for alias, name in ROLE_ALIASES.items():
        named = F.when(named == alias, name).otherwise(named)
    return F.struct(i.cast("bigint").alias("turn"), named.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def canonical_turns(df: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """conv_id, layout, fingerprint, turns of a table whose schema fingerprint selects a mapping with rows."""
    m = select_mapping(df.schema, mappings)
    if m is None or not m.rows:
        raise ValueError(f"no mapping for the layout {sorted(schema_paths(df.schema))}")
    key, turn, role, text = m.rows
    rows = df.select(F.col(key).alias("conv_id"), F.struct(F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")).select("conv_id", F.lit(m.name).alias("layout"), F.lit(m.fingerprint).alias("fingerprint"), "turns")


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([<\[])(?=/?(?:s>|INST\]))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(turns: Column) -> Column:
    one = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.when(t["role"] == "assistant", ANSWER).otherwise(ASK), escape(t["text"]), F.lit(CLOSE))
    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """array<struct<role, text, learn>> read back from a rendered conversation."""
    turn = F.lit(r"(?s)<s>(.*?)(\[/?INST\])(.*?)</s>")
    role, mark, text = (F.regexp_extract_all(formatted, turn, F.lit(k)) for k in (1, 2, 3))
    return F.transform(F.arrays_zip(role.alias("r"), mark.alias("m"), text.alias("t")), lambda x: F.struct(unescape(x["r"]).alias("role"), unescape(x["t"]).alias("text"), (x["m"] == ANSWER).alias("learn")))


def format_conversations(canonical: DataFrame) -> DataFrame:
    """conv_id, layout, formatted."""
    return canonical.select("conv_id", "layout", render(F.col("turns")).alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The digest columns, all taken from the rendered text."""
    turns = F.col("parsed")
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter(turns, lambda t: t["learn"]), lambda t: t["text"]), "")
    rows = formatted.select("conv_id", parse(F.col("formatted")).alias("parsed"), F.length("formatted").cast("long").alias("formatted_chars"))
    rows = rows.select("conv_id", F.size("parsed").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), learnt.alias("learnt"), "formatted_chars")
    return rows.select("conv_id", "n_turns", "turns_sha256", F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


def query_op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_back(format_conversations(canonical_turns(rows.unionByName(probe))))


SQL_OP7 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(replace(role, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g')) AS role_chars,
         length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g')) AS text_chars FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(3 + role_chars + CASE WHEN role = 'assistant' THEN 7 ELSE 6 END + text_chars + 4) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
