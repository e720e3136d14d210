"""Text segmentation: one text to many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.functions import rules, text as fx
from cartulary.functions.text import collapse, section_kind


def is_heading(line: Column, before_blank: Column, after_blank: Column) -> Column:
    """Article or section lines, capitals next to a blank line, short title-case lines between blank lines."""
    s = F.trim(line)
    titled = ~s.rlike(r"[A-Za-z][A-Z]|(^|[^A-Za-z])[a-z]")
    return (s != "") & (
        s.rlike(f"(?i){rules.ARTICLE_HEADING}")
        | s.rlike(f"(?i){rules.SECTION_HEADING}")
        | ((F.length(s) <= 140) & s.rlike(rules.CAPS_HEADING) & (before_blank | after_blank))
        | (before_blank & after_blank & (F.size(F.split(s, r"\s+")) <= 12) & titled & s.rlike("[A-Za-z]"))
    )


def sections(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section_index, heading, kind, start_line, end_line, text of every section.

    Headings start sections and a text's first line always does.  The lines of a
    text stay in its row's task order: the only shuffle is by document.
    """
    lines = df.select(F.col(id_col).alias("doc_id"), F.split(collapse(text_col), "\n").alias("lines"))
    # Each line goes with its neighbours' state, so that no row carries all lines.
    blank = F.concat(F.array(F.lit(True)), F.transform("lines", lambda x: F.trim(x) == ""), F.array(F.lit(True)))
    lines = lines.select("doc_id", F.posexplode(F.arrays_zip("lines", F.slice(blank, F.lit(1), F.size("lines")).alias("before"), F.slice(blank, F.lit(3), F.size("lines")).alias("after"))).alias("i", "x"))
    line = F.col("x.lines")
    marked = lines.select("doc_id", "i", line.alias("line"), ((F.col("i") == 0) | is_heading(line, F.col("x.before"), F.col("x.after"))).cast("int").alias("starts"), is_heading(line, F.lit(True), F.lit(False)).alias("heads"))
    number = F.sum("starts").over(Window.partitionBy("doc_id").orderBy("i"))
    parts = marked.withColumn("section_index", number).groupBy("doc_id", "section_index").agg(F.array_sort(F.collect_list(F.struct("i", "line", "heads"))).alias("l"), F.min("i").alias("lo"), F.max("i").alias("hi"))
    join = lambda a: collapse(F.array_join(F.transform(a, lambda x: x["line"]), "\n"))
    whole, first = join(F.col("l")), F.get("l", F.lit(0))
    body = F.when(first["heads"], join(F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0))))).otherwise(whole)
    heading = F.left(F.trim(first["line"]), F.lit(240))
    out = parts.select("doc_id", F.col("section_index").cast("long"), heading.alias("heading"), (F.col("lo") + 1).cast("long").alias("start_line"), (F.col("hi") + 1).cast("long").alias("end_line"), F.when(body == "", whole).otherwise(body).alias("text"))
    return out.withColumn("section_kind", section_kind(F.col("heading"), F.col("text")))


def clauses(text: Column) -> Column:
    """array<string>: clauses of a section, by enumerators or else by sentence ends, cleaned, without repeats."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    grouped = F.aggregate(
        lines,
        F.array().cast("array<string>"),
        lambda acc, x: F.when((F.size(acc) > 0) & ~x.rlike(rules.ENUMERATOR), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat_ws(" ", F.get(acc, F.size(acc) - 1), x)))).otherwise(F.concat(acc, F.array(x))),
    )
    pieces = F.when(F.size(grouped) <= 1, F.split(collapse(text), rules.SENTENCE_END)).otherwise(grouped)
    tidy = F.transform(pieces, lambda x: F.regexp_replace(F.regexp_replace(collapse(x), rules.ENUMERATOR, ""), r"^[ \-:;]+|[ \-:;]+$", ""))
    return F.array_distinct(F.filter(tidy, lambda x: (F.length(x) >= 25) & (x.rlike(f"(?i){rules.CLAUSE_MODAL}") | (F.size(F.split(x, r"\s+")) >= 10))))


def packed_chunks(text: Column, limit: int) -> Column:
    """array<string>: paragraphs packed greedily into chunks of at most ``limit`` characters; long ones are cut hard."""
    paragraphs = F.filter(F.transform(F.split(collapse(text), r"\n\n"), lambda x: F.trim(x)), lambda x: x != "")
    cut = F.flatten(F.transform(paragraphs, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / limit).cast("int")), lambda k: F.substring(p, k * limit + 1, F.lit(limit)))))
    return F.aggregate(
        cut,
        F.array().cast("array<string>"),
        lambda acc, p: F.when((F.size(acc) > 0) & (F.length(F.get(acc, F.size(acc) - 1)) + F.length(p) + 2 <= limit), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat_ws("\n\n", F.get(acc, F.size(acc) - 1), p)))).otherwise(F.concat(acc, F.array(p))),
    )


def embedding_chunks(text: Column, limit: int = 12_000) -> Column:
    """array<string>: paragraphs packed greedily; a longer one is cut at the last space past half the limit, else hard."""
    body = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\x0b\x0c"))
    tidy = lambda x: F.trim(x, F.lit(" \t\n\r\x0b\x0c"))
    paragraphs = F.filter(F.transform(F.split(body, r"\n\s*\n"), tidy), lambda x: x != "")
    state = "struct<rest:string,pieces:array<string>>"

    def cut(s: Column, _: Column) -> Column:
        rest = s["rest"]
        window = F.left(rest, F.lit(limit))
        space = F.length(window) - F.instr(F.reverse(window), " ")
        at = F.when((F.instr(window, " ") == 0) | (space < limit // 2), F.lit(limit)).otherwise(space)
        piece = tidy(F.substr(rest, F.lit(1), at))
        left = F.struct(tidy(F.substr(rest, at + 1)).alias("rest"), F.when(piece != "", F.concat(s["pieces"], F.array(piece))).otherwise(s["pieces"]).alias("pieces"))
        return F.when(F.length(rest) > limit, left.cast(state)).otherwise(s)

    def pieces(p: Column) -> Column:
        first = F.struct(p.alias("rest"), F.array().cast("array<string>").alias("pieces")).cast(state)
        turns = F.sequence(F.lit(0), F.floor(F.length(p) / max(1, limit // 2)).cast("int"))
        # Only the last piece of a paragraph may be joined with the next paragraph.
        return F.aggregate(turns, first, cut, lambda s: F.struct(s["pieces"].alias("closed"), s["rest"].alias("open")))

    kind = "struct<done:array<string>,now:string>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now")).cast(kind)

    def pack(s: Column, p: Column) -> Column:
        joined = F.when(s["now"] == "", p).otherwise(F.concat_ws("\n\n", s["now"], p))
        parts = pieces(p)
        closed = F.concat(F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))), parts["closed"])
        return F.when(F.length(joined) <= limit, F.struct(s["done"].alias("done"), joined.alias("now")).cast(kind)).otherwise(F.struct(closed.alias("done"), parts["open"].alias("now")).cast(kind))

    packed = F.aggregate(paragraphs, start, pack, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))
    return F.when(F.size(packed) > 0, packed).otherwise(F.array(body))


def transcript(df: DataFrame, key: str, place: str, role: str, text: str) -> DataFrame:
    """One text per key out of its ordered pages or turns."""
    block = F.struct(F.col(place).alias("p"), F.concat(F.lit("=== "), F.coalesce(F.col(role), F.lit("")), F.lit(" ===\n"), F.coalesce(F.col(text), F.lit(""))).alias("b"))
    return df.groupBy(key).agg(F.array_sort(F.collect_list(block)).alias("x")).select(key, F.array_join(F.transform("x", lambda b: b["b"]), "\n").alias("transcript"))


def parse_transcript(df: DataFrame, key: str, transcript_col: str) -> DataFrame:
    """The blocks of a transcript as rows: the inverse of ``transcript``."""
    pattern = F.lit(r"(?s)=== ([^=\n]*) ===\n(.*?)(?=\n=== [^=\n]* ===\n|\z)")
    both = F.arrays_zip(F.regexp_extract_all(transcript_col, pattern, F.lit(1)).alias("role"), F.regexp_extract_all(transcript_col, pattern, F.lit(2)).alias("text"))
    return df.select(key, F.posexplode(both).alias("place", "b")).select(key, F.col("place").cast("long"), "b.role", "b.text")


def spec_problems(df: DataFrame, key: str, start: str, end: str, last_line: str) -> DataFrame:
    """Why a list of line ranges isn't a contiguous cover of 1..last_line: gap, overlap, start, end; none if it is."""
    before = F.lag(end).over(Window.partitionBy(key).orderBy(start, end))
    rows = df.withColumn("_b", before)
    return rows.groupBy(key).agg(
        F.count_if(F.col(start) > F.col("_b") + 1).alias("gaps"), F.count_if(F.col(start) <= F.col("_b")).alias("overlaps"), (F.min(start) != 1).alias("bad_start"), (F.max(end) != F.max(last_line)).alias("bad_end")
    )


def repair_specs(df: DataFrame, key: str, start: str, end: str, last_line: str, slack: int = 1, head: int = 3) -> DataFrame:
    """key, start, end, number, status: line ranges made a contiguous cover of 1..last_line where that takes little.

    By start: a first range that begins by line ``head`` is moved to 1, gaps and
    tails of up to ``slack`` lines go to the range before them.  Overlaps, empty
    ranges, larger gaps and tails reject all ranges of the key.  Statuses:
    ``ok``, ``repaired``, ``rejected``.
    """
    rows = df.select(key, F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"), F.col(last_line).cast("long").alias("last"))
    order = Window.partitionBy(key).orderBy("s", "e")
    rows = rows.select("*", F.row_number().over(order).alias("number"), F.lag("e").over(order).alias("before"), F.lead("s").over(order).alias("next"))
    gap = F.when(F.col("before").isNull(), F.when(F.col("s") <= head, 0).otherwise(slack + 1)).otherwise(F.col("s") - F.col("before") - 1)
    tail = F.when(F.col("next").isNull(), F.col("last") - F.col("e")).otherwise(0)
    bad = (F.col("e") < F.col("s")) | (gap < 0) | (gap > slack) | (tail < 0) | (tail > slack)
    changed = (gap != 0) | (tail != 0) | (F.col("before").isNull() & (F.col("s") != 1))
    every = Window.partitionBy(key)
    status = F.when(F.max(bad.cast("int")).over(every) == 1, "rejected").when(F.max(changed.cast("int")).over(every) == 1, "repaired").otherwise("ok")
    first = F.when(F.col("before").isNull(), F.lit(1)).otherwise(F.col("s"))
    last = F.when(F.col("next").isNull(), F.col("last")).otherwise(F.col("next") - 1)
    kept = status != "rejected"
    return rows.select(key, F.when(kept, first).otherwise(F.col("s")).cast("long").alias("start"), F.when(kept, last).otherwise(F.col("e")).cast("long").alias("end"), F.col("number").cast("long").alias("number"), status.alias("status"))


def purpose_lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, motive, description, evidence, confidence: a row per line that states a purpose, or else of the first lines."""
    rows = df.select(*keys, fx.purpose_candidates(F.col(text)).alias("_lines"))
    rows = rows.withColumn("_codes", fx.best_motives(F.transform("_lines", lambda x: F.lower(x))))
    found = fx.purpose_lines(F.col("_lines"), F.col("_codes"))
    return rows.select(*keys, F.explode_outer(found).alias("_x")).filter("_x is not null").select(*keys, "_x.*")  # a plain explode would evaluate them twice
