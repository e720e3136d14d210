"""Queries that run the whole taxonomy: tags, signals, purposes, sections, numbers, references, gaps.

Their texts are composed from sentences of the field, chosen by a part's key, so
that every rule has something to find; the statements compose the same texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions import rules, text as fx
from cartulary.operators import segment

from .catalog import query, table

SENTENCES = (
    "WHEREAS the council finds it is the purpose of this ordinance to promote health, safety and the general welfare.",
    "No building in the R-1 or C 2 district shall exceed a height of 35 feet or three stories.",
    "The minimum lot area shall be 7,500 square feet and the lot width shall be at least 60 feet.",
    "Front yard setback of 25 feet; side yard of 8 ft.; rear yard of 30 feet, except as provided in Section 12.",
    "A public hearing will be held by the planning commission on the proposed zoning map change from R-2 to M-1.",
    "Any person who violates this chapter is guilty of a violation and subject to a fine of $500.",
    "Notice is hereby given that a copy may be examined and is available for public inspection.",
    "The board of appeals may grant a variance or special exception pursuant to article IV.",
    "Off-street parking: each use shall provide parking of 2 spaces, unless the zoning administrator approves less.",
    "[MISSING TEXT: the next newspaper page is not attached] continued on page 4",
    "Continued from page 3 [MISSING TEXT: illegible]",
    "Signs means any billboard or device; a nonconforming sign must not be enlarged.",
    "This ordinance shall take effect upon publication, and the effective date is January 1, 1962.",
    "Final plat approval is required before subdivision of land for mobile home park or planned unit development.",
    "The owner shall file an application; the building inspector shall issue a use permit if the site plan complies.",
    "The council meeting minutes were approved and the motion carried to keep the residential character and tax base.",
)
TITLES = ("Article IV: General Rules (as amended) of Use", "SECTION 12 - Signs and Billboards", "", "Chapter 3 Definitions; Terms", "Board of Adjustment Powers and Duties of the Clerk", "(reserved)")
#: The sentences of a text: multiplier and offset of the part's key.
PLACES = ((1, 0), (7, 3), (5, 1), (11, 6))


def texts(spark, sf_dir, spread: bool = False) -> DataFrame:
    """p_partkey, title, text; ``spread`` deals the rows to three tasks a core at least."""
    k = F.col("p_partkey")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    lines = [pick(SENTENCES, (k * a + b) % len(SENTENCES)) for a, b in PLACES]
    part = table(spark, sf_dir, "part").select("p_partkey")
    if spread:
        part = part.repartition(max(part.rdd.getNumPartitions(), 3 * spark.sparkContext.defaultParallelism), "p_partkey")
    return part.select("p_partkey", pick(TITLES, k % len(TITLES)).alias("title"), F.concat_ws("\n", *lines).alias("text"))


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


TEXTS = f"t AS (SELECT p_partkey, {_list(TITLES)}[1 + p_partkey % {len(TITLES)}] AS title, concat_ws(chr(10), {', '.join(f'{_list(SENTENCES)}[1 + (p_partkey * {a} + {b}) % {len(SENTENCES)}]' for a, b in PLACES)}) AS text FROM part)"


def _hit(pattern: str, column: str = "text") -> str:
    return f"regexp_matches({column}, '{pattern}', 'i')"


def _families(families: dict[str, tuple[str, ...]]) -> str:
    each = ", ".join(f"CASE WHEN {_hit('|'.join(f'(?:{p})' for p in patterns))} THEN '{name}' END" for name, patterns in families.items())
    return f"array_to_string(list_sort(list_filter([{each}], lambda x: x IS NOT NULL)), '|')"


def _motive_scores(column: str) -> str:
    """A list of structs of motives that score, best first, as SQL."""
    each = []
    for k, (motive, needles) in enumerate(rules.MOTIVE_NEEDLES.items()):
        score = " + ".join(f"CAST(contains(lower({column}), '{n}') AS INTEGER)" for n in needles)
        each.append(f"{{'minus': -({score}), 'place': {k}, 'motive': '{motive}'}}")
    return f"list_sort(list_filter([{', '.join(each)}], lambda x: x.minus < 0))"


def _motive(column: str) -> str:
    s = _motive_scores(column)
    return f"CASE WHEN len({s}) > 0 THEN {s}[1].motive WHEN {_hit(rules.PURPOSE, column)} THEN 'other' ELSE 'unclear' END"


def _needles(column: str, labelled, default: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({column}), '{n}') THEN '{label}'" for n, label in labelled) + f" ELSE '{default}' END"


def _patterns(column: str, labelled, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {_hit(p, column)} THEN '{label}'" for label, p in labelled) + f" ELSE '{default}' END"


def _section_kind(column: str) -> str:
    out = "CASE "
    for kind, some, every in rules.SECTION_KINDS:
        needs = [f"contains(lower({column}), '{n}')" for n in every]
        if some:
            needs.append("(" + " OR ".join(f"contains(lower({column}), '{n}')" for n in some) + ")")
        out += f"WHEN {' AND '.join(needs)} THEN '{kind}' "
    return out + "ELSE 'other' END"


@query(
    "mechanics_tags",
    f"""
    WITH {TEXTS}, c AS (SELECT *, {_hit(rules.ZONING_CONTEXT)} AS ok FROM t),
    d AS (SELECT *, list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(text, '{rules.DISTRICT_TOKEN}', 0, 'i'), lambda x: upper(x)),
              list_transform(regexp_extract_all(text, '{rules.DISTRICT_CODE}', 0, 'i'), lambda x: upper(regexp_replace(x, '^([rcim])\\s*-?\\s*([0-9]+)$', '\\1-\\2', 'i')))))) AS codes FROM c)
    SELECT p_partkey, CASE WHEN ok THEN {_families(rules.ACTION_TAGS)} ELSE '' END AS action_tags, CASE WHEN ok THEN {_families(rules.DIMENSION_TAGS)} ELSE '' END AS dimension_tags,
           CASE WHEN ok THEN {_families(rules.INSTRUMENT_TAGS)} ELSE '' END AS instrument_tags, CASE WHEN ok THEN array_to_string(codes[1:20], '|') ELSE '' END AS district_tokens
    FROM d
    """,
)
def mechanics_tags(spark, sf_dir):
    return texts(spark, sf_dir).select("p_partkey", *[F.array_join(x, "|").alias(n) for n, x in fx.mechanics(F.col("text")).items()])


@query("signal_regexes", f"WITH {TEXTS} SELECT p_partkey, {', '.join(f'CAST({_hit(p)} AS INTEGER) AS {n}' for n, p in rules.SIGNALS.items())} FROM t")
def signal_regexes(spark, sf_dir):
    return texts(spark, sf_dir).select("p_partkey", *[x.alias(n) for n, x in fx.signals(F.col("text")).items()])


@query("reference_counts", f"WITH {TEXTS} SELECT p_partkey, {', '.join(f'''CAST(len(regexp_extract_all(text, '{p}', 0, 'i')) AS BIGINT) AS {n}''' for n, p in rules.REFERENCES.items())} FROM t")
def reference_counts(spark, sf_dir):
    return texts(spark, sf_dir).select("p_partkey", *[x.alias(n) for n, x in fx.reference_counts(F.col("text")).items()])


@query(
    "numbers_found",
    f"WITH {TEXTS} "
    + " UNION ALL ".join(
        f"SELECT p_partkey, '{n}' AS feature, unnest(regexp_extract_all(text, '{p}', 1, 'i')) AS raw, unnest(regexp_extract_all(text, '{p}', 2, 'i')) AS unit, unnest(list_transform(regexp_extract_all(text, '{p}', 1, 'i'), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE))) AS value FROM t" for n, p in rules.NUMBERS.items()
    ),
)
def numbers_found(spark, sf_dir):
    x = texts(spark, sf_dir).select("p_partkey", F.explode(fx.numbers_found(F.col("text"))).alias("x"))
    return x.select("p_partkey", "x.feature", "x.raw", "x.unit", fx.parse_number("x.raw").alias("value"))


@query(
    "sentence_semantics",
    f"""
    WITH {TEXTS}, s AS (SELECT p_partkey, title, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM t),
    k AS (SELECT *, title || chr(10) || line AS sample FROM s)
    SELECT p_partkey, CAST(place - 1 AS INTEGER) AS place, {_section_kind("sample")} AS section_kind, {_patterns("line", rules.MODALITIES, "other")} AS modality, {_motive("line")} AS motive,
           {_needles("line", rules.INSTRUMENTS, "general_rule")} AS instrument, {_patterns("line", rules.ACTORS, "unknown")} AS actor, {_patterns("line", rules.TARGETS, "general")} AS target
    FROM k
    """,
)
def sentence_semantics(spark, sf_dir):
    s = texts(spark, sf_dir).select("p_partkey", "title", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    line = F.col("line")
    return s.select(
        "p_partkey",
        "place",
        fx.section_kind(F.col("title"), line).alias("section_kind"),
        fx.modality(line).alias("modality"),
        F.get(fx.motives(line), F.lit(0))["motive"].alias("motive"),
        fx.first_needle(line, rules.INSTRUMENTS, "general_rule").alias("instrument"),
        fx.first_match(line, rules.ACTORS, "unknown").alias("actor"),
        fx.first_match(line, rules.TARGETS, "general").alias("target"),
    )


@query(
    "purpose_lines",
    f"""
    WITH {TEXTS}, l AS (SELECT p_partkey, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM t),
    c AS (SELECT p_partkey, CASE WHEN len(list_filter(lines, lambda x: {_hit(rules.PURPOSE, 'x')} OR contains(lower(x), 'general welfare'))) > 0 THEN list_filter(lines, lambda x: {_hit(rules.PURPOSE, 'x')} OR contains(lower(x), 'general welfare')) ELSE lines[1:5] END AS lines FROM l),
    e AS (SELECT p_partkey, unnest(lines[1:8]) AS line, generate_subscripts(lines[1:8], 1) AS i FROM c), m AS (SELECT *, {_motive("line")} AS motive, {_motive_scores("line")} AS s FROM e),
    f AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, motive, left(line, 80) ORDER BY i) AS k FROM m)
    SELECT p_partkey, motive, left(line, 300) AS evidence, round(least(CAST(0.95 AS DOUBLE), 0.35 + 0.15 * CASE WHEN len(s) > 0 THEN -s[1].minus ELSE 1 END), 6) AS confidence FROM f WHERE k = 1
    """,
)
def purpose_lines(spark, sf_dir):
    # Small files are few tasks, and the rules cost far more than moving the keys.
    x = segment.purpose_lines(texts(spark, sf_dir, spread=True), ["p_partkey"], "text")
    return x.select("p_partkey", "motive", "evidence", F.round("confidence", 6).alias("confidence"))


@query(
    "architecture_anchors",
    f"""
    WITH {TEXTS}, a AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_split_to_array(regexp_replace(lower(title), '\\([^)]*\\)', ' ', 'g'), '[:;—-]')[1], '[^a-z0-9\\s]+', ' ', 'g'), '{rules.ANCHOR_WORDS}', ' ', 'g'), '\\s+', ' ', 'g')) AS s FROM t)
    SELECT p_partkey, CASE WHEN s = '' THEN 'unknown' ELSE array_to_string(string_split(s, ' ')[1:5], ' ') END AS anchor FROM a
    """,
)
def architecture_anchors(spark, sf_dir):
    return texts(spark, sf_dir).select("p_partkey", fx.architecture_anchor(F.col("title")).alias("anchor"))


def _edge(pattern: str, which: str) -> str:
    """Counts matches near an edge of the text, as SQL, from the lengths of the pieces around them."""
    found, gaps = f"regexp_extract_all(text, '{pattern}', 0, 'i')", f"regexp_split_to_array(regexp_replace(text, '{pattern}', chr(1), 'gi'), chr(1))"
    start = f"list_sum(list_transform({gaps}[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform({found}[1:i - 1], lambda f: length(f))), 0)"
    at = start if which == "start" else f"length(text) - ({start} + length({found}[i]))"
    return f"CAST(len(list_filter(range(1, len({found}) + 1), lambda i: ({at}) <= 500 OR ({at}) / greatest(length(text), 1) <= 0.05)) AS INTEGER)"


@query(
    "gap_audit",
    f"""
    WITH {TEXTS}, h AS (SELECT p_partkey, text, regexp_extract_all(text, '{rules.MISSING_TEXT}', 0, 'i') AS holes FROM t),
    c AS (SELECT p_partkey, CAST(len(holes) AS INTEGER) AS placeholders, CAST(len(list_filter(holes, lambda x: {_hit(rules.PAGE_GAP_HINT, 'x')})) AS INTEGER) AS page_gap_placeholders, {_edge(rules.CONTINUED_FROM, "start")} AS continued_from_edge, {_edge(rules.CONTINUED_ON, "end")} AS continued_on_edge FROM h)
    SELECT *, CASE WHEN page_gap_placeholders > 0 OR continued_from_edge > 0 OR continued_on_edge > 0 THEN 'high_confidence_missing_other_pages' WHEN placeholders > 0 THEN 'incomplete_text_cause_unclear' ELSE 'no_direct_gap_clue' END AS audit_category FROM c
    """,
)
def gap_audit(spark, sf_dir):
    return texts(spark, sf_dir).select("p_partkey", *[x.alias(n) for n, x in fx.gap_audit(F.col("text")).items()])


@query("clause_spans", f"WITH {TEXTS}, s AS (SELECT p_partkey, text, unnest(list_append(string_split(text, chr(10)), 'absent')) AS clause, generate_subscripts(list_append(string_split(text, chr(10)), 'absent'), 1) AS i FROM t) SELECT p_partkey, CAST(i - 1 AS INTEGER) AS place, CAST(greatest(instr(text, clause) - 1, 0) AS INTEGER) AS char_start, CAST(greatest(instr(text, clause) - 1, 0) + length(clause) AS INTEGER) AS char_end, array_to_string(string_split(text, chr(10))[i:i + 1], chr(10)) AS two_lines FROM s")
def clause_spans(spark, sf_dir):
    s = texts(spark, sf_dir).select("p_partkey", "text", F.posexplode(F.array_append(F.split("text", "\n"), F.lit("absent"))).alias("place", "clause"))
    span = fx.clause_span(F.col("text"), F.col("clause"))
    return s.select("p_partkey", "place", span["start"].alias("char_start"), span["end"].alias("char_end"), fx.line_slice(F.col("text"), F.col("place") + 1, F.col("place") + 2).alias("two_lines"))


_RANGES = "SELECT l_orderkey AS k, (l_linenumber - 1) * 10 + 1 + CASE WHEN l_partkey % 7 = 0 THEN 1 WHEN l_partkey % 41 = 0 THEN 5 WHEN l_partkey % 43 = 0 THEN -2 ELSE 0 END AS s, l_linenumber * 10 AS e, max(l_linenumber) OVER (PARTITION BY l_orderkey) * 10 + l_orderkey % 2 AS last FROM lineitem"


@query(
    "section_repair",
    f"""
    WITH r AS ({_RANGES}), n AS (SELECT *, row_number() OVER w AS number, lag(e) OVER w AS b, lead(s) OVER w AS nx FROM r WINDOW w AS (PARTITION BY k ORDER BY s, e)),
    g AS (SELECT *, CASE WHEN b IS NULL THEN CASE WHEN s <= 3 THEN 0 ELSE 2 END ELSE s - b - 1 END AS gap, CASE WHEN nx IS NULL THEN last - e ELSE 0 END AS tail FROM n),
    f AS (SELECT *, CASE WHEN max(CAST(e < s OR gap < 0 OR gap > 1 OR tail < 0 OR tail > 1 AS INTEGER)) OVER (PARTITION BY k) = 1 THEN 'rejected' WHEN max(CAST(gap <> 0 OR tail <> 0 OR (b IS NULL AND s <> 1) AS INTEGER)) OVER (PARTITION BY k) = 1 THEN 'repaired' ELSE 'ok' END AS status FROM g)
    SELECT k AS l_orderkey, CAST(CASE WHEN status = 'rejected' THEN s WHEN b IS NULL THEN 1 ELSE s END AS BIGINT) AS start_line, CAST(CASE WHEN status = 'rejected' THEN e WHEN nx IS NULL THEN last ELSE nx - 1 END AS BIGINT) AS end_line, number, status FROM f
    """,
)
def section_repair(spark, sf_dir):
    from pyspark.sql import Window

    n, p = F.col("l_linenumber"), F.col("l_partkey")
    moved = F.when(p % 7 == 0, 1).when(p % 41 == 0, 5).when(p % 43 == 0, -2).otherwise(0)
    last = F.max("l_linenumber").over(Window.partitionBy("l_orderkey")) * 10 + F.col("l_orderkey") % 2
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", ((n - 1) * 10 + 1 + moved).alias("s"), (n * 10).alias("e"), last.alias("last"))
    return segment.repair_specs(r, "l_orderkey", "s", "e", "last").withColumnsRenamed({"start": "start_line", "end": "end_line"})


@query("embedding_chunks")
def embedding_chunks(spark, sf_dir):
    """Paragraph packing with cuts at spaces; compared with a plain loop in the tests."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(segment.embedding_chunks(F.col("text"), 1200)).alias("chunk_index", "chunk"))
    return d.select("doc_id", "chunk_index", F.length("chunk").alias("chars"), F.sha2("chunk", 256).alias("chunk_sha256"))


@query(
    "text_utilities",
    f"""
    WITH {TEXTS}, u AS (SELECT p_partkey, title, text, '["a", " ", null, "b' || p_partkey || '"]' AS items FROM t)
    SELECT p_partkey, CASE WHEN regexp_replace(trim(title), '[^A-Za-z0-9._-]+', '_', 'g') = '' THEN 'item' ELSE regexp_replace(trim(title), '[^A-Za-z0-9._-]+', '_', 'g') END AS filename,
           array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: 'L' || lpad(CAST(i AS VARCHAR), 4, '0') || ': ' || x), chr(10)) AS numbered,
           CASE WHEN p_partkey % 3 = 0 THEN 'a|b' || p_partkey WHEN p_partkey % 3 = 1 THEN 'plain' ELSE '' END AS items, array_to_string(list_distinct(['x', 'y' || p_partkey % 2]), '|') IS NOT NULL AS has_items,
           CASE WHEN p_partkey % 100 + 1900 <= 1949 THEN '1920_1949' WHEN p_partkey % 100 + 1900 <= 1959 THEN '1950s' WHEN p_partkey % 100 + 1900 <= 1969 THEN '1960s' ELSE '1970_plus' END AS year_bin,
           CASE p_partkey % 3 WHEN 0 THEN 'springfield__il' WHEN 1 THEN 'st-paul__mn' ELSE '' END AS place_key, CASE p_partkey % 3 WHEN 0 THEN 'midwest' WHEN 1 THEN 'midwest' ELSE 'unknown' END AS region,
           'first' || p_partkey || 'third' AS said, CASE WHEN p_partkey % 2 = 0 THEN 1921 END AS first_year, CASE WHEN p_partkey % 2 = 0 THEN 1955 END AS last_year, CAST(1.5 + p_partkey AS DOUBLE) AS vector_sum
    FROM u
    """,
)
def text_utilities(spark, sf_dir):
    t, k = texts(spark, sf_dir), F.col("p_partkey")
    three = lambda a, b, c: F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise(c)
    items = three(F.concat(F.lit('["a", " ", null, "b'), k.cast("string"), F.lit('"]')), F.lit("plain"), F.lit(" none "))
    part = lambda kind, x: F.struct(F.lit(kind).alias("type"), x.alias("text"))
    body = F.struct(F.array(F.struct(F.array(part("output_text", F.concat(F.lit("first"), k.cast("string"))), part("reasoning", F.lit("no"))).alias("content")), F.struct(F.array(part("output_text", F.lit("third"))).alias("content"))).alias("output"))
    place = fx.place_key(three(F.lit("The City of Springfield"), F.lit("Town of St. Paul"), F.lit("None")), three(F.lit("IL"), F.lit("mn"), F.lit("xx")))
    years = fx.year_range(F.when(k % 2 == 0, F.lit("passed 1921, revised in 1933 and 1955")).otherwise(F.lit("no. 31921")))
    vector = fx.json_vector(F.concat(F.lit("[1.5, "), k.cast("string"), F.lit("]")))
    t = t.withColumns({"_body": body, "_years": years})
    return t.select(
        "p_partkey",
        fx.safe_filename("title").alias("filename"),
        fx.numbered_lines("text").alias("numbered"),
        F.array_join(fx.json_list(items), "|").alias("items"),
        (F.size(fx.unique_items(F.array(F.lit("x"), F.concat(F.lit("y"), (k % 2).cast("string")), F.lit("x")))) == 2).alias("has_items"),
        fx.year_bin(F.make_date((k % 100 + 1900).cast("int"), F.lit(1), F.lit(1))).alias("year_bin"),
        place.alias("place_key"),
        fx.region_of_state(three(F.lit("IL"), F.lit("mn"), F.lit("xx"))).alias("region"),
        fx.output_text(F.col("_body")).alias("said"),
        F.col("_years.first").alias("first_year"),
        F.col("_years.last").alias("last_year"),
        F.aggregate(vector, F.lit(0.0), lambda a, x: a + x).alias("vector_sum"),
    )
