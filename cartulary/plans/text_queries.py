"""Queries over texts: fingerprints, rules, features, segmentation, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.functions import rules, text as fx
from cartulary.operators import segment

from .catalog import query, table

_COLLAPSE = r"trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n|\r', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))"
_NORM = f"trim(regexp_replace(regexp_replace(lower({_COLLAPSE}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_WORDS = r"(CASE WHEN trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END)"


@query("text_fingerprint", f"SELECT doc_id, sha256({_NORM}) AS norm_sha, CAST(length({_COLLAPSE}) AS BIGINT) AS chars, CAST({_WORDS} AS BIGINT) AS words, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS lines FROM documents")
def text_fingerprint(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", fx.sha256(fx.fingerprint_text("text")).alias("norm_sha"), F.length(fx.collapse("text")).cast("long").alias("chars"), fx.word_count("text").alias("words"), fx.line_count("text").alias("lines"))


@query(
    "exact_dup_groups",
    """
    SELECT sha256(coalesce(text, '')) AS text_sha256, count(*) AS n_docs, min(doc_id) AS representative,
           string_agg(CAST(doc_id AS VARCHAR), '|' ORDER BY doc_id) AS members
    FROM documents GROUP BY 1 HAVING count(*) > 1
    """,
)
def exact_dup_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    members = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), "|")
    return docs.groupBy(fx.sha256("text").alias("text_sha256")).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("representative"), members.alias("members")).filter("n_docs > 1")


@query("slug_keys", "SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown') AS slug, coalesce(nullif(trim(regexp_replace(lower(trim(p_brand)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown') || '__' || lower(trim(p_type)) AS k FROM part")
def slug_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", fx.slugify("p_name").alias("slug"), F.concat(fx.slugify("p_brand"), F.lit("__"), F.lower(fx.clean_str("p_type"))).alias("k"))


@query("title_line", r"SELECT doc_id, coalesce(left(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], 240), '') AS title FROM documents")
def title_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fx.title_line("text").alias("title"))


@query("text_preview", r"WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE rtrim(left(t, 79)) || '…' END AS preview FROM t")
def text_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fx.preview("text", 80).alias("preview"))


@query("null_token_clean", "WITH v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' NaN ' WHEN 1 THEN 'None' WHEN 2 THEN '6,000' WHEN 3 THEN CAST(event_id AS VARCHAR) || '.0' ELSE event_type END AS raw FROM events) SELECT event_id, CASE WHEN lower(trim(raw)) IN ('', 'nan', 'none', 'null') THEN '' ELSE trim(raw) END AS cleaned, coalesce(CASE WHEN lower(trim(raw)) = 'nan' THEN NULL ELSE TRY_CAST(raw AS DOUBLE) END, 0.0) AS as_float, CASE WHEN lower(trim(raw)) = 'nan' THEN NULL ELSE TRY_CAST(replace(raw, ',', '') AS DOUBLE) END AS parsed FROM v")
def null_token_clean(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = F.col("event_id") % 5
    raw = F.when(m == 0, " NaN ").when(m == 1, "None").when(m == 2, "6,000").when(m == 3, F.concat(F.col("event_id").cast("string"), F.lit(".0"))).otherwise(F.col("event_type"))
    known = F.when(F.lower(F.trim("raw")) != "nan", F.col("raw"))
    return e.select("event_id", raw.alias("raw")).select("event_id", fx.clean_str("raw").alias("cleaned"), fx.to_float(known).alias("as_float"), fx.parse_number(known).alias("parsed"))


_RX = ("(^|[^a-z])(the|of|and)([^a-z]|$)", "[0-9]+", "[!?]")


@query("regex_counts_per_1k", f"SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '{_RX[0]}')) AS BIGINT) AS stop_hits, CAST(len(regexp_extract_all(text, '{_RX[1]}')) AS BIGINT) AS number_hits, CAST(len(regexp_extract_all(text, '{_RX[2]}')) AS BIGINT) AS marks, round(len(regexp_extract_all(lower(text), '{_RX[0]}')) * 1000.0 / greatest({_WORDS}, 1), 6) AS stop_per_1k, CAST(len(regexp_extract_all(text, '{_RX[1]}')) > 0 AS INTEGER) AS any_number FROM documents")
def regex_counts_per_1k(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("words", fx.word_count("text"))
    hit = [F.regexp_count(c, F.lit(p)).cast("long") for c, p in zip((F.lower("text"), F.col("text"), F.col("text")), _RX, strict=True)]
    return d.select("doc_id", hit[0].alias("stop_hits"), hit[1].alias("number_hits"), hit[2].alias("marks"), F.round(hit[0] * F.lit(1000.0) / F.greatest("words", F.lit(1)), 6).alias("stop_per_1k"), (hit[1] > 0).cast("int").alias("any_number"))


@query("signal_flags", "SELECT page_id, CAST(regexp_matches(html, '<script') AS INTEGER) AS has_script, CAST(regexp_matches(html, '<a ') AS INTEGER) AS has_link, CAST(regexp_matches(html, '<table') AS INTEGER) AS has_table, CASE WHEN regexp_matches(html, '<table') THEN 'table' WHEN regexp_matches(html, '<ul|<ol') THEN 'list' WHEN regexp_matches(html, '<p') THEN 'prose' ELSE 'other' END AS kind FROM pages")
def signal_flags(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", *[h.rlike(p).cast("int").alias(n) for n, p in (("has_script", "<script"), ("has_link", "<a "), ("has_table", "<table"))], fx.first_match(h, (("table", "<table"), ("list", "<ul|<ol"), ("prose", "<p")), "other").alias("kind"))


@query("ordered_class", "SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'license' WHEN contains(lower(text), 'token') THEN 'secret' WHEN contains(lower(text), '@') THEN 'contact' ELSE 'plain' END AS class FROM documents")
def ordered_class(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fx.first_needle(F.col("text"), (("license", "license"), ("token", "secret"), ("@", "contact")), "plain").alias("class"))


@query("numeric_extract_long", "SELECT page_id, unnest(regexp_extract_all(html, '([0-9]+)([a-z%]{0,3})', 1)) AS raw, unnest(regexp_extract_all(html, '([0-9]+)([a-z%]{0,3})', 2)) AS unit FROM pages")
def numeric_extract_long(spark, sf_dir):
    p = F.lit("([0-9]+)([a-z%]{0,3})")
    both = F.arrays_zip(F.regexp_extract_all("html", p, F.lit(1)).alias("raw"), F.regexp_extract_all("html", p, F.lit(2)).alias("unit"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(both).alias("x")).select("page_id", "x.raw", "x.unit")


@query(
    "linguistic_metrics",
    r"""
    WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z'']+') AS words, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: len(regexp_extract_all(s, '[A-Za-z'']+'))), lambda n: n > 0) AS sents FROM documents),
    y AS (SELECT *, list_transform(words, lambda w: regexp_replace(w, '[^a-z]', '', 'g')) AS bare FROM w),
    s AS (SELECT *, list_transform(bare, lambda w: CASE WHEN w = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN w LIKE '%e' AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(w, '[^aeiouy]le$') THEN 1 ELSE 0 END) END) AS syl FROM y)
    SELECT doc_id, CAST(len(sents) AS DOUBLE) AS sentence_count, round(coalesce(list_sum(sents) / nullif(len(sents), 0), 0), 10) AS avg_sentence_words,
           round(coalesce(list_sum(list_transform(words, lambda w: length(w))) / nullif(len(words), 0), 0), 10) AS avg_word_chars,
           round(coalesce(len(list_filter(words, lambda w: length(w) >= 7)) / nullif(len(words), 0), 0), 10) AS long_word_share,
           round(coalesce(list_sum(syl) / nullif(len(words), 0), 0), 10) AS syllables_per_word,
           round(CASE WHEN len(words) > 0 AND len(sents) > 0 THEN 206.835 - 1.015 * list_sum(sents) / len(sents) - 84.6 * list_sum(syl) / len(words) ELSE 0 END, 10) AS reading_ease,
           round(CASE WHEN len(words) > 0 AND len(sents) > 0 THEN 0.39 * list_sum(sents) / len(sents) + 11.8 * list_sum(syl) / len(words) - 15.59 ELSE 0 END, 10) AS grade
    FROM s
    """,
)
def linguistic_metrics(spark, sf_dir):
    m = fx.linguistic("text")
    return table(spark, sf_dir, "documents").select("doc_id", m["sentence_count"].alias("sentence_count"), *[F.round(c, 10).alias(n) for n, c in m.items() if n != "sentence_count"])


@query("page_url_parse", "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path, TRY_CAST(regexp_extract(url, '([0-9]+)[^0-9]*$', 1) AS BIGINT) AS last_number FROM pages")
def page_url_parse(spark, sf_dir):
    g = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", g("^([a-z]+)://").alias("scheme"), g("^[a-z]+://([^/:?#]+)").alias("host"), g("^[a-z]+://[^/]+(/[^?#]*)").alias("path"), g("([0-9]+)[^0-9]*$").try_cast("long").alias("last_number"))


@query("transcript_assemble", "SELECT conv_id, string_agg('=== ' || coalesce(role, '') || ' ===' || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def transcript_assemble(spark, sf_dir):
    return segment.transcript(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("transcript_parse", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations")
def transcript_parse(spark, sf_dir):
    t = segment.transcript(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return segment.parse_transcript(t, "conv_id", "transcript")


@query(
    "line_sections",
    f"""
    WITH l AS (SELECT doc_id, unnest(string_split({_COLLAPSE}, chr(10))) AS line, generate_subscripts(string_split({_COLLAPSE}, chr(10)), 1) AS i FROM documents),
    m AS (SELECT *, CASE WHEN i = 1 OR length(line) < 60 THEN 1 ELSE 0 END AS starts FROM l),
    n AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS section_index FROM m)
    SELECT doc_id, CAST(section_index AS BIGINT) AS section_index, min(i) AS start_line, max(i) AS end_line, CAST(sum(length(line)) AS BIGINT) AS chars FROM n GROUP BY 1, 2
    """,
)
def line_sections(spark, sf_dir):
    """Lines to sections by a running sum of starts; here short lines start one."""
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(fx.collapse("text"), "\n")).alias("i", "line"))
    starts = ((F.col("i") == 0) | (F.length("line") < 60)).cast("long")
    n = lines.withColumn("section_index", F.sum(starts).over(Window.partitionBy("doc_id").orderBy("i")))
    return n.groupBy("doc_id", "section_index").agg((F.min("i") + 1).cast("long").alias("start_line"), (F.max("i") + 1).cast("long").alias("end_line"), F.sum(F.length("line")).cast("long").alias("chars"))


def _heading(before: str, after: str) -> str:
    """Whether the trimmed line ``s`` is a heading, as SQL."""
    caps = rules.CAPS_HEADING.replace("'", "''")
    return f"""(s <> '' AND (regexp_matches(s, '{rules.ARTICLE_HEADING}', 'i') OR regexp_matches(s, '{rules.SECTION_HEADING}', 'i') OR (length(s) <= 140 AND regexp_matches(s, '{caps}') AND ({before} OR {after}))
        OR ({before} AND {after} AND len(regexp_split_to_array(s, '\\s+')) <= 12 AND NOT regexp_matches(s, '[A-Za-z][A-Z]|(^|[^A-Za-z])[a-z]') AND regexp_matches(s, '[A-Za-z]'))))"""


def _kind_of(sample: str) -> str:
    out = "CASE "
    for kind, some, every in rules.SECTION_KINDS:
        needs = [f"contains({sample}, '{n}')" for n in every] + (["(" + " OR ".join(f"contains({sample}, '{n}')" for n in some) + ")"] if some else [])
        out += f"WHEN {' AND '.join(needs)} THEN '{kind}' "
    return out + "ELSE 'other' END"


@query(
    "heading_sections",
    f"""
    WITH l AS (SELECT doc_id, unnest(string_split({_COLLAPSE}, chr(10))) AS line, generate_subscripts(string_split({_COLLAPSE}, chr(10)), 1) AS i FROM documents),
    b AS (SELECT *, trim(line) AS s, coalesce(trim(lag(line) OVER w) = '', TRUE) AS before, coalesce(trim(lead(line) OVER w) = '', TRUE) AS after FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    m AS (SELECT *, CAST(i = 1 OR {_heading("before", "after")} AS INTEGER) AS starts, {_heading("TRUE", "FALSE")} AS heads FROM b),
    n AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS section_index FROM m),
    p AS (SELECT doc_id, section_index, min(i) AS lo, max(i) AS hi, string_agg(line, chr(10) ORDER BY i) AS w, arg_min(line, i) AS head, arg_min(heads, i) AS heads FROM n GROUP BY 1, 2),
    q AS (SELECT *, {_COLLAPSE.replace("text", "w")} AS whole, CASE WHEN heads THEN substr(w, length(head) + 2) ELSE w END AS r FROM p), t AS (SELECT *, {_COLLAPSE.replace("text", "r")} AS body, left(trim(head), 240) AS heading FROM q),
    u AS (SELECT *, CASE WHEN body = '' THEN whole ELSE body END AS text FROM t)
    SELECT doc_id, CAST(section_index AS BIGINT) AS section_index, heading, lo AS start_line, hi AS end_line, text, {_kind_of("lower(heading || chr(10) || text)")} AS section_kind FROM u
    """,
)
def heading_sections(spark, sf_dir):
    return segment.sections(table(spark, sf_dir, "documents"))


@query("clause_semantics")
def clause_semantics(spark, sf_dir):
    """Sections to clauses to modality, instrument, role, motive and captured conditions."""
    s = segment.sections(table(spark, sf_dir, "documents"))
    c = s.select("doc_id", "section_index", "section_kind", F.posexplode(segment.clauses(F.col("text"))).alias("clause_index", "clause"))
    # Lower case once: a hundred needles look into it.
    c, low, clause = c.withColumn("low", F.lower("clause")), F.col("low"), F.col("clause")
    kind = F.when(F.col("section_kind") == "definitions", "Definition").when(F.col("section_kind") == "purpose", "Purpose statement").otherwise("General ordinance clause")
    c = c.withColumns({"modality": fx.modality(clause), "hint": fx.first_needle(low, rules.HINTS, kind, lowered=True)})
    c = c.withColumn("hinted", F.concat_ws(" ", F.lower("hint"), "low"))
    c = c.withColumns({"instrument": fx.first_needle(F.col("hinted"), rules.INSTRUMENTS, "general_rule", lowered=True), "actor": fx.first_match(clause, rules.ACTORS, "unknown"), "target": fx.first_match(clause, rules.TARGETS, "general")})
    c = c.withColumns({"role": fx.clause_role(clause, F.col("section_kind"), F.col("modality"), F.col("instrument")), "motives": fx.motives(low, lowered=True)})
    return c.select("doc_id", "section_index", "clause_index", "section_kind", "modality", "hint", "instrument", "actor", "target", "role", fx.is_operative(F.col("role"), F.col("modality"), F.col("instrument")).alias("operative"), F.get("motives", F.lit(0))["motive"].alias("motive"), fx.motive_confidence(F.col("motives")).alias("confidence"), fx.captured(F.col("clause"), rules.CONDITION).alias("condition"), fx.captured(F.col("clause"), rules.EXCEPTION).alias("exception"), F.size(fx.numbers_found(F.col("clause"))).alias("numbers"))


@query(
    "greedy_chunks",
    f"""
    WITH p AS (SELECT doc_id, list_filter(list_transform(string_split({_COLLAPSE}, chr(10) || chr(10)), lambda x: trim(x)), lambda x: x <> '') AS paras FROM documents),
    c AS (SELECT doc_id, flatten(list_transform(paras, lambda x: list_transform(range(0, (length(x) - 1) // 1200 + 1), lambda k: substr(x, k * 1200 + 1, 1200)))) AS cut FROM p WHERE len(paras) > 0),
    r AS (SELECT doc_id, list_reduce(list_transform(cut, lambda x: [x]), lambda a, b: CASE WHEN length(a[len(a)]) + length(b[1]) + 2 <= 1200 THEN list_concat(a[1:len(a) - 1], [a[len(a)] || chr(10) || chr(10) || b[1]]) ELSE list_concat(a, b) END) AS chunks FROM c),
    u AS (SELECT doc_id, len(chunks) AS n, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) AS i FROM r)
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_index, CAST(n AS INTEGER) AS chunk_count, CAST(length(chunk) AS INTEGER) AS chars, 1.0 / n AS doc_weight FROM u
    """,
)
def greedy_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", segment.packed_chunks(F.col("text"), 1200).alias("chunks"))
    return d.select("doc_id", F.size("chunks").alias("chunk_count"), F.posexplode("chunks").alias("chunk_index", "chunk")).select("doc_id", "chunk_index", "chunk_count", F.length("chunk").alias("chars"), (1 / F.col("chunk_count")).alias("doc_weight"))


@query(
    "token_topk_by_group",
    """
    WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS token FROM documents),
    c AS (SELECT lang, token, count(*) AS n FROM t GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS place FROM c)
    SELECT lang, token, n, place FROM r WHERE place <= 8
    """,
)
def token_topk_by_group(spark, sf_dir):
    from cartulary.operators.panel import top_k

    t = table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("token"))
    return top_k(t.groupBy("lang", "token").agg(F.count("*").alias("n")), ["lang"], [F.desc("n"), F.asc("token")], 8).withColumn("place", F.col("place").cast("long"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 0 AND 50 AS valid FROM events")
def json_props(spark, sf_dir):
    k = F.from_json("props", "struct<k:bigint>")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), k.between(0, 50).alias("valid"))


@query("page_gaps", "WITH l AS (SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber))) AS x FROM lineitem WHERE (l_orderkey + l_linenumber) % 3 <> 0 GROUP BY 1) SELECT l_orderkey, CAST(len(x) AS INTEGER) AS present, array_to_string(list_filter(range(x[1], x[-1] + 1), lambda v: NOT list_contains(x, CAST(v AS INTEGER))), ',') AS missing FROM l")
def page_gaps(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").filter("(l_orderkey + l_linenumber) % 3 <> 0").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("x"))
    return x.select("l_orderkey", F.size("x").alias("present"), F.array_join(fx.missing_integers(F.col("x")).cast("array<string>"), ",").alias("missing"))
