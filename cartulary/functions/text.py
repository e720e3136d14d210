"""Text, number, date, JSON and array functions: Column in, Column out, JVM-side but for ``best_motives``."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rules


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Strings ---------------------------------------------------------------------
def clean_str(c: Column | str) -> Column:
    """Trimmed text; null and the null tokens (any case) become the empty string."""
    t = F.trim(F.coalesce(_col(c).cast("string"), F.lit("")))
    return F.when(F.lower(t).isin(*rules.NULL_TOKENS), "").otherwise(t)


def slugify(c: Column | str) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(clean_str(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "unknown").otherwise(s)


def normalize_place(c: Column | str, passes: int = 4) -> Column:
    """A place name without kinds of government around it; ``passes`` unrolls the fixpoint."""
    tidy = lambda s: F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"^[ ,.\-]+|[ ,.\-]+$", "")
    s = clean_str(c)
    for _ in range(passes):
        s = F.regexp_replace(s, f"(?i)^{rules.PLACE_PREFIX}", "")
        s = F.regexp_replace(s, r"(?i)^of\s+", "")
        s = tidy(F.regexp_replace(s, f"(?i){rules.PLACE_SUFFIX}$", ""))
    return tidy(F.replace(s, F.lit("&"), F.lit(" and ")))


def place_key(city: Column | str, state: Column | str) -> Column:
    name, st = normalize_place(city), F.lower(clean_str(state))
    return F.when((name == "") | (st == ""), "").otherwise(F.concat(slugify(name), F.lit("__"), st))


def region_of_state(state: Column | str) -> Column:
    st = F.lower(clean_str(state))
    out = F.lit("unknown")
    for region, states in rules.REGION_STATES.items():
        out = F.when(st.isin(*states), region).otherwise(out)
    return out


def collapse(c: Column | str) -> Column:
    """One line-break style, single spaces, at most one blank line, trimmed."""
    s = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\r\n|\r", "\n")
    s = F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def fingerprint_text(c: Column | str) -> Column:
    """Lower-case letters and digits of a text, single spaces: what duplicates are found by."""
    s = F.regexp_replace(F.lower(collapse(c)), r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def normalize_print(c: Column | str) -> Column:
    """Lower-case letters, digits and single spaces of a text, whatever its line breaks."""
    s = F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), r"[^a-z0-9]+", " ")
    return F.trim(s)


def sha256(c: Column | str) -> Column:
    return F.sha2(F.coalesce(_col(c), F.lit("")), 256)


def word_count(c: Column | str) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("long")


def line_count(c: Column | str) -> Column:
    t = F.coalesce(_col(c), F.lit(""))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, "\n"))).cast("long")


def title_line(c: Column | str, limit: int = 240) -> Column:
    lines = F.filter(F.transform(F.split(F.coalesce(_col(c), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.left(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), F.lit(limit))


def preview(c: Column | str, limit: int = 80) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\s+", " "))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(limit - 1))), F.lit("…")))


def json_list(c: Column | str) -> Column:
    """Items of a JSON list; anything else is a list of the raw text, blank is empty."""
    raw = clean_str(c)
    items = F.filter(F.transform(F.from_json(raw, "array<string>"), lambda x: clean_str(x)), lambda x: x != "")
    return F.when(raw == "", F.array().cast("array<string>")).when(raw.startswith("["), F.coalesce(items, F.array(raw))).otherwise(F.array(raw))


def to_float(c: Column | str, default: float = 0.0) -> Column:
    """The number, or the default on any failure (a comma is a failure)."""
    return F.coalesce(_col(c).try_cast("double"), F.lit(default))


def parse_number(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit(","), F.lit("")).try_cast("double")


def zero_filled_id(c: Column | str, width: int) -> Column:
    s = F.regexp_replace(clean_str(c), r"\.0$", "")
    return F.when(s.rlike(r"^[0-9]+$") & (F.length(s) < width), F.lpad(s, width, "0")).otherwise(s)


def display_name(slug: Column | str) -> Column:
    return F.initcap(F.replace(clean_str(slug), F.lit("-"), F.lit(" ")))


def safe_filename(c: Column | str) -> Column:
    s = F.regexp_replace(clean_str(c), r"[^A-Za-z0-9._-]+", "_")
    return F.when(s == "", "item").otherwise(s)


def numbered_lines(c: Column | str) -> Column:
    return F.array_join(F.transform(F.split(_col(c), "\n"), lambda x, i: F.concat(F.lit("L"), F.lpad((i + 1).cast("string"), 4, "0"), F.lit(": "), x)), "\n")


def syllables(word: Column) -> Column:
    """Vowel groups; a silent final e is taken off, a final le after a consonant is put back; one at least."""
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    n = groups - F.when(w.rlike("e$") & (groups > 1), 1).otherwise(0) + F.when(w.rlike("[^aeiouy]le$"), 1).otherwise(0)
    return F.when(w == "", 0).otherwise(F.greatest(n, F.lit(1)))


def linguistic(c: Column | str) -> dict[str, Column]:
    """Sentence and word measures and the two readability proxies of a text.

    Sums over words are counts over the whole text: a few passes of compiled
    patterns, whatever the number of words.
    """
    raw = F.coalesce(_col(c), F.lit(""))
    low = F.lower(raw)
    bare = F.replace(low, F.lit("'"), F.lit(""))
    count = lambda t, p: F.regexp_count(t, F.lit(p))
    n, said = count(low, "[a-z']+"), count(raw, "[A-Za-z']+")
    sentences = count(raw, "[A-Za-z'][^.!?]*+")
    # Vowel groups, less silent final e's, plus final le's, plus one for words without a vowel.
    consonant = "[bcdfghjklmnpqrstvwxz]"
    silent = count(bare, f"(?<![a-z])[a-z]*[aeiouy]{consonant}[a-z]*e(?![a-z])")
    syl = safe_div(count(bare, "[aeiouy]++") - silent + count(bare, f"{consonant}le(?![a-z])") + count(bare, f"(?<![a-z]){consonant}++(?![a-z])"), n)
    length = safe_div(said, sentences)
    has = (n > 0) & (sentences > 0)
    return {
        "sentence_count": sentences.cast("double"),
        "avg_sentence_words": length,
        "avg_word_chars": safe_div(F.length(F.regexp_replace(low, "[^a-z']++", "")), n),
        "long_word_share": safe_div(count(low, "[a-z']{7,}+"), n),
        "syllables_per_word": syl,
        "reading_ease": F.when(has, 206.835 - 1.015 * length - 84.6 * syl).otherwise(0.0),
        "grade": F.when(has, 0.39 * length + 11.8 * syl - 15.59).otherwise(0.0),
    }


# Rules -----------------------------------------------------------------------
def first_match(c: Column, labelled: Iterable[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern (any case) that is found."""
    out = F.lit(default)
    for label, pattern in reversed(list(labelled)):
        out = F.when(c.rlike(f"(?i){pattern}"), label).otherwise(out)
    return out


def first_needle(c: Column, labelled: Iterable[tuple[str, str]], default: str | Column, lowered: bool = False) -> Column:
    """The label of the first needle that the lower-cased text holds (``lowered``: it is in lower case already)."""
    out, low = default if isinstance(default, Column) else F.lit(default), c if lowered else F.lower(c)
    for needle, label in reversed(list(labelled)):
        out = F.when(F.contains(low, F.lit(needle)), label).otherwise(out)
    return out


def section_kind(heading: Column, text: Column) -> Column:
    sample = F.lower(F.concat_ws("\n", heading, text))
    out = F.lit("other")
    for kind, some, every in reversed(rules.SECTION_KINDS):
        hit = F.lit(True)
        for needle in every:
            hit = hit & F.contains(sample, F.lit(needle))
        if some:
            any_of = F.lit(False)
            for needle in some:
                any_of = any_of | F.contains(sample, F.lit(needle))
            hit = hit & any_of
        out = F.when(hit, kind).otherwise(out)
    return out


def modality(c: Column) -> Column:
    return first_match(c, rules.MODALITIES, "other")


def motives(c: Column, lowered: bool = False) -> Column:
    """array<struct<rank, motive, score>>, best first; ties in the order of the taxonomy."""
    sample = c if lowered else F.lower(c)
    scored = []
    for k, (motive, needles) in enumerate(rules.MOTIVE_NEEDLES.items()):
        score = sum((F.contains(sample, F.lit(n)).cast("int") for n in needles), F.lit(0))
        scored.append(F.struct((-score).alias("minus"), F.lit(k).alias("place"), F.lit(motive).alias("motive")))
    found = F.array_sort(F.filter(F.array(*scored), lambda x: x["minus"] < 0))
    fallback = F.array(F.struct(F.lit(-1).alias("minus"), F.lit(99).alias("place"), F.when(sample.rlike(f"(?i){rules.PURPOSE}"), "other").otherwise("unclear").alias("motive")))
    return F.when(F.size(found) > 0, found).otherwise(fallback)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def best_motives(lows: pd.Series) -> pd.Series:
    """The first of ``motives`` of each text in lower case, as place * 1000 + score; -1 if none scores.

    Python's search is some twenty times faster than ``contains`` of the JVM, and equal lines of a batch are scored once.
    """
    needles, memo = list(rules.MOTIVE_NEEDLES.values()), {}

    def one(low: str) -> int:
        if low not in memo:
            scores = [sum(n in low for n in group) for group in needles]
            top = max(scores)
            memo[low] = scores.index(top) * 1000 + top if top else -1
        return memo[low]

    return lows.map(lambda texts: [one(x) for x in texts])


def motive_confidence(found: Column) -> Column:
    return F.least(F.lit(0.95), 0.35 + 0.15 * -F.get(found, F.lit(0))["minus"])


def clause_role(text: Column, kind: Column, mode: Column, instrument: Column) -> Column:
    return (
        F.when((kind == "definitions") | (mode == "definition") | (instrument == "definition"), "definition")
        .when((kind == "purpose") | text.rlike(f"(?i){rules.PREAMBLE}") | F.contains(F.lower(text), F.lit("general welfare")), "purpose_preamble")
        .when((kind == "district_map") | text.rlike(f"(?i){rules.MAP_BOUNDARY}"), "map_boundary")
        .when((kind == "closing") | text.rlike(f"(?i){rules.BOILERPLATE}"), "closing_boilerplate")
        .when(instrument.isin(*rules.PROCEDURAL_INSTRUMENTS), "administrative_procedure")
        .otherwise("substantive_standard")
    )


def is_operative(role: Column, mode: Column, instrument: Column) -> Column:
    idle = role.isin("definition", "purpose_preamble", "map_boundary", "closing_boilerplate")
    return (~idle & ~(instrument.isin("purpose", "definition") & ~mode.isin("must", "must_not", "may"))).cast("int")


def captured(c: Column, pattern: str, group: int = 2, limit: int = 240) -> Column:
    return F.left(clean_str(F.regexp_extract(c, f"(?i){pattern}", group)), F.lit(limit))


def numbers_found(c: Column) -> Column:
    """array<struct<feature, raw, unit>>: all matches of all number patterns."""
    parts = []
    for name, pattern in rules.NUMBERS.items():
        p = F.lit(f"(?i){pattern}")
        raw, unit = F.regexp_extract_all(c, p, F.lit(1)), F.regexp_extract_all(c, p, F.lit(2))
        parts.append(F.zip_with(raw, unit, _number(name)))
    return F.concat(*parts)


def _number(name: str):
    return lambda a, b: F.struct(F.lit(name).alias("feature"), a.alias("raw"), b.alias("unit"))


def tags(c: Column, labelled: Iterable[tuple[str, str]]) -> Column:
    """Sorted labels of all patterns that are found."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c.rlike(f"(?i){p}"), label) for label, p in labelled])))


def reference_counts(c: Column) -> dict[str, Column]:
    return {name: F.regexp_count(c, F.lit(f"(?i){p}")).cast("long") for name, p in rules.REFERENCES.items()}


def tag_families(c: Column, families: dict[str, tuple[str, ...]]) -> Column:
    """Sorted names of the families of which any pattern is found."""
    return tags(c, [(name, "|".join(f"(?:{p})" for p in patterns)) for name, patterns in families.items()])


def mechanics(c: Column, districts: int = 20) -> dict[str, Column]:
    """What a text does and regulates: sorted tags, and up to ``districts`` district codes; none outside the field's context."""
    t = F.trim(F.coalesce(c, F.lit("")))
    upper = F.transform(F.regexp_extract_all(t, F.lit(f"(?i){rules.DISTRICT_TOKEN}"), F.lit(0)), lambda x: F.upper(x))
    coded = F.transform(F.regexp_extract_all(t, F.lit(f"(?i){rules.DISTRICT_CODE}"), F.lit(0)), lambda x: F.upper(F.regexp_replace(x, r"(?i)^([rcim])\s*-?\s*([0-9]+)$", "$1-$2")))
    found = {
        "action_tags": tag_families(t, rules.ACTION_TAGS),
        "dimension_tags": tag_families(t, rules.DIMENSION_TAGS),
        "instrument_tags": tag_families(t, rules.INSTRUMENT_TAGS),
        "district_tokens": F.slice(F.array_sort(F.array_union(upper, coded)), F.lit(1), F.lit(districts)),
    }
    return {n: F.when(t.rlike(f"(?i){rules.ZONING_CONTEXT}"), x).otherwise(F.array().cast("array<string>")) for n, x in found.items()}


def signals(c: Column) -> dict[str, Column]:
    """0/1 flags of the signal patterns."""
    return {n: F.coalesce(c.rlike(f"(?i){p}"), F.lit(False)).cast("int") for n, p in rules.SIGNALS.items()}


def purpose_candidates(c: Column, first: int = 5, limit: int = 8) -> Column:
    """array<string>: the lines that state a purpose, else the first lines."""
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  # a lambda's argument is evaluated once, a repeated expression every time
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    states = lambda x: x.rlike(f"(?i){rules.PURPOSE}") | F.contains(F.lower(x), F.lit("general welfare"))
    choose = lambda every: once(F.filter(every, states), lambda stated: F.slice(F.when(F.size(stated) > 0, stated).otherwise(F.slice(every, F.lit(1), F.lit(first))), F.lit(1), F.lit(limit)))

    return once(lines, choose)


def purpose_lines(chosen: Column, codes: Column) -> Column:
    """array<struct<motive, description, evidence, confidence>> of ``purpose_candidates`` and their ``best_motives``.

    Lines of one motive that share their first 80 characters count once.
    """
    names = F.array(*[F.lit(m) for m in rules.MOTIVE_NEEDLES])

    def described(x: Column, code: Column) -> Column:
        low = F.when(code < 0, F.when(F.lower(x).rlike(f"(?i){rules.PURPOSE}"), "other").otherwise("unclear"))
        motive, minus = F.coalesce(low, F.get(names, F.floor(code / 1000).cast("int"))), F.when(code < 0, -1).otherwise(-(code % 1000))
        return F.struct(motive.alias("motive"), F.left(x, F.lit(600)).alias("description"), F.left(x, F.lit(300)).alias("evidence"), motive_confidence(F.array(F.struct(minus.alias("minus")))).alias("confidence"))

    def add(kept: Column, x: Column) -> Column:
        known = F.exists(kept, lambda y: (y["motive"] == x["motive"]) & (F.left(y["description"], F.lit(80)) == F.left(x["description"], F.lit(80))))
        return F.when(known, kept).otherwise(F.concat(kept, F.array(x)))

    none = F.array().cast("array<struct<motive:string,description:string,evidence:string,confidence:double>>")
    return F.aggregate(F.zip_with(chosen, codes, described), none, add)


def architecture_anchor(title: Column) -> Column:
    """The first five words of a title's head, without parentheses and words that only number it."""
    s = F.regexp_replace(F.lower(clean_str(title)), r"\([^)]*\)", " ")
    s = F.regexp_replace(F.get(F.split(s, "[:;\u2014-]"), F.lit(0)), r"[^a-z0-9\s]+", " ")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, rules.ANCHOR_WORDS, " "), r"\s+", " "))
    return F.when(s == "", "unknown").otherwise(F.substring_index(s, " ", 5))


def matches(c: Column, pattern: str) -> Column:
    """array<struct<start, end, value>>: all matches with their offsets in characters."""
    p = f"(?i){pattern}"
    gaps, found = F.split(c, p, -1), F.regexp_extract_all(c, F.lit(p), F.lit(0))
    kind = "array<struct<start:int,end:int,value:string>>"
    zipped = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, v: F.struct(g.alias("g"), v.alias("v")))

    def step(acc: Column, x: Column) -> Column:
        start = F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(0)) + F.length(x["g"])
        return F.concat(acc, F.array(F.struct(start.alias("start"), (start + F.length(x["v"])).alias("end"), x["v"].alias("value"))).cast(kind))

    return F.aggregate(zipped, F.array().cast(kind), step)


def gap_audit(c: Column, edge_chars: int = 500, edge_share: float = 0.05) -> dict[str, Column]:
    """Clues that pages of a text are missing, and the category they make."""
    t = F.coalesce(c, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    holes = F.regexp_extract_all(t, F.lit(f"(?i){rules.MISSING_TEXT}"), F.lit(0))
    paged = F.filter(holes, lambda x: x.rlike(f"(?i){rules.PAGE_GAP_HINT}"))
    near_start = F.filter(matches(t, rules.CONTINUED_FROM), lambda m: (m["start"] <= edge_chars) | (m["start"] / n <= edge_share))
    near_end = F.filter(matches(t, rules.CONTINUED_ON), lambda m: (F.length(t) - m["end"] <= edge_chars) | ((F.length(t) - m["end"]) / n <= edge_share))
    sure = (F.size(paged) > 0) | (F.size(near_start) > 0) | (F.size(near_end) > 0)
    return {
        "placeholders": F.size(holes),
        "page_gap_placeholders": F.size(paged),
        "continued_from_edge": F.size(near_start),
        "continued_on_edge": F.size(near_end),
        "audit_category": F.when(sure, "high_confidence_missing_other_pages").when(F.size(holes) > 0, "incomplete_text_cause_unclear").otherwise("no_direct_gap_clue"),
    }


def bounded(c: Column, limit: int) -> Column:
    """The text, or a failed job if it is longer than the limit."""
    return F.when(F.length(c) > limit, F.raise_error(F.concat(F.lit(f"text over {limit} characters: "), F.length(c).cast("string")))).otherwise(c)


def clause_span(text: Column, clause: Column) -> Column:
    """struct<start, end>: where a clause first stands in its section, from 0; 0 where it doesn't."""
    start = F.greatest(F.instr(text, clause) - 1, F.lit(0))
    return F.struct(start.alias("start"), (start + F.length(clause)).alias("end"))


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start..end, from 1, of a text."""
    return F.array_join(F.slice(F.split(text, "\n"), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def year_range(c: Column) -> Column:
    """struct<first, last>: the years that a text names first and last (first = last for one)."""
    years = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?<![0-9])(1[89][0-9]{2}|20[0-9]{2})(?![0-9])"), F.lit(1)), lambda y: y.cast("int"))
    return F.struct(F.get(years, F.lit(0)).alias("first"), F.get(years, F.size(years) - 1).alias("last"))


def exact_date(c: Column) -> Column:
    """The date of a text that is an ISO date or holds one; null otherwise."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(?<![0-9])([0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9])", 1).try_cast("date")


def keyword_density(c: Column, keywords: Iterable[str]) -> Column:
    """Keyword hits (whole words) per 1,000 words."""
    hits = F.regexp_count(F.lower(c), F.lit(r"\b(?:" + "|".join(keywords) + r")\b"))
    return F.coalesce(F.try_divide(hits * 1000.0, word_count(c).cast("double")), F.lit(0.0))


# Numbers, dates, vectors -------------------------------------------------------
def safe_div(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is not positive or anything is missing."""
    d = b.cast("double")
    return F.coalesce(F.when((d > 0) & ~F.isnan(d), a.cast("double") / d), F.lit(0.0))


def entropy(shares: Column) -> Column:
    """Shannon entropy (bits) of an array of shares divided by its maximum; 0 for one category or none."""
    p = F.filter(shares, lambda x: x > 0)
    h = F.aggregate(p, F.lit(0.0), lambda s, x: s - x * F.log2(x))
    return F.when(F.size(p) <= 1, 0.0).otherwise(h / F.log2(F.size(p)))


def js_similarity(p: Column, q: Column) -> Column:
    """1 - Jensen-Shannon divergence / ln 2 of two aligned distributions."""
    term = lambda a, m: F.when(a > 0, a * F.log(a / m)).otherwise(0.0)
    each = F.zip_with(p, q, lambda a, b: 0.5 * (term(a, (a + b) / 2) + term(b, (a + b) / 2)))
    return 1 - F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.log(F.lit(2.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(n > 0, dot(a, b) / n).otherwise(0.0)))


def year_bin(date: Column) -> Column:
    y = F.year(date)
    return F.when(y.isNull(), "unknown").when(y <= 1949, "1920_1949").when(y <= 1959, "1950s").when(y <= 1969, "1960s").otherwise("1970_plus")


def month_index(date: Column) -> Column:
    return (F.year(date) * 12 + F.month(date) - 1).cast("long")


def position(i: Column, n: Column) -> Column:
    """(i - 1) / (n - 1), 0 for a single item."""
    return F.when(n > 1, (i - 1).cast("double") / (n - 1)).otherwise(0.0)


def histogram_bin(c: Column, edges: list[float], low: float | None = None, high: float | None = None) -> Column:
    """Index of the half-open bin; the last one is closed; values outside low..high are clamped."""
    v = c
    if low is not None:
        v = F.greatest(v, F.lit(low))
    if high is not None:
        v = F.least(v, F.lit(high))
    out = F.lit(None).cast("int")
    for k in reversed(range(len(edges) - 1)):
        inside = (v >= edges[k]) & ((v < edges[k + 1]) if k < len(edges) - 2 else (v <= edges[k + 1]))
        out = F.when(inside, k).otherwise(out)
    return out


def missing_integers(values: Column) -> Column:
    """Integers between the least and the greatest of an array that it lacks."""
    return F.when(F.size(values) > 0, F.array_except(F.sequence(F.array_min(values), F.array_max(values)), values)).otherwise(F.array().cast("array<int>"))


def unique_items(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda x: F.coalesce(x, F.lit("")) != ""))


def split_cell(c: Column, separator: str = ",") -> Column:
    """The cleaned items of a list in a cell."""
    return F.filter(F.transform(F.split(clean_str(c), separator), lambda x: clean_str(x)), lambda x: x != "")


def count_map(counts: Column, limit: int = 5) -> Column:
    """``key:n|key:n`` of array<struct<key, n>>, most frequent first, ties by key."""
    order = F.array_sort(F.transform(counts, lambda x: F.struct((-x["n"]).alias("m"), x["key"].alias("key"))))
    return F.array_join(F.transform(F.slice(order, F.lit(1), F.lit(limit)), lambda x: F.concat(x["key"], F.lit(":"), (-x["m"]).cast("string"))), "|")


def json_vector(c: Column) -> Column:
    """array<double> of a JSON list of numbers; null where it is none or an item isn't a finite number."""
    v = F.from_json(c, "array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when((F.size(v) > 0) & ~bad, v)


# JSON ------------------------------------------------------------------------
def lenient_object(c: Column) -> Column:
    """The first JSON object of a text that may be fenced or surrounded by prose; null if it doesn't parse."""
    body = F.regexp_extract(F.regexp_replace(c, r"```(?:json)?", ""), r"(?s)\{.*\}", 0)
    body = F.regexp_replace(F.regexp_replace(body, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " "), r",\s*([}\]])", "$1")
    return F.when(F.try_parse_json(body).isNotNull(), body)


def output_text(response: Column) -> Column:
    """Concatenated output_text parts of a response body (typed struct column)."""
    parts = F.flatten(F.transform(response["output"], lambda o: F.filter(o["content"], lambda x: x["type"] == "output_text")))
    return F.array_join(F.transform(parts, lambda x: x["text"]), "")
