"""Operator 6 [native]: PII spans and information-theoretic sanitisation.

Base spans (email, ip, card, phone) are found by regular expressions over whole
texts.  Every found value is a protected entity ``c``, and so is the part it
shares with others (``_pool``: an address' domain, an IP's network, a card's
issuer, a phone's number block), since most values stand in one text only.
Kinds aren't pooled: the placeholder names the kind anyway.  Over all documents
the operator counts in how many rows ``c`` occurs, in how many rows a term
``t`` occurs, and in how many ``t`` stands within ``window`` characters of
``c``.  A term discloses ``c`` when it carries at least ``threshold`` of the
entity's information content:

    PMI(c; t) = log2(P(c|t) N / n(c))  >=  threshold * log2(N / n(c))

P(c|t) is n(c,t) / n(t) where ``support`` different texts or more show the
pair.  Where fewer do, it is (n(c,t) + m n(c)/N) / (n(t) + m): smoothed towards
independence by one more text with as many copies ``m`` as the pair's texts
have on average.  Such terms are
sanitised wherever they stand in a document that holds the entity: generalised
to their stem (first ``STEM`` letters) if the stem stays below the threshold,
removed otherwise.  They are added to the spans as kinds ``general`` and
``term``; base spans stay.

Everything is DataFrame functions.  Match offsets come from the lengths of the
pieces between matches (``split``) and of the matches (``regexp_extract_all``),
in code points.  The expressions only use possessive repetition where nothing
follows that could need backtracking, so they find what the plain ones find
without deep recursion or quadratic scans on long texts.

Defined results: null text is empty (no spans); exact copies of a text are
counted as rows but are one piece of evidence for ``support`` and smoothing; repeated rows
give repeated results; values compare case-insensitively.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table, texts_of

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # Shorter runs of digits can never pass, so they needn't match.
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this can't hold the kind.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
MORE_KINDS = ("term", "general")
TERM = r"(?<![\p{L}\p{N}@_%+.-])\p{L}{3,}+(?![\p{N}@_%+-]|\.[\p{L}\p{N}])"
STEM = 4
WINDOW = 80
SPANS = "array<struct<start:bigint,kind:int,end:bigint,value:string,left:string,right:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.when(F.length(_bare(p)) <= 3, _bare(p).cast("int") <= 255).otherwise(F.lit(False)))
    if kind == "card":
        return F.length(_digits(value)).between(14, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _bare(number: Column) -> Column:
    return F.regexp_replace(number, "^0+(?=.)", "")


def base_spans(text: Column, kind: str, window: int = WINDOW) -> Column:
    """The valid matches of a kind with their offsets and up to ``window`` + 1 characters on either side."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    state = "struct<at:bigint,out:" + SPANS + ">"
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("out")).cast(state)

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["gap"])
        end = begin + F.length(x["value"])
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), F.lower(x["value"]).alias("value"), F.right(x["gap"], F.lit(window + 1)).alias("left"), F.left(x["next"], F.lit(window + 1)).alias("right"))
        return F.struct(end.alias("at"), F.when(_valid(kind, x["value"]), F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out")).cast(state)

    gaps = F.split(text, PATTERNS[kind], -1)
    zipped = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    zipped = F.zip_with(zipped, F.slice(gaps, F.lit(2), F.size(found)), lambda x, n: F.struct(x["value"].alias("value"), x["gap"].alias("gap"), n.alias("next")))
    spans = F.aggregate(zipped, start, step, lambda s: s["out"])
    likely = F.contains(text, F.lit(HINTS[kind])) if HINTS[kind] else text.rlike(PATTERNS[kind])
    return F.when(likely & text.rlike(PATTERNS[kind]), spans).otherwise(F.array().cast(SPANS))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, key (of the text), spans by start and kind, and the text of rows that have any."""
    rows = texts_of(docs, id_col, text_col).select("doc_id", "text", *[base_spans(F.col("text"), k, window).alias(k) for k in KINDS])
    rows = rows.select("doc_id", "text", F.array_sort(F.concat(*KINDS)).alias("spans"))
    return rows.select("doc_id", F.md5(F.encode("text", "utf-8")).alias("key"), "spans", F.when(F.size("spans") > 0, F.col("text")).alias("text"))


def _entity(span: Column) -> Column:
    return F.concat_ws(":", span["kind"].cast("string"), span["value"])


def _pool(span: Column) -> Column:
    """The part of a value that others share."""
    digits = _digits(span["value"])
    shared = F.when(span["kind"] == KINDS.index("email"), F.substring_index(span["value"], "@", -1))
    shared = shared.when(span["kind"] == KINDS.index("ip"), F.array_join(F.transform(F.slice(F.split(span["value"], r"\."), 1, 3), _bare), "."))
    shared = shared.when(span["kind"] == KINDS.index("card"), F.left(digits, F.lit(6))).otherwise(F.left(digits, F.length(digits) - 4))
    return F.concat_ws(":", F.lit("pool"), span["kind"].cast("string"), shared)


def _entities(span: Column) -> Column:
    return F.explode(F.array(_entity(span), _pool(span))).alias("entity")


def _with_stems(words: Column) -> Column:
    return F.array_distinct(F.concat(words, F.transform(words, _stem)))


def _stem(word: Column) -> Column:
    return F.concat(F.lit("^"), F.left(word, F.lit(STEM)))


def _terms_near(span: Column, window: int) -> Column:
    """Terms of both sides of a span, without the words that the window cuts."""
    left = F.when(F.length(span["left"]) > window, F.regexp_replace(span["left"], r"^\S+", "")).otherwise(span["left"])
    right = F.when(F.length(span["right"]) > window, F.regexp_replace(span["right"], r"\S+$", "")).otherwise(span["right"])
    return F.regexp_extract_all(F.lower(F.concat_ws("\n", left, right)), F.lit(TERM), F.lit(0))


def disclosing_terms(docs: DataFrame, found: DataFrame, text_col: str = "text", threshold: float = 0.9, support: int = 3, window: int = WINDOW) -> DataFrame:
    """entity, term, general: words that reveal an entity, from counts over all documents."""
    texts = found.filter(F.size("spans") > 0).groupBy("key").agg(F.first("spans").alias("spans"), F.count("*").alias("rows"))
    near = texts.select("key", "rows", F.explode("spans").alias("span")).select("key", "rows", _entities(F.col("span")), _terms_near(F.col("span"), window).alias("terms"))
    entities = near.select("key", "rows", "entity").distinct().groupBy("entity").agg(F.sum("rows").alias("n_c"))
    pairs = near.select("key", "rows", "entity", F.explode(_with_stems(F.col("terms"))).alias("term")).distinct()
    pairs = stash(pairs.groupBy("entity", "term").agg(F.sum("rows").alias("n_ct"), F.count("*").alias("texts")), "pii-pairs")
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(TERM), F.lit(0)))
    df = docs.select(F.explode(_with_stems(words)).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    total = docs.agg(F.count("*").alias("n"))
    rated = pairs.join(df, "term").join(entities, "entity").crossJoin(F.broadcast(total))  # total: one row
    rated = rated.filter(F.log2(_given_term(support) * F.col("n") / F.col("n_c")) >= threshold * F.log2(F.col("n") / F.col("n_c")))
    rated = stash(rated.select("entity", "term"), "pii-terms")
    stems = rated.filter("term like '^%'").select("entity", F.col("term").alias("stem"))
    named = rated.filter("term not like '^%'").withColumn("stem", _stem(F.col("term")))
    return named.join(stems.withColumn("known", F.lit(True)), ["entity", "stem"], "left").select("entity", "term", F.col("known").isNull().alias("general"))


def _given_term(support: int) -> Column:
    """P(c|t), smoothed where fewer than ``support`` texts show the pair."""
    m = F.col("n_ct") / F.col("texts")
    smooth = (F.col("n_ct") + m * F.col("n_c") / F.col("n")) / (F.col("n_t") + m)
    return F.when(F.col("texts") >= support, F.col("n_ct") / F.col("n_t")).otherwise(smooth)


def term_spans(text: Column, terms: Column) -> Column:
    """Every place in a text of the given terms (array<struct<term, general>>)."""
    state = "struct<at:bigint,out:" + SPANS + ">"
    found, gaps = F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.split(text, TERM, -1)

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["gap"])
        end = begin + F.length(x["word"])
        hit = F.filter(terms, lambda t: t["term"] == F.lower(x["word"]))
        kind = F.when(F.exists(hit, lambda t: ~t["general"]), len(KINDS)).otherwise(len(KINDS) + 1)
        span = F.struct(begin.alias("start"), kind.alias("kind"), end.alias("end"), F.lower(x["word"]).alias("value"), F.lit("").alias("left"), F.lit("").alias("right"))
        return F.struct(end.alias("at"), F.when(F.size(hit) > 0, F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out")).cast(state)

    zipped = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda w, g: F.struct(w.alias("word"), g.alias("gap")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("out")).cast(state)
    return F.aggregate(zipped, start, step, lambda s: s["out"])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9, support: int = 3, window: int = WINDOW) -> DataFrame:
    """doc_id, key, spans (base), more (disclosing terms) and the text of rows with spans."""
    found = stash(find_spans(docs, id_col, text_col, window), "pii-found")
    reveal = disclosing_terms(docs, found, text_col, threshold, support, window)
    held = found.filter(F.size("spans") > 0).select("key", F.explode("spans").alias("span")).select("key", _entities(F.col("span"))).distinct()
    texts = found.filter(F.size("spans") > 0).groupBy("key").agg(F.first("text").alias("text"))
    # By the words of each text: a pool can have many texts and many terms, but few terms stand in one text.
    words = texts.select("key", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    hits = words.join(reveal, "term").join(held, ["key", "entity"], "left_semi").groupBy("key").agg(F.collect_set(F.struct("term", "general")).alias("terms"))
    # Written first, so that the last join is of two plain tables: broadcast if small, else split where copies make a key hot.
    more = stash(texts.join(hits, "key").select("key", term_spans(F.col("text"), F.col("terms")).alias("more")), "pii-more")
    return found.join(more, "key", "left").withColumn("more", F.coalesce("more", F.array().cast(SPANS)))


def sanitise(text: Column, spans: Column) -> Column:
    """The text with every span replaced: base kinds and terms by their name, generalised terms by their stem."""
    names = F.array(*[F.lit(k) for k in KINDS + MORE_KINDS])
    state = "struct<at:bigint,out:string>"

    def step(s: Column, x: Column) -> Column:
        put = F.when(x["kind"] == len(KINDS) + 1, F.concat(F.left(x["value"], F.lit(STEM)), F.lit("*"))).otherwise(F.concat(F.lit("["), F.upper(F.get(names, x["kind"])), F.lit("]")))
        kept = F.substr(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        return F.when(x["start"] >= s["at"], F.struct(x["end"].alias("at"), F.concat(s["out"], kept, put).alias("out")).cast(state)).otherwise(s)

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")).cast(state)
    return F.aggregate(F.array_sort(spans), start, step, lambda s: F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"))))


def written(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS + MORE_KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query_op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect(table(spark, sf_dir, "documents"))
    count = [F.size(F.filter("spans", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *count, F.sha2(written(F.col("spans")), 256).alias("base_sha256"), written(F.concat("spans", "more")).alias("spans"))


def _of_kind(i: int):
    return lambda s: s["kind"] == i
