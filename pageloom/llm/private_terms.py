"""PII: information-theoretic sanitisation, with DataFrame functions only.

Base spans (email, ip, card, phone) are the protected entities. The corpus tells how strongly a term reveals an entity
that its text mentions. Of N texts, e stands in de, t in dt and both in co; with p(e) = de / N the information of e is
IC(e) = -log2 p(e), and what t discloses of it is PMI(e; t) = log2(p(e|t) / p(e)), where

    p(e|t) = (co + PRIOR * p(e)) / (dt + PRIOR)

shrinks toward p(e), so that a single sighting proves little. A term discloses e if it leaves at most LEFT_BITS of IC(e)
open, -log2 p(e|t) <= LEFT_BITS, and tells at least LEAST_BITS. Both bounds are free of the corpus's size. Every
occurrence of such a term in every text that mentions e is a span of kind `term`; `sanitise` removes these and
generalises base spans to their kind. Copies of a text that mentions an entity count once, as they are no evidence of
their own. Entities that stand in the same texts share one profile, so a directory is not paired entity by entity.

Defined results: a null or empty text has no span; equal texts get equal spans, so repeated rows and ties do, too; null
ids are allowed; an empty table gives an empty table; only the id and text columns are read, so extra columns of any
name do not clash (`sanitise` keeps all columns). Time is near linear in the length of a text and in its spans.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.shared import BROADCAST_ROWS, small, written

#: The kinds in order and their patterns. Possessive forms find the same spans without recursion.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text that this does not match has no span of the kind; it spares the search for positions.
_HINT = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TERM = r"[\p{L}][\p{L}\p{N}_]{2,}+"
#: Texts that the prior counts for; bits of an entity that a term may leave open, and those that it must tell at least.
PRIOR, LEFT_BITS, LEAST_BITS = 1.0, 0.6, 4.0
REPLACEMENT = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": ""}
#: Copies of a text from which its rows are joined apart; spans that a broadcast table may hold in all.
HOT, BROADCAST_SPANS = 200, 500_000
#: Characters to a chunk of a text that is taken to pieces.
CHUNK = 512

SPAN = "array<struct<s:int,k:int,e:int,m:string>>"
Fold = Callable[[Column, Column], Column]


def _scanned(df: DataFrame, names: list[str], fold: Fold) -> DataFrame:
    """df with each named array of numbers (from 0) replaced by its folds of 0 .. i, in blocks of the root of its size.

    Every step has a projection of its own and meets an array that is read inside a lambda function at least twice, so
    that Spark computes it once.
    """
    kept = [c for c in df.columns if c not in names]
    total = lambda x: F.aggregate(x, F.lit(0), fold)

    def blocks(v: str) -> Column:
        size = F.greatest(F.lit(8), F.ceil(F.sqrt(F.size(v))).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / size).cast("int") - 1, F.lit(0))), lambda b: F.slice(v, b * size + 1, size))

    def before(sums: str) -> Column:
        return F.transform(sums, lambda _, i: total(F.slice(sums, 1, i)))

    def within(v: str) -> Column:
        return F.flatten(F.zip_with(v, f"{v}__before", lambda x, f: F.transform(x, lambda _, i: fold(f, total(F.slice(x, 1, i + 1))))))

    df = df.select(*kept, *(blocks(v).alias(v) for v in names))
    df = df.select(*kept, *names, *(F.transform(v, total).alias(f"{v}__sums") for v in names))
    df = df.select(*kept, *names, *(before(f"{v}__sums").alias(f"{v}__before") for v in names))
    return df.select(*kept, *(within(v).alias(v) for v in names))


def _matches(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with a column for each pattern that has all its matches in the text column as structs (s, e, m) with code point
    positions, from the lengths of the pieces between them. A pattern is only searched where its column holds."""
    kept, names = df.columns, list(patterns)
    none = lambda kind: F.array().cast(f"array<{kind}>")
    df = df.select(*kept, *(F.when(may, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none("string")).alias(k) for k, (p, may) in patterns.items()))
    steps = lambda k, p: F.zip_with(F.slice(F.split(text, p, -1), 1, F.size(k)), k, lambda x, h: F.length(x) + F.length(h))
    df = df.select(*kept, *names, *(F.when(F.size(k) > 0, steps(k, p)).otherwise(none("int")).alias(f"{k}__end") for k, (p, _) in patterns.items()))
    df = _scanned(df, [f"{k}__end" for k in names], lambda a, b: a + b)
    return df.select(*kept, *(F.zip_with(f"{k}__end", k, lambda e, h: F.struct((e - F.length(h)).alias("s"), e.alias("e"), h.alias("m"))).alias(k) for k in names))


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    if kind == "ip":
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(m, "[ -]", "")
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def with_base(df: DataFrame, text: str = "t") -> DataFrame:
    """df with __base: the valid base spans of the text column (not null), by start, then kind."""
    kept = df.columns
    has = {k: F.col(text).contains(_HINT[k]) if _HINT[k] else F.col(text).rlike(r"[0-9](?:[\x20-]?[0-9]){11}") for k in KINDS}
    df = _matches(df, text, {f"__{k}": (PATTERNS[k], has[k]) for k in KINDS})
    # a predicate on a column that is not deterministic stays above it; pushed down, it would repeat all steps inside it
    here = F.monotonically_increasing_id() >= 0
    return df.select(*kept, F.when(here, F.array_sort(F.concat(*(_valid_spans(k) for k in range(len(KINDS)))))).alias("__base"))


def _valid_spans(k: int) -> Column:
    valid = F.filter(f"__{KINDS[k]}", lambda x: _valid(KINDS[k], x["m"]))
    return F.transform(valid, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["m"].alias("m"))).cast(SPAN)


def _rebuilt(df: DataFrame, text: str, spans: str, out: str, mark: Callable[[Column], Column] | None) -> DataFrame:
    """df with out: the text with mark(kind) for each span, or with blanks of its length. Spans that overlap an earlier
    one are covered together: the text resumes after the furthest end."""
    kept = df.columns
    df = df.select(*kept, F.transform(spans, lambda x: x["e"]).alias("__top"))
    df = _scanned(df, ["__top"], lambda a, b: F.greatest(a, b))
    starts = F.concat(F.array(F.lit(0)), F.slice("__top", 1, F.greatest(F.size("__top") - 1, F.lit(0))))
    fresh = F.filter(F.zip_with(spans, starts, lambda x, top: F.struct(x["s"].alias("s"), x["k"].alias("k"), top.alias("top"))), lambda x: x["s"] >= x["top"])
    chunks = F.when(F.size(spans) > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))
    df = df.select(*kept, fresh.alias("__fresh"), F.get("__top", F.size("__top") - 1).alias("__end"), chunks.alias("__chunks"))

    def between(low: Column, high: Column) -> Column:
        first = F.floor(low / CHUNK).cast("int")
        some = F.array_join(F.slice("__chunks", first + 1, F.greatest(F.floor((high - 1) / CHUNK).cast("int") - first + 1, F.lit(0))), "")
        return F.when(high > low, F.substring(some, low - first * CHUNK + 1, high - low)).otherwise("")

    blank = lambda a, b: F.repeat(F.lit(" "), F.greatest(a - b, F.lit(0)))
    if mark:
        made, gap = F.transform("__fresh", lambda x: F.concat(between(x["top"], x["s"]), mark(x["k"]))), F.lit("")
    else:
        made = F.transform("__fresh", lambda x, i: F.concat(F.when(i > 0, blank(x["top"], F.get("__fresh", i - 1)["s"])).otherwise(""), between(x["top"], x["s"])))
        gap = blank(F.col("__end"), F.get("__fresh", F.size("__fresh") - 1)["s"])
    whole = F.concat(F.array_join(made, ""), gap, between(F.col("__end"), F.length(text)))
    return df.select(*kept, F.when(F.size(spans) > 0, whole).otherwise(F.col(text)).alias(out))


def _key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def mentions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per different text that mentions an entity: key, its entities, its words (t, s, e) clear of base spans, and
    n, its copies."""
    rows = with_base(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))).where(F.size("__base") > 0)
    names = F.array(*map(F.lit, KINDS))
    entity = lambda x: F.xxhash64(F.element_at(names, x["k"] + 1), F.lower(x["m"]))
    rows = _rebuilt(rows, "t", "__base", "masked", None)
    rows = rows.select(_key(F.col("t")).alias("key"), F.array_distinct(F.transform("__base", entity)).alias("entities"), "masked")
    rows = _matches(rows, "masked", {"words": (TERM, F.lit(True))})
    words = F.transform("words", lambda m: F.struct(F.lower(m["m"]).alias("t"), m["s"].alias("s"), m["e"].alias("e")))
    rows = rows.select("key", "entities", words.alias("words"))
    return rows.groupBy("key").agg(F.first("entities").alias("entities"), F.first("words").alias("words"), F.count("*").alias("n"))


def _open_bits(co: Column, de: Column, dt: Column, n: int) -> Column:
    """The bits of an entity that a term leaves open: -log2 p(e|t)."""
    return -F.log2((co + F.lit(PRIOR) * de / F.lit(float(n))) / (dt + F.lit(PRIOR)))


def _tells(co: Column, de: Column, dt: Column, n: int, left: float, least: float) -> Column:
    return (_open_bits(co, de, dt, n) <= left) & (F.lit(log2(n)) - F.log2(de) - _open_bits(co, de, dt, n) >= least)


def disclosing(docs: DataFrame, found: DataFrame, text_col: str = "text", left: float = LEFT_BITS, least: float = LEAST_BITS) -> DataFrame:
    """key, t: the terms that disclose an entity of the text. Counts cover all documents; each is combined before its
    shuffle. A pair is formed only if its counts alone do not rule it out."""
    spark = docs.sparkSession
    copies = found.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("more")).first().more
    n = max(docs.count() - copies, 1)
    none = spark.createDataFrame([], "key string, t string")
    each = found.select("key", F.explode("entities").alias("e"))
    # the texts of an entity, as their number and two sums of hashes; equal ones are one profile
    profile = [F.count("*").alias("de"), F.bit_xor(F.xxhash64("key")).alias("a"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("b")]
    entities = each.groupBy("e").agg(*profile).where(_tells(F.col("de"), F.col("de"), F.col("de"), n, left, least))
    of = written(each.join(small(written(entities, "entities")), "e").select("key", "de", "a", "b").distinct(), "profiles")
    most = of.agg(F.max("de").alias("de")).first().de
    if most is None:
        return none
    own = found.join(small(of.select("key").distinct()), "key", "left_semi").select("key", F.explode(F.array_distinct(F.transform("words", lambda w: w["t"]))).alias("t"))
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(TERM), F.lit(0)))
    # the outer form keeps Spark from evaluating the words a second time in a filter on their number
    rows = docs.select(F.explode_outer(words).alias("t")).where("t is not null").groupBy("t").agg(F.count("*").alias("all"))
    again = found.where("n > 1").select("n", F.explode(F.array_distinct(F.transform("words", lambda w: w["t"]))).alias("t")).groupBy("t").agg(F.sum(F.col("n") - 1).alias("more"))
    rare = rows.join(again, "t", "left").select("t", F.greatest(F.col("all") - F.coalesce("more", F.lit(0)), F.lit(1)).alias("dt"))
    # a term in so many texts that even the most frequent entity could not be told by it is out
    rare = rare.where(F.col("dt") <= F.lit((most + PRIOR) * 2.0**left))
    near = own.join(rare, "t").join(of, "key").where(_tells(F.least("de", "dt"), F.col("de"), F.col("dt"), n, left, least))
    near = written(near.select("key", "t", "dt", "de", "a", "b"), "near")
    pair = ["t", "de", "a", "b"]
    told = near.groupBy(*pair).agg(F.count("*").alias("co"), F.first("dt").alias("dt")).where(_tells(F.least("co", "dt"), F.col("de"), F.col("dt"), n, left, least)).select(*pair)
    return near.join(told, pair, "left_semi").select("key", "t").distinct()


def _added(docs: DataFrame, text_col: str, left: float, least: float) -> DataFrame:
    """__key, __n, __added: the term spans of each text that has some."""
    found = written(mentions(docs, text_col), "mentions")
    told = written(disclosing(docs, found, text_col, left, least), "told")
    some = found.join(small(told.select("key").distinct()), "key", "left_semi").select("key", "n", F.explode("words").alias("w"))
    spans = some.withColumn("t", F.col("w.t")).join(told, ["key", "t"], "left_semi")
    span = F.struct(F.col("w.s").alias("s"), F.lit(4).alias("k"), F.col("w.e").alias("e"), F.col("w.t").alias("m"))
    return written(spans.groupBy("key").agg(F.first("n").alias("n"), F.collect_list(span).cast(SPAN).alias("added")).toDF("__key", "__n", "__added"), "added")


def _attached(rows: DataFrame, added: DataFrame) -> DataFrame:
    """rows with __added. A table of few spans is broadcast; else the texts of many copies are, and rows that can have no
    term span, which need not meet, are spread evenly."""
    size = added.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("__added")), F.lit(0)).alias("spans")).first()
    table = added.select("__key", "__added")
    if size.rows <= BROADCAST_ROWS and size.spans <= BROADCAST_SPANS:
        return rows.join(F.broadcast(table), "__key", "left")
    hot = small(table.where(F.col("__n") > HOT).toDF("__hot_key", "__hot"))
    one = rows.join(hot, F.col("__key") == F.col("__hot_key"), "left")
    meets = (F.size("__base") > 0) & F.col("__hot").isNull()
    spread = F.when(meets, F.col("__key")).otherwise(F.concat("__key", F.lit("/"), F.pmod("__row", F.lit(4096)).cast("string")))
    rest = table.where(F.col("__n") <= HOT).toDF("__rest_key", "__rest")
    both = one.join(rest, spread == F.col("__rest_key"), "left")
    return both.withColumn("__added", F.coalesce("__hot", "__rest")).drop("__hot_key", "__hot", "__rest_key", "__rest")


def _with_spans(docs: DataFrame, cols: list[str], id_col: str, text_col: str, left: float, least: float) -> DataFrame:
    """row (a struct of cols) with __base and __spans (base and term spans by start, then kind)."""
    added = _added(docs.select(id_col, text_col), text_col, left, least)
    # the row travels as one struct, so its columns cannot clash with those made here
    own = docs.select(F.struct(*cols).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"), F.xxhash64(F.col(id_col).cast("string")).alias("__row"))
    own = with_base(own, "__t").withColumn("__key", _key(F.col("__t")))
    return _attached(own, added).withColumn("__spans", F.array_sort(F.concat("__base", F.coalesce("__added", F.array().cast(SPAN)))))


def _shown(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in (*KINDS, "term")))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", left: float = LEFT_BITS, least: float = LEAST_BITS) -> DataFrame:
    """id, the counts by kind, base_sha256, spans (kind:start:end by start, then kind), n_term."""
    rows = _with_spans(docs, [id_col], id_col, text_col, left, least)
    count = lambda k: F.size(F.filter("__spans", lambda x: x["k"] == k)).cast("long")
    return rows.select(F.col("row")[id_col].alias(id_col), *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(_shown(F.col("__base")), 256).alias("base_sha256"), _shown(F.col("__spans")).alias("spans"), count(4).alias("n_term"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", left: float = LEFT_BITS, least: float = LEAST_BITS) -> DataFrame:
    """docs with base spans generalised to their kind and disclosing terms removed; n_chars, if any, follows."""
    rows = _with_spans(docs, docs.columns, id_col, text_col, left, least)
    marks = F.array(*(F.lit(REPLACEMENT[k]) for k in (*KINDS, "term")))
    rows = _rebuilt(rows, "__t", "__spans", "__out", lambda k: F.element_at(marks, k + 1))
    rows = rows.withColumn("__clean", F.when(F.col("row")[text_col].isNotNull(), F.col("__out")))
    changed = {text_col: F.col("__clean"), "n_chars": F.coalesce(F.length("__clean").cast("long"), F.col("row")["n_chars"]) if "n_chars" in docs.columns else None}
    return rows.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
