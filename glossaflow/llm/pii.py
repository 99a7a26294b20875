"""Personal data, and the terms that give it away.

Base: e-mail addresses, IP addresses, card numbers and phone numbers, leftmost and non-overlapping within a kind, found
by Spark's own regular expressions. The patterns are written with possessive repeats and with starts held to the
beginning of a run, which finds the same matches without going back, so very long runs neither overflow the stack
nor take quadratic time. Positions are code points.

Method: every distinct base value is a protected entity. The words within CONTEXT words of its occurrences are terms that
may reveal it. Over the corpus, n(e, t) counts the distinct contexts in which term t stands beside entity e and n(t) the
distinct texts with t, or the distinct contexts with t where these are more. What t leaves unknown of e is IC(e) - PMI(e; t) = -log2(n(e, t) / n(t)) bits; with at least SUPPORT
contexts and at most one bit left (2 n(e, t) >= n(t)) the term discloses the entity. Copies of a text count once on both sides.
Disclosing terms are spans of the kind "term" wherever they occur, and sanitise() generalises them like base values.

Everything is DataFrame expressions. Nulls and empty texts have no spans; an empty table gives an empty result; very long texts are read
whole, in time about linear in their length. Rows of one id and text have equal results, a null id is an id like others. Other columns,
whatever their names, are left behind by spans() and kept by sanitise().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import located, put_back
from .common import checkpoint, fresh, only

KINDS = ("email", "ip", "card", "phone", "term")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"[\p{L}\p{N}_'-]++"
#: Words on each side of an entity, least length of a term, least number of distinct contexts.
CONTEXT = 5
LEAST_LETTERS = 4
SUPPORT = 3
#: Characters in which the words are looked for first; where they hold too few, the whole side is read.
_CONTEXT_CHARS = 120
_FIRST = rf"^(?:[^\p{{L}}\p{{N}}_'-]*+{WORD}){{0,{CONTEXT}}}"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _ip_valid(c: Column) -> Column:
    short = F.transform(F.split(c, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(short, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255"))))


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check: from the right, every second one doubled and its digits added."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2 / 10).cast("int") + d.cast("int") * 2 % 10))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _card_valid(c: Column) -> Column:
    digits = _digits(c)
    return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)


def _phone_valid(c: Column) -> Column:
    return F.length(_digits(c)).between(9, 15)


def _kind_spans(text: Column, kind: int, pattern: str, may: Column, valid=None) -> Column:
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    found = located(text, pattern)
    found = F.filter(found, lambda s: valid(s["value"])) if valid else found
    shaped = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    return F.when(may, shaped).otherwise(none)


def with_base_spans(df: DataFrame, text_col: str = "text", out: str = "base") -> DataFrame:
    """df with the column `out`: array of (start, kind, end, value) in order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digit = text.rlike("[0-9]")
    kinds = [
        _kind_spans(text, 0, EMAIL, text.contains("@")),
        _kind_spans(text, 1, IP, text.contains(".") & digit & text.rlike(r"[0-9]\.[0-9]"), _ip_valid),
        _kind_spans(text, 2, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), _card_valid),
        _kind_spans(text, 3, PHONE, text.contains("+") & digit, _phone_valid),
    ]
    return df.withColumn(out, F.array_sort(F.concat(*kinds)))


def _term(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contexts(text: Column, base: Column) -> Column:
    """Array of (entity, context, terms) for each base span: a digest of the words on both sides, and these words."""
    words = lambda c: F.regexp_extract_all(c, F.lit(WORD), F.lit(0))
    # the last word of a part may be cut, so one more than needed must be there
    enough = lambda part, whole: F.when(F.size(part) > CONTEXT, F.slice(part, 1, CONTEXT)).otherwise(whole)

    def one(s: Column) -> Column:
        reach = F.greatest(s["start"] - _CONTEXT_CHARS, F.lit(0))
        before = words(F.regexp_extract(F.reverse(text.substr(F.lit(1), s["start"])), _FIRST, 0))
        left = enough(F.reverse(words(text.substr(reach + 1, s["start"] - reach))), F.transform(before, lambda w: F.reverse(w)))
        after = words(F.regexp_extract(text.substr(s["end"] + 1, F.length(text)), _FIRST, 0))
        right = enough(words(text.substr(s["end"] + 1, F.lit(_CONTEXT_CHARS))), after)
        terms = F.array_distinct(F.transform(F.concat(left, right), _term))
        return F.struct(
            F.concat_ws(":", s["kind"].cast("string"), s["value"]).alias("entity"),
            F.sha1(F.concat_ws("\n", left, F.array(F.lit("")), right)).alias("context"),
            F.filter(terms, lambda t: F.length(t) >= LEAST_LETTERS).alias("terms"),
        )

    return F.transform(base, one)


def based(docs: DataFrame) -> DataFrame:
    """(id, mark, base, near) of (id, text): base spans and their contexts; mark tells texts of one id apart."""
    found = with_base_spans(docs).withColumn("near", contexts(F.coalesce("text", F.lit("")), F.col("base")))
    return checkpoint(found.select("id", F.xxhash64("text").alias("mark"), "base", "near"))


def disclosing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(term): terms of (id, text) that leave at most one bit unknown of some entity; found as based() gives it."""
    near = found.where(F.size("near") > 0).select(F.explode("near").alias("x")).select("x.entity", "x.context", F.explode("x.terms").alias("term"))
    # one row for each context first, so a copied text counts once and a hot entity is added up on the map side
    once = near.distinct()
    beside = once.groupBy("entity", "term").agg(F.count("*").alias("together")).where(F.col("together") >= SUPPORT)
    # a term that stands beside many entities leaves more than a bit unknown already; it needs no count over the corpus
    spread = once.select("term", "context").distinct().groupBy("term").agg(F.count("*").alias("contexts"))
    strongest = beside.groupBy("term").agg(F.max("together").alias("together")).join(spread, "term")
    strongest = checkpoint(strongest.where(2 * F.col("together") >= F.col("contexts")).select("term", "together"))
    if strongest.isEmpty():
        return strongest.select("term")
    spread = occurrences(docs, strongest).select("mark", "term").distinct().groupBy("term").agg(F.count("*").alias("n"))
    return checkpoint(spread.join(strongest, "term").where(2 * F.col("together") >= F.col("n")).select("term"))


def _few(terms: DataFrame, most_rows: int = 50_000) -> DataFrame:
    """Broadcast terms only when counted to be few."""
    return F.broadcast(terms) if terms.limit(most_rows + 1).count() <= most_rows else terms


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, mark, term): which of the terms each (id, text) has."""
    words = F.array_distinct(F.regexp_extract_all(_term(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0)))
    return docs.select("id", F.xxhash64("text").alias("mark"), F.explode(words).alias("term")).where(F.length("term") >= LEAST_LETTERS).join(_few(terms.select("term")), "term")


def _term_spans(text: Column, held: Column) -> Column:
    placed = F.filter(located(text, WORD), lambda s: F.array_contains(held, _term(s["value"])))
    return F.transform(placed, lambda s: F.struct(s["start"].alias("start"), F.lit(4).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def held_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, mark, held): the terms that each (id, text) has. They are stored and counted, so that few do not draw all texts into a shuffle."""
    return _few(checkpoint(occurrences(docs, terms).groupBy("id", "mark").agg(F.collect_set("term").alias("held"))))


def _same(left: str, right: str) -> Column:
    """Rows of one id, which may be null, and one text."""
    return F.col(f"{left}.id").eqNullSafe(F.col(f"{right}.id")) & (F.col(f"{left}.mark") == F.col(f"{right}.mark"))


def all_spans(docs: DataFrame) -> DataFrame:
    """(id, mark, base, terms) for each row of (id, text); terms as base, without those that a base span covers."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    small = based(docs)
    terms = disclosing_terms(docs, small)
    if terms.isEmpty():
        return small.select("id", "mark", "base", none.alias("terms"))
    held = held_terms(docs, terms)
    texts = docs.withColumn("mark", F.xxhash64("text")).alias("d").join(held.alias("h"), _same("d", "h")).select("h.id", "h.mark", "text", "held").dropDuplicates(["id", "mark"])
    found = texts.select("id", "mark", _term_spans(F.col("text"), F.col("held")).alias("terms"))
    joined = small.alias("s").join(found.alias("f"), _same("s", "f"), "left").select("s.id", "s.mark", "base", "terms")
    free = F.filter(F.coalesce("terms", none), lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return joined.select("id", "mark", "base", free.alias("terms"))


def _count(k: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row."""
    found = all_spans(only(df, id=id_col, text=text_col))
    counts = [_count(k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.select("id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.array_sort(F.concat("base", "terms"))).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; of overlapping spans the first gives the name."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    none = F.array().cast("array<struct<start:int,end:int,put:string>>")

    def step(state: Column, s: Column) -> Column:
        last = F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["kind"]).alias("put"))
        covered = F.struct(F.element_at(state, -1)["start"].alias("start"), F.greatest(F.element_at(state, -1)["end"], s["end"]).alias("end"), F.element_at(state, -1)["put"].alias("put"))
        overlaps = (F.size(state) > 0) & (s["start"] < F.coalesce(F.try_element_at(state, F.lit(-1))["end"], F.lit(0)))
        return F.when(overlaps, F.concat(F.slice(state, F.lit(1), F.size(state) - 1), F.array(covered))).otherwise(F.concat(state, F.array(last)))

    # most texts have no spans that overlap; only those that have are merged one by one
    apart = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["kind"]).alias("put")))
    clash = F.exists(F.sequence(F.lit(1), F.greatest(F.size(spans) - 1, F.lit(1))), lambda i: F.coalesce(F.get(spans, i)["start"] < F.get(spans, i - 1)["end"], F.lit(False)))
    return put_back(text, F.when(clash, F.aggregate(spans, none, step)).otherwise(apart))


def sanitise(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """df with base values and disclosing terms generalised to their kinds, and n_chars, if it is there, counted anew.

    Only texts with spans change. The terms that a text holds are joined to it by id and a hash of the text.
    """
    docs = only(df, id=id_col, text=text_col)
    terms = disclosing_terms(docs, based(docs))
    row = fresh(df, "row")  # a column of its own beside which no name can clash
    others = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    wide = df.select(F.struct(*others).alias(row), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("mark"))
    found = with_base_spans(wide)
    if terms.isEmpty():
        found = found.withColumn("spans", F.col("base"))
    else:
        found = found.alias("d").join(held_terms(docs, terms).alias("h"), _same("d", "h"), "left").select(f"d.{row}", "d.text", "base", "held")
        found = found.withColumn("spans", F.when(F.col("held").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", _term_spans(F.col("text"), F.col("held"))))))
    found = found.withColumn("clean", redact(F.col("text"), F.col("spans")))

    def column(c: str) -> Column:
        if c == text_col:
            return F.col("clean")
        if c == "n_chars":
            return F.when(F.size("spans") == 0, F.col(row)[c]).otherwise(F.length("clean").cast("bigint"))
        return F.col(row)[c]

    return found.select(*[column(c).alias(c) for c in df.columns])
