"""Scalar functions on texts as Column expressions: language and candidate tests, tokens, validation, escapes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Scripts, path endings, identifiers and placeholder tokens that the catalog's rules are stated in.
KANA = r"[぀-ゟ゠-ヿｦ-ﾟ]"
CJK = r"[㐀-䶿一-鿿豈-﫿]"
HANGUL = r"[가-힯]"
LATIN_WORD = r"[A-Za-z]{2,}"
DETECTORS = {"ja": f"{KANA}|{CJK}", "en": LATIN_WORD, "ko": HANGUL, "zh": CJK}
PATH_ENDINGS = ("png", "jpg", "ogg", "wav", "mp3", "json", "tscn", "tres", "gd", "gdc", "js", "webp", "ks", "tjs", "txt", "csv", "asset", "prefab")
PATH_LIKE = r"(?iU)^(res|user|uid|https?|file)://|^[\w./\\-]+\.(" + "|".join(PATH_ENDINGS) + r")\n?\z"
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_.:/-]*\n?\z"
BRACES = r"\{[^{}\n]*\}"
PRINTF = r"%(?:\d+\$)?[-+0 #]*(?:\d+|\*)?(?:\.(?:\d+|\*))?[sdifxXocv]"
SEGMENTS = r"[\n\r\t　：:・／/|]+|\[[^\]]*\]|<[^>]*>|\\[A-Za-z]+\[[^\]]*\]"
#: White space at the edges of a text: Unicode's, with the four separators that a regular expression's \s leaves out.
EDGE = r"[\s\u001c-\u001f]"
ERRORS = ("empty", "nul", "tokens", "line_feeds", "tabs", "returns", "edge_space")


def running_sums(values: Column, block: int = 256) -> Column:
    """For each of an array of integers the sum of those before it. Arrays grow within blocks only, so long ones stay cheap."""
    none = F.array().cast("array<int>")

    def sums(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("total"), none.alias("before"))
        return F.aggregate(part, start, lambda s, v: F.struct((s["total"] + v).alias("total"), F.concat(s["before"], F.array(s["total"])).alias("before")))

    parts = F.transform(F.sequence(F.lit(0), ((F.size(values) - 1) / block).cast("int")), lambda b: sums(F.slice(values, b * block + 1, F.lit(block))))
    shift = lambda p: F.flatten(F.zip_with(p, sums(F.transform(p, lambda x: x["total"]))["before"], lambda x, at: F.transform(x["before"], lambda v: v + at)))
    return F.when(F.size(values) > 0, F.transform(F.array(parts), shift)[0]).otherwise(none)


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all matches of a pattern, by the lengths of the stretches between them."""

    def place(x: Column) -> Column:
        lengths = F.transform(x, lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["value"]), F.lit(0)))
        found = F.zip_with(x, running_sums(lengths), lambda p, at: F.struct((at + F.length(p["gap"])).alias("start"), (at + F.length(p["gap"]) + F.length(p["value"])).alias("end"), p["value"].alias("value")))
        return F.filter(found, lambda f: f["value"].isNotNull())

    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    return F.transform(F.array(pairs), place)[0]


def replaced(text: Column, pattern: str, put: Callable[[Column, Column], Column]) -> Column:
    """text with put(match, number from 0) in the place of each match of a pattern, in one pass."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    return F.when(text.isNotNull(), F.concat_ws("", F.transform(pairs, lambda p, i: F.concat(p["gap"], F.coalesce(put(p["value"], i), F.lit(""))))))


def put_back(text: Column, edits: Column) -> Column:
    """text with edits, an array of (start, end, put) without overlaps, in its place."""
    ordered = F.array_sort(edits)
    end = lambda x, i: F.when(i > 0, F.get(x, i - 1)["end"]).otherwise(0)
    pieces = lambda x: F.concat_ws("", F.transform(x, lambda e, i: F.concat(F.substr(text, end(x, i) + 1, e["start"] - end(x, i)), e["put"])))
    done = lambda x: F.concat(pieces(x), F.substr(text, F.element_at(x, -1)["end"] + 1, F.length(text)))
    return F.when(F.size(edits) > 0, F.transform(F.array(ordered), done)[0]).otherwise(text)


def two_characters(text: Column) -> Column:
    """Neighbouring characters, two by two, in time linear in the text."""
    letters = F.split(text, "")
    pairs = F.zip_with(letters, F.slice(letters, 2, 1 << 30), lambda a, b: F.concat(a, b))
    return F.array_compact(pairs)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{EDGE}+|{EDGE}+\z", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(rf"(?U)^{EDGE}*\z")


def has_source_text(text: Column, lang: str = "ja") -> Column:
    """Whether text may hold the source language; an unknown language is an error."""
    if lang not in DETECTORS:
        raise ValueError(f"unsupported source language: {lang}")
    return text.rlike(DETECTORS[lang])


def has_kana(text: Column) -> Column:
    return text.rlike(KANA)


def is_candidate(text: Column, lang: str = "ja") -> Column:
    """Not blank, not like a path, for English not like an identifier, and in the source language; null: false."""
    bare = strip(text)
    rules = ~is_blank(text) & ~bare.rlike(PATH_LIKE) & has_source_text(bare, lang)
    if lang == "en":
        rules = rules & ~bare.rlike(IDENTIFIER)
    return F.coalesce(rules, F.lit(False))


def token_pattern(extra: tuple[str, ...] = ()) -> str:
    """One alternation of an engine's own tokens, which come first, and the general ones."""
    return "|".join(f"(?:{p})" for p in (*extra, BRACES, PRINTF))


def tokens(text: Column, extra: tuple[str, ...] = ()) -> Column:
    return F.regexp_extract_all(text, F.lit(token_pattern(extra)), F.lit(0))


def count_of(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def edge_space(text: Column) -> tuple[Column, Column]:
    """Widths of the white space before and after; all of a blank text counts on both sides."""
    before = F.length(text) - F.length(F.regexp_replace(text, rf"(?U)^{EDGE}+", ""))
    after = F.length(text) - F.length(F.regexp_replace(text, rf"(?U){EDGE}+\z", ""))
    return before, after


def target_errors(source: Column, target: Column, extra: tuple[str, ...] = ()) -> Column:
    """Array of ERRORS that a translation has, in their order; an empty array passes. Blank or null: only "empty"."""
    sides = [(a > 0) != (b > 0) for a, b in zip(edge_space(source), edge_space(target), strict=True)]
    checks = [
        ("nul", F.contains(target, F.lit("\0"))),
        ("tokens", F.array_sort(tokens(source, extra)) != F.array_sort(tokens(target, extra))),
        ("line_feeds", count_of(source, "\n") != count_of(target, "\n")),
        ("tabs", count_of(source, "\t") != count_of(target, "\t")),
        ("returns", count_of(source, "\r") != count_of(target, "\r")),
        ("edge_space", sides[0] | sides[1]),
    ]
    found = F.array_compact(F.array(*[F.when(wrong, F.lit(name)) for name, wrong in checks]))
    return F.when(is_blank(target), F.array(F.lit("empty"))).otherwise(found)


def segments(text: Column) -> Column:
    """Stripped, non-blank pieces between line ends, colons, slashes, bars, tags and control codes."""
    pieces = F.transform(F.split(text, SEGMENTS, -1), strip)
    return F.filter(pieces, lambda p: p != "")


def join_cjk(text: Column) -> Column:
    """text without single spaces between two characters of the CJK scripts."""
    wide = r"[　-ヿ㐀-䶿一-鿿豈-﫿＀-￯]"
    return F.regexp_replace(text, rf"(?<={wide}) (?={wide})", "")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"\[[^\]\n]*\]", "")


def escape_entry(text: Column) -> Column:
    """A dictionary file's escapes: backslash, line feed, return, tab, equals sign, and a leading //."""
    pairs = (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("=", "\\="))
    out = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)
    return F.when(out.startswith("//"), F.concat(F.lit("\\"), out)).otherwise(out)


def unescape_entry(text: Column) -> Column:
    """Undo escape_entry, one escape at a time from the left; a lone backslash at the end stays."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\\.|[^\\]+|\\\z"), F.lit(0))
    plain = F.create_map(*[F.lit(x) for x in ("n", "\n", "r", "\r", "t", "\t")])

    def one(p: Column) -> Column:
        code = F.substring(p, 2, 1)
        return F.when(p.startswith("\\") & (F.length(p) == 2), F.coalesce(F.try_element_at(plain, code), code)).otherwise(p)

    return F.concat_ws("", F.transform(parts, one))


def split_entry(line: Column) -> tuple[Column, Column]:
    """The sides of a dictionary line before and after its first unescaped equals sign; null where it has none."""
    pattern = r"(?s)^((?:\\.|[^\\=])*)=(.*)\z"
    known = line.rlike(pattern)
    return tuple(F.when(known, F.regexp_extract(line, pattern, n)) for n in (1, 2))


def unescape_source(text: Column) -> Column:
    """Script escapes by plain replacement in this order: quote, line feed, tab, backslash."""
    pairs = (('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\\\\", "\\"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def json_literal(body: Column) -> Column:
    """The text that the inside of a JSON string stands for; null where it is malformed."""
    return F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), body, F.lit('"'))), "$", "string")


def glob_pattern(glob: str) -> str:
    """A regular expression for a file glob; * also crosses slashes."""
    out, i = "", 0
    while i < len(glob):
        c, i = glob[i], i + 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := glob.find("]", i + 1 + (glob[i : i + 1] == "!"))) > 0:
            inside, i = glob[i:end], end + 1
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else inside).replace("\\", "\\\\").replace("[", "\\[") + "]"
        else:
            out += c if c.isalnum() or c in "_/-" else "\\" + c
    return f"(?s)^{out}\\z"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def matches_any(path: Column, globs: list[str] | tuple[str, ...]) -> Column:
    """Whether the path or its last part matches one of the globs."""
    tests = [c.rlike(glob_pattern(g)) for g in globs for c in (path, base_name(path))]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def is_safe_path(path: Column) -> Column:
    """Relative, with forward slashes, without drive, empty, "." or ".." parts."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", ".."))
    return ~(bad | path.rlike(r"[\\:\x00]"))


def is_safe_literal(target: Column, quote: Column) -> Column:
    """Whether target can stand inside a literal: no line end and no unescaped quote of its kind."""
    bare = F.regexp_replace(target, r"(?s)\\.", "")
    return ~(target.rlike(r"[\n\r]") | F.contains(bare, quote))


def retry_delay(attempt: Column) -> Column:
    """Seconds to wait after a failed attempt: 30, doubling, at most 300."""
    power = F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(4))
    return F.least(F.lit(300), (30 * F.pow(F.lit(2), power)).cast("int"))


def utf16_with_mark(text: Column) -> Column:
    return F.concat(F.lit(bytes.fromhex("FFFE")), F.encode(text, "UTF-16LE"))


def decode_script(content: Column, code_page: str = "cp932") -> Column:
    """UTF-16 of the byte order that its mark tells, else UTF-8 with or without its mark, else the code page; null where none holds."""
    little, big = (F.substring(content, 1, 2) == F.lit(bytes.fromhex(m)) for m in ("FFFE", "FEFF"))
    wide = little | big
    utf8 = F.try_validate_utf8(content.cast("string"))
    plain = F.regexp_replace(utf8, "^﻿", "")
    # Spark's own decode knows no legacy code pages; only rows in one reach Python, in Arrow batches
    legacy = F.when(utf8.isNull() & ~wide, content)
    rest = content.substr(F.lit(3), F.octet_length(content))
    return F.when(little, F.decode(rest, "UTF-16LE")).when(big, F.decode(rest, "UTF-16BE")).otherwise(F.coalesce(plain, _code_page_text(code_page)(legacy)))


def _code_page_text(code_page: str):
    def one(raw) -> str | None:
        try:
            return None if raw is None else bytes(raw).decode(code_page)
        except UnicodeDecodeError:
            return None

    @F.pandas_udf("string")
    def decode(column: pd.Series) -> pd.Series:
        return column.map(one)

    return decode


def needs_code_page(content: Column) -> Column:
    """Whether a script is in a legacy code page: no byte order mark, and not valid UTF-8."""
    marked = F.substring(content, 1, 2).isin(F.lit(bytes.fromhex("FFFE")), F.lit(bytes.fromhex("FEFF")))
    return ~(marked | F.is_valid_utf8(content.cast("string")))


def percent(part: Column, whole: Column) -> Column:
    """A share as whole percents, halves to the even one; null where there is no whole."""
    return F.concat(F.bround(100 * F.try_divide(part, whole)).cast("int").cast("string"), F.lit("%"))


def stamp(seconds: Column) -> Column:
    """Seconds since the epoch as date and time of the session's zone, to the second."""
    return F.date_format(F.timestamp_micros((seconds * 1_000_000).cast("bigint")), "yyyyMMdd-HHmmss")


def iso_date(seconds: Column) -> Column:
    return F.date_format(F.timestamp_micros((seconds * 1_000_000).cast("bigint")), "yyyy-MM-dd")
