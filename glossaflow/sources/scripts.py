"""Text units of scenario scripts and literals of program scripts, with their places, and putting translations back.

Everything is column expressions over one row for each file: a regular expression divides a text into units, and the lengths of the
stretches give their places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, is_candidate, is_safe_literal, json_literal, located, put_back, running_sums, strip, unescape_source

# Tags, the attributes that hold text, and blocks of code in scenario scripts.
TAG = r"\[[^\]\n]*\]"
ATTRIBUTE = r"""\b(?:text|jname)\s*=\s*(?:"[^"\]\n]*"|'[^'\]\n]*'|[^\s\]"']+)"""
CODE = (("[iscript]", "[endscript]"), ("[html]", "[endhtml]"), ("@iscript", "@endscript"))
SPEAKER = r"^【[^】\n]+】\z"
#: Scripts that run before translated ones can take their place.
EARLY_SCRIPTS = ("startup.tjs", "initialize.tjs")
#: Comments, embedded expressions and strings with their quotes, ended or not.
LITERAL = r"""//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)|@?"(?s:\\.|[^"\\\n])*+"?|@?'(?s:\\.|[^'\\\n])*+'?"""
WHOLE_STRING = r"""^(?:"(?s:\\.|[^"\\\n])*+"|'(?s:\\.|[^'\\\n])*+')\z"""


def _quoted(mark: str) -> str:
    return "".join("\\" + c if c in "[]" else c for c in mark)


def _stretches() -> str:
    """A pattern of blocks of code, from the line that opens one to the line that begins with its end, and of single lines."""
    blank = r"[^\S\n]*"
    blocks = [rf"^{blank}{_quoted(o)}(?![^\n]*{_quoted(c)})[^\n]*+(?s:.*?)(?:\n{blank}{_quoted(c)}[^\n]*+|\z)" for o, c in CODE]
    return "(?im)" + "|".join([*blocks, r"^[^\n]*+$"])


def scenario_lines(texts: DataFrame) -> DataFrame:
    """(seq, line, body, code) of texts (seq, text): each line outside code, and each block of code as one row."""
    feeds = lambda b: (F.length(b) - F.length(F.replace(b, F.lit("\n"), F.lit(""))) + 1).cast("int")
    # all within the row of a file: how many lines stand before a stretch is a running sum over its stretches
    numbered = lambda found: F.arrays_zip(found.alias("body"), running_sums(F.transform(found, feeds)).alias("line"))
    # a carriage return must not count as a line end to ^ and $
    stretches = F.regexp_extract_all("text", F.lit("(?d)" + _stretches()), F.lit(0))
    parts = texts.where("text <> ''").select("seq", F.explode(F.transform(F.array(stretches), numbered)[0]).alias("x")).select("seq", "x.line", "x.body")
    low = F.lower(strip(F.col("body")))
    opens = [low.startswith(o) & ~F.contains(F.substring_index(low, "\n", 1), F.lit(c)) for o, c in CODE]
    return parts.select("seq", "line", "body", reduce(lambda a, b: a | b, opens).alias("code"))


def scenario_units(texts: DataFrame) -> DataFrame:
    """(seq, line, kind, start, end, source) of texts (seq, text): speakers (#name), lines with text outside tags, and the text attributes of
    other tags; code, comments (;), labels (*) and commands (@) are passed over. Places count from the line's beginning."""
    lines = scenario_lines(texts).where("NOT code").drop("code").withColumn("bare", strip(F.col("body"))).where("bare <> '' AND bare NOT RLIKE '^[;*@]'")
    lead, end = F.length("body") - F.length(F.regexp_replace("body", r"(?U)^[\s\u001c-\u001f]+", "")), F.length(F.regexp_replace("body", r"(?U)[\s\u001c-\u001f]+\z", ""))
    kind = F.when(F.col("bare").startswith("#"), "speaker").when(strip(F.regexp_replace("bare", TAG, "")) != "", "text")
    named = lines.select("seq", "line", "body", kind.alias("kind"), lead.alias("lead"), end.alias("end"))
    start = F.col("lead") + F.when(F.col("kind") == "speaker", 1).otherwise(0)
    unit = lambda kind, start, end, source: F.struct(kind.alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"), source.alias("source"))
    plain = unit(F.col("kind"), start, F.col("end"), F.substr("body", start + 1, F.col("end") - start))

    def attribute(x: Column) -> Column:
        value = F.regexp_replace(x["value"], r"^\w+\s*=\s*", "")
        inner = F.when(value.rlike("^[\"']"), 1).otherwise(0)
        name = F.concat(F.lit("attr:"), F.regexp_extract(x["value"], r"^\w+", 0))
        return unit(name, x["end"] - F.length(value) + inner, x["end"] - inner, F.substr(value, inner + 1, F.length(value) - 2 * inner))

    units = F.when(F.col("kind").isNotNull(), F.array(plain)).otherwise(F.transform(located(F.col("body"), ATTRIBUTE), attribute))
    found = named.select("seq", "line", F.explode(units).alias("x")).select("seq", "line", "x.*")
    return found.where("kind <> 'speaker' OR trim(source) <> ''")


def string_literals(texts: DataFrame) -> DataFrame:
    """(seq, start, end, quote, source) of texts (seq, text): string literals of a program script, with their escapes as written.
    Comments, embedded expressions (@ before the quote) and strings without an end are passed over."""
    found = texts.select("seq", F.explode(F.filter(located(F.col("text"), LITERAL), lambda x: x["value"].rlike(WHOLE_STRING))).alias("x"))
    body = F.substr("x.value", F.lit(2), F.length("x.value") - 2)
    return found.select("seq", (F.col("x.start") + 1).alias("start"), (F.col("x.end") - 1).alias("end"), F.substring("x.value", 1, 1).alias("quote"), body.alias("source"))


def scenario_occurrences(files: DataFrame, lang: str = "ja", attributes_shown: bool = False) -> DataFrame:
    """(source, surface, ref, context, hint) of the candidates in scenarios (path, text). Lines of text are display; other units are unknown, or,
    where attributes are shown as they are, only speakers. A name alone in brackets is a speaker by context."""
    units = scenario_units(files.select(F.col("path").alias("seq"), "text"))
    visible = strip(F.regexp_replace("source", TAG, ""))
    shown = F.col("kind") != "speaker" if attributes_shown else F.col("kind") == "text"
    context = F.when(visible.rlike(SPEAKER), "speaker").otherwise(F.col("kind"))
    # a filter makes a text anew wherever it stands, so it is made once and named
    fit = units.where(F.transform(F.array(visible), lambda v: is_candidate(v, lang))[0])
    return fit.select("source", F.lit("scenario").alias("surface"), F.concat_ws(":", "seq", F.col("line") + 1).alias("ref"), context.alias("context"), F.when(shown, "display").otherwise("unknown").alias("hint"))


def literal_occurrences(files: DataFrame, lang: str = "ja") -> DataFrame:
    """(source, surface, ref, context, hint) of the candidates among the literals of program scripts (path, text): unknown, and protected in
    EARLY_SCRIPTS, whose translation would come too late."""
    found = string_literals(files.select(F.col("path").alias("seq"), "text")).where(is_candidate(F.col("source"), lang))
    early = F.lower(base_name(F.col("seq"))).isin(*EARLY_SCRIPTS)
    kind = F.lit("literal")
    return found.select("source", kind.alias("surface"), F.concat_ws("@", "seq", "start").alias("ref"), kind.alias("context"), F.when(early, "protected").otherwise("unknown").alias("hint"))


#: Scripts of the engine itself, and event commands whose parameters are code.
ENGINE_SCRIPTS = ("rpg_core.js", "rpg_managers.js", "rpg_objects.js", "rpg_scenes.js", "rpg_sprites.js", "rpg_windows.js")
CODE_COMMANDS = (111, 122, 355, 356, 655)


def script_corpus(files: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """(text): a game's own scripts (path, text), and the strings in the parameters of event commands with code, from json_walk.leaves()."""
    name = base_name(F.col("path"))
    own = files.where(name.endswith(".js") & ~name.isin(*ENGINE_SCRIPTS) & ~name.startswith("rmmz_") & F.col("text").isNotNull()).select("text")
    if leaves is None:
        return own
    at = lambda pattern: F.regexp_extract("path", pattern, 1)
    code, parameter = r"^(.*?)/?code$", r"^(.*?)/?parameters/.*$"
    coded = leaves.where(F.col("path").rlike(code) & F.col("text").try_cast("int").isin(*CODE_COMMANDS)).select("file", at(code).alias("at"))
    held = leaves.where((F.col("kind") == "STRING") & F.col("path").rlike(parameter)).select("file", at(parameter).alias("at"), "text")
    return own.unionByName(held.join(coded, ["file", "at"], "left_semi").select("text"))


def apply_units(texts: DataFrame, translations: DataFrame) -> DataFrame:
    """(seq, text, n_edits): scenarios (seq, text) with units translated (source, target) in place."""
    edits = scenario_units(texts).join(translations.where("source <> target"), "source")
    per_line = edits.groupBy("seq", "line").agg(F.collect_list(F.struct("start", "end", F.col("target").alias("put"))).alias("edits"))
    lines = texts.select("seq", F.posexplode(F.split("text", "\n", -1)).alias("line", "body"))
    changed = lines.join(per_line, ["seq", "line"], "left").select("seq", "line", F.coalesce(put_back(F.col("body"), F.col("edits")), "body").alias("body"), F.coalesce(F.size("edits"), F.lit(0)).alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))), lambda x: x["body"])
    return changed.groupBy("seq").agg(F.concat_ws("\n", ordered).alias("text"), F.sum(F.greatest("n", F.lit(0))).alias("n_edits"))


def apply_literals(texts: DataFrame, translations: DataFrame, allowed: Column | None = None) -> DataFrame:
    """(seq, text, n_edits, n_unsafe): literals translated in place, unless a translation cannot stand in a literal:
    n_unsafe counts these, and a caller should take any as an error."""
    found = string_literals(texts).join(translations.where("source <> target"), "source")
    found = found.where(allowed) if allowed is not None else found
    judged = found.withColumn("safe", is_safe_literal(F.col("target"), F.col("quote")))
    edits = judged.groupBy("seq").agg(F.collect_list(F.when(F.col("safe"), F.struct("start", "end", F.col("target").alias("put")))).alias("edits"), F.count_if(~F.col("safe")).alias("n_unsafe"))
    out = texts.join(edits, "seq", "left")
    n = F.coalesce(F.size("edits"), F.lit(0))
    return out.select("seq", F.coalesce(put_back(F.col("text"), F.col("edits")), "text").alias("text"), F.greatest(n, F.lit(0)).cast("bigint").alias("n_edits"), F.coalesce("n_unsafe", F.lit(0)).alias("n_unsafe"))


# Literals of a plug-in configuration, display properties of a scene, and strings in a line of a script.
PLUGIN_LITERAL = r'"(?:[^"\\]|\\.)*+"'
SCENE_PROPERTIES = ("text", "tooltip_text", "placeholder_text", "title", "dialog_text", "ok_button_text", "cancel_button_text")
SCRIPT_STRING = r"""("(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')"""
SCENE_PATTERN = r"(?ms)^(" + "|".join(SCENE_PROPERTIES) + r')\s*=\s*"((?:[^"\\]|\\.)*+)"'
MOST_PARAMETER = 200


def plugin_parameters(texts: DataFrame, lang: str = "ja") -> DataFrame:
    """(seq, start, source, hint) of the short literals in plug-in configurations (seq, text) that could be shown; all are
    protected, as plug-ins may look things up by them. Nested objects and lists are left out."""
    found = texts.select("seq", F.explode(located(F.col("text"), PLUGIN_LITERAL)).alias("x"))
    found = found.select("seq", F.col("x.start").alias("start"), json_literal(F.substr("x.value", F.lit(2), F.length("x.value") - 2)).alias("source"))
    fit = is_candidate(F.col("source"), lang) & (F.length("source") < MOST_PARAMETER) & ~strip(F.col("source")).rlike(r"^[{\[]")
    return found.where(fit).select("seq", "start", "source", F.lit("protected").alias("hint"))


def scene_texts(texts: DataFrame, lang: str = "ja") -> DataFrame:
    """(seq, property, source, hint) of the display properties in scene files (seq, text)."""
    both = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(SCENE_PATTERN), F.lit(g)).alias(n) for g, n in ((1, "property"), (2, "body"))])
    found = texts.select("seq", F.explode(both).alias("x")).select("seq", "x.property", unescape_source(F.col("x.body")).alias("source"))
    return found.where(is_candidate(F.col("source"), lang)).withColumn("hint", F.lit("display"))


def script_strings(texts: DataFrame, lang: str = "ja") -> DataFrame:
    """(seq, line, source, context) of the strings in each line of scripts (seq, text); lines count from 1, and the context is the
    beginning of the line."""
    lines = texts.select("seq", F.posexplode(F.split("text", r"\r\n|[\n\r]")).alias("line", "body"))
    found = lines.select("seq", (F.col("line") + 1).alias("line"), F.explode(F.regexp_extract_all("body", F.lit(SCRIPT_STRING), F.lit(1))).alias("quoted"), F.substring(strip(F.col("body")), 1, 200).alias("context"))
    source = unescape_source(F.expr("substring(quoted, 2, length(quoted) - 2)"))
    return found.select("seq", "line", source.alias("source"), "context").where(is_candidate(F.col("source"), lang))
