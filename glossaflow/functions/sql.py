"""The extractors and tests of texts as functions that SQL can call: register(spark) makes them for a session.

Scalar functions: item_id(source), visible_text(text), has_source_text(text, lang), is_candidate(text, lang). Table functions, used as
`FROM scripts s, LATERAL script_strings(s.body, 'en') t`:

    json_leaves(doc)             (path, kind, text) of the scalars of JSON text; what lies deeper than JSON_LEVELS comes as one JSON text
    script_strings(body, lang)   (line, source) of the strings in each line of a script that are candidates
    scene_texts(body, lang)      (property, source) of the display properties of a scene
    text_lines(body)             (line, text) of the lines that are not empty

They are SQL functions, so Spark's optimizer sees through them; patterns are those of the functions of the same names on DataFrames.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources import scripts
from . import text

JSON_LEVELS = 12


def _literal(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _unescaped(body: str) -> str:
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\\\\", "\\")):
        body = f"replace({body}, {_literal(a)}, {_literal(b)})"
    return body


def _json_leaves() -> str:
    down = "SELECT CASE WHEN e.value IS NULL THEN path ELSE concat(path, '/', coalesce(e.key, cast(e.pos AS STRING))) END AS path, coalesce(e.value, h.value) AS value FROM {0} h, LATERAL variant_explode_outer(h.value) e"
    levels = ["l0 AS (SELECT '' AS path, try_parse_json(regexp_replace(doc, '^﻿', '')) AS value)"]
    levels += [f"l{n + 1} AS ({down.format(f'l{n}')})" for n in range(JSON_LEVELS)]
    last = f"SELECT path, value, schema_of_variant(value) AS kind FROM l{JSON_LEVELS} WHERE value IS NOT NULL"
    return f"WITH {', '.join(levels)} SELECT substring(path, 2) AS path, kind, variant_get(value, '$', 'string') AS text FROM ({last}) WHERE NOT (kind IN ('OBJECT<>', 'ARRAY<VOID>') AND to_json(value) IN ('{{}}', '[]'))"


def _has_source_text(body: str) -> str:
    detected = " ".join(f"WHEN {_literal(k)} THEN {body} RLIKE {_literal(v)}" for k, v in text.DETECTORS.items())
    return f"CASE lang {detected} ELSE raise_error(concat('unsupported source language: ', lang)) END"


def _is_candidate(body: str) -> str:
    edge, blank = (_literal(p) for p in (rf"(?U)^{text.EDGE}+|{text.EDGE}+\z", rf"(?U)^{text.EDGE}*\z"))
    bare = f"regexp_replace({body}, {edge}, '')"
    return f"coalesce(NOT {body} RLIKE {blank} AND NOT {bare} RLIKE {_literal(text.PATH_LIKE)} AND {_has_source_text(bare)} AND NOT (lang = 'en' AND {bare} RLIKE {_literal(text.IDENTIFIER)}), false)"


def statements() -> list[str]:
    """The CREATE FUNCTION statements."""
    scalar = {
        "item_id(source STRING) RETURNS STRING": "substring(sha1(cast(source AS BINARY)), 1, 16)",
        "visible_text(body STRING) RETURNS STRING": f"regexp_replace(body, {_literal(scripts.TAG)}, '')",
        "has_source_text(body STRING, lang STRING) RETURNS BOOLEAN": _has_source_text("body"),
        "is_candidate(body STRING, lang STRING) RETURNS BOOLEAN": _is_candidate("body"),
    }
    # Each table function of texts makes one array and takes it apart at once, from built-in functions alone. Spark then runs it within the row that
    # calls it; what stands on several steps meets its callers by a join on their whole text.
    inner, fit = _unescaped("substring(q, 2, length(q) - 2)"), _is_candidate("x.source")
    quoted = f"transform(regexp_extract_all(l, {_literal(scripts.SCRIPT_STRING)}, 1), q -> named_struct('line', p + 1, 'source', {inner}))"
    pattern = _literal(scripts.SCENE_PATTERN)
    both = f"arrays_zip(regexp_extract_all(body, {pattern}, 1), regexp_extract_all(body, {pattern}, 2))"
    table = {
        "text_lines(body STRING) RETURNS TABLE(line INT, text STRING)": "SELECT inline(filter(transform(split(body, '\\n', -1), (l, p) -> named_struct('line', p + 1, 'text', l)), x -> x.text <> ''))",
        "script_strings(body STRING, lang STRING) RETURNS TABLE(line INT, source STRING)": f"SELECT inline(filter(flatten(transform(split(body, '\\\\r\\\\n|[\\\\n\\\\r]'), (l, p) -> {quoted})), x -> {fit}))",
        "scene_texts(body STRING, lang STRING) RETURNS TABLE(property STRING, source STRING)": (
            f"SELECT inline(filter(transform({both}, z -> named_struct('property', z.`0`, 'source', {_unescaped('z.`1`')})), x -> {fit}))"
        ),
        "json_leaves(doc STRING) RETURNS TABLE(path STRING, kind STRING, text STRING)": _json_leaves(),
    }
    return [f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}" for head, body in (scalar | table).items()]


def register(spark: SparkSession) -> None:
    for statement in statements():
        spark.sql(statement)
