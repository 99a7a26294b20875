"""Texts in JSON documents, with their paths: VARIANT values taken apart level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_candidate, strip
from ..session import checkpoint

# Display fields of the engine's data files.
DATABASE_FIELDS = {
    "Actors.json": ("name", "nickname", "profile"),
    "Classes.json": ("name",),
    "Skills.json": ("name", "description", "message1", "message2"),
    "Items.json": ("name", "description"),
    "Weapons.json": ("name", "description"),
    "Armors.json": ("name", "description"),
    "Enemies.json": ("name",),
    "States.json": ("name", "message1", "message2", "message3", "message4"),
}
SYSTEM_TEXTS = ("gameTitle", "currencyUnit")
SYSTEM_LISTS = ("elements", "skillTypes", "weaponTypes", "armorTypes", "equipTypes")
TERM_LISTS = ("basic", "commands", "params")
#: Command codes, the parameter that holds the text, the context's name and the kind.
COMMANDS = ((401, 0, "event:401", "text"), (405, 0, "event:405", "text"), (320, 1, "event:320", "text"), (324, 1, "event:324", "text"), (325, 1, "event:325", "text"), (101, 4, "event:101:speaker", "name"), (402, 1, "event:402:choice-branch", "text"))
#: Levels that one pass goes down.
LEVELS = 8


def parsed(text: Column) -> Column:
    """A VARIANT of JSON text with or without a byte order mark; null where it is malformed."""
    return F.try_parse_json(F.regexp_replace(text, "^﻿", ""))


def _walked(docs: DataFrame, start: str, down: str) -> DataFrame:
    """(file, path, value, kind) of every scalar and every empty object or array of documents (file, value VARIANT).

    start is the path of a document, down what a part `e` (key, pos) makes of its holder's path. A round goes LEVELS levels down in one pass
    over the rows: what has parts gives a row for each, a scalar stays as it is. Only rows that still have parts after that go into
    another round, so documents of any depth are walked, and flat ones take one pass.
    """
    rows, out = docs.select("file", F.expr(start).alias("path"), "value"), None
    while True:
        for _ in range(LEVELS):
            # the frame is an argument of the query, so no view of the session is overwritten
            rows = docs.sparkSession.sql(
                f"SELECT file, CASE WHEN e.value IS NULL THEN path ELSE {down} END AS path, coalesce(e.value, h.value) AS value FROM {{held}} h, LATERAL variant_explode_outer(h.value) e", held=rows
            )
        rows = checkpoint(rows.where("value IS NOT NULL").withColumn("kind", F.schema_of_variant("value")))
        inner = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
        # nulls alone have the same kind as nothing
        empty = F.col("kind").isin("OBJECT<>", "ARRAY<VOID>") & F.to_json("value").isin("{}", "[]")
        flat = rows.where(~inner | empty)
        out = flat if out is None else out.unionByName(flat)
        rows = rows.where(inner & ~empty).select("file", "path", "value")
        if rows.isEmpty():
            return out


def leaves(docs: DataFrame) -> DataFrame:
    """(file, path, kind, text) of every scalar of documents (file, value VARIANT); path is keys and places joined by /."""
    found = _walked(docs, "''", "concat(path, '/', coalesce(e.key, cast(e.pos AS STRING)))").where("NOT (kind LIKE 'OBJECT%' OR kind LIKE 'ARRAY%')")
    return found.select("file", F.substring("path", 2, 1 << 30).alias("path"), "kind", F.variant_get("value", "$", "string").alias("text"))


def steps(docs: DataFrame) -> DataFrame:
    """(file, path, json) of every scalar and every empty object or array: path is an array of (key, pos), one of them null; json is the value's text."""
    step = "named_struct('key', e.key, 'pos', CASE WHEN e.key IS NULL THEN e.pos END)"
    found = _walked(docs, "cast(array() AS ARRAY<STRUCT<key: STRING, pos: INT>>)", f"concat(path, array({step}))")
    return found.select("file", "path", F.to_json("value").alias("json"))


def string_leaves(docs: DataFrame, lang: str | None = None) -> DataFrame:
    """(file, path, text) of string values, of one language's candidates if given."""
    found = leaves(docs).where("kind = 'STRING'").select("file", "path", "text")
    return found.where(is_candidate(F.col("text"), lang)) if lang else found


def display_fields(docs: DataFrame) -> DataFrame:
    """(file, path, text, context, kind) of the display fields in data files (file, value): databases, system, maps and
    event commands at any depth."""
    found = leaves(docs)
    texts = found.where("kind = 'STRING'").select("file", "path", "text")
    keys = F.split("path", "/")
    last, depth = F.element_at(keys, -1), F.size(keys)
    field_rules = F.create_map(*[x for name, fields in DATABASE_FIELDS.items() for x in (F.lit(name), F.array(*map(F.lit, fields)))])
    allowed = F.try_element_at(field_rules, F.col("file"))
    database = texts.where((depth == 2) & F.array_contains(allowed, last)).select("file", "path", "text", last.alias("context"), F.when(last.isin("name", "nickname"), "name").otherwise("text").alias("kind"))
    first = F.element_at(keys, 1)
    number = last.rlike("^[0-9]+$")
    second = F.try_element_at(keys, F.lit(2))
    context = (
        F.when((depth == 1) & first.isin(*SYSTEM_TEXTS), first)
        .when((depth == 2) & first.isin(*SYSTEM_LISTS) & number, first)
        .when((depth == 3) & (first == "terms") & second.isin(*TERM_LISTS) & number, F.concat(F.lit("terms."), second))
        .when((depth == 3) & (first == "terms") & (second == "messages"), F.concat(F.lit("terms.messages."), last))
    )
    system = texts.where(F.col("file") == "System.json").withColumn("context", context).where("context IS NOT NULL")
    system = system.withColumn("kind", F.when(F.col("context").startswith("terms.messages."), "text").otherwise("name"))
    maps = texts.where(F.col("file").rlike(r"^Map\d+\.json$") & (F.col("path") == "displayName")).select("file", "path", "text", F.lit("displayName").alias("context"), F.lit("name").alias("kind"))
    return database.unionByName(system).unionByName(maps).unionByName(commands(found))


def commands(found: DataFrame) -> DataFrame:
    """(file, path, text, context, kind) of the texts of event commands among leaves(): objects with a code and parameters."""
    codes = found.where(F.col("path").rlike(r"(^|/)code$") & F.col("kind").isin("BIGINT", "TINYINT", "SMALLINT", "INT"))
    codes = codes.select("file", F.regexp_replace("path", "/?code$", "").alias("at"), F.col("text").try_cast("int").alias("code"))
    pattern = r"^(?:(.*)/)?parameters/(\d+)(?:/(\d+))?$"
    held = found.where((F.col("kind") == "STRING") & F.col("path").rlike(pattern))
    place = F.regexp_extract("path", pattern, 3)
    held = held.select("file", "path", "text", F.regexp_extract("path", pattern, 1).alias("at"), F.regexp_extract("path", pattern, 2).try_cast("int").alias("slot"), place.alias("place"))
    joined = held.join(codes, ["file", "at"])
    context, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for code, slot, name, what in COMMANDS:
        hit = (F.col("code") == code) & (F.col("slot") == slot) & (F.col("place") == "")
        context, kind = F.when(hit, name).otherwise(context), F.when(hit, what).otherwise(kind)
    choice = (F.col("code") == 102) & (F.col("slot") == 0) & (F.col("place") != "")
    context, kind = F.when(choice, "event:102:choice").otherwise(context), F.when(choice, "text").otherwise(kind)
    return joined.select("file", "path", "text", context.alias("context"), kind.alias("kind")).where("context IS NOT NULL")


def occurrences(docs: DataFrame, corpus: DataFrame | None = None, lang: str = "ja") -> DataFrame:
    """(source, surface, ref, context, hint) of the candidates: display, but unknown for a name that a script (text) contains."""
    from ..operators.quality import containing

    found = display_fields(docs).where(is_candidate(F.col("text"), lang))
    hint = F.lit("display")
    if corpus is not None:
        names = found.where("kind = 'name'").select(strip(F.col("text")).alias("part"))
        numbered = corpus.select(F.monotonically_increasing_id().alias("seq"), "text")
        seen = containing(numbered, names).select(F.col("part").alias("_part")).distinct()
        found = found.join(seen, (F.col("kind") == "name") & (strip(F.col("text")) == F.col("_part")), "left")
        hint = F.when(F.col("_part").isNotNull(), "unknown").otherwise("display")
    return found.select(F.col("text").alias("source"), F.lit("json").alias("surface"), F.concat_ws("#", "file", "path").alias("ref"), "context", hint.alias("hint"))
