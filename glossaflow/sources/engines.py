"""A registry of source kinds: how a tree of files is recognised, and which texts it holds.

A plug-in registers an Engine under its name; the library's own ones are registered below. files have (root, path, text).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import listing
from ..operators.catalog import Rejected
from . import json_walk, scripts


@dataclass(frozen=True)
class Engine:
    """rules are (pattern of a path, score); occurrences takes (files, lang) and gives (source, surface, ref, context, hint)."""

    name: str
    rules: tuple[tuple[str, int], ...]
    occurrences: Callable[[DataFrame, str], DataFrame]
    allow_dual: bool = False


ENGINES: dict[str, Engine] = {}


def register(engine: Engine) -> Engine:
    if engine.name in ENGINES:
        raise Rejected(f"engine {engine.name} is registered already")
    ENGINES[engine.name] = engine
    return engine


def engine(name: str) -> Engine:
    if name not in ENGINES:
        raise Rejected(f"no engine {name}; there are {sorted(ENGINES)}")
    return ENGINES[name]


def detected(files: DataFrame) -> DataFrame:
    """(root, engine, score): for each root the registered engine with the highest score, of equals the last by name."""
    rules = [(e.name, pattern, score) for e in ENGINES.values() for pattern, score in e.rules]
    scores = listing.engine_scores(files, files.sparkSession.createDataFrame(rules, "engine STRING, pattern STRING, score INT"))
    best = F.max_by(F.struct("engine", "score"), F.struct("score", "engine")).alias("best")
    return scores.groupBy("root").agg(best).select("root", "best.*")


def _of_json(files: DataFrame, lang: str) -> DataFrame:
    docs = files.where(F.col("path").rlike(r"(^|/)data/[^/]*\.json$")).select(F.element_at(F.split("path", "/"), -1).alias("file"), json_walk.parsed(F.col("text")).alias("value"))
    return json_walk.occurrences(docs.where("value IS NOT NULL"), scripts.script_corpus(files, json_walk.leaves(docs.where("value IS NOT NULL"))), lang)


def _of_scripts(files: DataFrame, lang: str) -> DataFrame:
    literals = scripts.literal_occurrences(files.where(F.lower("path").endswith(".tjs")), lang)
    return literals.unionByName(scripts.scenario_occurrences(files.where(F.lower("path").endswith(".ks")), lang))


register(Engine("json", ((r"(^|/)data/System\.json$", 60), (r"(^|/)js/(rpg|rmmz)_core\.js$", 90)), _of_json))
register(Engine("scenario", ((r"\.ks$", 70), (r"(^|/)startup\.tjs$", 80)), _of_scripts))
register(Engine("tagged", ((r"(^|/)data/scenario/[^/]*\.ks$", 85),), lambda files, lang: scripts.scenario_occurrences(files.where(F.col("path").rlike(r"(^|/)data/.*\.ks$")), lang, attributes_shown=True)))
