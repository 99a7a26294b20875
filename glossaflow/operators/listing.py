"""File listings, overlays, task records and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Scripts that are written without spaces.
EAST_ASIAN = "[\u3000-\u30ff\u3400-\u9fff\uff00-\uffef]"
ACTIVE = ("running", "pausing", "paused", "cancelling")


def overlay(entries: DataFrame, precedence: str = "precedence", path_col: str = "path") -> DataFrame:
    """entries with key, the lower-case last part of the path; of equal keys the one of highest precedence (of equals the
    last path) stays."""
    keyed = entries.withColumn("key", F.lower(text.base_name(F.col(path_col))))
    names = [c for c in keyed.columns if c != "key"]
    last = keyed.groupBy("key").agg(F.max_by(F.struct(*names), F.struct(precedence, path_col)).alias("last"))
    return last.select("key", "last.*")


def clashes(entries: DataFrame, path_col: str = "path") -> DataFrame:
    """(key, n) of last path parts that several entries share, letter case aside."""
    return entries.groupBy(F.lower(text.base_name(F.col(path_col))).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def archive_precedence(path: Column) -> Column:
    """Loose files below archives, the data archive below other ones, patches above them in the order of their numbers."""
    name = F.lower(text.base_name(path))
    number = F.regexp_extract(name, r"^patch(\d*)\.xp3$", 1)
    patch = name.rlike(r"^patch\d*\.xp3$")
    rank = F.when(~name.endswith(".xp3"), 0).when(name == "data.xp3", 1).when(~patch, 2).otherwise(3)
    return F.struct(rank.alias("rank"), F.when(patch, F.coalesce(number.try_cast("int"), F.lit(1))).otherwise(0).alias("number"), name.alias("name"))


def engine_scores(listing: DataFrame, rules: DataFrame, root_col: str = "root", most_rules: int = 1_000) -> DataFrame:
    """(root, engine, score) of a listing (root, path), the best first: the highest score of an engine's rules
    (engine, pattern, score) that some path matches; engines without a match are left out, ties go by name, last first.

    Rules are tests of the program, a few dozen; more than most_rules are an error. Paths are looked at once, without a join.
    """
    known = rules.select("engine", "pattern", "score").limit(most_rules + 1).collect()
    if len(known) > most_rules:
        raise ValueError(f"more than {most_rules} rules")
    tests = [F.when(F.col("path").rlike(r["pattern"]), F.struct(F.lit(r["engine"]).alias("engine"), F.lit(r["score"]).alias("score"))) for r in known]
    none = F.array().cast("array<struct<engine:string,score:int>>")
    hits = listing.select(root_col, F.explode(F.array_compact(F.array(*tests)) if tests else none).alias("hit")).select(root_col, "hit.*")
    return hits.groupBy(root_col, "engine").agg(F.max("score").alias("score")).where("score > 0").orderBy(root_col, F.desc("score"), F.desc("engine"))


def read_records(lines: DataFrame, schema: str, name_col: str = "name", value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records, warnings) of one JSON object a row (name, value): the fields of schema with the name, and the names (name, problem) of
    those that are no object or have a field of another type."""
    parsed = F.from_json(value_col, f"{schema}, _broken STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    seen = lines.select(F.col(name_col).alias("name"), parsed.alias("x"), F.schema_of_variant(F.try_parse_json(value_col)).alias("kind"))
    fine = F.coalesce(F.col("kind").startswith("OBJECT"), F.lit(False)) & F.col("x._broken").isNull()
    records = seen.where(fine).select("name", "x.*").drop("_broken")
    return records, seen.where(~fine).select("name", F.lit("unreadable record").alias("problem"))


def task_snapshot(tasks: DataFrame, stale_seconds: float, now: float, most: int = 30) -> DataFrame:
    """Task records (id, state, started, updated), active ones first, then the latest; a task that is active but has not been
    heard of for stale_seconds is interrupted."""
    active = F.col("state").isin(*ACTIVE)
    stale = active & (F.coalesce("updated", F.lit(0.0)) < now - stale_seconds)
    seen = tasks.withColumn("state", F.when(stale, "interrupted").otherwise(F.col("state")))
    return seen.orderBy(F.col("state").isin(*ACTIVE).desc(), F.desc("started"), "id").limit(most)


def worker_states(workers: DataFrame, started: float) -> DataFrame:
    """The last record of each worker (worker, at, state) since a task started."""
    last = workers.where(F.col("at") >= started).groupBy("worker").agg(F.max_by(F.struct(*workers.columns), "at").alias("last"))
    return last.select("last.*")


def failure_streaks(batches: DataFrame, most: int = 3) -> DataFrame:
    """(worker, n, streak, blocked) of batches (worker, n, accepted): empty batches in a row up to each; blocked from `most` on."""
    order = Window.partitionBy("worker").orderBy("n")
    runs = batches.withColumn("_run", F.sum((F.col("accepted") > 0).cast("int")).over(order))
    inside = Window.partitionBy("worker", "_run").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    streak = F.sum((F.col("accepted") == 0).cast("int")).over(inside)
    return runs.select("worker", "n", streak.alias("streak"), (streak >= most).alias("blocked"))


def log_markers(lines: DataFrame, markers: list[str]) -> DataFrame:
    """(log, marked): logs with a line that tells of an error and has a marker. A JSON line tells of one by its stop reason,
    another line by the word."""
    parsed = F.try_parse_json("line")
    reason = F.try_variant_get(parsed, "$.message.stopReason", "string")
    told = F.when(parsed.isNotNull(), F.coalesce(reason == "error", F.lit(False))).otherwise(F.contains(F.lower("line"), F.lit("error")))
    found = F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(F.lower("line"), m))
    return lines.groupBy("log").agg(F.bool_or(told & found).alias("marked"))


def dictionary_file(translations: DataFrame) -> DataFrame:
    """(value): lines escape(source)=escape(target) in the order of the source, without pairs that are equal."""
    pairs = translations.where("source <> target").orderBy("source")
    return pairs.select(F.concat(text.escape_entry(F.col("source")), F.lit("="), text.escape_entry(F.col("target"))).alias("value"))


def read_dictionary(lines: DataFrame) -> DataFrame:
    """(source, target) of dictionary lines (value): blank lines, comments and rules (r:, sr:) are skipped."""
    shown = lines.select(F.regexp_replace("value", "^﻿", "").alias("value"))
    shown = shown.where(~text.is_blank(F.col("value")) & ~F.col("value").rlike(r"^(//|s?r:)"))
    left, right = text.split_entry(F.col("value"))
    sides = shown.select(left.alias("left"), right.alias("right")).where("left IS NOT NULL")
    return sides.select(text.unescape_entry(F.col("left")).alias("source"), text.unescape_entry(F.col("right")).alias("target"))


def read_recognised(lines: DataFrame) -> DataFrame:
    """(file, place, text, error) of recognition results, one JSON object a line (value): {file, lines} gives a row for each line, in which a
    space between East Asian characters goes, {file, error} one row. Blank lines are skipped; one that is neither is an error `unreadable`."""
    value = F.regexp_replace("value", "^\ufeff", "")
    seen = lines.where(~text.is_blank(value)).select(F.from_json(value, "file STRING, lines ARRAY<STRING>, error STRING").alias("x"), F.schema_of_variant(F.try_parse_json(value)).alias("kind"))
    seen = seen.select("x.*", F.coalesce(F.col("kind").startswith("OBJECT"), F.lit(False)).alias("known"))
    error = F.when(~F.col("known") | (F.col("lines").isNull() & F.col("error").isNull()), "unreadable").otherwise(F.col("error"))
    seen = seen.select("file", error.alias("error"), F.posexplode_outer(F.when(error.isNull(), F.col("lines"))).alias("place", "text"))
    shown = seen.where("error IS NOT NULL OR text IS NOT NULL")
    return shown.select("file", "place", F.regexp_replace("text", f"(?<={EAST_ASIAN}) (?={EAST_ASIAN})", "").alias("text"), "error")


def recognition_report(recognised: DataFrame, residuals: DataFrame) -> DataFrame:
    """One row: errors, lines with enough words, residuals, and whether a scan of them says nothing, as there are no lines."""
    lines = screen_lines(recognised.where("error IS NULL")).agg(F.count("*").alias("n_lines"))
    counts = recognised.agg(F.count("error").alias("n_errors")).crossJoin(lines).crossJoin(residuals.agg(F.count("*").alias("n_residuals")))  # one row each
    return counts.withColumn("says_nothing", F.col("n_lines") == 0)


def screen_lines(recognised: DataFrame, least: int = 2) -> DataFrame:
    """Recognised lines (text) with at least so many word units: a character of an East Asian script, or two Latin letters or more."""
    return recognised.where(F.regexp_count("text", F.lit(r"[ぁ-ヿ㐀-鿿가-힯]|[A-Za-z]{2,}")) >= least)


def checksums(manifest: DataFrame) -> DataFrame:
    """(value): lines "sha256  path" of a manifest (path, sha256), by path."""
    return manifest.orderBy("path").select(F.concat("sha256", F.lit("  "), "path").alias("value"))
