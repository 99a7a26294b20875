"""Checks before a build: remaining source text, changed files, and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def residual_segments(texts: DataFrame, known: DataFrame, allow: DataFrame | None = None) -> DataFrame:
    """(seq, text, hits): texts (seq, text) with pieces that are known sources (source) of two characters or more.

    Allowed texts and pieces (text) do not count. hits keeps the order and repeats of the pieces.
    """
    shown = texts.where(~text.is_blank(F.col("text")))
    known = known.where(F.length(text.strip(F.col("source"))) >= 2).select(F.col("source").alias("piece")).distinct()
    pieces = shown.select("seq", "text", F.posexplode(text.segments(F.col("text"))).alias("place", "piece"))
    if allow is not None:
        pieces = pieces.join(allow.select("text"), "text", "left_anti").join(allow.select(F.col("text").alias("piece")), "piece", "left_anti")
    hit = pieces.join(known, "piece", "left_semi")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda x: x["piece"])
    return hit.groupBy("seq", "text").agg(listed.alias("hits"))


def _inner_words(c: Column) -> Column:
    """Words with white space on both sides inside the text."""
    words = F.split(c, r"\s+", -1)
    return F.array_distinct(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))


#: Parts that every task may hold to look for all of them at once: how many, and their characters.
MOST_PARTS = 200_000
MOST_CHARACTERS = 32_000_000


def containing(texts: DataFrame, parts: DataFrame, text_col: str = "text", part_col: str = "part") -> DataFrame:
    """Pairs (seq, part) of texts (seq, text) that contain a part. Empty parts and null texts have none.

    Parts that are counted to fit are looked for together, in one pass over the texts and without a shuffle. More of them are
    joined by an anchor: a word with white space on both sides where a part has one, else two neighbouring characters (or its only
    one), of those the one that the fewest parts have; then the whole part is compared.
    """
    named = parts.select(F.col(part_col).alias("part")).where(F.length("part") > 0).distinct()
    held = texts.select("seq", F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    n, characters = named.agg(F.count("*"), F.coalesce(F.sum(F.length("part")), F.lit(0))).first()
    if n <= MOST_PARTS and characters <= MOST_CHARACTERS:
        return _looked_up(held, [r["part"] for r in named.collect()])
    pieces = F.concat(text.two_characters(F.col("part")), F.when(F.length("part") == 1, F.array("part")).otherwise(F.array().cast("array<string>")))
    inner = F.size(_inner_words(F.col("part"))) > 0
    by_word = _anchored(named.where(inner), _inner_words(F.col("part")))
    by_piece = _anchored(named.where(~inner), F.array_distinct(pieces))
    found = None
    for anchors, of_text in ((by_word, F.split("text", r"\s+", -1)), (by_piece, F.concat(text.two_characters(F.col("text")), F.split("text", "")))):
        looked = held.select("seq", F.explode(F.array_distinct(of_text)).alias("anchor")).join(anchors, "anchor").select("seq", "part")
        some = looked.join(held, "seq").where(F.contains("text", "part")).select("seq", "part").distinct()
        found = some if found is None else found.unionByName(some)
    return found


def _anchored(parts: DataFrame, pieces: Column) -> DataFrame:
    """(part, anchor): of the pieces the one that the fewest parts have, and of equals the longest, which is rare among texts too."""
    each = parts.select("part", F.explode(pieces).alias("anchor"))
    often = each.groupBy("anchor").agg(F.count("*").alias("n"))
    return each.join(often, "anchor").groupBy("part").agg(F.min_by("anchor", F.struct("n", -F.length("anchor"), "anchor")).alias("anchor"))


def _looked_up(held: DataFrame, parts: list[str]) -> DataFrame:
    """(seq, part) by an automaton of all parts in each task."""
    import ahocorasick
    import pyarrow as pa

    shared = held.sparkSession.sparkContext.broadcast(sorted(parts))

    def run(batches):
        automaton = ahocorasick.Automaton()
        for part in shared.value:
            automaton.add_word(part, part)
        if len(automaton):
            automaton.make_automaton()
        for batch in batches:
            at, found = [], []
            for row, value in enumerate(batch.column(1).to_pylist() if len(automaton) else ()):
                hits = {part for _, part in automaton.iter(value)}
                at += [row] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], ["seq", "part"])

    return held.mapInArrow(run, f"seq {held.schema['seq'].dataType.simpleString()}, part string")


def residual_kana(texts: DataFrame, allow: DataFrame | None = None) -> DataFrame:
    """(seq, text) with kana and without an allowed string (text) in them."""
    shown = texts.where(text.has_kana(F.col("text")))
    if allow is None:
        return shown.select("seq", "text")
    kept = containing(shown, allow.where("text <> ''"), part_col="text")
    return shown.join(kept.select("seq").distinct(), "seq", "left_anti").select("seq", "text")


def residual_scan(texts: DataFrame, known: DataFrame, lang: str = "ja", allow: DataFrame | None = None) -> DataFrame:
    """(seq, text, hits) of texts that look untranslated: by known pieces, and for Japanese by kana."""
    hits = residual_segments(texts, known, allow)
    if lang != "ja":
        return hits
    shown = texts if allow is None else texts.join(allow.select("text"), "text", "left_anti")
    kana = residual_kana(shown, allow).withColumn("kana", F.lit(True))
    none = F.array().cast("array<string>")
    return hits.join(kana, ["seq", "text"], "full").select("seq", "text", F.coalesce("hits", none).alias("hits"))


def untranslated_ratio(targets: DataFrame, lang: str = "ja", pattern: str | None = None) -> DataFrame:
    """Share of targets that still hold the source language's script; 0.0 of none."""
    left = F.count_if(F.col("target").rlike(pattern or text.KANA)) if lang == "ja" or pattern else F.lit(0)
    return targets.agg(F.coalesce(F.try_divide(left, F.count("*")), F.lit(0.0)).cast("double").alias("ratio"))


def manifest_diff(expected: DataFrame, actual: DataFrame, deep: bool = False, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, change) of manifests (path, size, mtime_ns, sha256): missing, added, size or content.

    A file of equal size is compared by content only where its time differs, or always when deep.
    """
    if exclude:
        expected, actual = (d.where(~text.matches_any(F.col("path"), exclude)) for d in (expected, actual))
    a = expected.select("path", *[F.col(c).alias(f"a_{c}") for c in ("size", "mtime_ns", "sha256")], F.lit(1).alias("in_a"))
    b = actual.select("path", *[F.col(c).alias(f"b_{c}") for c in ("size", "mtime_ns", "sha256")], F.lit(1).alias("in_b"))
    look = (F.col("a_mtime_ns") != F.col("b_mtime_ns")) | F.lit(deep)
    change = (
        F.when(F.col("in_b").isNull(), "missing")
        .when(F.col("in_a").isNull(), "added")
        .when(F.col("a_size") != F.col("b_size"), "size")
        .when(look & (F.col("a_sha256") != F.col("b_sha256")), "content")
    )
    return a.join(b, "path", "full").select("path", change.alias("change")).where("change IS NOT NULL")


def invalid_targets(items: DataFrame, extra_tokens: tuple[str, ...] = ()) -> DataFrame:
    """Released items whose translation breaks a format rule, with its errors."""
    held = items.where("released AND target IS NOT NULL")
    return held.withColumn("errors", text.target_errors(F.col("source"), F.col("target"), extra_tokens)).where(F.size("errors") > 0)


def gate(items: DataFrame, glossary_conflicts: DataFrame, diff: DataFrame | None, extra_tokens: tuple[str, ...] = ()) -> DataFrame:
    """One row with problems, an array in fixed order; empty means that a build may start. diff None: no manifest."""
    counts = items.agg(
        F.count_if(F.col("usage") == "pending").alias("pending"), F.count_if(F.col("released") & F.col("target").isNull()).alias("untranslated")
    ).crossJoin(glossary_conflicts.agg(F.count("*").alias("conflicts")))
    counts = counts.crossJoin(invalid_targets(items, extra_tokens).agg(F.count("*").alias("invalid")))
    counts = counts.crossJoin(diff.agg(F.count("*").alias("changed"))) if diff is not None else counts.withColumn("changed", F.lit(-1))
    named = [(c, F.col(c) > 0) for c in ("pending", "untranslated", "conflicts", "invalid")]
    named += [("no manifest", F.col("changed") < 0), ("changed", F.col("changed") > 0)]
    return counts.select(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in named])).alias("problems"))
