"""The catalog: items keyed by their source text, where each occurs, and their audit.

Tables are DataFrames, and each change is a function of tables, inputs and the time that gives new tables:
items (id, seq, source, usage, reason, released, target, worker, lease, expires, updated),
refs (item_id, surface, ref, context, hint), quarantine (id, reason, worker, created),
glossary (source, target, category, worker) and glossary_conflicts (source, old, new, worker, created).
Times are seconds since the epoch. seq is the order of insertion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

USAGES = ("pending", "display", "dual", "protected", "excluded")
FIXED_HINTS = ("display", "protected", "excluded")
CATEGORIES = ("person", "place", "special")
ITEM_COLUMNS = (
    "id STRING, seq BIGINT, source STRING, usage STRING, reason STRING, released BOOLEAN, target STRING, worker STRING, lease STRING, expires DOUBLE, updated DOUBLE"
)
REF_COLUMNS = "item_id STRING, surface STRING, ref STRING, context STRING, hint STRING"


class Rejected(ValueError):
    """A batch that breaks a rule; nothing of it is applied."""


def item_id(source: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-1 of the UTF-8 text."""
    return F.substring(F.sha1(source.cast("binary")), 1, 16)


def first_occurrences(occurrences: DataFrame) -> DataFrame:
    """(id, source, first_seq, n_refs) of (seq, source): one row for each distinct text, null texts left out."""
    return (
        occurrences.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.min("seq").alias("first_seq"), F.count("*").alias("n_refs"))
        .select(item_id(F.col("source")).alias("id"), "source", "first_seq", "n_refs")
    )


def is_released(usage: Column, allow_dual: bool) -> Column:
    """Display texts, and texts with both uses where the engine has a display layer."""
    return usage.isin("display", "dual") if allow_dual else usage == "display"


def new_items(occurrences: DataFrame, items: DataFrame, allow_dual: bool = False) -> DataFrame:
    """Items for the sources that items lacks, from occurrences (seq, source, surface, ref, context, hint).

    The first occurrence of a source fixes its usage: a fixed hint as it is, anything else pending.
    """
    first = occurrences.where(F.col("source").isNotNull()).groupBy("source").agg(F.min_by(F.struct("seq", "surface", "hint"), "seq").alias("first"))
    fixed = F.col("first.hint").isin(*FIXED_HINTS)
    usage = F.when(fixed, F.col("first.hint")).otherwise("pending")
    fresh = first.select(
        item_id(F.col("source")).alias("id"),
        F.col("first.seq").alias("seq"),
        "source",
        usage.alias("usage"),
        F.when(fixed, F.concat(F.lit("adapter:"), F.col("first.surface"))).alias("reason"),
        is_released(usage, allow_dual).alias("released"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("target", "string"), ("worker", "string"), ("lease", "string"), ("expires", "double"), ("updated", "double"))],
    )
    return fresh.join(items.select("id"), "id", "left_anti")


def merged_refs(occurrences: DataFrame, refs: DataFrame) -> DataFrame:
    """refs with those of occurrences; the last context and hint of an (item, surface, ref) hold."""
    fresh = occurrences.where(F.col("source").isNotNull()).select(item_id(F.col("source")).alias("item_id"), "surface", "ref", "context", "hint", "seq")
    both = refs.withColumn("seq", F.lit(-1).cast("bigint")).unionByName(fresh)
    last = both.groupBy("item_id", "surface", "ref").agg(F.max_by(F.struct("context", "hint"), "seq").alias("last"))
    return last.select("item_id", "surface", "ref", "last.*")


def bad_decisions(decisions: DataFrame, items: DataFrame) -> DataFrame:
    """The decisions (id, usage, reason) that break a rule: unknown or pending usage, blank reason, no such item."""
    known = items.select("id", F.lit(True).alias("known"))
    joined = decisions.join(known, "id", "left")
    blank = F.col("reason").isNull() | (F.trim("reason") == "")
    usage = F.coalesce(F.col("usage").isin(*USAGES[1:]), F.lit(False))
    return joined.where(~usage | blank | F.col("known").isNull()).select("id", "usage", "reason")


def apply_decisions(items: DataFrame, decisions: DataFrame, quarantine: DataFrame, allow_dual: bool = False) -> DataFrame:
    """items after a whole batch of decisions; the last one on an id (by the column seq, else by usage and reason) holds."""
    if not bad_decisions(decisions, items).isEmpty():
        raise Rejected("invalid decisions")
    order = F.col("seq") if "seq" in decisions.columns else F.struct("usage", "reason")
    last = decisions.groupBy("id").agg(F.max_by(F.struct("usage", F.trim("reason").alias("reason")), order).alias("new"))
    held = quarantine.select("id").distinct().withColumn("held", F.lit(True))
    joined = items.join(last, "id", "left").join(held, "id", "left")
    changed, released = F.col("new").isNotNull(), F.col("held").isNull() & is_released(F.col("new.usage"), allow_dual)
    freed = changed & ~released & F.col("target").isNull()
    return joined.select(
        "id", "seq", "source",
        F.when(changed, F.col("new.usage")).otherwise(F.col("usage")).alias("usage"),
        F.when(changed, F.col("new.reason")).otherwise(F.col("reason")).alias("reason"),
        F.when(changed, released).otherwise(F.col("released")).alias("released"),
        "target",
        *[F.when(~freed, F.col(c)).alias(c) for c in ("worker", "lease", "expires")],
        "updated",
    )


def top_refs(refs: DataFrame, most: int = 6) -> DataFrame:
    """Up to so many refs of each item, in the order of surface and ref."""
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("surface", "ref"))
    return refs.withColumn("place", place).where(F.col("place") <= most)


def with_refs(items: DataFrame, refs: DataFrame, most: int) -> DataFrame:
    """items with an array of up to so many refs."""
    packed = top_refs(refs, most).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("place", "surface", "ref", "context", "hint"))).alias("refs"))
    plain = F.transform("refs", lambda r: F.struct(r["surface"].alias("surface"), r["ref"].alias("ref"), r["context"].alias("context"), r["hint"].alias("hint")))
    none = F.array().cast("array<struct<surface:string,ref:string,context:string,hint:string>>")
    return items.join(packed, items["id"] == packed["item_id"], "left").drop("item_id").withColumn("refs", F.coalesce(plain, none))


def pending_audit(items: DataFrame, refs: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, source, refs) of the items still to be audited, in order."""
    waiting = items.where("usage = 'pending'").orderBy("seq")
    waiting = waiting.limit(limit) if limit else waiting
    return with_refs(waiting.select("seq", "id", "source"), refs, 6).orderBy("seq").select("id", "source", "refs")


def numbered(rows: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """rows with their number, from 1, in an order. Range partitions and the counts of those before number them, not one task."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # checkpointed, as ranges that are drawn anew after a lost executor may have other bounds
    ordered = checkpoint(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    counted = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counted.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    placed = ordered.withColumn("_own", own).join(F.broadcast(before.select("_part", "_before")), "_part")  # a row for each partition
    return placed.withColumn(name, (F.col("_before") + F.col("_own")).cast("bigint")).drop("_part", "_own", "_before")


def batches(items: DataFrame, size: int = 300, order: str = "seq") -> DataFrame:
    """items with batch: 1 for the first `size` in order, 2 for the next, ..."""
    placed = numbered(items, order, name="_number")
    return placed.withColumn("batch", F.floor((F.col("_number") - 1) / size).cast("bigint") + 1).drop("_number")


def usage_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("usage").agg(F.count("*").alias("n"))


def status(items: DataFrame, glossary_conflicts: DataFrame, quarantine: DataFrame) -> DataFrame:
    """One row of totals; leased counts released, untranslated items with a worker, whether or not the lease has ended."""
    open_ = F.col("released") & F.col("target").isNull()
    totals = items.agg(
        F.count_if("released").alias("released"),
        F.count_if(F.col("released") & F.col("target").isNotNull()).alias("translated"),
        F.count_if(open_ & F.col("worker").isNotNull()).alias("leased"),
        F.count_if(open_).alias("pending_translation"),
        F.count_if(F.col("usage") == "pending").alias("pending_audit"),
    )
    extra = glossary_conflicts.agg(F.count("*").alias("glossary_conflicts")).crossJoin(quarantine.agg(F.count("*").alias("quarantined")))
    return totals.crossJoin(extra)  # one row each


def snapshot_counts(items: DataFrame, glossary_conflicts: DataFrame, quarantine: DataFrame, now: float) -> DataFrame:
    """One row of totals for a progress display; unlike in status(), leases that have ended at `now` do not count as leased."""
    running = F.col("worker").isNotNull() & F.coalesce(F.col("expires") > now, F.lit(False))
    open_ = F.col("released") & F.col("target").isNull()
    counts = {
        "pending_audit": F.col("usage") == "pending", "released": F.col("released"), "translated": F.col("released") & F.col("target").isNotNull(),
        "pending_translation": open_, "leased": open_ & running,
    }
    totals = items.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in counts.items()])
    extra = quarantine.agg(F.count("*").alias("quarantined")).crossJoin(glossary_conflicts.agg(F.count("*").alias("glossary_conflicts")))
    return totals.crossJoin(extra)  # one row each


def worker_counts(items: DataFrame) -> DataFrame:
    """(worker, done, owned) of released items."""
    return items.where("released AND worker IS NOT NULL").groupBy("worker").agg(F.count("target").alias("done"), F.count_if(F.col("target").isNull()).alias("owned"))


def mapping(items: DataFrame) -> DataFrame:
    """(source, target) of released and translated items."""
    return items.where("released AND target IS NOT NULL").select("source", "target")


def apply_mapping(texts: DataFrame, translations: DataFrame, source_col: str = "source") -> DataFrame:
    """texts with target, the translation where there is one that differs, else the source, and replaced."""
    known = translations.where("source <> target").select(F.col("source").alias("_source"), F.col("target").alias("_target"))
    joined = texts.join(known, texts[source_col] == known["_source"], "left")
    out = joined.withColumn("target", F.coalesce("_target", source_col)).withColumn("replaced", F.col("_target").isNotNull())
    return out.drop("_source", "_target")


def unknown_sources(rows: DataFrame, items: DataFrame) -> DataFrame:
    return rows.join(items.select("source"), "source", "left_anti")


def bad_terms(terms: DataFrame) -> DataFrame:
    """Glossary terms with an unknown category, or a source or target that is blank or longer than 100 characters."""
    fine = F.col("category").isin(*CATEGORIES)
    for c in ("source", "target"):
        fine = fine & (F.trim(c) != "") & (F.length(c) <= 100)
    return terms.where(~F.coalesce(fine, F.lit(False)))


def merge_terms(glossary: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(glossary, conflicts (source, old, new, worker)) after terms (seq, source, target, category, worker).

    The first target of a source stays; every later term with another target is a conflict.
    """
    old = glossary.withColumn("seq", F.lit(-1).cast("bigint"))
    every = old.unionByName(terms.select(*old.columns))
    # aggregates combine before the shuffle, so a source with very many terms is no large group
    merged = every.groupBy("source").agg(F.min_by(F.struct("target", "category", "worker"), "seq").alias("first")).select("source", "first.*")
    firsts = merged.select("source", F.col("target").alias("old"))
    conflicts = terms.join(firsts, "source").where("target <> old").select("source", "old", F.col("target").alias("new"), "worker")
    return merged, conflicts


def quarantined(items: DataFrame, quarantine: DataFrame, reports: DataFrame, worker: str, now: float) -> tuple[DataFrame, DataFrame]:
    """(items, quarantine) after a worker's reports (seq, id, reason): items unreleased, the first reason of each kept."""
    joined = reports.join(items.select("id", F.col("worker").alias("_owner"), F.lit(True).alias("_known")), "id", "left")
    foreign = F.col("_owner").isNotNull() & (F.col("_owner") != worker)
    blank = F.col("reason").isNull() | (F.trim("reason") == "")
    if not joined.where(F.col("_known").isNull() | foreign | blank).isEmpty():
        raise Rejected("reports of items of another worker, or without a reason")
    fresh = reports.groupBy("id").agg(F.min_by("reason", "seq").alias("reason")).join(quarantine.select("id"), "id", "left_anti")
    fresh = fresh.select("id", "reason", F.lit(worker).alias("worker"), F.lit(float(now)).alias("created"))
    hit = items.join(reports.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    free = F.col("_hit").isNull()
    changed = hit.withColumn("released", F.col("released") & free)
    for c in ("worker", "lease", "expires"):
        changed = changed.withColumn(c, F.when(free, F.col(c)))
    return changed.select(*items.columns), quarantine.unionByName(fresh)


def import_rows(
    items: DataFrame, rows: DataFrame, quarantine: DataFrame, allow_dual: bool, now: float, extra_tokens: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """(items, report) after rows (seq, source, usage, reason, target): decisions first, then valid targets of released items.

    Rows hold in the order of seq, so of several for one source the last decision and the last valid target stay. A null or empty usage is
    no decision, a null or empty reason is `imported`, a null target none; a decision that breaks a rule rejects the batch. Items with a
    new target lose their lease and have `now` as updated. The report is one row: usage_applied, applied and rejected (targets of
    known sources, valid or not, whether released or not) and unknown (rows without an item).
    """
    from ..functions import text

    known = rows.join(items.select("id", "source"), "source")
    decided = known.where("usage <> ''").select("id", "usage", F.expr("coalesce(nullif(reason, ''), 'imported') AS reason"), "seq")
    after = apply_decisions(items, decided, quarantine, allow_dual)
    targets = known.where("target IS NOT NULL").select("id", "source", F.col("target").alias("new"), "seq")
    judged = targets.withColumn("ok", F.size(text.target_errors(F.col("source"), F.col("new"), extra_tokens)) == 0)
    good = judged.where("ok").groupBy("id").agg(F.max_by("new", "seq").alias("new"))
    joined = after.join(good, "id", "left")
    use = F.col("released") & F.col("new").isNotNull()
    out = joined.withColumn("target", F.when(use, F.col("new")).otherwise(F.col("target"))).withColumn("updated", F.when(use, F.lit(float(now))).otherwise(F.col("updated")))
    for c in ("worker", "lease", "expires"):
        out = out.withColumn(c, F.when(~use, F.col(c)))
    counts = judged.agg(F.count_if("ok").alias("applied"), F.count_if(~F.col("ok")).alias("rejected"))
    report = decided.agg(F.count("*").alias("usage_applied")).crossJoin(counts).crossJoin(unknown_sources(rows, items).agg(F.count("*").alias("unknown")))  # one row each
    return out.select(*items.columns), report
