"""Leases of untranslated items to workers, as functions of the item table, a time and a lease id."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .catalog import Rejected, bad_terms, with_refs

LEASE_SECONDS = 1800
MOST_ITEMS = 300
WORKER = re.compile(r"[A-Za-z0-9_-]{1,50}")


def _set(items: DataFrame, rows: Column, worker, lease, expires) -> DataFrame:
    out = items
    for name, value in (("worker", worker), ("lease", lease), ("expires", expires)):
        out = out.withColumn(name, F.when(rows, value).otherwise(F.col(name)))
    return out


def reclaim(items: DataFrame, now: float) -> DataFrame:
    """items with leases that end now or earlier taken back from rows without a translation."""
    ended = F.col("target").isNull() & F.coalesce(F.col("expires") <= now, F.lit(False))
    return _set(items, ended, F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("double"))


def pick(items: DataFrame, worker: str, limit: int = MOST_ITEMS) -> tuple[DataFrame, str | None]:
    """(rows, lease) that a claim gives out: a worker's open rows, whatever the limit, and their lease, else up to `limit` free ones in
    order and none. Ended leases must have been taken back."""
    if not WORKER.fullmatch(worker) or not 1 <= limit <= MOST_ITEMS:
        raise Rejected("invalid worker or limit")
    waiting = items.where("released AND target IS NULL")
    own = waiting.where(F.col("worker") == worker)
    first = own.orderBy("seq").select("lease").head()
    return (own, first["lease"]) if first else (waiting.where("worker IS NULL").orderBy("seq").limit(limit), None)


def mark(items: DataFrame, ids: DataFrame, worker: str, lease: str, now: float) -> DataFrame:
    """items with the rows of the ids leased to a worker from now on."""
    marked = items.join(ids.select("id").withColumn("_mine", F.lit(True)), "id", "left")
    return _set(marked, F.col("_mine").isNotNull(), F.lit(worker), F.lit(lease), F.lit(now + LEASE_SECONDS)).select(*items.columns)


def claim(items: DataFrame, refs: DataFrame, worker: str, lease: str, now: float, limit: int = MOST_ITEMS) -> tuple[DataFrame, DataFrame]:
    """(items, batch): a worker's open rows with a fresh expiry, whatever the limit, else up to `limit` free ones in order.

    lease is used for a new batch; open rows keep the one they have. batch: (id, source, refs, lease, expires).
    """
    current = reclaim(items, now)
    chosen, held = pick(current, worker, limit)
    lease = held or lease
    batch = with_refs(chosen.select("seq", "id", "source"), refs, 4).select("seq", "id", "source", "refs", F.lit(lease).alias("lease"), F.lit(now + LEASE_SECONDS).alias("expires"))
    return mark(current, chosen, worker, lease, now), batch.orderBy("seq").drop("seq")


def remaining(items: DataFrame) -> DataFrame:
    """How many released items have no translation, leased ones included."""
    return items.agg(F.count_if(F.col("released") & F.col("target").isNull()).alias("remaining_total"))


def submission_errors(items: DataFrame, translations: DataFrame, worker: str, lease: str, now: float, extra_tokens: tuple[str, ...] = ()) -> DataFrame:
    """(id, error) of translations (id, target): ids given twice, rows not under this lease, and faulty targets."""
    twice = translations.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("twice").alias("error"))
    joined = translations.select("id", F.col("target").alias("new")).join(items, "id", "left")
    held = F.col("released") & (F.col("worker") == worker) & (F.col("lease") == lease) & (F.coalesce("expires", F.lit(0.0)) > now) & F.col("target").isNull()
    held = F.coalesce(held, F.lit(False))
    faults = F.concat_ws(",", text.target_errors(F.col("source"), F.col("new"), extra_tokens))
    error = F.when(~held, F.lit("not leased")).when(faults != "", faults)
    return twice.unionByName(joined.select("id", error.alias("error")).where("error IS NOT NULL"))


def submit(items: DataFrame, translations: DataFrame, worker: str, lease: str, now: float, terms: DataFrame | None = None, extra_tokens: tuple[str, ...] = ()) -> DataFrame:
    """items with the translations in place and the rest of the lease extended; any error rejects all."""
    if translations.isEmpty() or not submission_errors(items, translations, worker, lease, now, extra_tokens).isEmpty():
        raise Rejected("invalid translations")
    if terms is not None and not bad_terms(terms).isEmpty():
        raise Rejected("invalid terms")
    joined = items.join(translations.select("id", F.col("target").alias("_new")), "id", "left")
    done = F.col("_new").isNotNull()
    out = joined.withColumn("target", F.coalesce("_new", "target")).withColumn("updated", F.when(done, F.lit(float(now))).otherwise(F.col("updated")))
    mine = (F.col("worker") == worker) & (F.col("lease") == lease) & F.col("target").isNull()
    return out.withColumn("expires", F.when(mine, F.lit(now + LEASE_SECONDS)).otherwise(F.col("expires"))).select(*items.columns)


def release(items: DataFrame, worker: str, lease: str | None = None) -> DataFrame:
    """items with a worker's untranslated rows set free, of one lease or of all."""
    mine = (F.col("worker") == worker) & F.col("target").isNull()
    mine = mine & (F.col("lease") == lease) if lease else mine
    return _set(items, F.coalesce(mine, F.lit(False)), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("double"))
