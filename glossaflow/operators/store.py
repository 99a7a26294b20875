"""The catalog as stored tables: partitions by a prefix of the id, of which a change rewrites only those that it touches.

A change is a batch with a name. What it makes of the touched partitions is written beside the tables first; a mark says that all of it is
there. Then partitions are overwritten from that copy, a second mark says that the batch is applied, and the copy goes. A batch whose
name is applied is skipped, so a stream's foreachBatch may bring it again. After a failure the next change (or recover()) finishes a
marked copy and drops an unmarked one: a batch is applied whole or not at all. One writer at a time; readers may see a
change half done. Every row that a change touches must lie in the partitions of the ids that it names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Files
from . import catalog, leasing
from .catalog import item_id

#: Columns of each table, and what its partition comes from.
TABLES = {
    "items": (catalog.ITEM_COLUMNS, "id"),
    "refs": (catalog.REF_COLUMNS, "item_id"),
    "quarantine": ("id STRING, reason STRING, worker STRING, created DOUBLE", "id"),
    "glossary": ("source STRING, target STRING, category STRING, worker STRING", "source"),
    "glossary_conflicts": ("source STRING, old STRING, new STRING, worker STRING, created DOUBLE", None),
}


class Catalog:
    """A catalog below a folder on a file system that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, digits: int = 2):
        """digits: hexadecimal ones of the id to a partition's name; 2 give 256 partitions."""
        self.spark, self.path, self.digits = spark, path.rstrip("/"), digits
        self.files = Files(spark, path)
        for name in (*TABLES, "_staged", "_applied"):
            self.files.folder(f"{self.path}/{name}")
        self.recover()

    def part(self, of: str | None, batch: str = "") -> Column:
        """The partition of a row; rows that are only added are parted by their batch."""
        if of is None:
            return F.lit(batch)
        key = item_id(F.col(of)) if of == "source" else F.col(of)
        return F.concat(F.lit("p"), F.substring(key, 1, self.digits))

    def table(self, name: str, parts: list[str] | None = None) -> DataFrame:
        """A table without its partition column; of the given partitions only these are read."""
        whole = self.spark.read.schema(f"{TABLES[name][0]}, part STRING").parquet(f"{self.path}/{name}")
        return (whole if parts is None else whole.where(F.col("part").isin(parts))).drop("part")

    def parts_of(self, ids: DataFrame, column: str = "id") -> list[str]:
        """The partitions of some ids (of sources by the column `source`): 16 to the power of `digits` at most."""
        return sorted(r[0] for r in ids.where(F.col(column).isNotNull()).select(self.part(column).alias("part")).distinct().collect())

    def applied(self, batch: str) -> bool:
        return self.files.exists(f"{self.path}/_applied/{batch}")

    def apply(self, batch: str, change: Callable[[], dict[str, DataFrame]]) -> bool:
        """Apply a batch once: change() gives, by table, all rows that the partitions it touches shall have. False if it was applied before."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise catalog.Rejected("a batch is named by letters, digits, - and _")
        self.recover()
        if self.applied(batch):
            return False
        staged = f"{self.path}/_staged/{batch}"
        for name, rows in change().items():
            columns, of = TABLES[name]
            rows.select(*[c.split()[0] for c in columns.split(", ")], self.part(of, batch).alias("part")).write.partitionBy("part").parquet(f"{staged}/{name}")
        self.files.mark(f"{staged}/_whole")
        self._promote(batch)
        return True

    def _promote(self, batch: str) -> None:
        staged = f"{self.path}/_staged/{batch}"
        for name in self.files.names(staged):
            if name in TABLES:
                rows = self.spark.read.schema(f"{TABLES[name][0]}, part STRING").parquet(f"{staged}/{name}")
                rows.repartition("part").write.partitionBy("part").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/{name}")
        if not self.applied(batch):
            self.files.mark(f"{self.path}/_applied/{batch}")
        self.files.remove(staged)

    def recover(self) -> None:
        """Finish what a failed change had written whole, and drop what it had not."""
        for batch in self.files.names(f"{self.path}/_staged"):
            if self.files.exists(f"{self.path}/_staged/{batch}/_whole"):
                self._promote(batch)
            else:
                self.files.remove(f"{self.path}/_staged/{batch}")

    def add_occurrences(self, batch: str, occurrences: DataFrame, allow_dual: bool = False) -> bool:
        """New items and refs from occurrences (seq, source, surface, ref, context, hint); their order follows that of all items before."""

        def change() -> dict[str, DataFrame]:
            parts = self.parts_of(occurrences, "source")
            items = self.table("items", parts)
            behind = (self.table("items").agg(F.max("seq")).first()[0] or 0) + 1 - (occurrences.agg(F.min("seq")).first()[0] or 0)
            fresh = catalog.new_items(occurrences.withColumn("seq", F.col("seq") + behind), items, allow_dual)
            return {"items": items.unionByName(fresh), "refs": catalog.merged_refs(occurrences, self.table("refs", parts))}

        return self.apply(batch, change)

    def apply_decisions(self, batch: str, decisions: DataFrame, allow_dual: bool = False) -> bool:
        """The audit decisions (id, usage, reason, seq) of a batch, all or none."""

        def change() -> dict[str, DataFrame]:
            parts = self.parts_of(decisions)
            return {"items": catalog.apply_decisions(self.table("items", parts), decisions, self.table("quarantine", parts), allow_dual)}

        return self.apply(batch, change)

    def import_rows(self, batch: str, rows: DataFrame, now: float, allow_dual: bool = False, extra_tokens: tuple[str, ...] = ()) -> bool:
        """Decisions and targets by source; see catalog.import_rows()."""

        def change() -> dict[str, DataFrame]:
            parts = self.parts_of(rows, "source")
            return {"items": catalog.import_rows(self.table("items", parts), rows, self.table("quarantine", parts), allow_dual, now, extra_tokens)[0]}

        return self.apply(batch, change)

    def claim(self, batch: str, worker: str, now: float, limit: int = leasing.MOST_ITEMS) -> DataFrame:
        """(id, source, refs, lease, expires) of what the worker now has; the batch's name is a new lease's."""

        def change() -> dict[str, DataFrame]:
            every = self.table("items")
            chosen, held = leasing.pick(leasing.reclaim(every, now), worker, limit)
            chosen = chosen.select("id")
            ended = every.where(F.col("target").isNull() & (F.col("expires") <= now)).select("id")
            current = leasing.reclaim(self.table("items", self.parts_of(chosen.unionByName(ended))), now)
            return {"items": leasing.mark(current, chosen, worker, held or batch, now)}

        self.apply(batch, change)
        mine = self.table("items").where((F.col("worker") == worker) & F.col("target").isNull() & F.col("released"))
        packed = catalog.with_refs(mine.select("seq", "id", "source", "lease", "expires"), self.table("refs"), 4)
        return packed.orderBy("seq").select("id", "source", "refs", "lease", "expires")

    def submit(self, batch: str, translations: DataFrame, worker: str, lease: str, now: float, terms: DataFrame | None = None, extra_tokens: tuple[str, ...] = ()) -> bool:
        """Translations (id, target) under a lease, whose other rows get more time, and terms (seq, source, target, category, worker)."""

        def change() -> dict[str, DataFrame]:
            held = self.table("items").where((F.col("worker") == worker) & (F.col("lease") == lease)).select("id")
            items = self.table("items", self.parts_of(held.unionByName(translations.select("id"))))
            after = {"items": leasing.submit(items, translations, worker, lease, now, terms, extra_tokens)}
            if terms is not None:
                glossary, conflicts = catalog.merge_terms(self.table("glossary", self.parts_of(terms, "source")), terms)
                after |= {"glossary": glossary, "glossary_conflicts": conflicts.withColumn("created", F.lit(float(now)))}
            return after

        return self.apply(batch, change)

    def release(self, batch: str, worker: str, lease: str | None = None) -> bool:
        def change() -> dict[str, DataFrame]:
            mine = self.table("items").where((F.col("worker") == worker) & F.col("target").isNull()).select("id")
            return {"items": leasing.release(self.table("items", self.parts_of(mine)), worker, lease)}

        return self.apply(batch, change)

    def quarantine(self, batch: str, reports: DataFrame, worker: str, now: float) -> bool:
        """Reports (seq, id, reason) of a worker: their items are held back."""

        def change() -> dict[str, DataFrame]:
            parts = self.parts_of(reports)
            items, held = catalog.quarantined(self.table("items", parts), self.table("quarantine", parts), reports, worker, now)
            return {"items": items, "quarantine": held}

        return self.apply(batch, change)

    def status(self) -> DataFrame:
        return catalog.status(self.table("items"), self.table("glossary_conflicts"), self.table("quarantine"))

    def sink(self, name: str, write: Callable[[str, DataFrame], object]) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: each micro-batch goes to write(batch, rows) under the name of the stream and its number."""

        def one(rows: DataFrame, number: int) -> None:
            batch = f"{name}-{number}"
            if not self.applied(batch):
                write(batch, rows)

        return one
