"""JSON files that people and workers exchange with the catalog: decisions, translations, imports and terms, and exported batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import Rejected, batches, with_refs

SCHEMAS = {
    "audit": "id STRING, usage STRING, reason STRING",
    "submit": "id STRING, target STRING",
    "import": "source STRING, usage STRING, reason STRING, target STRING",
    "terms": "source STRING, target STRING, category STRING",
    "reports": "id STRING, reason STRING",
}


def read_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of one of the SCHEMAS, with seq, their order in the file, from a JSON file that holds one array of objects; fields of other
    names are left behind. A file that is no such array, or has a field of another type, is rejected whole."""
    fields = SCHEMAS[kind]
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("value"))
    checked = whole.select("value", F.schema_of_variant(F.try_parse_json("value")).alias("kind"), F.from_json("value", f"ARRAY<STRUCT<{fields.replace(' ', ': ')}>>".replace(",: ", ", ")).alias("rows"))
    if not checked.where("kind IS NULL OR kind NOT LIKE 'ARRAY%' OR rows IS NULL").isEmpty():
        raise Rejected(f"{path} holds no rows of kind {kind}")
    return checked.select(F.posexplode("rows").alias("seq", "row")).select(F.col("seq").cast("bigint").alias("seq"), "row.*")


def export_audit(items: DataFrame, refs: DataFrame, path: str, size: int = 300) -> None:
    """Pending items with their refs as JSON, `size` to a folder batch=1, batch=2, ... in order; earlier batches at the path go."""
    waiting = with_refs(items.where("usage = 'pending'").select("seq", "id", "source"), refs, 6)
    numbered = batches(waiting, size).select("batch", "id", "source", "refs")
    numbered.repartition("batch").write.partitionBy("batch").mode("overwrite").json(path)


def export_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines; what was at the path goes."""
    rows.write.mode("overwrite").json(path)
