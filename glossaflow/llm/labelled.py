"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, held_out


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of at most `most` labelled rows that are not held out, those with the least hashed ids.

    Rows with a null id or label are left out; an id that has both labels counts as 1, and of several texts of one id the least is taken.
    """
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(id_col)))
    ids = ids.groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("label"))
    ids = checkpoint(ids.orderBy(F.xxhash64("id"), "id").limit(most))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.min("text").alias("text")).select("id", "text", "label")
