"""Queries over BINARY columns that Spark packs from the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import packed, text
from ..session import table
from ..sources import length_prefixed
from .registry import query

LETTERS = r"[\x20-\x7E\xA1-\xAC\xAE-\xFF]+"


@query(rf"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents),
    fine AS (SELECT *, octet_length(encode(line)) AS n FROM lines
      WHERE regexp_full_match(line, '[\x20-\x7E\x{{A1}}-\x{{AC}}\x{{AE}}-\x{{FF}}]+') AND octet_length(encode(line)) BETWEEN 2 AND 4096 AND regexp_matches(trim(line), '[A-Za-z]{{2,}}') AND NOT regexp_matches(trim(line), '^[A-Za-z_][A-Za-z0-9_.:/-]*$')
        AND NOT regexp_matches(trim(line), '(?i)^(res|user|uid|https?|file)://|^[\w./\\-]+\.(png|jpg|ogg|wav|mp3|json|tscn|tres|gd|gdc|js|webp|ks|tjs|txt|csv|asset|prefab)$'))
    SELECT doc_id AS id, (sum(n + 4) OVER (PARTITION BY doc_id ORDER BY k) - n - 4)::BIGINT AS at_, line AS text FROM fine""")
def packed_texts(spark, sf_dir):
    """The lines of each document, packed one behind another with their lengths in front, and found again in the bytes."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    fits = lambda s: s.rlike(f"^{LETTERS}$") & F.octet_length(s).between(2, 4096) & text.is_candidate(s, "en")
    record = lambda s: F.concat(F.hex(packed.packed(F.octet_length(s))), F.hex(s))
    content = F.unhex(F.array_join(F.transform(F.filter(F.split("text", "\n"), fits), record), ""))
    return length_prefixed.probe(docs.select(F.col("doc_id").alias("id"), content.alias("content")), "en").withColumnRenamed("at", "at_")


KINDS = """CASE WHEN c = 101 THEN 'message' WHEN c = 102 THEN 'choice' WHEN c = 150 AND (cents >> 4) & 7 = 2 AND n = 0 THEN 'picture-text' WHEN c = 122 AND n = 0 THEN 'set-string'
      WHEN c IN (112, 250) THEN 'logic' WHEN c IN (103, 106) THEN NULL ELSE 'other' END"""


@query(f"""WITH e AS (SELECT event_id, user_id * 7 - 500 AS low, (value * 100)::BIGINT AS cents, event_id % 2 AS n, [101, 102, 103, 106, 112, 122, 150, 250, 999][event_id % 9 + 1] AS c FROM events)
    SELECT event_id, low, cents, cents % 256 AS first_byte, c AS command, {KINDS} AS kind,
           CASE {KINDS} WHEN 'logic' THEN 'protected' WHEN 'other' THEN 'unknown' WHEN 'set-string' THEN 'unknown' WHEN NULL THEN NULL ELSE CASE WHEN {KINDS} IS NOT NULL THEN 'display' END END AS hint,
           coalesce([0, 5, 0][event_id % 5 + 1], -1)::INT AS type, ((4 - cents % 4) % 4)::BIGINT AS padding, ((cents + 15) // 16 * 16)::BIGINT AS aligned FROM e""")
def packed_events(spark, sf_dir):
    """Events packed into bytes, and read by place: integers, bit tests, kinds of commands, hints and types by position.

    Keys and amounts take eight bytes each, so they hold any of the tables' integers; the first byte marks those that are there.
    """
    command = F.element_at(F.array(*map(F.lit, (101, 102, 103, 106, 112, 122, 150, 250, 999))), (F.col("event_id") % 9 + 1).cast("int"))
    # halves go to the even number, as in the SQL
    held = [F.col("event_id"), F.col("user_id") * 7 - 500, F.rint(F.col("value") * 100).cast("bigint")]
    there = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(held)])
    fields = [packed.packed(there, 1), *[packed.packed(F.coalesce(c, F.lit(0)), 8) for c in held], packed.packed(F.coalesce(command, F.lit(0)), 2)]
    events = table(spark, sf_dir, "events").select("event_id", F.concat(*fields).alias("data"))
    data = F.col("data")
    known = lambda i, value: F.when(packed.bits(packed.unsigned(data, 0, 1), i, 1) == 1, value)
    key = known(0, packed.signed(data, 1, 8))
    read = events.select(
        "event_id", known(1, packed.signed(data, 9, 8)).alias("low"), known(2, packed.signed(data, 17, 8)).alias("cents"), known(2, packed.unsigned(data, 17, 1)).alias("first_byte"),
        known(0, packed.unsigned(data, 25, 2)).cast("int").alias("command"), (key % 2).alias("n"), (key % 5).cast("int").alias("field"),
    )
    kind = packed.command_kind(F.col("command"), F.array("cents"), F.col("n"))
    read = read.withColumn("kind", kind).withColumn("hint", packed.hint_of(F.col("kind")))
    types = F.array(F.lit(0), F.lit(5), F.lit(0))
    return read.select(
        "event_id", "low", "cents", "first_byte", "command", "kind", "hint", packed.at_or(types, F.col("field")).alias("type"), packed.padding(F.col("cents"), 4).alias("padding"), packed.aligned(F.col("cents"), 16).alias("aligned")
    )
