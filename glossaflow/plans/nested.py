"""Queries over nested JSON documents that Spark makes from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql
from ..session import table
from ..sources import json_build, json_walk
from .registry import CANDIDATE_SQL, PLAIN_SQL, plain_lines, query


@query("""WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS k FROM conversations WHERE conv_id IS NOT NULL)
    SELECT conv_id AS file, 'c' AS path, conv_id::VARCHAR AS text FROM t GROUP BY conv_id
    UNION ALL SELECT conv_id, 'turns/' || k || '/' || name, value FROM (SELECT conv_id, k, unnest(['turn', 'role', 'text']) AS name, unnest([turn::VARCHAR, role, text]) AS value FROM t) WHERE value IS NOT NULL""")
def nested_leaves(spark, sf_dir):
    """Each conversation as one document of objects in an array, taken apart."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    docs = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL").groupBy("conv_id").agg(turns)
    texts = docs.select(F.col("conv_id").alias("file"), F.to_json(F.struct(F.col("conv_id").alias("c"), "turns")).alias("text"))
    return json_walk.leaves(texts.select("file", json_walk.parsed(F.col("text")).alias("value"))).select("file", "path", "text")


BASE = "{'a': {'l': coalesce(lang, 'und'), 'n': n_chars}, 'k': [1, doc_id]}"


@query(f"""SELECT doc_id AS file, CASE WHEN l.quality IS NULL THEN to_json({BASE})::VARCHAR ELSE json_merge_patch(to_json({BASE}), to_json({{'a': {{'n': l.quality, 'z': {{'s': source}}}}, 'k': [l.toxic]}}))::VARCHAR END AS text
    FROM documents d LEFT JOIN labels l USING (doc_id)""")
def merged_settings(spark, sf_dir):
    """A document for each text, and one for each label that is put over it."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    base = docs.selectExpr("doc_id AS file", "to_json(named_struct('a', named_struct('l', coalesce(lang, 'und'), 'n', n_chars), 'k', array(1L, doc_id))) AS text")
    over = docs.join(labels, "doc_id").selectExpr("doc_id AS file", "to_json(named_struct('a', named_struct('n', quality, 'z', named_struct('s', source)), 'k', array(toxic))) AS text")
    return json_build.merge_documents(base, over)


@query(f"""WITH {PLAIN_SQL}, s AS (SELECT doc_id AS seq, 'say' AS kind, (k + 1)::VARCHAR AS place, l AS text FROM plain WHERE {CANDIDATE_SQL.format("trim(l)")})
    SELECT * FROM s UNION ALL SELECT event_id, 'leaf', u.k, json_extract_string(props, '$.' || u.k) FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) u""")
def sql_functions(spark, sf_dir):
    """Strings of scripts and leaves of JSON by functions that SQL calls."""
    sql.register(spark)
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.lit('say("'), x, F.lit('", 12)'))), "\n")
    files = plain_lines(spark, sf_dir).select(F.col("doc_id").alias("seq"), body.alias("body"))
    return spark.sql(
        """SELECT seq, 'say' AS kind, cast(s.line AS STRING) AS place, s.source AS text FROM {files}, LATERAL script_strings(body, 'en') s
           UNION ALL SELECT event_id, 'leaf', l.path, l.text FROM {events}, LATERAL json_leaves(props) l""",
        files=files, events=table(spark, sf_dir, "events"),
    )
