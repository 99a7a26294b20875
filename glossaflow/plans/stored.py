"""Queries that go through stored tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import store
from ..session import shared_folder, table
from ..sources import archives, trees
from .registry import DECISIONS_SQL, HINT, decisions_of, occurrences, query


@query(f"""WITH occ AS (SELECT doc_id, doc_id % 2 AS b, text AS source, source AS surface, {HINT} AS hint FROM documents),
    moved AS (SELECT o.*, doc_id + 1 - min(doc_id) OVER (PARTITION BY b) AS own FROM occ o),
    told AS (SELECT * FROM moved WHERE source IS NOT NULL),
    even AS (SELECT source, min(own) AS seq, arg_min(surface, own) AS surface, arg_min(hint, own) AS hint FROM told WHERE b = 0 GROUP BY 1),
    odd AS (SELECT source, min(own) + (SELECT coalesce(max(seq), 0) FROM even) AS seq, arg_min(surface, own) AS surface, arg_min(hint, own) AS hint FROM told WHERE b = 1 AND source NOT IN (SELECT source FROM even) GROUP BY 1),
    items AS (SELECT substr(sha1(source), 1, 16) AS id, * FROM (SELECT * FROM even UNION ALL SELECT * FROM odd)), {DECISIONS_SQL}
    SELECT i.id, seq, coalesce(d.usage, CASE WHEN hint = 'unknown' THEN 'pending' ELSE hint END) AS usage, CASE WHEN d.id IS NOT NULL THEN 'audit' WHEN hint <> 'unknown' THEN 'adapter:' || surface END AS reason,
           CASE WHEN d.id IS NOT NULL THEN d.usage = 'display' ELSE hint = 'display' END AS released FROM items i LEFT JOIN decisions d ON d.id = i.id""")
def stored_catalog(spark, sf_dir):
    """Documents in two batches, one of them twice, then the labels' decisions, by stored tables."""
    found = store.Catalog(spark, shared_folder(spark, "catalog"), digits=1)
    every = occurrences(spark, sf_dir)
    for batch, rest in (("even", 0), ("odd", 1), ("even", 0)):
        found.add_occurrences(batch, every.where(F.col("seq") % 2 == rest))
    found.apply_decisions("audit", decisions_of(spark, sf_dir))
    return found.table("items").select("id", "seq", "usage", "reason", "released")


PAGE_PATH = "CASE WHEN page_id % 3 = 0 THEN 'data/scenario/p' || page_id || '.ks' ELSE 'data/image/p' || page_id || '.png' END"


def page_files(spark, sf_dir):
    """Every page as a file, a third of them scenario scripts."""
    pages = table(spark, sf_dir, "pages").where("page_id IS NOT NULL")
    return pages.selectExpr(f"{PAGE_PATH} AS path", "cast(coalesce(html, '') AS BINARY) AS content")


@query(f"SELECT {PAGE_PATH} AS path, octet_length(encode(coalesce(html, '')))::BIGINT AS size, md5(coalesce(html, '')) AS md5 FROM pages WHERE page_id % 3 = 0")
def archive_entries(spark, sf_dir):
    """Pages packed into archives; their directories are read, and of the entries the scenario scripts."""
    path = shared_folder(spark, "archives")
    archives.write_archives(page_files(spark, sf_dir), path)
    wanted = archives.scenario_files(archives.archive_entries(spark, path))
    return archives.contents(wanted).select("path", "size", F.md5("content").alias("md5"))


@query(f"""SELECT {PAGE_PATH} AS path, CASE WHEN page_id % 7 = 0 THEN 'copied' ELSE 'kept' END AS action, sha256(coalesce(html, '')) AS sha256 FROM pages WHERE page_id IS NOT NULL
    UNION ALL SELECT 'new/' || page_id, 'deleted', NULL FROM pages WHERE page_id % 7 = 1""")
def tree_restore(spark, sf_dir):
    """Pages as a folder of files and a copy of it; some files change, some are new, and the folder is restored."""
    root, copy = shared_folder(spark, "tree"), shared_folder(spark, "copy")
    trees.write_tree(page_files(spark, sf_dir), root)
    trees.copy_tree(spark, root, copy)
    pages = table(spark, sf_dir, "pages")
    changed = pages.where("page_id % 7 = 0").selectExpr(f"{PAGE_PATH} AS path", "cast(concat(coalesce(html, ''), 'x') AS BINARY) AS content")
    trees.write_tree(changed.unionByName(pages.where("page_id % 7 = 1").selectExpr("concat('new/', page_id) AS path", "cast(url AS BINARY) AS content")), root)
    done = trees.restore(spark, root, trees.manifest(spark, copy), copy)
    return trees.manifest(spark, root).select("path", "sha256").join(done, "path", "full_outer").select("path", F.coalesce("action", F.lit("kept")).alias("action"), "sha256")


BYTES = "list_transform(range(1, octet_length(encode(html)) + 1), lambda i: ('0x' || substr(hex(html), (2 * i - 1)::BIGINT, 2))::BIGINT)"


@query(f"""WITH b AS (SELECT {PAGE_PATH} AS path, {BYTES} AS b FROM (SELECT page_id, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL))
    SELECT path, len(b)::BIGINT AS size, ((len(b) + coalesce(list_sum(list_transform(b, lambda x, i: x * (len(b) - i + 1))), 0)) % 65521 * 65536 + (1 + coalesce(list_sum(b), 0)) % 65521)::BIGINT AS adler32 FROM b""")
def tree_checksums(spark, sf_dir):
    """Checksums of pages as files, added up over ranges of 1,000 bytes."""
    root = shared_folder(spark, "tree")
    trees.write_tree(page_files(spark, sf_dir), root)
    return trees.checksums(spark, root, range_bytes=1000)
