"""Queries over the tables of a data folder, one or more for each group of operators, with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog, leasing, listing, messages, quality
from ..operators.display_forms import FORMS
from ..session import table
from ..sources import json_walk, scripts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# What the tables stand for: a document is an occurrence (text, surface = source, ref and order = doc_id, hint by language),
# a benchmark item is a known source, a label an audit decision.
HINT = "CASE lang WHEN 'en' THEN 'display' WHEN 'fr' THEN 'protected' WHEN 'de' THEN 'excluded' ELSE 'unknown' END"
ITEMS_SQL = f"""
    occ AS (SELECT doc_id AS seq, text AS source, source AS surface, {HINT} AS hint FROM documents WHERE text IS NOT NULL),
    firsts AS (SELECT source, min(seq) AS seq, arg_min(surface, seq) AS surface, arg_min(hint, seq) AS hint FROM occ GROUP BY source),
    items AS (
      SELECT substr(sha1(source), 1, 16) AS id, seq, source, CASE WHEN hint = 'unknown' THEN 'pending' ELSE hint END AS usage,
             CASE WHEN hint <> 'unknown' THEN 'adapter:' || surface END AS reason, hint = 'display' AS released
      FROM firsts)
"""


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.selectExpr("doc_id AS seq", "text AS source", "source AS surface", "cast(doc_id AS STRING) AS ref", "lang AS context", f"{HINT} AS hint")


def no_items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], catalog.ITEM_COLUMNS)


def items_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.new_items(occurrences(spark, sf_dir), no_items(spark))


LEASED_SQL = f"""
    held AS (SELECT id, seq, source, usage, released, CASE WHEN seq % 5 = 0 THEN 'done ' || id END AS target, CASE WHEN seq % 3 = 0 THEN 'w' || (seq % 7)::VARCHAR END AS worker,
             CASE WHEN seq % 3 = 0 THEN 'l' || (seq % 2)::VARCHAR END AS lease, CASE WHEN seq % 3 = 0 THEN (seq % 100)::DOUBLE END AS expires FROM items)
"""


def leased_items(spark, sf_dir) -> DataFrame:
    """Items with translations and leases by their order, some of them ended at time 50."""
    leased = "seq % 3 = 0"
    return (
        items_of(spark, sf_dir)
        .withColumn("target", F.expr("CASE WHEN seq % 5 = 0 THEN concat('done ', id) END"))
        .withColumn("worker", F.expr(f"CASE WHEN {leased} THEN concat('w', seq % 7) END"))
        .withColumn("lease", F.expr(f"CASE WHEN {leased} THEN concat('l', seq % 2) END"))
        .withColumn("expires", F.expr(f"CASE WHEN {leased} THEN cast(seq % 100 AS DOUBLE) END"))
    )


@query("SELECT substr(sha1(text), 1, 16) AS id, text AS source, min(doc_id) AS first_seq, count(*)::BIGINT AS n_refs FROM documents WHERE text IS NOT NULL GROUP BY text")
def catalog_dedup(spark, sf_dir):
    return catalog.first_occurrences(table(spark, sf_dir, "documents").selectExpr("doc_id AS seq", "text AS source"))


@query(f"""WITH {ITEMS_SQL}
    SELECT id, seq, usage, reason, released FROM items
    WHERE source NOT IN (SELECT d.text FROM documents d JOIN labels l USING (doc_id) WHERE d.text IS NOT NULL)""")
def catalog_insert(spark, sf_dir):
    """New items against a catalog that has the labelled texts."""
    known = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    existing = known.where("text IS NOT NULL").select(catalog.item_id(F.col("text")).alias("id")).distinct()
    return catalog.new_items(occurrences(spark, sf_dir), existing).select("id", "seq", "usage", "reason", "released")


@query(f"""SELECT substr(sha1(text), 1, 16) AS item_id, source AS surface, lang AS ref, arg_max(doc_id::VARCHAR, doc_id) AS context, arg_max({HINT}, doc_id) AS hint
    FROM documents WHERE text IS NOT NULL GROUP BY 1, 2, 3""")
def refs_last_wins(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    occ = docs.selectExpr("doc_id AS seq", "text AS source", "source AS surface", "lang AS ref", "cast(doc_id AS STRING) AS context", f"{HINT} AS hint")
    return catalog.merged_refs(occ, spark.createDataFrame([], catalog.REF_COLUMNS))


@query("""SELECT item_id, surface, ref, place::INT AS place FROM (
      SELECT substr(sha1(text), 1, 16) AS item_id, source AS surface, doc_id::VARCHAR AS ref,
             row_number() OVER (PARTITION BY text ORDER BY source, doc_id::VARCHAR) AS place
      FROM documents WHERE text IS NOT NULL) WHERE place <= 4""")
def refs_topk(spark, sf_dir):
    refs = catalog.merged_refs(occurrences(spark, sf_dir), spark.createDataFrame([], catalog.REF_COLUMNS))
    return catalog.top_refs(refs, 4).select("item_id", "surface", "ref", "place")


DECISIONS_SQL = """
    decisions AS (
      SELECT substr(sha1(d.text), 1, 16) AS id, arg_max(CASE WHEN l.toxic = 1 THEN 'protected' WHEN l.quality = 1 THEN 'display' ELSE 'dual' END, d.doc_id) AS usage
      FROM documents d JOIN labels l USING (doc_id) WHERE d.text IS NOT NULL GROUP BY 1)
"""


def decisions_of(spark, sf_dir) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("text IS NOT NULL")
    usage = "CASE WHEN toxic = 1 THEN 'protected' WHEN quality = 1 THEN 'display' ELSE 'dual' END"
    return joined.select(catalog.item_id(F.col("text")).alias("id"), F.expr(f"{usage} AS usage"), F.lit("audit").alias("reason"), F.col("doc_id").alias("seq"))


def no_quarantine(spark) -> DataFrame:
    return spark.createDataFrame([], "id STRING, reason STRING, worker STRING, created DOUBLE")


@query(f"""WITH {ITEMS_SQL}, {DECISIONS_SQL}
    SELECT i.id, coalesce(d.usage, i.usage) AS usage, CASE WHEN d.id IS NOT NULL THEN 'audit' ELSE i.reason END AS reason,
           CASE WHEN d.id IS NOT NULL THEN d.usage = 'display' ELSE i.released END AS released
    FROM items i LEFT JOIN decisions d USING (id)""")
def audit_apply(spark, sf_dir):
    after = catalog.apply_decisions(items_of(spark, sf_dir), decisions_of(spark, sf_dir), no_quarantine(spark))
    return after.select("id", "usage", "reason", "released")


@query(f"WITH {ITEMS_SQL}, {DECISIONS_SQL} SELECT coalesce(d.usage, i.usage) AS usage, count(*)::BIGINT AS n FROM items i LEFT JOIN decisions d USING (id) GROUP BY 1")
def usage_status(spark, sf_dir):
    return catalog.usage_counts(catalog.apply_decisions(items_of(spark, sf_dir), decisions_of(spark, sf_dir), no_quarantine(spark)))


@query(f"""WITH {ITEMS_SQL}, {LEASED_SQL}, t AS (SELECT doc_id AS seq, source, lang AS target FROM documents), f AS (SELECT source, arg_min(target, seq) AS first FROM t GROUP BY 1)
    SELECT count_if(released)::BIGINT AS released, count_if(released AND target IS NOT NULL)::BIGINT AS translated, count_if(released AND target IS NULL AND worker IS NOT NULL)::BIGINT AS leased,
           count_if(released AND target IS NULL)::BIGINT AS pending_translation, count_if(usage = 'pending')::BIGINT AS pending_audit,
           (SELECT count(*) FROM t JOIN f USING (source) WHERE target <> first)::BIGINT AS glossary_conflicts, (SELECT count(*) FROM labels WHERE toxic = 1)::BIGINT AS quarantined FROM held""")
def catalog_status(spark, sf_dir):
    """Totals of leased items, of the conflicts between all texts' languages by source, and of toxic labels as held back."""
    return catalog.status(leased_items(spark, sf_dir), language_conflicts(spark, sf_dir), table(spark, sf_dir, "labels").where("toxic = 1"))


@query(f"WITH {ITEMS_SQL} SELECT id, ((row_number() OVER (ORDER BY seq) - 1) // 300 + 1)::BIGINT AS batch FROM items")
def audit_batches(spark, sf_dir):
    return catalog.batches(items_of(spark, sf_dir).select("id", "seq")).select("id", "batch")


TOKENS_SQL = r"list_sort(regexp_extract_all({0}, '(?:\{{[^{{}}\n]*\}})|(?:%(?:\d+\$)?[-+0 #]*(?:\d+|\*)?(?:\.(?:\d+|\*))?[sdifxXocv])'))"
COUNT_SQL = "(length({0}) - length(replace({0}, {1}, '')))"
EDGES_SQL = r"(regexp_matches({0}, '^[\s\x{{b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{2003}}\x{{3000}}]') <> regexp_matches({1}, '^[\s\x{{b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{2003}}\x{{3000}}]') OR regexp_matches({0}, '[\s\x{{b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{2003}}\x{{3000}}]$') <> regexp_matches({1}, '[\s\x{{b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{2003}}\x{{3000}}]$'))"


@query(
    "WITH pairs AS (SELECT doc_id, text AS s, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS t FROM documents) SELECT doc_id, "
    "CASE WHEN t IS NULL OR trim(t) = '' THEN 'empty' ELSE array_to_string(list_filter([CASE WHEN "
    + TOKENS_SQL.format("s")
    + " <> "
    + TOKENS_SQL.format("t")
    + " THEN 'tokens' END, CASE WHEN "
    + COUNT_SQL.format("s", "chr(10)")
    + " <> "
    + COUNT_SQL.format("t", "chr(10)")
    + " THEN 'line_feeds' END, CASE WHEN "
    + COUNT_SQL.format("s", "chr(9)")
    + " <> "
    + COUNT_SQL.format("t", "chr(9)")
    + " THEN 'tabs' END, CASE WHEN "
    + EDGES_SQL.format("s", "t")
    + " THEN 'edge_space' END], lambda x: x IS NOT NULL), ',') END AS errors FROM pairs"
)
def validate_pairs(spark, sf_dir):
    """Every text against the next one of its source, as if that were its translation."""
    docs = table(spark, sf_dir, "documents")
    # ids alone are put in order; a source that has a large share of all texts is cut by the ranges
    placed = catalog.numbered(docs.select("doc_id", "source"), "source", "doc_id")
    after = placed.select((F.col("n") - 1).alias("n"), F.col("doc_id").alias("next_id"), F.col("source").alias("next_source"))
    follows = placed.join(after, "n").where("source <=> next_source").select("doc_id", "next_id")
    targets = follows.join(docs.select(F.col("doc_id").alias("next_id"), F.col("text").alias("t")), "next_id").drop("next_id")
    pairs = docs.select("doc_id", F.col("text").alias("s")).join(targets, "doc_id", "left")
    return pairs.select("doc_id", F.concat_ws(",", text.target_errors(F.col("s"), F.col("t"))).alias("errors"))


@query(r"""SELECT doc_id, coalesce(regexp_matches(trim(text), '[A-Za-z]{2,}') AND NOT regexp_matches(trim(text), '^[A-Za-z_][A-Za-z0-9_.:/-]*$')
      AND NOT regexp_matches(trim(text), '(?i)^(res|user|uid|https?|file)://|^[\w./\\-]+\.(png|jpg|ogg|wav|mp3|json|tscn|tres|gd|gdc|js|webp|ks|tjs|txt|csv|asset|prefab)$'), false) AS candidate
    FROM documents""")
def candidate_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.is_candidate(F.col("text"), "en").alias("candidate"))


PIECES_SQL = r"list_filter(list_transform(regexp_split_to_array({0}, '[\n\r\t\x{{3000}}:\x{{ff1a}}\x{{30fb}}/\x{{ff0f}}|]+|\[[^\]]*\]|<[^>]*>|\\[A-Za-z]+\[[^\]]*\]'), lambda x: trim(x)), lambda x: x <> '')"


@query(
    f"""WITH known AS (SELECT DISTINCT trim(line) AS piece FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark) WHERE length(trim(line)) >= 2),
    pieces AS (SELECT doc_id, unnest({PIECES_SQL.format("text")}) AS piece FROM documents WHERE trim(text) <> '')
    SELECT doc_id AS seq, count(*)::BIGINT AS n_hits FROM pieces WHERE piece IN (SELECT piece FROM known) GROUP BY 1"""
)
def residual_scan(spark, sf_dir):
    lines = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("line")).select(F.trim("line").alias("source"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text")
    return quality.residual_scan(docs, lines, "en").select("seq", F.size("hits").cast("bigint").alias("n_hits"))


@query("SELECT d.doc_id AS seq, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def corpus_contains(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("part"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text")
    return quality.containing(docs, items).join(items, "part").select("seq", "item_id")


@query(f"""SELECT avg(CASE WHEN regexp_matches(text, '[à-ÿ]') THEN 1.0 ELSE 0.0 END)::DOUBLE AS ratio FROM documents WHERE text IS NOT NULL""")
def untranslated_ratio(spark, sf_dir):
    """Accented letters stand in for kana, which the tables do not have."""
    targets = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("text").alias("target"))
    return quality.untranslated_ratio(targets, pattern="[à-ÿ]")


@query("""WITH a AS (SELECT doc_id::VARCHAR AS path, n_chars AS size, md5(text) AS h FROM documents),
    b AS (SELECT doc_id::VARCHAR AS path, n_chars + quality AS size, md5(text || toxic::VARCHAR) AS h FROM documents JOIN labels USING (doc_id))
    SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.size <> b.size THEN 'size' WHEN a.h <> b.h THEN 'content' END AS change
    FROM a FULL JOIN b USING (path) WHERE b.path IS NULL OR a.size <> b.size OR a.h <> b.h""")
def manifest_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    before = docs.selectExpr("cast(doc_id AS STRING) AS path", "n_chars AS size", "0L AS mtime_ns", "md5(cast(text AS BINARY)) AS sha256")
    after = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    after = after.selectExpr("cast(doc_id AS STRING) AS path", "n_chars + quality AS size", "1L AS mtime_ns", "md5(cast(concat(text, toxic) AS BINARY)) AS sha256")
    return quality.manifest_diff(before, after)


@query("""WITH t AS (SELECT doc_id AS seq, source, lang AS target, 'w' AS worker FROM documents)
    SELECT source, f.first AS old, target AS new, count(*)::BIGINT AS n FROM t JOIN (SELECT source, arg_min(target, seq) AS first FROM t GROUP BY 1) f USING (source)
    WHERE target <> f.first GROUP BY 1, 2, 3""")
def glossary_conflicts(spark, sf_dir):
    return language_conflicts(spark, sf_dir).groupBy("source", "old", "new").agg(F.count("*").alias("n"))


def language_conflicts(spark, sf_dir) -> DataFrame:
    terms = table(spark, sf_dir, "documents").selectExpr("doc_id AS seq", "source", "lang AS target", "'place' AS category", "'w' AS worker")
    glossary = spark.createDataFrame([], "source STRING, target STRING, category STRING, worker STRING")
    return catalog.merge_terms(glossary, terms)[1]


TIMELINE = "epoch_us(ts) / 1e6"


@query(f"""SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS worker, CASE WHEN e.expires > m.now THEN e.expires END AS expires
    FROM (SELECT event_id, user_id, {TIMELINE} + 1800 AS expires FROM events) e, (SELECT max({TIMELINE}) AS now FROM events) m WHERE e.expires > m.now""")
def lease_reclaim(spark, sf_dir):
    """Leases taken at the time of each event that still run at the last one."""
    events = table(spark, sf_dir, "events").withColumn("at", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / F.lit(1e6))
    now = events.agg(F.max("at")).first()[0]
    items = events.selectExpr("cast(event_id AS STRING) AS id", "cast(NULL AS STRING) AS target", "cast(user_id AS STRING) AS worker", "'l' AS lease", "at + 1800 AS expires")
    return leasing.reclaim(items, now).where("worker IS NOT NULL").select("id", "worker", "expires")


@query(f"WITH {ITEMS_SQL} SELECT id, source, 1800.0::DOUBLE AS expires FROM items WHERE released ORDER BY seq LIMIT 300")
def claim_batch(spark, sf_dir):
    """The first batch of a new worker: 300 items are the feature's limit."""
    refs = catalog.merged_refs(occurrences(spark, sf_dir), spark.createDataFrame([], catalog.REF_COLUMNS))
    _, batch = leasing.claim(items_of(spark, sf_dir), refs, "worker-1", "lease-1", 0.0)
    return batch.select("id", "source", "expires")


@query(f"""WITH {ITEMS_SQL}, bad AS (SELECT DISTINCT substr(sha1(d.text), 1, 16) AS id FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1)
    SELECT id, released AND id NOT IN (SELECT id FROM bad) AS released FROM items""")
def quarantine_release(spark, sf_dir):
    reports = decisions_of(spark, sf_dir).where("usage = 'protected'").select("seq", "id", F.lit("toxic").alias("reason"))
    items, _ = catalog.quarantined(items_of(spark, sf_dir), no_quarantine(spark), reports, "worker-1", 0.0)
    return items.select("id", "released")


@query("""WITH m AS (SELECT text AS source, arg_min(lang || ':' || doc_id::VARCHAR, doc_id) AS target FROM documents JOIN labels USING (doc_id) GROUP BY 1)
    SELECT doc_id, md5(coalesce(m.target, d.text)) AS target_md5, m.target IS NOT NULL AS replaced FROM documents d LEFT JOIN m ON d.text = m.source""")
def apply_mapping(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    known = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    known = known.groupBy(F.col("text").alias("source")).agg(F.min_by(F.concat_ws(":", "lang", F.col("doc_id").cast("string")), "doc_id").alias("target"))
    out = catalog.apply_mapping(docs.select("doc_id", "text"), known, "text")
    return out.select("doc_id", F.md5(F.col("target").cast("binary")).alias("target_md5"), "replaced")


@query("SELECT count(*)::BIGINT AS n FROM documents WHERE text NOT IN (SELECT d.text FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1)")
def unknown_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    good = docs.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").select(F.col("text").alias("source")).distinct()
    return catalog.unknown_sources(docs.select(F.col("text").alias("source")), good).agg(F.count("*").alias("n"))


GRAMS_SQL = """grams AS (SELECT DISTINCT item_id, substr(text, i, 2) AS g FROM (SELECT item_id, text, unnest(range(1, length(text))) AS i FROM benchmark))"""


@query(f"""WITH {GRAMS_SQL}, freq AS (SELECT g, count(*) AS n FROM grams GROUP BY g)
    SELECT item_id AS pair_id, arg_min(g, (n, g)) AS anchor FROM grams JOIN freq USING (g) GROUP BY 1""")
def rare_anchor(spark, sf_dir):
    return messages.rare_anchors(table(spark, sf_dir, "benchmark").selectExpr("item_id AS pair_id", "text AS source"))


@query("""SELECT item_id, replace(replace(replace(replace(text, '\\', '\\\\'), chr(10), '\\n'), chr(9), '\\t'), '=', '\\=') || '=' || item_id::VARCHAR AS entry FROM benchmark""".replace("\\\\", "\\"))
def dictionary_lines(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat(text.escape_entry(F.col("text")), F.lit("="), F.col("item_id").cast("string")).alias("entry"))


@query("SELECT event_id::VARCHAR AS file, u.k AS path, json_extract_string(props, '$.' || u.k) AS text FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) u")
def json_leaves(spark, sf_dir):
    docs = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("file"), json_walk.parsed(F.col("props")).alias("value"))
    return json_walk.leaves(docs).select("file", "path", "text")


LINES_SQL = "SELECT seq, unnest(string_split(body, chr(10))) AS line_text, unnest(range(len(string_split(body, chr(10))))) AS line FROM scripts"


@query(rf"""WITH scripts AS (SELECT conv_id * 1000 + turn AS seq, '#' || role || chr(10) || text AS body FROM conversations),
    lines AS (SELECT seq, line::INT AS line, line_text AS t, trim(line_text) AS bare FROM ({LINES_SQL})),
    kinds AS (SELECT *, CASE WHEN bare[1] = '#' THEN 'speaker' ELSE 'text' END AS kind, length(t) - length(ltrim(t)) AS lead, length(rtrim(t)) AS fin FROM lines
              WHERE bare <> '' AND bare[1] NOT IN (';', '*', '@') AND (bare[1] = '#' OR trim(regexp_replace(bare, '\[[^\]\n]*\]', '', 'g')) <> ''))
    SELECT seq, line, kind, (lead + (kind = 'speaker')::INT)::INT AS start, fin::INT AS "end", substr(t, lead + (kind = 'speaker')::INT + 1, fin - lead - (kind = 'speaker')::INT) AS source
    FROM kinds WHERE kind = 'text' OR trim(bare[2:]) <> ''""")
def scenario_units(spark, sf_dir):
    return scripts.scenario_units(table(spark, sf_dir, "conversations").selectExpr("conv_id * 1000 + turn AS seq", "concat('#', role, '\n', text) AS text"))


LITERALS_SQL = r"""'//[^\n]*|/\*(?s:.*?)(?:\*/|\z)|@?"(?:\\(?s:.)|[^"\\\n])*"?|@?\x27(?:\\(?s:.)|[^\x27\\\n])*\x27?'"""


@query(rf"""WITH found AS (SELECT page_id AS seq, unnest(regexp_extract_all(html, {LITERALS_SQL})) AS v, unnest(regexp_split_to_array(html, {LITERALS_SQL})[:-2]) AS gap,
      unnest(range(1, len(regexp_extract_all(html, {LITERALS_SQL})) + 1)) AS n FROM pages),
    placed AS (SELECT seq, v, sum(length(v) + length(gap)) OVER (PARTITION BY seq ORDER BY n) AS fin FROM found)
    SELECT seq, (fin - length(v) + 1)::INT AS start, (fin - 1)::INT AS "end", v[1] AS quote, v[2:-2] AS source FROM placed
    WHERE regexp_full_match(v, '"(?:\\(?s:.)|[^"\\\n])*"|\x27(?:\\(?s:.)|[^\x27\\\n])*\x27')""")
def page_literals(spark, sf_dir):
    return scripts.string_literals(table(spark, sf_dir, "pages").selectExpr("page_id AS seq", "html AS text"))


@query("""WITH RECURSIVE hits AS (SELECT d.doc_id, b.text AS source, 'item ' || b.item_id::VARCHAR AS target, row_number() OVER (PARTITION BY d.doc_id ORDER BY length(b.text) DESC, b.item_id) AS k
      FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
    steps AS (SELECT doc_id, 0::BIGINT AS k, text FROM documents WHERE doc_id IN (SELECT doc_id FROM hits)
      UNION ALL SELECT s.doc_id, h.k, replace(s.text, h.source, h.target) FROM steps s JOIN hits h ON h.doc_id = s.doc_id AND h.k = s.k + 1)
    SELECT d.doc_id AS seq, r.target FROM documents d LEFT JOIN (SELECT doc_id, arg_max(text, k) AS target FROM steps GROUP BY 1) r USING (doc_id)""")
def message_rewrite(spark, sf_dir):
    pairs = table(spark, sf_dir, "benchmark").selectExpr("item_id AS pair_id", "text AS source", "concat('item ', item_id) AS target")
    return messages.rewrite(table(spark, sf_dir, "documents").selectExpr("doc_id AS seq", "text"), pairs).select("seq", "target")


@query("""SELECT item_id * 10 + n AS seq, CASE n WHEN 0 THEN 'item ' || item_id || ' of 7 costs ' || length(text) || ' gold' WHEN 1 THEN 'You took ' || item_id END AS target
    FROM benchmark, (SELECT unnest([0, 1, 2]) AS n)""")
def template_rewrite(spark, sf_dir):
    """Placeholders: numbers are captured, repeated names must be equal (they are not in the third text)."""
    pairs = spark.createDataFrame(
        [(1, "Pay %d coins for {thing}: %d sold", "item {thing} of %d costs %d gold"), (2, "{who} is taken by {who}", "never"), (3, "Taken by you: {thing}", "You took {thing}")],
        "pair_id BIGINT, source STRING, target STRING",
    )
    shown = "CASE n WHEN 0 THEN concat('Pay 7 coins for ', item_id, ': ', length(text), ' sold') WHEN 1 THEN concat('Taken by you: ', item_id) ELSE concat(item_id, ' is taken by x', item_id) END AS text"
    texts = table(spark, sf_dir, "benchmark").selectExpr("item_id", "text", "explode(array(0, 1, 2)) AS n").selectExpr("item_id * 10 + n AS seq", shown)
    return messages.rewrite(texts, pairs).select("seq", "target")


@query(r"""WITH plain AS (SELECT doc_id AS seq, translate(text, '*[(「“', '') AS t FROM documents WHERE text IS NOT NULL),
    marked AS (SELECT seq, string_split(regexp_replace(t, ' (and|the|und|que|de) ', ' **\1** ', 'g'), '**') AS parts, string_split(regexp_replace(t, ' (in|of|die|es|en) ', ' 「\1」 ', 'g'), chr(10)) AS lines FROM plain),
    told AS (SELECT seq, unnest(lines) AS line, unnest(range(len(lines))) AS k FROM marked),
    toned AS (SELECT seq, string_agg(array_to_string(list_transform(string_split_regex(line, '「[^」]*」'), lambda g, i: CASE WHEN g = '' THEN '' ELSE '[color={__narration}]' || g || '[/color]' END || coalesce(regexp_extract_all(line, '「[^」]*」')[i], '')), ''), chr(10) ORDER BY k) AS t,
              bool_or(contains(line, '「')) AS quoted, string_agg(line, chr(10) ORDER BY k) AS bare FROM told GROUP BY seq)
    SELECT seq, md5(array_to_string(list_transform(parts, lambda x, i: CASE WHEN i % 2 = 0 THEN '[color={__style_' || (i // 2 - 1)::BIGINT || '_ink}]' || x || '[/color]' ELSE x END), '')) AS markup_md5,
           md5(CASE WHEN quoted THEN toned.t ELSE bare END) AS narration_md5 FROM marked JOIN toned USING (seq)""")
def display_aliases(spark, sf_dir):
    """Whole texts with frequent words emphasised or quoted, as the game shows them."""
    plain = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("seq"), F.translate("text", "*[(「“", "").alias("t"))
    marked = F.regexp_replace("t", " (and|the|und|que|de) ", " **$1** ")
    quoted = F.regexp_replace("t", " (in|of|die|es|en) ", " 「$1」 ")
    shown = {f"{n}_md5": FORMS[f].shown(c) for n, f, c in (("markup", "double_markup", marked), ("narration", "quote_narration", quoted))}
    return plain.select("seq", *[F.md5(c.cast("binary")).alias(n) for n, c in shown.items()])


@query("""WITH t AS (SELECT doc_id AS seq, unnest(['{a}', '%d', '{name}'] || list_transform(range(doc_id % 4), lambda i: '{a}') || ['%d']) AS token,
      unnest(range(5 + doc_id % 4)) AS place FROM documents)
    SELECT seq, place::INT AS place, token, (row_number() OVER (PARTITION BY seq, token ORDER BY place) - 1)::INT AS ordinal FROM t WHERE token IS NOT NULL""")
def token_ordinals(spark, sf_dir):
    shown = F.expr("concat(replace(replace(text, '%', ''), '{', ''), ' {a} %d {name}', repeat(' {a}', cast(doc_id % 4 AS INT)), '%d')")
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("seq"), F.coalesce(shown, F.expr("concat('{a} %d {name}', repeat(' {a}', cast(doc_id % 4 AS INT)), '%d')")).alias("text"))
    return docs.select("seq", F.posexplode(messages.token_ordinals(F.col("text"))).alias("place", "x")).select("seq", "place", "x.token", "x.ordinal")


@query(r"""SELECT u AS root, engine, max(score)::INT AS score FROM (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS u, unnest([CASE WHEN regexp_matches(url, '[02468]$') THEN 60 END, CASE WHEN regexp_matches(url, '[13][a-z0-9]*$') THEN 90 END, CASE WHEN regexp_matches(url, 'example\.(com|org)') THEN 80 END]) AS score,
      unnest(['one', 'one', 'two']) AS engine FROM pages) WHERE score IS NOT NULL GROUP BY 1, 2""")
def engine_scores(spark, sf_dir):
    """The pages of each host as the files of a root."""
    files = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("root"), F.col("url").alias("path"))
    rules = spark.createDataFrame([("one", "[02468]$", 60), ("one", "[13][a-z0-9]*$", 90), ("two", r"example\.(com|org)", 80), ("none", "^ftp:", 50)], "engine STRING, pattern STRING, score INT")
    return listing.engine_scores(files, rules)


@query("SELECT text AS source, 'item=' || item_id AS target FROM benchmark")
def dictionary_round_trip(spark, sf_dir):
    """A dictionary file written and read again, with comments and rules between its lines."""
    pairs = table(spark, sf_dir, "benchmark").selectExpr("text AS source", "concat('item=', item_id) AS target")
    noise = spark.createDataFrame([("// note=x",), ("r:a=b",), ("sr:a=b",), ("",), ("no equals",)], "value STRING")
    return listing.read_dictionary(listing.dictionary_file(pairs).unionByName(noise))


@query("""SELECT lower(lang) || (doc_id % 50)::VARCHAR || '.ks' AS key, max(doc_id) AS doc_id, count(*)::BIGINT AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1""")
def overlay_entries(spark, sf_dir):
    entries = table(spark, sf_dir, "documents").where("lang IS NOT NULL").selectExpr("doc_id", "concat('p', doc_id % 7, '/', upper(lang), doc_id % 50, '.KS') AS path", "doc_id AS precedence")
    counts = listing.clashes(entries).select("key", "n")
    return listing.overlay(entries).join(counts, "key", "left").select("key", "doc_id", F.coalesce("n", F.lit(1)).cast("bigint").alias("n"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 WHEN doc_id % 4 = 1 THEN 1 WHEN doc_id % 4 = 2 THEN 2 ELSE 3 END AS rank,
    CASE WHEN doc_id % 4 < 3 THEN 0 WHEN doc_id % 8 = 3 THEN 1 ELSE doc_id END::INT AS number FROM documents""")
def archive_order(spark, sf_dir):
    name = "CASE doc_id % 4 WHEN 0 THEN 'loose.ks' WHEN 1 THEN 'Data.xp3' WHEN 2 THEN concat('voice', doc_id, '.xp3') ELSE concat('patch', CASE WHEN doc_id % 8 = 3 THEN '' ELSE cast(doc_id AS STRING) END, '.xp3') END AS path"
    found = table(spark, sf_dir, "documents").selectExpr("doc_id", name).select("doc_id", listing.archive_precedence(F.col("path")).alias("p"))
    return found.select("doc_id", "p.rank", "p.number")


@query("""WITH b AS (SELECT user_id::VARCHAR AS worker, event_id AS n, (event_id % 3 > 0 OR value < 20)::INT AS empty FROM events),
    runs AS (SELECT *, sum(1 - empty) OVER (PARTITION BY worker ORDER BY n) AS run FROM b),
    s AS (SELECT worker, n, sum(empty) OVER (PARTITION BY worker, run ORDER BY n)::BIGINT AS streak FROM runs) SELECT *, streak >= 3 AS blocked FROM s""")
def failure_streaks(spark, sf_dir):
    batches = table(spark, sf_dir, "events").selectExpr("cast(user_id AS STRING) AS worker", "event_id AS n", "CASE WHEN event_id % 3 > 0 OR value < 20 THEN 0 ELSE 5 END AS accepted")
    return listing.failure_streaks(batches)


@query("""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents WHERE text IS NOT NULL)
    SELECT source AS log, bool_or((doc_id + k) % 3 < 2 AND doc_id % 40 = 0 AND (contains(lower(line), 'der ') OR contains(lower(line), ' the '))) AS marked FROM l GROUP BY 1""")
def log_markers(spark, sf_dir):
    """Every line of every text as a log line: JSON lines with a stop reason, plain lines with the word, and JSON lines that only mention it.
    Of most documents the stop reason is another one, and the word is left out."""
    lines = table(spark, sf_dir, "documents").where("text IS NOT NULL").selectExpr("doc_id", "source", "posexplode(split(text, '\n', -1)) AS (k, l)")
    line = """CASE (doc_id + k) % 3 WHEN 0 THEN to_json(named_struct('message', named_struct('stopReason', CASE WHEN doc_id % 40 = 0 THEN 'error' ELSE 'end' END, 't', l)))
      WHEN 1 THEN concat(CASE WHEN doc_id % 40 = 0 THEN 'ERROR ' ELSE 'note ' END, replace(lower(l), 'error', '')) ELSE to_json(named_struct('message', named_struct('stopReason', 'end'), 't', concat('error ', l))) END AS line"""
    return listing.log_markers(lines.selectExpr("source AS log", line), ["der ", " the "])


@query("""SELECT event_id::VARCHAR AS id, CASE WHEN event_id % 4 = 0 THEN 'complete' WHEN value < 30 THEN 'interrupted' ELSE 'running' END AS state
    FROM events ORDER BY (event_id % 4 > 0 AND value >= 30) DESC, epoch_us(ts) / 1e6 DESC, event_id::VARCHAR LIMIT 30""")
def task_snapshot(spark, sf_dir):
    """The latest 30 tasks: the limit is the report's own."""
    at = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 1e6D AS started"
    tasks = table(spark, sf_dir, "events").selectExpr("cast(event_id AS STRING) AS id", "CASE WHEN event_id % 4 = 0 THEN 'complete' ELSE 'running' END AS state", at, "CASE WHEN value < 30 THEN 0.0D ELSE 100.0D END AS updated")
    return listing.task_snapshot(tasks, 30.0, 110.0).select("id", "state")


@query("""SELECT user_id::VARCHAR AS worker, arg_max(event_type, event_id) AS state FROM events WHERE event_id >= 100 GROUP BY 1""")
def worker_states(spark, sf_dir):
    records = table(spark, sf_dir, "events").selectExpr("cast(user_id AS STRING) AS worker", "cast(event_id AS DOUBLE) AS at", "event_type AS state")
    return listing.worker_states(records, 100.0).select("worker", "state")


@query(f"WITH {ITEMS_SQL}, {LEASED_SQL} SELECT worker, count(target)::BIGINT AS done, count_if(target IS NULL)::BIGINT AS owned FROM held WHERE released AND worker IS NOT NULL GROUP BY 1")
def worker_counts(spark, sf_dir):
    return catalog.worker_counts(leased_items(spark, sf_dir))


@query(f"""WITH {ITEMS_SQL}, {LEASED_SQL}
    SELECT count(*)::BIGINT AS total, count_if(usage = 'pending')::BIGINT AS pending_audit, count_if(released)::BIGINT AS released, count_if(released AND target IS NOT NULL)::BIGINT AS translated,
           count_if(released AND target IS NULL)::BIGINT AS pending_translation, count_if(released AND target IS NULL AND worker IS NOT NULL AND expires > 50)::BIGINT AS leased,
           (SELECT count(*) FROM labels)::BIGINT AS quarantined, 0::BIGINT AS glossary_conflicts FROM held""")
def snapshot_counts(spark, sf_dir):
    conflicts = spark.createDataFrame([], "source STRING, old STRING, new STRING, worker STRING")
    return catalog.snapshot_counts(leased_items(spark, sf_dir), conflicts, table(spark, sf_dir, "labels"), 50.0)


@query(f"""WITH {ITEMS_SQL}, {LEASED_SQL}
    SELECT id, CASE WHEN released AND target IS NULL AND worker = 'w3' AND lease = 'l1' AND expires > 50 THEN source ELSE target END AS target,
           CASE WHEN worker = 'w3' AND lease = 'l1' AND target IS NULL AND NOT (released AND expires > 50) THEN 1850.0 ELSE expires END AS expires FROM held""")
def submit_batch(spark, sf_dir):
    """A worker hands in all that its lease holds; its other rows on the lease get more time."""
    items = leased_items(spark, sf_dir)
    batch = items.where("released AND target IS NULL AND worker = 'w3' AND lease = 'l1' AND expires > 50").select("id", F.col("source").alias("target"))
    return leasing.submit(items, batch, "w3", "l1", 50.0).select("id", "target", "expires")


@query(f"WITH {ITEMS_SQL}, {LEASED_SQL} SELECT id, CASE WHEN worker = 'w3' AND target IS NULL AND lease = 'l1' THEN NULL ELSE worker END AS worker FROM held")
def release_lease(spark, sf_dir):
    return leasing.release(leased_items(spark, sf_dir), "w3", "l1").select("id", "worker")


IMPORT_SQL = f"""
    rows AS (SELECT doc_id AS seq, substr(sha1(text), 1, 16) AS id, text AS s, text || ' v' || doc_id AS t,
                    CASE doc_id % 4 WHEN 0 THEN 'display' WHEN 1 THEN '' WHEN 3 THEN 'excluded' END AS usage, CASE doc_id % 3 WHEN 0 THEN 'row ' || doc_id WHEN 1 THEN '' END AS reason,
                    doc_id % 2 = 0 AS given FROM documents WHERE text IS NOT NULL),
    decided AS (SELECT id, arg_max(usage, seq) AS usage, arg_max(coalesce(nullif(reason, ''), 'imported'), seq) AS reason FROM rows WHERE usage <> '' GROUP BY 1),
    judged AS (SELECT id, t, seq, trim(t) <> '' AND {TOKENS_SQL.format("s")} = {TOKENS_SQL.format("t")} AND NOT {EDGES_SQL.format("s", "t")} AS ok FROM rows WHERE given),
    good AS (SELECT id, arg_max(t, seq) AS t FROM judged WHERE ok GROUP BY 1),
    after AS (SELECT h.*, d.id IS NOT NULL AS changed, coalesce(d.usage, h.usage) AS usage_, coalesce(d.reason, 'adapter:' || surface) AS reason_, CASE WHEN d.id IS NULL THEN h.released ELSE d.usage = 'display' END AS released_, g.t
              FROM held h JOIN firsts USING (source) LEFT JOIN decided d ON d.id = h.id LEFT JOIN good g ON g.id = h.id)
"""


def import_tables(spark, sf_dir):
    """Items with leases, and rows for every document: decisions, reasons and targets come and lack by turns, copies of a text bring several."""
    usage = "CASE doc_id % 4 WHEN 0 THEN 'display' WHEN 1 THEN '' WHEN 3 THEN 'excluded' END AS usage"
    reason = "CASE doc_id % 3 WHEN 0 THEN concat('row ', doc_id) WHEN 1 THEN '' END AS reason"
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    rows = docs.selectExpr("doc_id AS seq", "text AS source", usage, reason, "CASE WHEN doc_id % 2 = 0 THEN concat(text, ' v', doc_id) END AS target")
    return catalog.import_rows(leased_items(spark, sf_dir), rows, no_quarantine(spark), False, 1000.0)


@query(f"""WITH {ITEMS_SQL}, {LEASED_SQL}, {IMPORT_SQL}
    SELECT id, usage_ AS usage, CASE WHEN changed OR usage_ <> 'pending' THEN reason_ END AS reason, released_ AS released, md5(CASE WHEN released_ AND t IS NOT NULL THEN t ELSE target END) AS target_md5,
           CASE WHEN released_ AND t IS NOT NULL OR (changed AND NOT released_ AND target IS NULL) THEN NULL ELSE worker END AS worker, CASE WHEN released_ AND t IS NOT NULL THEN 1000.0::DOUBLE END AS updated FROM after""")
def import_rows(spark, sf_dir):
    after, _ = import_tables(spark, sf_dir)
    return after.select("id", "usage", "reason", "released", F.md5(F.col("target").cast("binary")).alias("target_md5"), "worker", "updated")


@query(f"""WITH {ITEMS_SQL}, {LEASED_SQL}, {IMPORT_SQL}
    SELECT (SELECT count(*) FROM rows WHERE usage <> '')::BIGINT AS usage_applied, count_if(ok)::BIGINT AS applied, count_if(NOT ok)::BIGINT AS rejected, 0::BIGINT AS unknown FROM judged""")
def import_report(spark, sf_dir):
    return import_tables(spark, sf_dir)[1]


@query(f"""WITH {ITEMS_SQL}, {LEASED_SQL}, t AS (SELECT count_if(usage = 'pending') AS a, count_if(released AND target IS NULL) AS b FROM held),
    c AS (SELECT count(*) AS n FROM (SELECT source, lang, arg_min(lang, doc_id) OVER (PARTITION BY source) AS first FROM documents) WHERE lang <> first),
    d AS (SELECT count(*) AS n FROM documents x LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR l.quality <> 0 OR md5(x.text || l.toxic::VARCHAR) <> md5(x.text))
    SELECT [x FOR x IN [CASE WHEN a > 0 THEN 'pending' END, CASE WHEN b > 0 THEN 'untranslated' END, CASE WHEN c.n > 0 THEN 'conflicts' END, CASE WHEN d.n > 0 THEN 'changed' END] IF x IS NOT NULL] AS problems FROM t, c, d""")
def build_gate(spark, sf_dir):
    """The gate over leased items, conflicts of languages, and the difference of two manifests of the documents."""
    items = leased_items(spark, sf_dir).withColumn("target", F.when(F.col("target").isNotNull(), F.col("source")))
    return quality.gate(items, language_conflicts(spark, sf_dir), manifest_diff(spark, sf_dir))


@query(r"""SELECT page_id, regexp_replace(html, '\[[^\]\n]*\]', '', 'g') = html AS untagged, least(300, 30 * 2 ** least(greatest(page_id % 9 - 1, 0), 4))::INT AS delay,
    NOT (contains(url, ':') OR contains(url, chr(92))) AND len(list_filter(string_split(url, '/'), lambda p: p IN ('', '.', '..'))) = 0 AS safe,
    regexp_full_match(url, '(?s).*\.html') OR regexp_full_match(url, '(?s)[0-9].*') OR regexp_full_match(string_split(url, '/')[-1], '(?s)[0-9].*') AS matched FROM pages""")
def text_functions(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id", (text.strip_tags(F.col("html")) == F.col("html")).alias("untagged"), text.retry_delay((F.col("page_id") % 9).cast("int")).alias("delay"),
        text.is_safe_path(F.col("url")).alias("safe"), text.matches_any(F.col("url"), ["*.html", "[0-9]*"]).alias("matched"),
    )


CANDIDATE_SQL = r"""coalesce(regexp_matches({0}, '[A-Za-z]{{2,}}') AND NOT regexp_matches({0}, '^[A-Za-z_][A-Za-z0-9_.:/-]*$')
      AND NOT regexp_matches({0}, '(?i)^(res|user|uid|https?|file)://|^[\w./\\-]+\.(png|jpg|ogg|wav|mp3|json|tscn|tres|gd|gdc|js|webp|ks|tjs|txt|csv|asset|prefab)$'), false)"""
#: The lines of each text without the characters that mean something in the formats below: (doc_id, k, l).
PLAIN_SQL = r"""plain AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, unnest(range(len(string_split(t, chr(10))))) AS k
      FROM (SELECT doc_id, translate(text, '"\''[]{}【】;*@#' || chr(9) || chr(13), '') AS t FROM documents WHERE text IS NOT NULL))"""


def plain_lines(spark, sf_dir) -> DataFrame:
    """(doc_id, source, lines) of every text, whole, without the characters that mean something in scripts and JSON."""
    plain = F.translate("text", "\"\\'[]{}【】;*@#\t\r", "")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "source", F.split(plain, "\n", -1).alias("lines"))


@query(f"WITH {PLAIN_SQL} SELECT doc_id AS seq, (k + 1)::INT AS line, l AS source FROM plain WHERE {CANDIDATE_SQL.format('trim(l)')}")
def script_strings(spark, sf_dir):
    """Every line of every text as a call with a string in a script."""
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.lit('say("'), x, F.lit("\", 12)"))), "\n")
    return scripts.script_strings(plain_lines(spark, sf_dir).select(F.col("doc_id").alias("seq"), body.alias("text")), "en").select("seq", "line", "source")


@query(f"WITH {PLAIN_SQL} SELECT doc_id AS seq, CASE k % 3 WHEN 0 THEN 'text' ELSE 'title' END AS property, l AS source, 'display' AS hint FROM plain WHERE k % 3 < 2 AND {CANDIDATE_SQL.format('trim(l)')}")
def scene_texts(spark, sf_dir):
    """Every line of every text as a property of a scene, of which a third is not displayed."""
    name = lambda i: F.when(i % 3 == 0, "text").when(i % 3 == 1, "title").otherwise("name")
    body = F.array_join(F.transform("lines", lambda x, i: F.concat(name(i), F.lit(' = "'), x, F.lit('"'))), "\n")
    return scripts.scene_texts(plain_lines(spark, sf_dir).select(F.col("doc_id").alias("seq"), body.alias("text")), "en")


@query(f"""WITH {PLAIN_SQL}, placed AS (SELECT *, (sum(length(l) + 3) OVER (PARTITION BY doc_id ORDER BY k) - length(l) - 2)::INT AS start FROM plain)
    SELECT doc_id AS seq, start, l AS source, 'protected' AS hint FROM placed WHERE length(l) < 200 AND {CANDIDATE_SQL.format('trim(l)')}""")
def plugin_parameters(spark, sf_dir):
    """The lines of every text as a list of parameters; long ones are no parameters that are shown."""
    body = F.concat(F.lit('["'), F.array_join("lines", '","'), F.lit('"]'))
    return scripts.plugin_parameters(plain_lines(spark, sf_dir).select(F.col("doc_id").alias("seq"), body.alias("text")), "en")


@query(f"""WITH {PLAIN_SQL} SELECT doc_id::VARCHAR || ':' || (k + 1) AS ref, trim(l) AS source, 'text' AS context, 'display' AS hint FROM plain WHERE {CANDIDATE_SQL.format('trim(l)')}""")
def scenario_occurrences(spark, sf_dir):
    """Every text as a scenario; the tables have no Japanese, so the language is English."""
    files = plain_lines(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.array_join("lines", "\n").alias("text"))
    return scripts.scenario_occurrences(files, "en").select("ref", "source", "context", "hint")