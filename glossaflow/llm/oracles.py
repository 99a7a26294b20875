"""The same results in DuckDB's SQL, for the operators that it can express."""

from __future__ import annotations

from . import jaccard_join, phrase_mining, pii, prefix_trie, quality_rules

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
_WORD = r"[^\x20\x09-\x0D]+"

JACCARD_JOIN = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {jaccard_join.SHINGLE - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {jaccard_join.SHINGLE - 1}], ' ') AS s FROM places),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= {jaccard_join.PERCENT} * (nx.n + ny.n - o)),
reach AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT l.y, r.c FROM reach r JOIN links l ON l.x = r.id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM reach GROUP BY 1) r ON r.id = d.doc_id
"""


def _bucket(v: str) -> str:
    power = f"(length(bin({v})) - 4)"
    return f"CASE WHEN {v} < 16 THEN {v} ELSE {power} * 8 + ({v} >> {power}::INT) END"


_FLOOR = "CASE WHEN {0} < 16 THEN {0} ELSE ({0} - ({0} - 8) // 8 * 8) << (({0} - 8) // 8)::INT END"
_RATES = " UNION ALL ".join(
    f"SELECT doc_id, lang, source, '{name}' AS rate, ({a} * 1000 // greatest({b}, 1))::BIGINT AS v, {least} AS least FROM m" for name, a, b, least in quality_rules.RATES
)
QUALITY_RULES = rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
places AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS tri FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS k FROM places) WHERE k > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, (SELECT unnest([0, 1, 2]) AS j) GROUP BY 1),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{_WORD}') GROUP BY 1),
m AS (
  SELECT w.doc_id, w.lang, w.source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_bangs
  FROM w LEFT JOIN lines l USING (doc_id) LEFT JOIN covered c USING (doc_id)),
r AS ({_RATES}),
base AS (SELECT lang, source, rate, least, {_bucket("v")} AS b, count(*) AS n FROM r GROUP BY ALL),
levels AS (
  SELECT 2 AS level, lang, source, rate, least, b, n FROM base
  UNION ALL SELECT 1, lang, NULL, rate, least, b, sum(n) FROM base GROUP BY ALL
  UNION ALL SELECT 0, NULL, NULL, rate, least, b, sum(n) FROM base GROUP BY ALL),
placed AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate) AS every, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY b) AS below FROM levels),
q AS (
  SELECT level, lang, source, rate, least, max(every) AS every, min(CASE WHEN below * 100 >= every * 50 THEN b END) AS b50, min(CASE WHEN below * 100 >= every * 10 THEN b END) AS b10
  FROM placed GROUP BY ALL),
f AS (SELECT level, lang, source, rate, least, every, {_FLOOR.format("b50")} AS mid, {_FLOOR.format("b10")} AS low FROM q),
limits AS (SELECT level, lang, source, rate, every, mid + {quality_rules.SPREAD} * greatest(mid - low, least) AS most FROM f),
verdict AS (
  SELECT r.doc_id, bool_and(r.v <= (a.most * a.every + {quality_rules.PRIOR} * ((b.most * b.every + {quality_rules.PRIOR} * c.most) // (b.every + {quality_rules.PRIOR}))) // (a.every + {quality_rules.PRIOR})) AS fine
  FROM r JOIN limits a ON a.level = 2 AND a.lang IS NOT DISTINCT FROM r.lang AND a.source IS NOT DISTINCT FROM r.source AND a.rate = r.rate
         JOIN limits b ON b.level = 1 AND b.lang IS NOT DISTINCT FROM r.lang AND b.rate = r.rate
         JOIN limits c ON c.level = 0 AND c.rate = r.rate
  GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND fine AS kept
FROM (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS failed FROM m) JOIN verdict USING (doc_id)
"""

_PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    r"[0-9](?:[\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = (
    f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN substr({_DIGITS}, i::BIGINT, 1)::INT "
    f"ELSE (substr({_DIGITS}, i::BIGINT, 1)::INT * 2) // 10 + (substr({_DIGITS}, i::BIGINT, 1)::INT * 2) % 10 END)) % 10 = 0"
)
_VALID = (
    "true",
    "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0",
    f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}",
    f"length({_DIGITS}) BETWEEN 9 AND 15",
)
_TERM_WORD = r"[\p{L}\p{N}_''-]+"


def _located(pattern: str, source: str) -> str:
    """(doc_id, s, e, v) of the matches of a pattern in source (doc_id, t)."""
    split = f"(SELECT doc_id, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS m FROM {source})"
    rows = f"(SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, unnest(g[1:len(m)]) AS gap, unnest(m) AS v FROM {split} WHERE len(m) > 0)"
    end = "sum(length(gap) + length(v)) OVER (PARTITION BY doc_id ORDER BY i)"
    return f"(SELECT doc_id, {end} - length(v) AS s, {end} AS e, v FROM {rows})"


_BASE = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, s, e, v FROM {_located(p, 't')} WHERE {_VALID[k]}" for k, p in enumerate(_PATTERNS))
_NAMES = "['email', 'ip', 'card', 'phone', 'term'][k + 1]"
_SIDES = f"list_transform(list_filter(list_distinct(list_concat(l, r)), lambda x: length(x) >= {pii.LEAST_LETTERS}), lambda x: x)"
PII = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_BASE}),
sides AS (
  SELECT k::VARCHAR || ':' || v AS entity,
         list_reverse(regexp_extract_all(substr(t, 1, s::BIGINT), '{_TERM_WORD}'))[1:{pii.CONTEXT}] AS lw,
         regexp_extract_all(substr(t, e::BIGINT + 1), '{_TERM_WORD}')[1:{pii.CONTEXT}] AS rw
  FROM base JOIN t USING (doc_id)),
near AS (
  SELECT DISTINCT entity, array_to_string(lw, chr(10)) || chr(10) || chr(10) || array_to_string(rw, chr(10)) AS context,
         translate(unnest(list_concat(lw, rw)), '{_UPPER}', '{_LOWER}') AS term FROM sides),
long AS (SELECT * FROM near WHERE length(term) >= {pii.LEAST_LETTERS}),
beside AS (SELECT term, max(n) AS together FROM (SELECT entity, term, count(*) AS n FROM long GROUP BY 1, 2 HAVING count(*) >= {pii.SUPPORT}) GROUP BY 1),
spread AS (SELECT term, count(DISTINCT context) AS contexts FROM long GROUP BY 1),
likely AS (SELECT term, together FROM beside JOIN spread USING (term) WHERE 2 * together >= contexts),
held AS (SELECT DISTINCT doc_id, t, term FROM (SELECT doc_id, t, unnest(regexp_extract_all(translate(t, '{_UPPER}', '{_LOWER}'), '{_TERM_WORD}')) AS term FROM t) JOIN likely USING (term)),
terms AS (SELECT term FROM (SELECT term, count(DISTINCT t) AS n FROM held GROUP BY 1) JOIN likely USING (term) WHERE 2 * together >= n),
marked AS (SELECT * FROM t WHERE doc_id IN (SELECT doc_id FROM held JOIN terms USING (term))),
extra AS (
  SELECT doc_id, 4 AS k, s, e, v FROM {_located(_TERM_WORD, "marked")} x
  WHERE translate(v, '{_UPPER}', '{_LOWER}') IN (SELECT term FROM terms)
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.s < x.e AND x.s < b.e)),
every AS (SELECT doc_id, k, s, e FROM base UNION ALL SELECT doc_id, k, s, e FROM extra),
told AS (
  SELECT doc_id, string_agg({_NAMES} || ':' || s::VARCHAR || ':' || e::VARCHAR, ',' ORDER BY s, k) AS spans,
         string_agg({_NAMES} || ':' || s::VARCHAR || ':' || e::VARCHAR, ',' ORDER BY s, k) FILTER (k < 4) AS base,
         count_if(k = 0) AS n0, count_if(k = 1) AS n1, count_if(k = 2) AS n2, count_if(k = 3) AS n3
  FROM every GROUP BY 1)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_email, coalesce(n1, 0)::BIGINT AS n_ip, coalesce(n2, 0)::BIGINT AS n_card, coalesce(n3, 0)::BIGINT AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN told USING (doc_id)
"""

PHRASE_MINING = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
runs AS (
  SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase FROM (
    SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS size) WHERE len(ws) >= size)),
f AS (SELECT lang, size, phrase, count(*) AS n FROM runs GROUP BY ALL),
every AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY 1),
c AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND n >= {phrase_mining.LEAST_COUNT}),
cuts AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS lft, array_to_string(ws[k + 1:], ' ') AS rgt FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
scores AS (
  SELECT cuts.lang, cuts.phrase, a, k, x.n AS l, y.n AS r, (1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lft JOIN f y ON y.lang = cuts.lang AND y.phrase = rgt),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE size = 3),
longer AS (SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < {phrase_mining.PERCENT} * lowest.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, every.n AS n, score::BIGINT AS score
FROM kept JOIN every USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {phrase_mining.MOST_PHRASES}
"""

# the CRC-32 of a decimal id: each byte is XORed in, then eight shifts follow
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
    "lambda crc, b: CASE WHEN b >= 0 THEN xor(crc, b) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END))"
)
PREFIX_TRIE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC} % {prefix_trie.HEADS} AS h, conv_id - conv_id % {prefix_trie.FAMILY} AS base FROM (SELECT DISTINCT conv_id FROM t)),
n AS (SELECT conv_id AS base, count(*) AS n FROM t GROUP BY 1),
p AS (SELECT conv_id, h, base, least(h, coalesce(n, 0)) AS took FROM c LEFT JOIN n USING (base)),
r AS (
  SELECT p.conv_id, t.i AS depth, role, text FROM p JOIN t ON t.conv_id = p.base AND t.i <= p.h
  UNION ALL SELECT p.conv_id, p.took + t.i - p.h, role, text FROM p JOIN t ON t.conv_id = p.conv_id AND t.i > p.h),
paths AS (
  SELECT conv_id, depth, length(text) AS chars, string_agg(length(role) || ':' || role || length(text) || ':' || text, ';' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS node FROM r),
steps AS (
  SELECT conv_id, 0 AS depth, 0 AS chars, '' AS node FROM c UNION ALL SELECT conv_id, depth, chars, node FROM paths),
linked AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM steps),
nodes AS (
  SELECT node, any_value(depth) AS depth, any_value(parent) AS parent, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM linked GROUP BY 1),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
full_ AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
below AS (SELECT DISTINCT a.node AS top, b.node FROM steps a JOIN steps b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
sums AS (SELECT top AS node, count_if(n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved FROM below JOIN full_ USING (node) GROUP BY 1)
SELECT f.conv_id, f.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, f.ends_sha256
FROM full_ f JOIN sums USING (node) LEFT JOIN nodes up ON up.node = f.parent
"""
