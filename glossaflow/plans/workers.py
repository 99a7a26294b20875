"""Queries of leases and pools by worker: `events` stand for what workers do."""

from __future__ import annotations

from ..session import table
from ..streaming import workers
from .registry import query

AT = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 1e6D AS at"
SIX_HOURS, LATE = 21600.0, 60.0
REACHED = f"(SELECT floor(max(epoch_us(ts)) / 1000 - {LATE} * 1000) AS ms FROM events)"


@query(f"""WITH RECURSIVE ev AS (
      SELECT user_id::VARCHAR AS worker, event_id AS seq, epoch_us(ts) / 1e6 AS tm,
             CASE event_type WHEN 'view' THEN 'claim' WHEN 'signup' THEN 'claim' WHEN 'error' THEN 'release' WHEN 'click' THEN 'submit' ELSE 'other' END AS action,
             CASE WHEN event_type = 'click' THEN ['abc'[event_id % 3 + 1]] ELSE ['a', 'b', 'c'][:event_id % 3 + 1] END AS items,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
      FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    st AS (
      SELECT DISTINCT worker, 0::BIGINT AS n, []::VARCHAR[] AS open, NULL::DOUBLE AS expires, NULL::VARCHAR AS outcome, []::VARCHAR[] AS told, NULL::DOUBLE AS ended, []::VARCHAR[] AS freed FROM ev
      UNION ALL
      SELECT worker, n, CASE outcome WHEN 'granted' THEN items WHEN 'accepted' THEN list_filter(live, lambda x: x <> items[1]) WHEN 'released' THEN [] ELSE live END,
             CASE WHEN outcome IN ('granted', 'kept') OR (outcome = 'accepted' AND len(live) > 1) THEN tm + {SIX_HOURS} WHEN outcome IN ('rejected', 'ignored') AND NOT over THEN expires END,
             outcome, CASE outcome WHEN 'kept' THEN live WHEN 'released' THEN live WHEN 'granted' THEN items WHEN 'accepted' THEN items ELSE [] END,
             CASE WHEN over THEN expires END, CASE WHEN over THEN open ELSE [] END
      FROM (SELECT *, CASE WHEN action = 'claim' AND len(live) > 0 THEN 'kept' WHEN action = 'claim' THEN 'granted' WHEN action = 'submit' AND list_contains(live, items[1]) THEN 'accepted'
                 WHEN action = 'submit' THEN 'rejected' WHEN action = 'release' THEN 'released' ELSE 'ignored' END AS outcome
            FROM (SELECT ev.*, st.open, st.expires, coalesce(st.expires <= ev.tm, false) AS over, CASE WHEN coalesce(st.expires <= ev.tm, false) THEN [] ELSE st.open END AS live
                  FROM st JOIN ev ON ev.worker = st.worker AND ev.n = st.n + 1))),
    told AS (SELECT worker, ended AS tm, freed FROM st WHERE ended IS NOT NULL
      UNION ALL SELECT worker, expires, open FROM (SELECT worker, arg_max(expires, n) AS expires, arg_max(open, n) AS open FROM (SELECT worker, n, coalesce(expires, 'inf'::DOUBLE) AS expires, open FROM st) GROUP BY 1), {REACHED} WHERE ceil(round(expires * 1e6) / 1000) <= ms)
    SELECT worker, seq, tm AS "at", action, outcome, array_to_string(list_sort(told), ',') AS items, len(open)::INT AS n_open, expires FROM st JOIN ev USING (worker, n)
    UNION ALL SELECT worker, NULL, tm, 'expire', 'expired', array_to_string(list_sort(freed), ','), 0, NULL FROM told""")
def worker_leases(spark, sf_dir):
    """Claims of one to three items, submissions of one, releases; leases of six hours, with their ends."""
    action = "CASE event_type WHEN 'view' THEN 'claim' WHEN 'signup' THEN 'claim' WHEN 'error' THEN 'release' WHEN 'click' THEN 'submit' ELSE 'other' END AS action"
    items = "CASE WHEN event_type = 'click' THEN array(substr('abc', cast(event_id % 3 AS INT) + 1, 1)) ELSE slice(array('a', 'b', 'c'), 1, cast(event_id % 3 AS INT) + 1) END AS items"
    return workers.worker_leases(table(spark, sf_dir, "events").selectExpr("cast(user_id AS STRING) AS worker", "event_id AS seq", AT, action, items), SIX_HOURS, LATE)


@query(f"""WITH RECURSIVE raw AS (
      SELECT (user_id % 20)::VARCHAR AS pool, user_id::VARCHAR AS worker, event_id AS seq, epoch_us(ts) / 1e6 AS tm,
             CASE WHEN event_type = 'purchase' AND value > 60 THEN 'pause' WHEN event_type = 'purchase' AND value > 20 THEN 'resume' WHEN event_type = 'error' THEN 'limited' WHEN event_type IN ('view', 'click') THEN 'finish' ELSE 'start' END AS action,
             (event_id % 3 > 0)::INT AS accepted FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    runs AS (SELECT *, sum((action = 'finish' AND accepted > 0)::INT) OVER (PARTITION BY worker ORDER BY tm, seq) AS run FROM raw),
    empty AS (SELECT *, sum((action = 'finish' AND accepted = 0)::INT) OVER (PARTITION BY worker, run ORDER BY tm, seq) AS f FROM runs),
    known AS (SELECT *, coalesce(bool_or(action = 'finish' AND f >= 3) OVER (PARTITION BY worker ORDER BY tm, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AND action NOT IN ('pause', 'resume') AS over,
              coalesce(last_value(CASE action WHEN 'pause' THEN true WHEN 'resume' THEN false END IGNORE NULLS) OVER (PARTITION BY pool ORDER BY tm, seq), false) AS paused,
              row_number() OVER (PARTITION BY pool ORDER BY tm, seq) AS n FROM empty),
    st AS (
      SELECT DISTINCT pool, 0::BIGINT AS n, 0::INT AS streak, 0.0::DOUBLE AS cooldown FROM known
      UNION ALL
      SELECT k.pool, k.n, CASE WHEN k.over THEN st.streak WHEN action = 'limited' THEN st.streak + 1 WHEN action = 'finish' AND k.tm >= st.cooldown THEN 0 ELSE st.streak END,
             CASE WHEN action = 'limited' AND NOT k.over THEN greatest(st.cooldown, k.tm + least(300, 30 * 2 ** least(st.streak, 4))) ELSE st.cooldown END
      FROM st JOIN known k ON k.pool = st.pool AND k.n = st.n + 1),
    j AS (SELECT *, lag(tm) OVER (PARTITION BY worker, action = 'finish' ORDER BY tm, seq) AS earlier, lead(tm) OVER (PARTITION BY worker, action = 'finish' ORDER BY tm, seq) AS later,
              lead(tm) OVER (PARTITION BY pool, action = 'limited' AND NOT over ORDER BY tm, seq) AS next_limit FROM known JOIN st USING (pool, n)),
    waits AS (SELECT worker, tm, seq, tm + 10 AS until, coalesce(later, 'inf'::DOUBLE) AS stale FROM j WHERE action = 'finish' AND NOT over AND f IN (1, 2) AND accepted = 0),
    held AS (SELECT j.*, w.until AS wait FROM j LEFT JOIN waits w ON w.worker = j.worker AND (w.tm, w.seq) < (j.tm, j.seq) AND j.tm < w.until AND j.tm <= w.stale AND j.action IN ('start', 'finish') AND NOT j.over),
    ends AS (SELECT pool, w.worker, until AS tm, 'ready' AS state, f::INT AS failures FROM waits w JOIN j USING (worker, seq) WHERE NOT (stale < until)
      UNION ALL SELECT pool, NULL, cooldown, 'cooldown_over', NULL FROM j WHERE action = 'limited' AND NOT over AND NOT coalesce(next_limit < cooldown, false))
    SELECT pool, worker, seq, tm AS "at",
           CASE WHEN action = 'pause' THEN 'paused' WHEN action = 'resume' THEN 'resumed' WHEN over THEN 'blocked' WHEN action = 'limited' THEN 'rate_limited' WHEN action = 'finish' THEN CASE WHEN f >= 3 THEN 'blocked' ELSE 'batch_finished' END
             WHEN paused THEN 'paused' WHEN cooldown > tm THEN 'global_cooldown' WHEN wait IS NOT NULL THEN 'waiting' ELSE 'running' END AS state,
           CASE WHEN action IN ('pause', 'resume') THEN NULL WHEN over THEN 3 ELSE f END::INT AS failures, streak,
           CASE WHEN over OR action IN ('pause', 'resume') THEN NULL WHEN action = 'limited' THEN cooldown WHEN action = 'finish' THEN CASE WHEN accepted = 0 AND f < 3 THEN tm + 10 END
             WHEN paused THEN NULL WHEN cooldown > tm THEN cooldown ELSE wait END AS until FROM held
    UNION ALL SELECT e.pool, e.worker, NULL, e.tm, state, failures, (SELECT arg_max(streak, n) FROM j WHERE j.pool = e.pool AND j.tm < e.tm), NULL FROM ends e, {REACHED} WHERE ceil(round(e.tm * 1e6) / 1000) <= ms""")
def worker_pools(spark, sf_dir):
    """Twenty pools of workers that start, finish (a third of the runs empty), meet rate limits and are paused."""
    action = "CASE WHEN event_type = 'purchase' AND value > 60 THEN 'pause' WHEN event_type = 'purchase' AND value > 20 THEN 'resume' WHEN event_type = 'error' THEN 'limited' WHEN event_type IN ('view', 'click') THEN 'finish' ELSE 'start' END AS action"
    events = table(spark, sf_dir, "events").selectExpr("cast(user_id % 20 AS STRING) AS pool", "cast(user_id AS STRING) AS worker", "event_id AS seq", AT, action, "cast(event_id % 3 > 0 AS INT) AS accepted")
    return workers.worker_pools(events, LATE)
