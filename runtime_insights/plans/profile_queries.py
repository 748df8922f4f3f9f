"""Behaviour profiles, detection, and what is asked about alerts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from runtime_insights.functions.classify import metrics_category
from runtime_insights.operators import (
    counters as K, detect as D, profile as P, rates as Q, search, sessions, snapshot,
)
from runtime_insights.operators.paths import known
from runtime_insights.plans.base import register
from runtime_insights.plans.ingest_queries import METRIC_CATEGORY
from runtime_insights.plans.runtime_events import kept_alerts, runtime_events, stored, table
from runtime_insights.plans.twins import ALERTS, CUT, LEARNED, NODES, PATHS, RT_EVENTS, with_tables
from runtime_insights.session import materialize

# The data are sparse, so a container counts as quiet after six hours.
GAP_MS = 6 * 3_600_000
LEARNING = P.Learning(quiet_gap_ms=GAP_MS, warmup_ms=0)
BEFORE = datetime(2024, 1, 20)


def _twin(*parts: str, select: str) -> str:
    return with_tables(RT_EVENTS, PATHS, CUT, *parts, select=select, gap=GAP_MS, warmup=0)


def _rollup(events):
    return materialize(P.path_rollup(events, GAP_MS), "path-rollup")


def _cuts(spark, folder):
    return P.learning_cut(runtime_events(spark, folder), LEARNING)


def _learned(spark, folder):
    """Events up to the stored end of learning."""
    cuts = stored(spark, folder, "cuts", _cuts)
    return P.learned_events(runtime_events(spark, folder), cuts)


def _find_nodes(spark, folder):
    return P.profile_nodes(_learned(spark, folder))


def _nodes(spark, folder):
    """The stored node table, as snapshot readers use it."""
    return stored(spark, folder, "nodes", _find_nodes)


def _find_alerts(spark, folder):
    return D.detect_alerts(runtime_events(spark, folder), LEARNING)


def _alerts(spark, folder):
    """The stored alert table, as searches and statistics use it."""
    return stored(spark, folder, "alerts", _find_alerts)


@register("learning_cut", _twin(select="""
SELECT container_name, start_ts, c[1] AS cut_ts, c[2] AS cut_seq FROM cut"""))
def learning_cut(spark, folder):
    return P.describe_cut(_cuts(spark, folder))


@register("learning_cut_warmup", with_tables(RT_EVENTS, PATHS, CUT, select="""
SELECT container_name, start_ts, c[1] AS cut_ts, c[2] AS cut_seq FROM cut""",
    gap=3 * 3_600_000, warmup=5 * 86_400_000))
def learning_cut_warmup(spark, folder):
    learning = P.Learning(quiet_gap_ms=3 * 3_600_000, warmup_ms=5 * 86_400_000)
    return P.describe_cut(P.learning_cut(runtime_events(spark, folder), learning))


@register("phase_events", _twin(select="""
SELECT l.container_name, seq, CASE WHEN (l.ts, l.seq) > c THEN 'detect' ELSE 'learn' END AS phase
FROM listed l JOIN cut USING (container_name)"""))
def phase_events(spark, folder):
    events = runtime_events(spark, folder)
    phased = P.with_phase(events, stored(spark, folder, "cuts", _cuts))
    return phased.select("container_name", "seq", "phase")


@register("first_seen", _twin(select="""
SELECT container_name, branch, 2 AS level, evt_type, NULL AS proc_name, NULL AS attr,
  f[2] AS first_seq, f[1] AS first_ts FROM first_op
UNION ALL SELECT container_name, branch, 3, evt_type, proc_name, NULL, f[2], f[1] FROM first_proc
UNION ALL SELECT container_name, branch, 4, evt_type, proc_name, attr, f[2], f[1] FROM first_leaf"""))
def first_seen(spark, folder):
    return P.first_seen(runtime_events(spark, folder))


@register("novelty_rate", _twin("""
keys AS (SELECT container_name, f FROM first_op UNION ALL SELECT container_name, f FROM first_proc
  UNION ALL SELECT container_name, f FROM first_leaf),
per_ms AS (SELECT container_name, epoch_us(f[1]) // 1000 AS ts_ms, count(*) AS new_nodes
  FROM keys JOIN cut USING (container_name) WHERE c IS NULL OR f <= c GROUP BY ALL)""", select="""
SELECT container_name, ts_ms, new_nodes, CAST(sum(new_nodes) OVER (PARTITION BY container_name
  ORDER BY ts_ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS BIGINT) AS novelty_count
FROM per_ms"""))
def novelty_rate(spark, folder):
    events = runtime_events(spark, folder)
    rollup = _rollup(events)
    return P.novelty_rate(rollup, P.learning_cut(events, LEARNING, rollup), 3_600_000)


@register("learning_notices", _twin("""
keys AS (
  SELECT container_name, branch, 2 AS level, evt_type AS new_key, f FROM first_op
  UNION ALL SELECT container_name, branch, 3, proc_name, f FROM first_proc
  UNION ALL SELECT container_name, branch, 4, attr, f FROM first_leaf)""", select="""
SELECT k.container_name, branch, level, new_key, f[2] AS seq, f[1] AS ts
FROM keys k JOIN cut USING (container_name)
WHERE (branch = 'process' OR level = 4) AND (c IS NULL OR f <= c)"""))
def learning_notices(spark, folder):
    events = runtime_events(spark, folder)
    rollup = _rollup(events)
    return P.learning_notices(rollup, P.learning_cut(events, LEARNING, rollup))


# -------------------------------------------------------------------------- tree

@register("hbt_nodes", _twin(LEARNED, NODES, select="""
SELECT container_name, CAST(level AS INTEGER) AS level, branch, evt_type, proc_name, attr,
  node_type, events_count, CAST(subtree_events AS BIGINT) AS subtree_events,
  f[2] AS first_seq, f[1] AS first_seen, last_updated
FROM nodes"""))
def hbt_nodes(spark, folder):
    return _find_nodes(spark, folder).drop("metadata", "first_pos")


@register("hbt_lookup", _twin(LEARNED, NODES, select="""
SELECT container_name, CAST(level AS INTEGER) AS level, branch, evt_type, proc_name, attr,
  node_type, events_count FROM nodes WHERE container_name = 'c3'"""))
def hbt_lookup(spark, folder):
    nodes = _nodes(spark, folder).filter(F.col("container_name") == "c3")
    return nodes.select(
        "container_name", "level", "branch", "evt_type", "proc_name", "attr",
        "node_type", "events_count",
    )


@register("hbt_leaf_counts", _twin(LEARNED, select="""
SELECT container_name, branch, evt_type, proc_name, attr, count(*) AS events_count
FROM learned_leaves GROUP BY ALL"""))
def hbt_leaf_counts(spark, folder):
    return P.leaf_counts(_learned(spark, folder))


@register("hbt_rollup", _twin(LEARNED, select="""
SELECT container_name, branch, evt_type, proc_name, CAST(0 AS BIGINT) AS events_count,
  CAST(sum(n) AS BIGINT) AS subtree_events, count(*) AS events
FROM (SELECT container_name, category AS branch, evt_type, proc_name, len(attrs) AS n FROM learned)
GROUP BY GROUPING SETS ((container_name, branch, evt_type, proc_name),
  (container_name, branch, evt_type), (container_name, branch))"""))
def hbt_rollup(spark, folder):
    return P.rollup_counts(_learned(spark, folder))


@register("hbt_statistics", _twin(LEARNED, select="""
SELECT container_name AS container_id, count(*) AS total_events,
  count(*) FILTER (category = 'process') AS process_events,
  count(*) FILTER (category = 'network') AS network_events,
  count(*) FILTER (category = 'file') AS file_events
FROM learned GROUP BY 1"""))
def hbt_statistics(spark, folder):
    return P.statistics(_learned(spark, folder))


@register("hbt_listing", _twin(LEARNED, NODES, select="""
SELECT container_name, CAST(level AS INTEGER) AS level, repeat('  ', level) ||
  CASE level WHEN 0 THEN 'root' WHEN 1 THEN branch || '_branch' WHEN 2 THEN evt_type
    WHEN 3 THEN proc_name ELSE attr END || ' (' || node_type || ')' ||
  CASE WHEN events_count > 0 THEN ' (' || events_count || ' events)' ELSE '' END AS line
FROM nodes"""))
def hbt_listing(spark, folder):
    return snapshot.listing(_nodes(spark, folder)).select("container_name", "level", "line")


_LEAF_DOC = """
leaf_doc AS (
  SELECT container_name, branch, evt_type, proc_name, string_agg('"' || attr ||
    '":{"name":"' || attr || '","type":"' || node_type || '","events_count":' || events_count ||
    ',"metadata":{},"children":{}}', ',' ORDER BY fp) AS body
  FROM leaf_nodes GROUP BY ALL),
proc_doc AS (
  SELECT p.container_name, p.branch, p.evt_type, p.f, '"' || p.proc_name || '":{"name":"' ||
    p.proc_name || '","type":"process_name","events_count":0,"metadata":{},"children":{' ||
    coalesce(body, '') || '}}' AS body
  FROM proc_nodes p LEFT JOIN leaf_doc USING (container_name, branch, evt_type, proc_name)),
op_doc AS (
  SELECT container_name, branch, min(f) AS f, '"' || evt_type || '":{"name":"' || evt_type ||
    '","type":"' || branch || '_operation","events_count":0,"metadata":{},"children":{' ||
    string_agg(body, ',' ORDER BY f) || '}}' AS body
  FROM proc_doc GROUP BY container_name, branch, evt_type),
branch_doc AS (
  SELECT container_name, branch, string_agg(body, ',' ORDER BY f) AS body
  FROM op_doc GROUP BY ALL),
three AS (
  SELECT container_name, b, pos, '"' || b || '_branch":{"name":"' || b ||
    '_branch","type":"branch","events_count":0,"metadata":{},"children":{' ||
    coalesce(body, '') || '}}' AS body
  FROM (SELECT DISTINCT container_name FROM branch_doc) CROSS JOIN
       (VALUES ('process', 1), ('network', 2), ('file', 3)) v(b, pos)
  LEFT JOIN branch_doc USING (container_name) WHERE branch = b
  UNION ALL
  SELECT container_name, b, pos, '"' || b || '_branch":{"name":"' || b ||
    '_branch","type":"branch","events_count":0,"metadata":{},"children":{}}'
  FROM (SELECT DISTINCT container_name FROM branch_doc) d CROSS JOIN
       (VALUES ('process', 1), ('network', 2), ('file', 3)) v(b, pos)
  WHERE NOT EXISTS (SELECT 1 FROM branch_doc x WHERE x.container_name = d.container_name
                    AND x.branch = b))"""


@register("hbt_snapshot", _twin(LEARNED, NODES, _LEAF_DOC, select="""
SELECT container_name, CAST(0 AS INTEGER) AS part, '{"container_id":"' || container_name ||
  '","hbt_structure":{"name":"root","type":"root","events_count":0,"metadata":{},"children":{' ||
  string_agg(body, ',' ORDER BY pos) || '}}}' AS document
FROM three GROUP BY container_name"""))
def hbt_snapshot(spark, folder):
    return snapshot.documents(_learned(spark, folder))


@register("hbt_rebuild", _twin(LEARNED, NODES, select="""
SELECT container_name, CAST(level AS INTEGER) AS level, branch, evt_type, proc_name, attr,
  node_type, events_count FROM nodes"""))
def hbt_rebuild(spark, folder):
    """Snapshot documents in parts, written as JSON, read back as a node table."""
    documents = materialize(snapshot.documents(_learned(spark, folder), 8), "snapshot")
    return snapshot.rebuild(documents)


@register("profile_diff", with_tables(RT_EVENTS, PATHS, """
keyed AS (
  SELECT container_name, branch, ts < TIMESTAMP '2024-01-16' AS early, '4' AS level, evt_type,
    proc_name, attr, 1 AS n FROM leaf_rows
  UNION ALL SELECT container_name, category, ts < TIMESTAMP '2024-01-16', '3', evt_type, proc_name, '', 0 FROM listed
  UNION ALL SELECT container_name, category, ts < TIMESTAMP '2024-01-16', '2', evt_type, '', '', 0 FROM listed),
both_sides AS (
  SELECT container_name, level, branch, evt_type, proc_name, attr,
    CAST(sum(n) FILTER (early) AS BIGINT) AS count_before,
    CAST(sum(n) FILTER (NOT early) AS BIGINT) AS count_after
  FROM keyed GROUP BY ALL)""", select="""
SELECT *, CASE WHEN count_before IS NULL THEN 'added' WHEN count_after IS NULL THEN 'removed'
  ELSE 'changed' END AS change
FROM both_sides WHERE count_before IS DISTINCT FROM count_after"""))
def profile_diff(spark, folder):
    events = runtime_events(spark, folder)
    middle = F.lit(datetime(2024, 1, 16)).cast("timestamp_ntz")
    before = P.profile_nodes(events.filter(F.col("ts") < middle))
    after = P.profile_nodes(events.filter(F.col("ts") >= middle))
    return D.profile_diff(before, after)


# -------------------------------------------------------------------- detection

@register("detect_alerts", _twin(ALERTS, select="SELECT * FROM alerts"))
def detect_alerts(spark, folder):
    return _find_alerts(spark, folder)


def _register_branch(branch: str) -> None:
    @register(f"detect_{branch}", _twin(ALERTS, select=f"""
SELECT * FROM alerts WHERE branch = '{branch}'"""))
    def query(spark, folder):
        return D.detect_alerts(runtime_events(spark, folder), LEARNING, branch)


for _branch in ("process", "network", "file"):
    _register_branch(_branch)


@register("detect_stored_profile", with_tables(RT_EVENTS, PATHS, """
old AS (SELECT * FROM listed WHERE ts < TIMESTAMP '2024-01-03'),
old_leaves AS (SELECT DISTINCT container_name, branch, evt_type, proc_name, attr FROM leaf_rows
  WHERE ts < TIMESTAMP '2024-01-03'),
misses AS (
  SELECT r.container_name, r.seq, min((r.pos, r.attr)) AS h
  FROM leaf_rows r ANTI JOIN old_leaves USING (container_name, branch, evt_type, proc_name, attr)
  GROUP BY ALL),
judged AS (
  SELECT l.*, h, EXISTS (SELECT 1 FROM old o WHERE o.container_name = l.container_name
      AND o.category = l.category AND o.evt_type = l.evt_type) AS has_op,
    EXISTS (SELECT 1 FROM old o WHERE o.container_name = l.container_name
      AND o.category = l.category AND o.evt_type = l.evt_type AND o.proc_name = l.proc_name)
      AS has_proc
  FROM listed l LEFT JOIN misses m ON m.container_name = l.container_name AND m.seq = l.seq
  WHERE l.ts >= TIMESTAMP '2024-01-03')""", select="""
SELECT container_name, seq, CAST(CASE WHEN NOT has_op THEN 1 WHEN NOT has_proc THEN 2 ELSE 3 END
    AS INTEGER) AS level,
  CASE WHEN NOT has_op THEN evt_type WHEN NOT has_proc THEN proc_name ELSE h[2] END AS missing_key
FROM judged WHERE NOT has_op OR NOT has_proc OR h IS NOT NULL"""))
def detect_stored_profile(spark, folder):
    """A profile of the first two days, kept as a node table, judges all later events."""
    events = runtime_events(spark, folder)
    start = F.lit(datetime(2024, 1, 3)).cast("timestamp_ntz")
    nodes = materialize(P.profile_nodes(events.filter(F.col("ts") < start)), "profile")
    alerts = D.detect_against(events.filter(F.col("ts") >= start), D.profile_paths(nodes))
    return alerts.select("container_name", "seq", "level", "missing_key")


@register("phase_metrics", _twin(ALERTS, select="""
SELECT l.container_name, CASE WHEN max(c) IS NULL THEN 'learn' ELSE 'detect' END AS phase,
  count(*) FILTER (c IS NULL OR (l.ts, l.seq) <= c) AS learn_events,
  count(*) FILTER ((l.ts, l.seq) > c) AS detect_events,
  count(*) / 86400.0 / 30 AS event_rate,
  (SELECT count(*) FROM alerts a WHERE a.container_name = l.container_name) AS anomalies
FROM listed l JOIN cut USING (container_name) GROUP BY l.container_name"""))
def phase_metrics(spark, folder):
    events = runtime_events(spark, folder)
    phased = P.with_phase(events, stored(spark, folder, "cuts", _cuts))
    return D.phase_metrics(phased, _alerts(spark, folder), timedelta(days=30))


@register("alert_counters", _twin(ALERTS, select="""
SELECT container_name, rule, priority, source, CAST(count(*) AS DOUBLE) AS value
FROM alerts GROUP BY ALL"""))
def alert_counters(spark, folder):
    return K.alert_counters(_alerts(spark, folder))


@register("alert_rate", _twin(ALERTS, """
moment AS (SELECT max(ts) AS t FROM rt)""", select="""
SELECT rule, priority, CAST(count(*) AS DOUBLE) / 604800.0 AS value FROM alerts, moment
WHERE container_name = 'c3' AND ts > t - INTERVAL 7 DAY AND ts <= t GROUP BY ALL"""))
def alert_rate(spark, folder):
    """Alert rate of one container by rule and priority."""
    alerts = search.alert_search(_alerts(spark, folder), "c3")
    at = Q.latest(runtime_events(spark, folder))
    return Q.rate(alerts, ["rule", "priority"], at, timedelta(days=7))


@register("container_rate", with_tables(RT_EVENTS, """
moment AS (SELECT max(ts) AS t FROM rt)""", select="""
SELECT CAST(count(*) AS DOUBLE) / 86400.0 AS value FROM rt, moment
WHERE container_name = 'c3' AND ts > t - INTERVAL 1 DAY AND ts <= t"""))
def container_rate(spark, folder):
    events = runtime_events(spark, folder)
    one = events.filter(F.col("container_name") == "c3")
    return Q.rate(one, [], Q.latest(events), timedelta(days=1))


def _kept(spark, folder):
    """The kept alert table that searches, pages and the overview read."""
    return kept_alerts(spark, folder, _find_alerts)


@register("alert_upkeep", _twin(ALERTS, select="""
SELECT container_name, CAST(ts AS DATE) AS day, count(*) AS n FROM alerts GROUP BY ALL"""))
def alert_upkeep(spark, folder):
    """Detects, keeps the alerts, and says how many there are by day."""
    return kept_alerts(spark, folder, _find_alerts, again=True).counts()


@register("alert_search", _twin(ALERTS, select="""
SELECT container_name, seq, ts, branch, level, missing_key FROM alerts
WHERE container_name = 'c3' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'
  AND priority = 'Warning'"""))
def alert_search(spark, folder):
    found = _kept(spark, folder).search("c3", datetime(2024, 1, 5), datetime(2024, 1, 25), "warning")
    return found.select("container_name", "seq", "ts", "branch", "level", "missing_key")


@register("alert_page", _twin(ALERTS, """
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY container_name ORDER BY ts DESC, seq DESC)
  AS INTEGER) AS position FROM alerts WHERE (ts, seq) < (TIMESTAMP '2024-01-20', 0))""", select="""
SELECT container_name, position, seq, ts, missing_key FROM ranked WHERE position <= 5"""))
def alert_page(spark, folder):
    page = _kept(spark, folder).page(5, (BEFORE, 0))
    return page.select("container_name", "position", "seq", "ts", "missing_key")


@register("top_alerts", _twin(ALERTS, """
counts AS (SELECT rule, date_trunc('day', ts) AS window_start, count(*) AS n FROM alerts GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY window_start ORDER BY n DESC, rule)
  AS INTEGER) AS rank FROM counts)""", select="SELECT * FROM ranked WHERE rank <= 3"))
def top_alerts(spark, folder):
    counts = Q.windowed_counts(_alerts(spark, folder), ["rule"], 86_400_000_000)
    return Q.top_per_window(counts, 3, "rule")


@register("alert_context", _twin(ALERTS, select="""
SELECT a.container_name, a.seq AS alert_seq, r.seq, r.ts, r.rule, r.priority, r.evt_type,
  r.proc_name, epoch_us(r.ts) - epoch_us(a.ts) AS offset_us
FROM alerts a JOIN rt r ON r.container_name = a.container_name
  AND epoch_us(r.ts) BETWEEN epoch_us(a.ts) - 600000000 AND epoch_us(a.ts) + 600000000"""))
def alert_context(spark, folder):
    return D.alert_context(_alerts(spark, folder), runtime_events(spark, folder), 600_000)


@register("overview", _twin(ALERTS, f"""
cat AS (SELECT *, {METRIC_CATEGORY} AS rule_category FROM rt),
moment AS (SELECT max(ts) AS t FROM rt),
now AS (SELECT cat.* FROM cat, moment WHERE ts > t - INTERVAL 1 DAY AND ts <= t)""", select="""
SELECT 'total_rate' AS section, 'all' AS key, count(*) / 86400.0 AS value FROM now
UNION ALL SELECT 'priority', priority, count(*) / 86400.0 FROM now GROUP BY priority
UNION ALL SELECT 'rule_category', rule_category, count(*) / 86400.0 FROM now GROUP BY rule_category
UNION ALL (SELECT 'top_rules', rule, count(*) / 86400.0 AS v FROM now GROUP BY rule
           ORDER BY v DESC, rule LIMIT 10)
UNION ALL SELECT 'alerts_today', 'all', CAST(count(*) AS DOUBLE) FROM alerts, moment
  WHERE date_trunc('day', ts) = date_trunc('day', t)"""))
def overview(spark, folder):
    events = runtime_events(spark, folder).withColumn(
        "rule_category", metrics_category(F.col("rule"), F.col("evt_type"))
    )
    at = Q.latest(events)
    return Q.overview(events, _kept(spark, folder).day_count(at), at, timedelta(days=1))


# ------------------------------------------------------------- search and scope

@register("log_search", with_tables(RT_EVENTS, select="""
SELECT seq, ts, rule, priority, evt_type, proc_name, fd_type, fd_name, fd_directory FROM rt
WHERE container_name = 'c1' AND priority = 'Debug' AND ts >= TIMESTAMP '2024-01-05'
  AND ts < TIMESTAMP '2024-01-15' ORDER BY ts DESC, seq DESC LIMIT 100"""))
def log_search(spark, folder):
    return search.log_search(
        runtime_events(spark, folder), "c1", datetime(2024, 1, 5), datetime(2024, 1, 15),
        100, "debug",
    )


@register("scoped_events", with_tables(RT_EVENTS, select="""
SELECT seq, container_name, rule FROM rt WHERE container_name IN
  (SELECT 'c' || (n_nationkey % 10) FROM nation WHERE n_regionkey = 1)"""))
def scoped_events(spark, folder):
    grants = table(spark, folder, "nation").filter("n_regionkey = 1").select(
        F.concat(F.lit("c"), (F.col("n_nationkey") % 10).cast("string")).alias("container_name")
    )
    return search.scoped(runtime_events(spark, folder), grants).select("seq", "container_name", "rule")


@register("dedupe_events", with_tables(RT_EVENTS, select="""
SELECT container_name, k, min((ts, seq))[1] AS ts, min((ts, seq))[2] AS seq FROM rt GROUP BY 1, 2"""))
def dedupe_events(spark, folder):
    """Copies share container and number ``k``."""
    events = runtime_events(spark, folder).select("container_name", "k", "ts", "seq", "rule")
    return search.dedupe(events, ["container_name", "k"]).drop("rule")


_HITS = """
hits AS (SELECT container_name, epoch_us(ts) AS us FROM rt WHERE priority = 'Critical'),
gaps AS (SELECT *, us - lag(us) OVER (PARTITION BY container_name ORDER BY us) AS gap FROM hits),
runs AS (SELECT *, sum(CASE WHEN gap <= 1800000000 THEN 0 ELSE 1 END) OVER (
  PARTITION BY container_name ORDER BY us ROWS UNBOUNDED PRECEDING) AS n FROM gaps),
captures AS (SELECT container_name, min(us) AS start_us, max(us) + 1800000000 AS end_us,
  count(*) AS hits FROM runs GROUP BY container_name, n)"""


def _captures(spark, folder):
    hits = runtime_events(spark, folder).filter(F.col("priority") == "Critical")
    return sessions.capture_sessions(hits, 1_800_000)


@register("capture_sessions", with_tables(RT_EVENTS, _HITS, select="SELECT * FROM captures"))
def capture_sessions(spark, folder):
    return _captures(spark, folder)


@register("captured_events", with_tables(RT_EVENTS, _HITS, select="""
SELECT container_name, seq, start_us FROM rt JOIN captures USING (container_name)
WHERE epoch_us(ts) >= start_us AND epoch_us(ts) < end_us"""))
def captured_events(spark, folder):
    found = sessions.captured_events(
        runtime_events(spark, folder), _captures(spark, folder), 1_800_000
    )
    return found.select("container_name", "seq", "start_us")


@register("drop_alerts", with_tables("RECURSIVE " + RT_EVENTS.strip(), """
ratios AS (
  SELECT container_name AS host, epoch_us(ts) // 60000000 AS tick,
    count(*) FILTER (rule = 'custom') AS dropped, count(*) AS total
  FROM rt GROUP BY ALL),
over_limit AS (SELECT *, dropped / total AS ratio FROM ratios WHERE dropped / total > 0.1),
-- A message empties the bucket; the next needs 120 minutes of credit.
sent AS (
  SELECT host, min(tick) AS tick FROM over_limit GROUP BY host
  UNION ALL
  SELECT s.host, min(o.tick) FROM sent s JOIN over_limit o ON o.host = s.host
    AND o.tick >= s.tick + 120 GROUP BY s.host, s.tick)""", select="""
SELECT host, make_timestamp(tick * 60000000) AS window_start, dropped, total, ratio
FROM sent JOIN over_limit USING (host, tick)"""))
def drop_alerts(spark, folder):
    """Error events stand for drops, minutes for seconds."""
    ratios = sessions.drop_ratios(
        runtime_events(spark, folder), F.col("rule") == "custom", "container_name", 60_000_000
    )
    return sessions.drop_alerts(ratios, 60_000_000, rate_per_second=1 / 7200)


_RECORDS = """
records AS (
  SELECT 'event' AS type, ts, container_name AS container, seq,
    '{"rule":"' || rule || '","evt_type":"' || evt_type || '","severity":"' ||
    CASE priority WHEN 'Critical' THEN 'error' WHEN 'Warning' THEN 'warn' ELSE 'info' END || '"}'
    AS payload FROM rt
  UNION ALL
  SELECT 'alert', ts, container_name, seq, '{"level":' || level || ',"missing_key":"' ||
    missing_key || '","severity":"' || CASE priority WHEN 'Critical' THEN 'error'
    WHEN 'Warning' THEN 'warn' ELSE 'info' END || '"}' FROM alerts)"""


def _records(spark, folder):
    events = runtime_events(spark, folder)
    return search.merged_stream(
        events, _alerts(spark, folder), ["rule", "evt_type"], ["level", "missing_key"]
    )


@register("envelope", _twin(ALERTS, _RECORDS, select="SELECT * FROM records"))
def envelope(spark, folder):
    return _records(spark, folder)


@register("envelope_priority", _twin(ALERTS, _RECORDS, select="""
SELECT make_timestamp(epoch_us(ts) // 500000 * 500000) AS batch, type, container, seq,
  CAST(CASE type WHEN 'alert' THEN 0 ELSE 1 END AS INTEGER) AS turn FROM records"""))
def envelope_priority(spark, folder):
    ordered = search.alerts_first(_records(spark, folder), 500_000)
    return ordered.select("batch", "type", "container", "seq", "turn")


@register("detector_quality", _twin(ALERTS, """
j AS (SELECT a.seq IS NOT NULL AS p, l.priority = 'Critical' AS a
  FROM listed l LEFT JOIN alerts a ON a.container_name = l.container_name AND a.seq = l.seq),
c AS (SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp,
  count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM j)""", select="""
SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall,
  2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, fp / nullif(fp + tn, 0) AS false_positive_rate
FROM c"""))
def detector_quality(spark, folder):
    """Alerts judged against a label of the events: critical ones should alert."""
    events = known(runtime_events(spark, folder)).select("container_name", "seq", "priority")
    alerts = _alerts(spark, folder).select("container_name", "seq", F.lit(True).alias("alerted"))
    judged = events.join(alerts, ["container_name", "seq"], "left")
    return D.detector_quality(judged, F.col("alerted").isNotNull(), F.col("priority") == "Critical")


@register("detect_ties", with_tables(RT_EVENTS, """
tied AS (SELECT * REPLACE (date_trunc('minute', ts) AS ts) FROM rt)""", PATHS.replace("FROM rt WHERE", "FROM tied WHERE"), """
first_op AS (SELECT container_name, category AS branch, evt_type, min(ts) AS f FROM listed GROUP BY ALL),
first_proc AS (SELECT container_name, category AS branch, evt_type, proc_name, min(ts) AS f
  FROM listed GROUP BY ALL),
first_leaf AS (SELECT container_name, branch, evt_type, proc_name, attr, min(ts) AS f
  FROM leaf_rows GROUP BY ALL),
novel AS (SELECT DISTINCT container_name, f AS ts FROM
  (SELECT container_name, f FROM first_op UNION ALL SELECT container_name, f FROM first_proc
   UNION ALL SELECT container_name, f FROM first_leaf)),
clocked AS (
  SELECT l.container_name, l.ts, NOT (l.category = 'network' AND l.fd_name = '') AS closes,
    epoch_us(l.ts) // 1000 AS ms, max(CASE WHEN n.ts IS NOT NULL THEN epoch_us(l.ts) // 1000 END)
      OVER (PARTITION BY l.container_name ORDER BY l.ts RANGE UNBOUNDED PRECEDING) AS last_ms
  FROM listed l LEFT JOIN novel n ON n.container_name = l.container_name AND n.ts = l.ts),
cut AS (SELECT container_name, min(ts) FILTER (closes AND ms - last_ms > {gap}) AS c
  FROM clocked GROUP BY 1),
leaf_hit AS (
  SELECT r.seq, min((r.pos, r.attr)) AS h FROM leaf_rows r
  JOIN first_leaf fl USING (container_name, branch, evt_type, proc_name, attr)
  JOIN cut USING (container_name) WHERE fl.f > c GROUP BY r.seq)""", select="""
SELECT l.container_name, l.ts, l.category AS branch, l.evt_type, l.proc_name,
  CAST(CASE WHEN o.f > c THEN 1 WHEN p.f > c THEN 2 ELSE 3 END AS INTEGER) AS level,
  CASE WHEN o.f > c THEN l.evt_type WHEN p.f > c THEN l.proc_name ELSE h[2] END AS missing_key
FROM listed l JOIN cut ON cut.container_name = l.container_name
JOIN first_op o ON o.container_name = l.container_name AND o.branch = l.category
  AND o.evt_type = l.evt_type
JOIN first_proc p ON p.container_name = l.container_name AND p.branch = l.category
  AND p.evt_type = l.evt_type AND p.proc_name = l.proc_name
LEFT JOIN leaf_hit h ON h.seq = l.seq
WHERE o.f > c OR p.f > c OR h.h IS NOT NULL""", gap=GAP_MS))
def detect_ties(spark, folder):
    """Events without numbers and with times cut to the minute: each is judged by itself."""
    events = runtime_events(spark, folder).withColumn("seq", F.lit(0).cast("bigint")).withColumn(
        "ts", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    return D.detect_alerts(events, LEARNING).select(
        "container_name", "ts", "branch", "evt_type", "proc_name", "level", "missing_key")
