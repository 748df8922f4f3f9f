"""Counters, gauges, samples, rates and rankings."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from runtime_insights import schema as S
from runtime_insights.functions.classify import metrics_category
from runtime_insights.operators import counters as K, rates as Q
from runtime_insights.plans.base import register
from runtime_insights.plans.ingest_queries import METRIC_CATEGORY
from runtime_insights.plans.runtime_events import log_lines, runtime_events
from runtime_insights.plans.twins import RT_EVENTS, with_tables
from runtime_insights.sources import lines as L

HOUR, DAY = 3_600_000_000, 86_400_000_000


def counted(spark, folder):
    """Log lines with the eight counter labels."""
    parsed = L.parse_lines(log_lines(spark, folder))
    return K.labelled(parsed.drop("category", "reason"), F.col("ts").cast("timestamp"))


def categorized(spark, folder):
    """Flat events with the counter's category label."""
    events = runtime_events(spark, folder)
    return events.withColumn("rule_category", metrics_category(F.col("rule"), F.col("evt_type")))


# Without output_fields every label but rule and priority is the default.
_LABELLED = f"""
labelled AS (
  SELECT seq, ts,
    CASE k WHEN 94 THEN 'None' ELSE rule END AS rule,
    CASE k WHEN 99 THEN 'unknown' ELSE priority END AS priority,
    CASE k WHEN 99 THEN 'unknown' ELSE container_name END AS container_name,
    CASE WHEN k = 99 OR k % 7 = 0 THEN 'unknown' ELSE 'img' || (k % 3) END AS image_repository,
    CASE k WHEN 99 THEN 'unknown' ELSE proc_name END AS process_name,
    CASE WHEN k = 99 OR k % 5 <= 1 THEN 'none' ELSE 'ns' || (k % 3) END AS k8s_namespace,
    'none' AS k8s_pod,
    CASE WHEN k = 99 AND rule = 'custom' THEN 'unknown'
         WHEN k = 94 THEN CASE WHEN evt_type IN ('execve', 'clone', 'fork') THEN 'process'
              WHEN evt_type IN ('connect', 'bind') THEN 'network'
              WHEN evt_type IN ('openat', 'close', 'read') THEN 'file' ELSE 'unknown' END
         ELSE {METRIC_CATEGORY} END AS rule_category
  FROM rt WHERE k NOT BETWEEN 90 AND 93 AND k <> 98),
counters AS (
  SELECT rule, priority, container_name, image_repository, process_name, k8s_namespace, k8s_pod,
         rule_category, CAST(count(*) AS DOUBLE) AS value
  FROM labelled GROUP BY ALL)"""
_CAT = f"cat AS (SELECT *, {METRIC_CATEGORY} AS rule_category FROM rt)"
_AT = "moment AS (SELECT max(ts) AS t FROM rt)"


def _counters(spark, folder):
    return K.event_counters(counted(spark, folder))


@register("event_counters", with_tables(RT_EVENTS, _LABELLED, select="SELECT * FROM counters"))
def event_counters(spark, folder):
    return _counters(spark, folder)


@register("last_event_ts", with_tables(RT_EVENTS, _LABELLED, select="""
SELECT container_name, CAST(epoch_us(arg_max(ts, (ts, seq))) // 1000000 AS DOUBLE) AS value
FROM labelled GROUP BY 1"""))
def last_event_ts(spark, folder):
    return K.last_event(counted(spark, folder))


@register("latest_event", with_tables(RT_EVENTS, _LABELLED, select="""
SELECT max(CAST(epoch_us(ts) // 1000000 AS DOUBLE)) AS value FROM labelled"""))
def latest_event(spark, folder):
    return K.last_event(counted(spark, folder)).agg(F.max("value").alias("value"))


@register("metrics_exposition", with_tables(RT_EVENTS, _LABELLED, select="""
SELECT 'syscall_events_total{rule="' || rule || '",priority="' || priority ||
  '",container_name="' || container_name || '",image_repository="' || image_repository ||
  '",process_name="' || process_name || '",k8s_namespace="' || k8s_namespace ||
  '",k8s_pod="' || k8s_pod || '",rule_category="' || rule_category || '"} ' ||
  CAST(CAST(value AS BIGINT) AS VARCHAR) || '.0' AS line FROM counters
UNION ALL SELECT unnest(['# HELP syscall_events_total Total number of syscall events observed.',
  '# TYPE syscall_events_total counter'])"""))
def metrics_exposition(spark, folder):
    head = K.exposition_head(spark, S.EVENTS_TOTAL, S.EVENTS_TOTAL_HELP, "counter")
    return head.union(K.exposition(_counters(spark, folder), S.EVENTS_TOTAL, S.EVENT_LABELS))


@register("label_whitelist", with_tables(RT_EVENTS, _LABELLED, select="""
SELECT rule_category, CASE WHEN process_name IN ('p0', 'p1') THEN process_name ELSE 'other' END
  AS process_name, sum(value) AS value FROM counters GROUP BY ALL"""))
def label_whitelist(spark, folder):
    keep = {"rule_category": None, "process_name": ["p0", "p1"]}
    return K.whitelist(_counters(spark, folder), keep)


@register("label_cardinality", with_tables(RT_EVENTS, _LABELLED, select="""
SELECT label, count(DISTINCT v) AS cardinality, count(DISTINCT v) > 6 AS high
FROM (UNPIVOT (SELECT * EXCLUDE value FROM counters) ON * INTO NAME label VALUE v)
GROUP BY label"""))
def label_cardinality(spark, folder):
    return K.label_cardinality(_counters(spark, folder), 6)


# DuckDB's // rounds towards zero, so the step is taken from positive numbers.
_SAMPLES = """
stepped AS (
  SELECT container_name, rule, (epoch_us(ts) + 3599999999) // 3600000000 AS step FROM rt),
grown AS (SELECT container_name, rule, {epoch} AS epoch, step, count(*) AS n FROM stepped GROUP BY ALL),
grid AS (
  SELECT container_name, rule, epoch,
    unnest(range(min(step), least((SELECT max(step) FROM stepped), {end}) + 1)) AS step
  FROM grown GROUP BY container_name, rule, epoch),
samples AS (
  SELECT container_name, rule, step, CAST(sum(coalesce(n, 0)) OVER (
      PARTITION BY container_name, rule, epoch ORDER BY step) AS DOUBLE) AS value
  FROM grid LEFT JOIN grown USING (container_name, rule, epoch, step))"""


def _bounds(events):
    """Times of the first and last event: one scan of one column."""
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    return first or datetime(1970, 1, 1), last or datetime(1970, 1, 1)


@register("metric_samples", with_tables(RT_EVENTS, _SAMPLES, select="""
SELECT container_name, rule, make_timestamp(step * 3600000000) AS ts, value FROM samples""",
    epoch="0", end="(SELECT max(step) FROM stepped)"))
def metric_samples(spark, folder):
    events = runtime_events(spark, folder)
    return K.counter_samples(events, ["container_name", "rule"], HOUR, bounds=_bounds(events))


@register("counter_rate", with_tables(RT_EVENTS, _SAMPLES, """
deltas AS (
  SELECT container_name, rule, step, value, lag(value) OVER (
    PARTITION BY container_name, rule ORDER BY step) AS p FROM samples)""", select="""
SELECT container_name, rule, make_timestamp(((step * 3600000000 + 86399999999) // 86400000000)
    * 86400000000) AS window_end,
  sum(CASE WHEN p IS NULL OR value < p THEN value ELSE value - p END) AS increase,
  sum(CASE WHEN p IS NULL OR value < p THEN value ELSE value - p END) / 86400 AS rate
FROM deltas GROUP BY 1, 2, 3""", epoch="((step * 3600000000 - 1) // (5 * 86400000000))",
    end="(epoch + 1) * (5 * 24)"))
def counter_rate(spark, folder):
    """Counters that restart every five days."""
    labels = ["container_name", "rule"]
    events = runtime_events(spark, folder)
    first, last = _bounds(events)
    samples = K.counter_samples(events, labels, HOUR, 5 * DAY, (first, last))
    # The last sample is taken at the end of its step.
    return K.counter_increase(samples, labels, DAY, (first, last + timedelta(hours=1)))


# ------------------------------------------------------------------------ rates

def _recent(by: str, days: str = "1") -> str:
    group = f"GROUP BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    return with_tables(RT_EVENTS, _CAT, _AT, select=f"""
SELECT {keys}CAST(count(*) AS DOUBLE) / (86400.0 * {days}) AS value
FROM cat, moment WHERE ts > t - INTERVAL {days} DAY AND ts <= t {group}""")


def _register_rate(name: str, by: list[str]) -> None:
    @register(name, _recent(", ".join(by)))
    def query(spark, folder):
        events = categorized(spark, folder)
        return Q.rate(events, by, Q.latest(events), timedelta(days=1))


for _name, _by in {
    "rate_total": [], "rate_by_priority": ["priority"], "rate_by_category": ["rule_category"],
    "rate_by_rule": ["rule"], "rate_by_rule_priority": ["rule", "priority"],
    "rate_by_container": ["container_name"],
}.items():
    _register_rate(_name, _by)


@register("rate_5m", with_tables(RT_EVENTS, _CAT, _AT, select="""
SELECT rule, CAST(count(*) AS DOUBLE) / 300.0 AS value
FROM cat, moment WHERE ts > t - INTERVAL 5 MINUTE AND ts <= t GROUP BY rule"""))
def rate_5m(spark, folder):
    events = runtime_events(spark, folder)
    return Q.rate(events, ["rule"], Q.latest(events), timedelta(minutes=5))


@register("increase_1h", with_tables(RT_EVENTS, _AT, select="""
SELECT container_name, CAST(count(*) AS DOUBLE) AS value FROM rt, moment
WHERE priority = 'Critical' AND ts > t - INTERVAL 1 HOUR AND ts <= t GROUP BY 1"""))
def increase_1h(spark, folder):
    events = runtime_events(spark, folder)
    at = Q.latest(events)
    critical = events.filter(F.col("priority") == "Critical")
    return Q.increase(critical, ["container_name"], at, timedelta(hours=1))


@register("rate_panels", with_tables(RT_EVENTS, _CAT, _AT, select="""
SELECT concat_ws(',', CASE WHEN grouping(priority) = 0 THEN 'priority' END,
    CASE WHEN grouping(rule) = 0 THEN 'rule' END,
    CASE WHEN grouping(rule_category) = 0 THEN 'rule_category' END) AS panel,
  priority, rule, rule_category, CAST(count(*) AS DOUBLE) / 86400.0 AS value
FROM cat, moment WHERE ts > t - INTERVAL 1 DAY AND ts <= t
GROUP BY GROUPING SETS ((), (priority), (rule_category), (rule), (rule, priority))"""))
def rate_panels(spark, folder):
    events = categorized(spark, folder)
    return Q.rates_by(events, Q.PANELS, Q.latest(events), timedelta(days=1))


@register("top_rules", with_tables(RT_EVENTS, _AT, select="""
SELECT rule, CAST(count(*) AS DOUBLE) / 86400.0 AS value
FROM rt, moment WHERE ts > t - INTERVAL 1 DAY AND ts <= t GROUP BY rule
ORDER BY value DESC, rule LIMIT 10"""))
def top_rules(spark, folder):
    events = runtime_events(spark, folder)
    return Q.top(Q.rate(events, ["rule"], Q.latest(events), timedelta(days=1)), 10, "rule")


@register("rate_range", with_tables(RT_EVENTS, """
stepped AS (SELECT rule, (epoch_us(ts) + 3599999999) // 3600000000 AS s, count(*) AS n
            FROM rt GROUP BY ALL),
bounds AS (SELECT min(s) AS lo, max(s) + 5 AS hi FROM stepped),
grid AS (SELECT rule, unnest(range(lo, hi + 1)) AS g FROM (SELECT DISTINCT rule FROM stepped), bounds)
""", select="""
SELECT grid.rule, make_timestamp(g * 3600000000) AS ts, coalesce(sum(n), 0) / 21600.0 AS value
FROM grid LEFT JOIN stepped ON stepped.rule = grid.rule AND s BETWEEN g - 5 AND g
GROUP BY grid.rule, g"""))
def rate_range(spark, folder):
    return Q.rate_range(runtime_events(spark, folder), ["rule"], 6 * HOUR, HOUR, zero_fill=True)


@register("rate_10s", with_tables(RT_EVENTS, select="""
SELECT container_name, make_timestamp(epoch_us(ts) // 10000000 * 10000000) AS window_start,
  count(*) / 10.0 AS value FROM rt GROUP BY ALL"""))
def rate_10s(spark, folder):
    return Q.windowed_rate(runtime_events(spark, folder), ["container_name"], 10_000_000)


@register("rule_counts_hourly", with_tables(RT_EVENTS, select="""
SELECT rule, date_trunc('hour', ts) AS window_start, count(*) AS n FROM rt GROUP BY ALL"""))
def rule_counts_hourly(spark, folder):
    return Q.windowed_counts(runtime_events(spark, folder), ["rule"], HOUR)


@register("downsample", with_tables(RT_EVENTS, select="""
SELECT container_name, make_timestamp(epoch_us(ts) // 900000000 * 900000000) AS window_start,
  count(*) AS n, max(ts) AS last_ts FROM rt GROUP BY 1, 2"""))
def downsample(spark, folder):
    minutes = Q.minute_table(runtime_events(spark, folder), ["container_name"])
    return Q.downsample(minutes, ["container_name"], 900_000_000)


@register("container_list", with_tables(RT_EVENTS, _AT, select="""
SELECT container_name,
  CAST(nullif(count(*) FILTER (ts > t - INTERVAL 1 HOUR), 0) AS DOUBLE) / 3600.0 AS rate,
  max(ts) AS last_event
FROM rt, moment GROUP BY container_name"""))
def container_list(spark, folder):
    events = runtime_events(spark, folder)
    return Q.container_list(events, Q.latest(events), timedelta(hours=1))
