"""Ingest, classification, rules and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from runtime_insights.functions import classify as C, fields as X, timestamps as TS
from runtime_insights.operators import paths, rules as R
from runtime_insights.plans.base import register
from runtime_insights.plans.runtime_events import field_map, log_lines, runtime_events
from runtime_insights.plans.twins import PATHS, RT_EVENTS, with_tables
from runtime_insights.session import work_dir
from runtime_insights.sources import lines as L

import uuid

_REASON = """
  CASE WHEN k = 91 THEN 'not JSON' WHEN k = 92 THEN 'not an object'
       WHEN k = 94 THEN 'null rule' WHEN k = 98 THEN 'null output_fields'
       WHEN k = 95 AND rule IN ('process', 'PROC') THEN 'null command line'
       WHEN k = 96 AND rule = 'net' AND fd_name <> '' THEN 'null descriptor type'
       WHEN k = 97 AND rule = 'net' AND fd_name <> '' THEN 'two arrows' END"""
_JUDGED = f"judged AS (SELECT *, {_REASON} AS reason FROM rt WHERE k NOT IN (90, 93))"


@register("ingest_rejects", with_tables(RT_EVENTS, _JUDGED, select="""
SELECT seq, reason FROM judged WHERE reason IS NOT NULL"""))
def ingest_rejects(spark, folder):
    parsed = L.parse_lines(log_lines(spark, folder))
    return parsed.filter(F.col("reason").isNotNull()).select("seq", "reason")


@register("ingest_stats", with_tables(RT_EVENTS, select="""
SELECT count(*) FILTER (k <> 90) AS lines_processed, count(*) FILTER (k = 91) AS json_errors
FROM rt"""))
def ingest_stats(spark, folder):
    return L.ingest_stats(log_lines(spark, folder))


_TYPED = with_tables(RT_EVENTS, _JUDGED, select="""
SELECT seq, ts, container_name, rule,
  CASE WHEN k = 99 THEN NULL ELSE priority END AS priority,
  CASE WHEN rule IN ('process', 'PROC') THEN 'process' WHEN rule = 'net' THEN 'network'
       WHEN rule = 'file' THEN 'file' WHEN k = 99 THEN category ELSE 'unknown' END AS category,
  evt_type, proc_name, CASE WHEN k <> 95 THEN cmdline END AS cmdline,
  CASE WHEN k = 96 THEN '' ELSE fd_type END AS fd_type,
  CASE WHEN k = 97 AND fd_name <> '' THEN fd_name || '->x->y' ELSE fd_name END AS fd_name,
  fd_directory, CASE WHEN k <> 99 THEN source END AS source,
  CASE WHEN k <> 99 THEN 'h1' END AS hostname, CASE WHEN k <> 99 THEN 't1,t' || (k % 3) END AS tags,
  CAST(CASE WHEN k = 99 THEN 11 ELSE 10 END AS INTEGER) AS fields
FROM judged WHERE reason IS NULL""")


@register("typed_events", _TYPED)
def typed_events(spark, folder):
    return _plain(L.typed_events(L.parse_lines(log_lines(spark, folder))))


def _plain(events):
    """Tags as text and the number of fields, which both engines can compare."""
    return events.withColumn("tags", F.array_join("tags", ",")).withColumn(
        "fields", F.size("fields"))


@register("read_events_jsonl", _TYPED.replace("SELECT seq, ts,", "SELECT seq,"))
def read_events_jsonl(spark, folder):
    """The same lines written as text files and read back."""
    path = f"{work_dir(spark)}/lines-{uuid.uuid4().hex}"
    log_lines(spark, folder).select("raw").write.text(path)
    events = L.typed_events(L.read_events_file(spark, path, whole_files=False))
    # Lines without a time get that of the file, which SQL cannot know.
    return _plain(events).drop("ts")


@register("parse_event_data", with_tables(RT_EVENTS, select="""
SELECT seq, CASE WHEN k IN (90, 91, 92, 93) THEN NULL WHEN k = 94 THEN NULL ELSE rule END AS rule,
  CAST(CASE WHEN k IN (90, 91, 92, 93) THEN 0
            WHEN k = 99 THEN 11
            ELSE 7 END AS INTEGER) AS keys
FROM rt"""))
def parse_event_data(spark, folder):
    parsed = F.col("parsed")
    rows = log_lines(spark, folder).select(
        "seq", F.explode(F.array(L.parse_event_data(F.col("raw")))).alias("parsed")
    )
    return rows.select(
        "seq", X.field(parsed, "rule").alias("rule"), F.size(parsed).alias("keys")
    )


@register("output_fields", with_tables(RT_EVENTS, select="""
SELECT seq, CASE WHEN k <> 98 THEN container_name END AS container,
  CASE WHEN k = 98 THEN FALSE ELSE k % 7 <> 0 END AS has_image,
  k <> 98 AND k % 7 = 0 AS has_pod
FROM rt WHERE k NOT BETWEEN 90 AND 93"""))
def output_fields(spark, folder):
    inner = F.col("inner")
    return (
        L.parse_lines(log_lines(spark, folder)).filter(F.col("whole").isNotNull())
        .withColumnRenamed("fields", "inner").select(
            "seq", X.field(inner, "container.name").alias("container"),
            X.has_field(inner, "container.image.repository").alias("has_image"),
            X.has_field(inner, "k8s.pod.name").alias("has_pod"),
        )
    )


@register("categorize_parser", with_tables(RT_EVENTS, select="SELECT seq, category FROM rt"))
def categorize_parser(spark, folder):
    return runtime_events(spark, folder).select("seq", "category")


METRIC_CATEGORY = """CASE WHEN category = 'unknown' AND evt_type IN ('listen', 'bind')
  THEN 'network' ELSE category END"""


@register("categorize_exporter", with_tables(RT_EVENTS, select=f"""
SELECT seq, {METRIC_CATEGORY} AS category FROM rt"""))
def categorize_exporter(spark, folder):
    events = runtime_events(spark, folder)
    return events.select(
        "seq", C.metrics_category(F.col("rule"), F.col("evt_type")).alias("category")
    )


@register("priority_threshold", with_tables(RT_EVENTS, select="""
SELECT seq, priority, CAST(CASE priority WHEN 'Critical' THEN 2 ELSE 4 END AS INTEGER) AS rank
FROM rt WHERE priority IN ('Critical', 'Warning')"""))
def priority_threshold(spark, folder):
    events = runtime_events(spark, folder)
    return events.filter(C.at_least(F.col("priority"), "warning")).select(
        "seq", "priority", C.priority_rank(F.col("priority")).alias("rank")
    )


@register("severity", with_tables(RT_EVENTS, select="""
SELECT seq, CASE priority WHEN 'Critical' THEN 'error' WHEN 'Warning' THEN 'warn' ELSE 'info' END
  AS severity FROM rt"""))
def severity(spark, folder):
    return runtime_events(spark, folder).select("seq", C.severity(F.col("priority")).alias("severity"))


def _rules():
    named = F.col("proc_name") != "<NA>"
    return [
        R.Rule("critical", F.col("priority") == "Critical"),
        *R.default_rules(C.metrics_category(F.col("rule"), F.col("evt_type")), F.col("proc_name")),
        R.Rule("p0", (F.col("proc_name") == "p0") & named),
        R.Rule("off", F.lit(True), enabled=False),
    ]


_MATCHES = f"""
hits AS (
  SELECT seq, 0 AS pos, 'critical' AS matched_rule FROM rt WHERE priority = 'Critical'
  UNION ALL
  SELECT seq, 1, CASE c WHEN 'network' THEN 'net' ELSE c END
  FROM (SELECT seq, {METRIC_CATEGORY} AS c FROM rt) WHERE c <> 'unknown'
  UNION ALL
  SELECT seq, 2, 'p0' FROM rt WHERE proc_name = 'p0')"""


@register("rule_match_first", with_tables(RT_EVENTS, _MATCHES, select="""
SELECT seq, arg_min(matched_rule, pos) AS matched_rule FROM hits GROUP BY seq"""))
def rule_match_first(spark, folder):
    return R.match(runtime_events(spark, folder), _rules()).select("seq", "matched_rule")


@register("rule_match_all", with_tables(
    RT_EVENTS, _MATCHES, select="SELECT seq, matched_rule FROM hits"))
def rule_match_all(spark, folder):
    return R.match(runtime_events(spark, folder), _rules(), "all").select("seq", "matched_rule")


_FIELD_SQL = {
    "evt.num": "CAST(seq AS VARCHAR)", "evt.type": "evt_type", "container.id": "NULL",
    "container.name": "container_name",
    "container.image.repository": "CASE WHEN k % 7 <> 0 THEN 'img' || (k % 3) END",
    "proc.name": "proc_name", "proc.cmdline": "CASE WHEN k <> 95 THEN cmdline END",
    "fd.type": "CASE WHEN k <> 96 THEN fd_type END",
    "fd.name": "CASE WHEN k = 97 AND fd_name <> '' THEN fd_name || '->x->y' ELSE fd_name END",
    "fd.directory": "fd_directory",
}


def _output_sql(names) -> str:
    parts = []
    for n in names:
        value = f"coalesce({_FIELD_SQL.get(n, 'NULL')}, '<NA>')"
        parts.append(f"'{n}=[' || {value} || ']'" if n == "evt.args" else f"'{n}=' || {value}")
    return " || ' ' || ".join(parts)


@register("rule_output", with_tables(RT_EVENTS, select=f"""
SELECT seq, CASE category WHEN 'process' THEN {_output_sql(R.S.PROCESS_RULE_FIELDS)}
  WHEN 'network' THEN {_output_sql(R.S.NETWORK_RULE_FIELDS)}
  ELSE {_output_sql(R.S.FILE_RULE_FIELDS)} END AS output
FROM rt WHERE category <> 'unknown'"""))
def rule_output(spark, folder):
    events = runtime_events(spark, folder).withColumn("fields", field_map())
    rules = R.default_rules(F.col("category"), F.col("proc_name"))
    return R.match(events, rules).select(
        "seq", R.rule_output(F.col("fields"), F.col("matched_rule"), rules).alias("output")
    )


def _names_sql(names) -> str:
    present = []
    for n in sorted(set(names) & set(_FIELD_SQL) - {"container.id"}):
        text = f"'{n}'"
        present.append(f"CASE WHEN k % 7 <> 0 THEN {text} END"
                       if n == "container.image.repository" else text)
    return f"concat_ws(',', {', '.join(present)})"


@register("rule_fields", with_tables(RT_EVENTS, select=f"""
SELECT seq, CASE category WHEN 'process' THEN {_names_sql(R.S.PROCESS_RULE_FIELDS)}
  WHEN 'network' THEN {_names_sql(R.S.NETWORK_RULE_FIELDS)}
  ELSE {_names_sql(R.S.FILE_RULE_FIELDS)} END AS names
FROM rt WHERE category <> 'unknown'"""))
def rule_fields(spark, folder):
    events = runtime_events(spark, folder).withColumn("fields", field_map())
    rules = R.default_rules(F.col("category"), F.col("proc_name"))
    kept = R.rule_fields(F.col("fields"), F.col("matched_rule"), rules)
    return R.match(events, rules).select(
        "seq", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("names")
    )


@register("record_properties", with_tables(RT_EVENTS, select=f"""
SELECT seq, 'hostname,priority,rule,source,message,tags' AS properties,
  CASE category WHEN 'process' THEN {_output_sql(R.S.PROCESS_RULE_FIELDS)}
  WHEN 'network' THEN {_output_sql(R.S.NETWORK_RULE_FIELDS)}
  ELSE {_output_sql(R.S.FILE_RULE_FIELDS)} END AS message
FROM rt WHERE category <> 'unknown'"""))
def record_properties(spark, folder):
    """Records with the message switched on and the fields switched off."""
    events = runtime_events(spark, folder).withColumn("fields", field_map()).withColumn(
        "hostname", F.lit("h1")).withColumn("tags", F.array(F.lit("t1")))
    rules = R.default_rules(F.col("category"), F.col("proc_name"))
    records = R.match(events, rules).select(
        "seq", F.explode(F.array(
            R.record(rules, include_message=True, include_fields=False))).alias("record"))
    return records.select(
        "seq", F.array_join(F.json_object_keys("record"), ",").alias("properties"),
        F.get_json_object("record", "$.message").alias("message"),
    )


@register("append_fields", with_tables(RT_EVENTS, select="""
SELECT seq, 'all' AS site,
  CASE WHEN rule = 'net' THEN container_name || '/net' END AS link,
  CASE WHEN k % 3 = 1 AND rule = 'file' THEN 'tagged' END AS mark,
  CASE WHEN rule = 'net' THEN 'changed' ELSE proc_name END AS proc
FROM rt"""))
def append_fields(spark, folder):
    events = runtime_events(spark, folder).withColumn("fields", field_map())
    tags = F.array(F.lit("base"), F.concat(F.lit("t"), (F.col("k") % 3).cast("string")))
    entries = [
        R.Append({"site": F.lit("all")}),
        R.Append({"link": F.concat("container_name", F.lit("/net")),
                  "proc.name": F.lit("changed")}, rule="net", source="syscall"),
        R.Append({"mark": F.lit("tagged")}, rule="file", tags=("base", "t1")),
    ]
    out = R.append_fields(F.col("fields"), F.col("rule"), F.col("source"), tags, entries)
    named = events.select("seq", out.alias("f"))
    return named.select(
        "seq", X.field(F.col("f"), "site").alias("site"), X.field(F.col("f"), "link").alias("link"),
        X.field(F.col("f"), "mark").alias("mark"), X.field(F.col("f"), "proc.name").alias("proc"),
    )


@register("event_ts", with_tables(RT_EVENTS, select="""
SELECT seq,
  CASE k % 5 WHEN 0 THEN epoch_us(ts) // 1000000
             WHEN 1 THEN CAST(trunc(CAST(epoch_us(ts) * 1000 AS DOUBLE) / 1e9) AS BIGINT)
             WHEN 2 THEN CAST(trunc(CAST(epoch_us(ts) AS DOUBLE) / 1e9) AS BIGINT)
             WHEN 3 THEN CAST(trunc(CAST(epoch_us(ts) // 1000000 AS DOUBLE) / 1e6) AS BIGINT)
             ELSE epoch_us(ts) // 1000000 + 3600 END AS reference_seconds,
  CASE k % 5 WHEN 3 THEN make_timestamp(epoch_us(ts) // 1000000 * 1000000)
             WHEN 4 THEN ts + INTERVAL 1 HOUR ELSE ts END AS event_time
FROM rt"""))
def event_ts(spark, folder):
    """ISO text, nanoseconds, microseconds, seconds, or nothing but the ingest time."""
    us, form = TS.micros(F.col("ts")), F.col("k") % 5
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    number = F.when(form == 1, us * 1000).when(form == 2, us).when(form == 3, TS.bucket(us, 1_000_000))
    fields = F.when(form == 0, F.create_map(F.lit("evt.time.iso8601"), iso)).otherwise(
        F.create_map(F.lit("evt.time"), number.cast("string"))
    )
    ingest = F.expr("ts + INTERVAL 1 HOUR").cast("timestamp")
    rows = runtime_events(spark, folder).select(
        "seq", fields.alias("fields"), ingest.alias("ingest")
    )
    return rows.select(
        "seq",
        TS.metric_seconds(F.col("fields"), F.col("ingest")).alias("reference_seconds"),
        TS.event_time(F.lit(None).cast("string"), F.col("fields"), F.col("ingest"))
        .alias("event_time"),
    )


@register("cmd_tokens", with_tables(RT_EVENTS, select=r"""
SELECT seq, unnest(t) AS token, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos
FROM (SELECT seq, regexp_extract_all(cmdline || ' --x-y', '-{1,2}[^\s-]+') AS t FROM rt)"""))
def cmd_tokens(spark, folder):
    tokens = X.command_tokens(F.concat("cmdline", F.lit(" --x-y")))
    return runtime_events(spark, folder).select("seq", F.posexplode(tokens).alias("pos", "token"))


@register("net_attribute", with_tables(RT_EVENTS, select="""
SELECT seq, CASE WHEN fd_name = '' THEN NULL
  WHEN fd_name LIKE '%->%' THEN split_part(fd_name, '->', 2) || ':' || fd_type
  ELSE '::' || fd_type END AS attr
FROM rt WHERE category = 'network'"""))
def net_attribute(spark, folder):
    events = runtime_events(spark, folder).filter(F.col("category") == "network")
    return events.select("seq", X.network_attribute(F.col("fd_name"), F.col("fd_type")).alias("attr"))


@register("file_attributes", with_tables(RT_EVENTS, select="""
SELECT seq, 0 AS pos, fd_directory AS attr, 'directory_path' AS attr_type
FROM rt WHERE fd_directory <> ''
UNION ALL SELECT seq, 1, fd_name, 'file_name' FROM rt WHERE fd_name <> ''"""))
def file_attributes(spark, folder):
    events = runtime_events(spark, folder)
    return events.select(
        "seq", F.inline(X.file_attributes(F.col("fd_directory"), F.col("fd_name")))
    )


@register("event_paths", with_tables(RT_EVENTS, PATHS, select="""
SELECT l.container_name, l.seq, l.ts, l.category AS branch, l.evt_type, l.proc_name,
  CAST(r.pos AS INTEGER) AS pos, r.attr,
  CASE WHEN r.attr IS NULL THEN NULL WHEN l.category = 'process' THEN 'cmd_argument'
       WHEN l.category = 'network' THEN 'network_attribute'
       WHEN r.pos = 0 THEN 'directory_path' ELSE 'file_name' END AS attr_type
FROM listed l LEFT JOIN leaf_rows r ON r.seq = l.seq"""))
def event_paths(spark, folder):
    return paths.event_paths(runtime_events(spark, folder))
