"""The ``events`` table seen as runtime-security events."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runtime_insights.functions.classify import lookup, profile_category
from runtime_insights.operators.alert_store import AlertStore
from runtime_insights.session import apply_settings, materialize, work_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return apply_settings(spark).read.parquet(f"{folder}/{name}.parquet")


# The system call depends on the kind of event and on k modulo 4.
_CALLS = {
    "click": ("execve", "clone", "execve", "clone"),
    "signup": ("prctl",) * 4,
    "purchase": ("connect", "shutdown", "connect", "shutdown"),
    "view": ("openat", "close", "openat", "close"),
    "error": ("fork", "bind", "read", "mmap"),
}
_RULES = {"click": "process", "signup": "PROC", "purchase": "net", "view": "file", "error": "custom"}
_FILE_EVENT = "(event_type = 'view' OR (event_type = 'error' AND k % 4 = 2))"


def runtime_events(spark: SparkSession, folder: str) -> DataFrame:
    """Flat events; only the columns a query uses are read and computed."""
    events = table(spark, folder, "events")
    by_case = {f"{kind}{i}": call for kind, four in _CALLS.items() for i, call in enumerate(four)}
    return (
        events.withColumn("k", F.expr("CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"))
        .withColumn("rule", lookup(_RULES, F.col("event_type")))
        .withColumn("evt_type", lookup(by_case, F.expr("concat(event_type, k % 4)")))
        .selectExpr(
            "event_id AS seq", "ts", "k", "value",
            "concat('c', user_id % 10) AS container_name",
            "concat('p', user_id div 10 % 5) AS proc_name",
            "rule", "evt_type",
            "CASE WHEN value >= 100 THEN 'Critical' WHEN value >= 35 THEN 'Warning' "
            "ELSE 'Debug' END AS priority",
            "'syscall' AS source",
            "concat('run --a', k % 20, ' -b', k % 3) AS cmdline",
            "CASE event_type WHEN 'view' THEN 'file' WHEN 'purchase' THEN 'ipv4' "
            "WHEN 'error' THEN if(k % 4 = 2, 'file', 'ipv4') ELSE '' END AS fd_type",
            "CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 17 = 0 THEN '' "
            "WHEN k % 13 = 0 THEN '0.0.0.0:80' "
            "ELSE concat('10.0.0.1:5000->10.0.0.', k % 10, ':443') END "
            f"WHEN {_FILE_EVENT} THEN concat('/d', k % 4, '/f', k % 25) ELSE '' END AS fd_name",
            f"if({_FILE_EVENT}, concat('/d', k % 4), '') AS fd_directory",
        )
        .withColumn("category", profile_category(F.col("rule"), F.col("evt_type")))
    )


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(
    spark: SparkSession, folder: str, name: str, build: Callable[[SparkSession, str], DataFrame]
) -> DataFrame:
    """A result table that other queries read, such as the alerts.

    It is written once per session and state of the input: files that were added, removed
    or changed give a new table. ``forget`` drops all.
    """
    key = (spark.sparkContext.applicationId, _state(spark, folder), name)
    if key not in _STORED:
        _STORED[key] = materialize(build(spark, folder), name)
    return _STORED[key]


def forget() -> None:
    _STORED.clear()


def kept_alerts(
    spark: SparkSession, folder: str, detect: Callable[[SparkSession, str], DataFrame], again: bool = False
) -> AlertStore:
    """The kept alerts of the input as it is now. Upkeep, detection and a batch, is only done if that
    is new, or ``again``; ``forget`` does not drop them."""
    state = hashlib.sha256(_state(spark, folder).encode()).hexdigest()[:24]
    store = AlertStore(spark, f"{work_dir(spark)}/alert-store-{spark.sparkContext.applicationId}-{state}")
    if again or not store.exists():
        store.append(0, detect(spark, folder))
    return store


def _state(spark: SparkSession, folder: str) -> str:
    """The files of the events table with sizes and times of change."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/events.parquet")
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return ",".join(sorted(
        f"{s.getPath()}:{s.getLen()}:{s.getModificationTime()}" for s in files.listStatus(place)
    ))


def field_map() -> Column:
    """The events' ``output_fields``; some keys are missing or null, depending on k."""
    k = F.col("k")
    every = F.create_map(*[x for name, value in {
        "evt.num": F.col("seq"),
        "evt.type": F.col("evt_type"),
        "container.name": F.col("container_name"),
        "container.image.repository": F.concat(F.lit("img"), k % 3),
        "proc.name": F.col("proc_name"),
        "proc.cmdline": F.when(k != 95, F.col("cmdline")),
        "fd.type": F.when(k != 96, F.col("fd_type")),
        "fd.name": F.when(
            (k == 97) & (F.col("fd_name") != ""), F.concat("fd_name", F.lit("->x->y"))
        ).otherwise(F.col("fd_name")),
        "fd.directory": F.col("fd_directory"),
        "k8s.ns.name": F.when(k % 5 == 1, "").when(k % 5 > 1, F.concat(F.lit("ns"), k % 3)),
        "k8s.pod.name": F.lit(None),
    }.items() for x in (F.lit(name), value.cast("string"))])
    missing = F.when(k % 7 == 0, F.array(F.lit("container.image.repository"))).otherwise(
        F.array(F.lit("k8s.pod.name"))
    )
    return F.map_filter(every, lambda key, _: ~F.array_contains(missing, key))


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The events as JSON log lines, every kind of malformed line among them."""
    k = F.col("k")
    keep_nulls = {"ignoreNullFields": "false"}
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    envelope = F.struct(
        F.lit("h1").alias("hostname"),
        F.when(k != 98, F.col("fields")).alias("output_fields"),
        "priority",
        F.when(k != 94, F.col("rule")).alias("rule"),
        "source",
        F.array(F.lit("t1"), F.concat(F.lit("t"), (k % 3).cast("string"))).alias("tags"),
        iso.alias("time"),
    )
    flat = F.map_concat(F.col("fields"), F.create_map(F.lit("rule"), F.col("rule")))
    raw = (
        F.when(k == 90, "  \t")
        .when(k == 91, F.concat(F.lit('{"rule": "cut at '), F.col("seq")))
        .when(k == 92, "[1,2]")
        .when(k == 93, "{}")
        .when(k == 99, F.to_json(flat, keep_nulls))
        .otherwise(F.to_json(envelope, keep_nulls))
    )
    return runtime_events(spark, folder).withColumn("fields", field_map()).select(
        "seq", "ts", F.col("ts").cast("timestamp").alias("ingest_ts"),
        F.explode(F.array(raw)).alias("raw"),
    )


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The log lines as a stored table, as a log would be."""
    return stored(spark, folder, "lines", raw_lines)
