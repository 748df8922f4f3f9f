"""Searches over events and alerts, row scoping, and paging."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window as W, functions as F

from runtime_insights.functions import timestamps as TS
from runtime_insights.functions.classify import severity
from runtime_insights.operators.skew import is_small

LOG_COLUMNS = (
    "seq", "ts", "rule", "priority", "evt_type", "proc_name",
    "fd_type", "fd_name", "fd_directory",
)


def _matching(
    rows: DataFrame, container: str | None, start: datetime | None,
    end: datetime | None, priority: str | None,
) -> DataFrame:
    """All given conditions, as constants on plain columns: they reach the scan."""
    if container is not None:
        rows = rows.filter(F.col("container_name") == container)
    if start is not None:
        rows = rows.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.filter(F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    if priority is not None:
        rows = rows.filter(F.lower("priority") == priority.lower())
    return rows


def log_search(
    events: DataFrame, container: str | None = None, start: datetime | None = None,
    end: datetime | None = None, limit: int | None = None, priority: str | None = None,
    columns: Sequence[str] = LOG_COLUMNS,
) -> DataFrame:
    """Newest first; with a limit each task keeps only its newest ``limit`` rows."""
    found = _matching(events, container, start, end, priority).select(*columns)
    found = found.orderBy(F.desc("ts"), F.desc("seq"))
    return found if limit is None else found.limit(limit)


def alert_search(
    alerts: DataFrame, container: str | None = None, start: datetime | None = None,
    end: datetime | None = None, priority: str | None = None,
) -> DataFrame:
    return _matching(alerts, container, start, end, priority)


def alert_page(
    alerts: DataFrame, size: int, before: tuple[datetime, int] | None = None
) -> DataFrame:
    """The newest ``size`` alerts of each container older than ``before``, a (ts, seq).

    The rank filter lets Spark cut every task to ``size`` rows per container before
    the shuffle, so a container with most of the alerts stays small.
    """
    if before is not None:
        ts, seq = F.lit(before[0]).cast("timestamp_ntz"), before[1]
        alerts = alerts.filter(
            (F.col("ts") < ts) | ((F.col("ts") == ts) & (F.col("seq") < F.lit(seq)))
        )
    order = W.partitionBy("container_name").orderBy(F.desc("ts"), F.desc("seq"))
    return alerts.withColumn("position", F.row_number().over(order)).filter(
        F.col("position") <= size
    )


def scoped(rows: DataFrame, grants: DataFrame, column: str = "container_name") -> DataFrame:
    """Only rows of granted containers; the grants are reduced to distinct names."""
    names = grants.select(column).distinct()
    # A hot container is no problem for a broadcast; beyond that, adaptive execution
    # splits its partition.
    return rows.join(F.broadcast(names) if is_small(names) else names, column, "left_semi")


def dedupe(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First row by (ts, seq) of each key; of equal ones the one with the smallest content hash.

    The aggregate only holds the order, one fixed-width number, so it is a hash aggregate
    that combines copies before the shuffle; rows then meet the order of their key. Columns
    of any type may come along. Rows that are equal in everything are one.
    """
    content = F.to_json(F.struct(*events.columns))
    order = TS.order_key(
        TS.micros(F.col("ts")), F.col("seq"), F.pmod(F.xxhash64(content), F.lit(TS.MAX_POS + 1))
    )
    marked = events.withColumn("_order", order)
    first = marked.groupBy(*keys).agg(F.min("_order").alias("_first")).select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], "_first"
    )
    same = F.col("_order") == F.col("_first")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return marked.join(first, same).dropDuplicates(list(keys)).select(*events.columns)


def envelope(rows: DataFrame, kind: str, payload: Sequence[str]) -> DataFrame:
    """Stream records: type, ts, container and a JSON payload with the severity tag."""
    body = F.to_json(F.struct(*payload, severity(F.col("priority")).alias("severity")))
    return rows.select(
        F.lit(kind).alias("type"), "ts", F.col("container_name").alias("container"),
        body.alias("payload"), "seq",
    )


def merged_stream(
    events: DataFrame, alerts: DataFrame, event_payload: Sequence[str], alert_payload: Sequence[str]
) -> DataFrame:
    return envelope(events, "event", event_payload).unionByName(
        envelope(alerts, "alert", alert_payload)
    )


def alerts_first(records: DataFrame, width_us: int) -> DataFrame:
    """Order of delivery: by merge window, alerts before events in each, then by time.

    The result is globally sorted; ``batch`` is the start of the merge window.
    """
    batch = TS.from_micros(TS.bucket(TS.micros(F.col("ts")), width_us) * width_us)
    turn = F.when(F.col("type") == "alert", 0).otherwise(1)
    return records.withColumn("batch", batch).withColumn("turn", turn).orderBy(
        "batch", "turn", "ts", "seq"
    )
