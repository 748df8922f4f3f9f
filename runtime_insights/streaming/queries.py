"""Continuous counters, rates, de-duplication, envelopes and drop alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from runtime_insights import schema as S
from runtime_insights.functions import fields as X
from runtime_insights.operators.counters import last_event
from runtime_insights.operators.search import alerts_first, envelope
from runtime_insights.operators.sessions import admit
from runtime_insights.sources.lines import is_json

WATERMARK = "2 minutes"


def clocked(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Events with a watermarked ``event_time``; rows later than that are dropped."""
    return events.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark(
        "event_time", watermark
    )


# ------------------------------------------------------------ counters and rates

def running_counters(events: DataFrame, labels: Sequence[str] = S.EVENT_LABELS) -> DataFrame:
    """Write in update mode; state is one number per series."""
    return events.groupBy(*labels).agg(F.count(F.lit(1)).cast("double").alias("value"))


def running_last_event(events: DataFrame) -> DataFrame:
    """Seconds of the event written last; update mode."""
    return last_event(events)


def sliding_rates(
    events: DataFrame, by: Sequence[str], window: str = "5 minutes", slide: str = "1 minute",
    watermark: str = WATERMARK,
) -> DataFrame:
    """Rate per second in sliding windows, taken as (start, end] by a shift of 1 µs."""
    shifted = (F.col("event_time") - F.expr("INTERVAL '0.000001' SECOND")).alias("event_time")
    rows = clocked(events, watermark).select(*by, shifted)
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return (
        rows.groupBy(F.window("event_time", window, slide).alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select("w", *by, (F.col("n") / seconds).alias("value"))
    )


def dedupe_stream(events: DataFrame, keys: Sequence[str], watermark: str = WATERMARK) -> DataFrame:
    """First copy of each key; copies may come up to the watermark apart."""
    return clocked(events, watermark).dropDuplicatesWithinWatermark(list(keys))


def alert_context_stream(alerts: DataFrame, events: DataFrame, width: str = "1 minute") -> DataFrame:
    """Events near an alert of the same container; both sides' state is bounded by time."""
    a = clocked(alerts).select(
        F.col("container_name").alias("alert_container"), F.col("seq").alias("alert_seq"),
        F.col("event_time").alias("alert_time"),
    )
    e = clocked(events)
    near = (
        (F.col("container_name") == F.col("alert_container"))
        & (F.col("event_time") >= F.expr(f"alert_time - INTERVAL {width}"))
        & (F.col("event_time") <= F.expr(f"alert_time + INTERVAL {width}"))
    )
    return e.join(a, near)


# --------------------------------------------------------------- ingest statistics

def observed(lines: DataFrame, name: str = "ingest") -> DataFrame:
    """Count lines and JSON errors on the way, without a second pass."""
    full = ~X.is_blank(F.col("raw"))
    return lines.observe(
        name, F.count_if(full).alias("lines_processed"),
        F.count_if(full & ~is_json(F.col("raw"))).alias("json_errors"),
    )


class IngestListener(StreamingQueryListener):
    """Sums of the observed counts, and the source's backlog where it reports one."""

    def __init__(self, name: str = "ingest"):
        self.name = name
        self.stats = {"lines_processed": 0, "json_errors": 0, "queue_size": 0}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.stats["lines_processed"] += row["lines_processed"]
            self.stats["json_errors"] += row["json_errors"]
        for source in event.progress.sources:
            behind = source.metrics.get("numFilesOutstanding") or source.metrics.get(
                "maxOffsetsBehindLatest")
            if behind is not None:
                self.stats["queue_size"] = int(behind)

    def onQueryTerminated(self, event) -> None:
        pass


# ----------------------------------------------------------------------- envelopes

def write_envelopes(
    events: DataFrame, payload: Sequence[str], path: str, checkpoint: str,
    alerts_of: Callable[[DataFrame], DataFrame], alert_payload: Sequence[str],
    merge_ms: int = S.MERGE_WINDOW_MS, once: bool = False,
) -> StreamingQuery:
    """Records of events and their alerts, merged per trigger, alerts first.

    Each batch has its own folder and overwrites it, so a repeated batch writes the same.
    """
    def deliver(batch: DataFrame, batch_id: int) -> None:
        records = envelope(batch, "event", payload).unionByName(
            envelope(alerts_of(batch), "alert", alert_payload)
        )
        alerts_first(records, merge_ms * 1000).write.mode("overwrite").parquet(
            f"{path}/batch={batch_id}"
        )

    writer = events.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{merge_ms} milliseconds").start()


# --------------------------------------------------------------------- drop alerts

class TokenBucket(StatefulProcessor):
    """Lets a host's windows through at a bounded rate; the state is two numbers.

    Credit is in seconds of waiting, a message costs ``1 / rate`` of them.
    """

    def __init__(self, per_second: float, burst: int):
        self.per_second, self.burst = per_second, burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "credit double, last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cost = round(1 / self.per_second, 9)
        full = self.burst * cost
        credit, last = self.state.get() if self.state.exists() else (full, None)
        batch = pd.concat(list(rows)).sort_values("window_start")
        times = [t.timestamp() for t in batch["window_start"]]
        sent, credit, last = admit(times, cost, full, credit, last)
        self.state.update((credit, last))
        yield batch[sent]

    def close(self) -> None:
        pass


def drop_alert_stream(
    events: DataFrame, dropped: Column, host: str, window: str = "1 second",
    threshold: float = S.DROP_THRESHOLD, per_second: float = S.DROP_RATE_PER_SECOND,
    burst: int = S.DROP_MAX_BURST, watermark: str = WATERMARK,
) -> DataFrame:
    """Windows over the drop threshold, rate limited per host; append mode.

    Events are counted per host and window first, so the keyed state sees one row per
    host and window however many events a host sends. Needs the RocksDB state store.
    """
    ratios = (
        clocked(events, watermark)
        .groupBy(F.col(host).alias("host"), F.window("event_time", window).alias("w"))
        .agg(F.count_if(dropped).alias("dropped"), F.count(F.lit(1)).alias("total"))
        .withColumn("ratio", F.col("dropped") / F.col("total"))
        .filter(F.col("ratio") > threshold)
        .select("host", F.col("w.start").alias("window_start"), "dropped", "total", "ratio")
    )
    return ratios.groupBy("host").transformWithStateInPandas(
        TokenBucket(per_second, burst),
        "host string, window_start timestamp, dropped bigint, total bigint, ratio double",
        "append", "none",
    )
