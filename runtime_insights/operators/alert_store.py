"""A kept table of alerts, so that searching and paging do not detect again.

Alerts are appended in numbered batches. Each batch is a folder of its own, partitioned by day and
sorted by container and time within its files, so a search lists only its days and skips by the
footers' minima what is not its container. Beside them a small table counts the alerts of each day and container, which tells a
page how far back it has to read. Writing a batch again replaces it: a rerun or a stream's retry changes nothing.

    store = AlertStore(spark, "/shared/alerts")
    store.append(7, detect_alerts(events))
    store.search(container="web", start=..., end=...)
    store.page(50, before=(last_ts, last_seq))
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from runtime_insights.operators import search
from runtime_insights.operators.skew import BROADCAST_BYTES, BROADCAST_ROWS

COLUMNS = (
    "container_name string, seq bigint, ts timestamp_ntz, branch string, evt_type string, proc_name string, "
    "rule string, priority string, source string, level int, missing_key string, phase string"
)
COUNTS = "container_name string, day date, n bigint, batch bigint"


class AlertStore:
    """Alerts under ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, batch: int, alerts: DataFrame) -> None:
        """Write a batch; the same number again replaces it."""
        names = [part.split()[0] for part in COLUMNS.split(", ")]
        folder = f"{self.path}/alerts/batch={int(batch)}"
        # Ranges of (day, container, time): a day or container with most alerts is many files.
        dated = alerts.select(*names, F.to_date("ts").alias("day"))
        keys = ("day", "container_name", "ts", "seq")
        dated.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("day").parquet(folder)
        written = self.spark.read.schema(f"{COLUMNS}, day date").parquet(folder)
        written.groupBy("container_name", "day").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode(
            "overwrite").parquet(f"{self.path}/counts/batch={int(batch)}")

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch`` of a stream of alerts."""
        return lambda alerts, batch: self.append(batch, alerts)

    def exists(self) -> bool:
        """Whether a batch has been written whole."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/counts")
        files = place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return files.exists(place)

    def alerts(self) -> DataFrame:
        """All kept alerts, with ``day``."""
        return self.spark.read.schema(f"{COLUMNS}, batch bigint, day date").parquet(f"{self.path}/alerts").drop("batch")

    def counts(self) -> DataFrame:
        """Alerts by ``container_name`` and ``day``."""
        table = self.spark.read.schema(COUNTS).parquet(f"{self.path}/counts")
        return table.groupBy("container_name", "day").agg(F.sum("n").alias("n"))

    def search(
        self, container: str | None = None, start: datetime | None = None, end: datetime | None = None,
        priority: str | None = None,
    ) -> DataFrame:
        """Alerts with start <= ts < end; the days outside are not listed."""
        alerts = self.alerts()
        if start is not None:
            alerts = alerts.filter(F.col("day") >= F.lit(start.date()))
        if end is not None:
            alerts = alerts.filter(F.col("day") <= F.lit(end.date()))
        return search.alert_search(alerts, container, start, end, priority).drop("day")

    def page(self, size: int, before: tuple[datetime, int] | None = None, container: str | None = None) -> DataFrame:
        """The newest ``size`` alerts of each container older than ``before``, with their ``position``.

        Only the days that can hold them are read: per container those back to the one with which the
        days wholly before ``before`` have ``size`` alerts.
        """
        counts = self.spark.read.schema(COUNTS).parquet(f"{self.path}/counts")
        alerts = self.alerts()
        if container is not None:
            counts, alerts = (x.filter(F.col("container_name") == container) for x in (counts, alerts))
        if before is not None:
            counts, alerts = (x.filter(F.col("day") <= F.lit(before[0].date())) for x in (counts, alerts))
            # The day of ``before`` may have any part of its alerts on the page.
            counted = F.when(F.col("day") < F.lit(before[0].date()), F.col("n")).otherwise(0)
        else:
            counted = F.col("n")
        # All batches' alerts of later days.
        later = W.partitionBy("container_name").orderBy(-F.unix_date("day")).rangeBetween(W.unboundedPreceding, -1)
        days = counts.withColumn("newer", F.coalesce(F.sum(counted).over(later), F.lit(0))).filter(
            F.col("newer") < size).select("container_name", "day").distinct()
        oldest, rows, width = days.agg(
            F.min("day"), F.count(F.lit(1)), F.sum(F.octet_length("container_name") + 8)).first()
        if not rows:
            return search.alert_page(alerts.filter(F.lit(False)).drop("day"), size)
        alerts = alerts.filter(F.col("day") >= F.lit(oldest))
        if rows <= BROADCAST_ROWS and width <= BROADCAST_BYTES:
            near = alerts.join(F.broadcast(days), ["container_name", "day"])
        else:
            near = alerts.join(days, ["container_name", "day"])  # adaptive execution splits hot ones
        return search.alert_page(near.drop("day"), size, before)

    def day_count(self, at: datetime) -> DataFrame:
        """How many alerts the day of ``at`` has, from the counts alone."""
        return self.counts().filter(F.col("day") == F.lit(at.date())).agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("value"))
