"""Session settings and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # Timestamps are read and written as UTC wall clock.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split hot join partitions even where that costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # "First n of each group" cuts every task to n rows per group before the shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "runtime-insights", **overrides: str) -> SparkSession:
    """A session with the library's settings; master and sizes come from the launcher."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Put the run-time settings on a session somebody else made."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and driver and
    executors are one process (tests, local runs) a folder of our own is made and put into
    the setting; elsewhere a table in a local folder would be lost, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        require_local(spark.sparkContext.master)
        folder = tempfile.mkdtemp(prefix="runtime-insights-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def require_local(master: str) -> None:
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all of {master} share")


_KEPT: list[list[str]] = []  # tables made within each open ``scratch``


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Cuts the lineage, survives lost executors, keeps column pruning, and gives the
    planner the true size, so it broadcasts by measured bytes, not by a guess.
    """
    path = f"{work_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    if _KEPT:
        _KEPT[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that are materialized within, once the results are written.

        with scratch(spark):
            detect_alerts(events).write.parquet(path)
    """
    _KEPT.append([])
    try:
        yield
    finally:
        for path in _KEPT.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever Spark can reach it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
