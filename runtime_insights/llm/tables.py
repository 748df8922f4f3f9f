"""Intermediate tables in the shared folder, connected components, and small helpers."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runtime_insights.session import work_dir

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Shuffle files of a job go when its table is written, not when the driver collects."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage cut, survives executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path  # for discard()
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables made by ``store`` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_stored_at", None)
        if path:
            jvm = table.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(
                place, True
            )


def short_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Whole texts go to Python ``rows`` at a time, unless the session says how many: Spark's 10,000
    are held by the JVM and by the worker at once, in each task."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(rows))


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def columns_or_null(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Only the columns an operator reads, cast; other columns never reach its work."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in wanted.items()])


def unused(names: list[str], *wanted: str) -> list[str]:
    """Column names like ``wanted`` that none of ``names`` is, in whatever case."""
    taken, out = {name.lower() for name in names}, []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def row_key(*columns: str) -> Column:
    """A 64-bit key of a row's own content; equal rows share it, and all results with it."""
    return F.xxhash64(*[F.col(c) for c in columns])


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a, b: long): ``node``, ``component`` (smallest node).

    Distributed union-find by alternating large and small stars. Each round is two joins
    with the minimum of each node's neighbours (hash aggregation, combined on the map
    side; a hub is a skewed join that adaptive execution splits) and ends as a table.
    """
    edges = store(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b").distinct(), label,
    )

    def state(table: DataFrame) -> tuple:
        row = table.agg(
            F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))
        ).head()
        return row[0], int(row[1])

    before = state(edges)
    while before[0]:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.filter("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        large = store(large, label)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
            .select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
            .filter("a <> b").distinct()
        )
        old, edges = edges, store(small, label)
        discard(old, large)
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
