"""Events to path rows: (container, branch, operation, process, attribute)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from runtime_insights import schema as S
from runtime_insights.functions import timestamps as TS
from runtime_insights.functions.branches import attributes, closes_learning


def known(events: DataFrame) -> DataFrame:
    """Only the events that belong to a branch."""
    return events.filter(F.col("category") != "unknown")


def event_paths(events: DataFrame) -> DataFrame:
    """One row per attribute of each event, or one with null attribute if it has none."""
    return known(events).select(
        "container_name", "seq", "ts", F.col("category").alias("branch"),
        "evt_type", "proc_name", F.inline_outer(attributes()),
    )


def _slots(*extra: Column) -> Column:
    process = F.struct(
        F.lit(-1).alias("pos"), F.lit("").alias("attr"),
        F.lit(S.PROCESS_NODE_TYPE).alias("attr_type"),
    )
    return F.concat(F.array(process), attributes(), *extra)


def path_rows(events: DataFrame, *carry: str) -> DataFrame:
    """Path rows with their order key.

    Every event gives one row for its process path (empty ``attr``, slot 0) and one row
    per attribute (slot = position + 1), so one table holds the process and leaf levels.
    """
    return _ordered(events, _slots(), *carry)


def path_and_clock_rows(events: DataFrame) -> DataFrame:
    """Path rows, and for each event that may end learning one row with null ``attr``."""
    tick = F.array(F.struct(
        F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("attr"),
        F.lit(None).cast("string").alias("attr_type"),
    ))
    clock = F.when(closes_learning(), tick).otherwise(
        F.array().cast("array<struct<pos:int,attr:string,attr_type:string>>")
    )
    return _ordered(events, _slots(clock))


def _ordered(events: DataFrame, slots: Column, *carry: str) -> DataFrame:
    exploded = known(events).select(
        "container_name", F.col("category").alias("branch"), "evt_type", "proc_name",
        "seq", TS.micros(F.col("ts")).alias("ts_us"), *carry, F.inline(slots),
    )
    return exploded.withColumn(
        "ord", TS.order_key(F.col("ts_us"), F.col("seq"), F.col("pos") + 1)
    )
