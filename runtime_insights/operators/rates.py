"""Rates, increases, rankings and overviews from events.

A rate over ``w`` at time ``t`` counts the events in (t - w, t] and divides by ``w``.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from runtime_insights.functions import timestamps as TS

PANELS = ([], ["priority"], ["rule_category"], ["rule"], ["rule", "priority"])


def latest(events: DataFrame) -> datetime:
    """Evaluation time taken from the data, for those who have no clock: scans one column.

    Callers that know the time give it to the operators below and skip this.
    """
    return events.agg(F.max("ts")).first()[0]


def recent(events: DataFrame, at: datetime, window: timedelta) -> DataFrame:
    """Events in (at - window, at]; both bounds are constants, so the scan prunes by them."""
    return events.filter(
        (F.col("ts") > F.lit(at - window).cast("timestamp_ntz"))
        & (F.col("ts") <= F.lit(at).cast("timestamp_ntz"))
    )


def increase(events: DataFrame, by: Sequence[str], at: datetime, window: timedelta) -> DataFrame:
    return recent(events, at, window).groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("value")
    )


def rate(events: DataFrame, by: Sequence[str], at: datetime, window: timedelta) -> DataFrame:
    return increase(events, by, at, window).withColumn(
        "value", F.col("value") / F.lit(window.total_seconds())
    )


def rates_by(
    events: DataFrame, panels: Sequence[Sequence[str]], at: datetime, window: timedelta
) -> DataFrame:
    """All panels' ``sum by (...)`` rates in one pass.

    Events are counted once by the union of the labels; grouping sets then run over
    that small table. ``panel`` names the labels that were kept.
    """
    labels = sorted({name for panel in panels for name in panel})
    counts = recent(events, at, window).groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))
    names = F.concat_ws(
        ",", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in labels]
    ).alias("panel")
    return (
        counts.groupingSets([[F.col(c) for c in p] for p in panels], *labels)
        .agg(names, (F.sum("n").cast("double") / F.lit(window.total_seconds())).alias("value"))
    )


def top(values: DataFrame, n: int, *ties: str) -> DataFrame:
    """The ``n`` largest; equal values by name."""
    return values.orderBy(F.desc("value"), *ties).limit(n)


def windowed_counts(events: DataFrame, by: Sequence[str], width_us: int) -> DataFrame:
    """Count per tumbling window that starts at a multiple of ``width_us``."""
    start = TS.bucket(TS.micros(F.col("ts")), width_us)
    return (
        events.groupBy(*by, start.alias("w")).agg(F.count(F.lit(1)).alias("n"))
        .select(*by, TS.from_micros(F.col("w") * width_us).alias("window_start"), "n")
    )


def windowed_rate(events: DataFrame, by: Sequence[str], width_us: int) -> DataFrame:
    return windowed_counts(events, by, width_us).select(
        *by, "window_start", (F.col("n") / F.lit(width_us / 1e6)).alias("value")
    )


def downsample(minutes: DataFrame, by: Sequence[str], width_us: int) -> DataFrame:
    """Coarser windows from a fine table: sum of counts, maximum of gauges."""
    start = TS.bucket(TS.micros(F.col("window_start")), width_us)
    return (
        minutes.groupBy(*by, start.alias("w"))
        .agg(F.sum("n").alias("n"), F.max("last_ts").alias("last_ts"))
        .select(*by, TS.from_micros(F.col("w") * width_us).alias("window_start"), "n", "last_ts")
    )


def minute_table(events: DataFrame, by: Sequence[str], width_us: int = 60_000_000) -> DataFrame:
    """Base table for trends: count and last time per series and minute."""
    start = TS.bucket(TS.micros(F.col("ts")), width_us)
    return (
        events.groupBy(*by, start.alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))
        .select(*by, TS.from_micros(F.col("w") * width_us).alias("window_start"), "n", "last_ts")
    )


def rate_range(
    events: DataFrame, by: Sequence[str], window_us: int, step_us: int, zero_fill: bool = False
) -> DataFrame:
    """Rate of each series at every step, ``window_us`` a multiple of ``step_us``.

    Events are counted per step; only those counts are repeated for the evaluation
    times that see them. With ``zero_fill`` each series has a value at all steps from
    the first to the last step of the whole result.
    """
    spans = window_us // step_us
    if spans * step_us != window_us:
        raise ValueError("the window must be a multiple of the step")
    step = -TS.bucket(-TS.micros(F.col("ts")), step_us)
    counts = events.groupBy(*by, step.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    seen = counts.select(
        *by, "n", F.explode(F.sequence(F.col("s"), F.col("s") + (spans - 1))).alias("s")
    )
    if zero_fill:
        first, last = counts.agg(F.min("s"), F.max("s")).first()
        if first is not None:
            grid = counts.select(*by).distinct().select(
                *by, F.lit(0).cast("bigint").alias("n"),
                F.explode(F.sequence(F.lit(first), F.lit(last + spans - 1))).alias("s"),
            )
            seen = seen.unionByName(grid)
    return (
        seen.groupBy(*by, "s").agg(F.sum("n").alias("n"))
        .select(
            *by, TS.from_micros(F.col("s") * step_us).alias("ts"),
            (F.col("n") / F.lit(window_us / 1e6)).alias("value"),
        )
    )


def top_per_window(counts: DataFrame, n: int, *ties: str) -> DataFrame:
    """The ``n`` largest counts of each window."""
    order = W.partitionBy("window_start").orderBy(F.desc("n"), *ties)
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def section(df: DataFrame, name: str, key: Column, value: Column) -> DataFrame:
    return df.select(F.lit(name).alias("section"), key.alias("key"), value.cast("double").alias("value"))


def alerts_of_day(alerts: DataFrame, at: datetime) -> DataFrame:
    """The number of alerts of the day of ``at``."""
    midnight = at.replace(hour=0, minute=0, second=0, microsecond=0)
    return alerts.filter(
        (F.col("ts") >= F.lit(midnight).cast("timestamp_ntz"))
        & (F.col("ts") < F.lit(midnight + timedelta(days=1)).cast("timestamp_ntz"))
    ).agg(F.count(F.lit(1)).alias("value"))


def overview(
    events: DataFrame, today: DataFrame, at: datetime, window: timedelta, top_n: int = 10
) -> DataFrame:
    """Total rate, distributions, top rules and the number of alerts ``today`` (see ``alerts_of_day``)."""
    rates = rates_by(events, [[], ["priority"], ["rule_category"], ["rule"]], at, window)

    def panel(name: str) -> DataFrame:
        return rates.filter(F.col("panel") == name)

    rules = top(panel("rule"), top_n, "rule")
    value = F.col("value")
    parts = [
        section(panel(""), "total_rate", F.lit("all"), value),
        section(panel("priority"), "priority", F.col("priority"), value),
        section(panel("rule_category"), "rule_category", F.col("rule_category"), value),
        section(rules, "top_rules", F.col("rule"), value),
        section(today, "alerts_today", F.lit("all"), value),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def container_list(events: DataFrame, at: datetime, window: timedelta) -> DataFrame:
    """Every container with its recent rate and last event time, null where it has none."""
    rates = rate(events, ["container_name"], at, window).withColumnRenamed("value", "rate")
    last = events.groupBy("container_name").agg(F.max("ts").alias("last_event"))
    return last.join(rates, "container_name", "full_outer").select(
        "container_name", "rate", "last_event"
    )
