"""Labelled counters, last-seen gauges, samples of them and their text form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from runtime_insights import schema as S
from runtime_insights.functions import fields as X, timestamps as TS
from runtime_insights.functions.classify import metrics_category
from runtime_insights.operators.scan import ordered_span, scan_before
from runtime_insights.session import materialize


def labelled(parsed: DataFrame, ingest_ts: Column) -> DataFrame:
    """Parsed lines with the eight counter labels and the gauge's seconds.

    Lines whose inner fields are null are dropped, as a consumer that cannot read them
    would do. All columns of ``parsed`` stay.
    """
    whole = F.col("whole")
    # ``parse_lines`` has read the inner object already.
    parsed_inner = F.col("fields") if "fields" in parsed.columns else F.from_json(
        X.field(whole, "output_fields"), S.FIELDS)
    inner = F.when(X.has_field(whole, "output_fields"), parsed_inner).otherwise(
        F.create_map().cast(S.FIELDS))
    fields = F.col("_fields")
    return (
        parsed.filter(whole.isNotNull()).select("*", F.explode(F.array(inner)).alias("_fields"))
        .filter(fields.isNotNull())
        .select(
            "*",
            X.label(whole, "rule").alias("rule"),
            X.label(whole, "priority").alias("priority"),
            X.label(fields, "container.name").alias("container_name"),
            X.label(fields, "container.image.repository").alias("image_repository"),
            X.label(fields, "proc.name").alias("process_name"),
            X.optional_label(fields, "k8s.ns.name").alias("k8s_namespace"),
            X.optional_label(fields, "k8s.pod.name").alias("k8s_pod"),
            metrics_category(
                X.field_if_present(whole, "rule", "unknown"),
                X.field_if_present(fields, "evt.type", "unknown"),
            ).alias("rule_category"),
            TS.metric_seconds(fields, ingest_ts).alias("ts_sec"),
        )
        .drop("_fields")
    )


def event_counters(events: DataFrame, labels: Sequence[str] = S.EVENT_LABELS) -> DataFrame:
    return events.groupBy(*labels).agg(F.count(F.lit(1)).cast("double").alias("value"))


def last_event(events: DataFrame) -> DataFrame:
    """Seconds of the last *written* event per container, not the largest.

    Both values that the aggregate holds have a fixed width, so it is a hash aggregate.
    Of events with equal time and number the one with the larger last digits counts.
    """
    return events.groupBy("container_name").agg(
        F.max_by("ts_sec", written_order()).cast("double").alias("value")
    )


def written_order() -> Column:
    """Order of writing, (ts, seq), with the gauge's last digits for ties."""
    return TS.order_key(
        TS.micros(F.col("ts")), F.col("seq"), F.pmod(F.col("ts_sec"), F.lit(TS.MAX_POS + 1))
    )


def alert_counters(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("container_name", "rule", "priority", "source").agg(
        F.count(F.lit(1)).cast("double").alias("value")
    )


def whitelist(counters: DataFrame, keep: Mapping[str, Sequence[str] | None]) -> DataFrame:
    """Counters over the kept labels; values outside a given list become ``other``."""
    labels = [
        F.col(name) if values is None
        else F.when(F.col(name).isin(*values), F.col(name)).otherwise("other")
        for name, values in keep.items()
    ]
    named = [c.alias(n) for c, n in zip(labels, keep)]
    return counters.groupBy(*named).agg(F.sum("value").alias("value"))


def label_cardinality(counters: DataFrame, limit: int, exact: bool = True) -> DataFrame:
    """Distinct values per label, and whether that is more than ``limit``.

    Runs over the counter table (one row per label combination). The exact form counts
    distinct (label, value) rows in two steps, so no task holds all values of a label.
    """
    long = counters.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("label"), F.col(n).alias("label_value")) for n in S.EVENT_LABELS
    ])).alias("x")).select("x.*")
    if exact:
        sizes = long.distinct().groupBy("label").agg(F.count(F.lit(1)).alias("cardinality"))
    else:
        sizes = long.groupBy("label").agg(F.approx_count_distinct("label_value").alias("cardinality"))
    return sizes.withColumn("high", F.col("cardinality") > limit)


def exposition_head(spark: SparkSession, name: str, help_text: str, kind: str) -> DataFrame:
    """The HELP and TYPE lines of a metric."""
    lines = [(f"# HELP {name} {help_text}",), (f"# TYPE {name} {kind}",)]
    return spark.createDataFrame(lines, "line string")


def exposition(metrics: DataFrame, name: str, labels: Sequence[str]) -> DataFrame:
    """``name{label="value",...} number`` lines; ``exposition_head`` has those before them."""
    def quoted(text: Column) -> Column:
        # The text format's escapes of backslash, line feed and quote.
        text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        text = F.replace(text, F.lit("\n"), F.lit("\\n"))
        return F.replace(text, F.lit('"'), F.lit('\\"'))

    pairs = [F.concat(F.lit(f'{n}="'), quoted(F.col(n)), F.lit('"')) for n in labels]
    body = F.concat(F.lit(name + "{"), F.concat_ws(",", *pairs), F.lit("} "))
    return metrics.select(F.concat(body, number_text(F.col("value"))).alias("line"))


def number_text(value: Column) -> Column:
    """A sample value as text: ``2.0``, and ``1.7356896e+09`` from a million up."""
    plain = F.regexp_replace(F.format_string("%.6f", value), r"(\.\d+?)0*$", "$1")
    digits = F.regexp_replace(F.format_string("%.15e", value), r"(\.\d*?)0*e", "$1e")
    digits = F.regexp_replace(digits, r"\.e", "e")
    return F.when(F.abs(value) < 1e6, plain).otherwise(digits)


# ------------------------------------------------------------------ time series

def counter_samples(
    events: DataFrame,
    labels: Sequence[str],
    step_us: int,
    restart_us: int | None = None,
    bounds: tuple[datetime, datetime] | None = None,
) -> DataFrame:
    """Cumulative counter of each series at the end of every step, as a scrape takes them.

    A series begins with the step of its first event and goes on to the last step of
    all, also through steps in which it did not grow. Events are counted per series and
    step; running sums are taken over those rows alone, by ranges of steps, and each row gives the samples
    since the one before it. ``restart_us`` sets counters back to zero at each multiple, as a restarted
    exporter does; a series is then missing until its next event. ``bounds`` are the times of the first and
    last event where the caller knows them; else the counts are stored and asked.
    """
    us = TS.micros(F.col("ts"))
    # A step's sample is taken at its end, so an event exactly there still counts.
    step = -TS.bucket(-us, step_us)
    counts = events.groupBy(*labels, step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    epoch = F.lit(0) if restart_us is None else TS.bucket(
        F.col("step") * step_us - 1, restart_us)
    counts = counts.withColumn("epoch", epoch.cast("bigint"))
    if bounds is None:
        counts = materialize(counts, "step-counts")
        span = ordered_span(counts, F.col("step"))
    else:
        span = tuple(-(-TS.epoch_micros(t) // step_us) for t in bounds)
    last = F.lit(span[1]).cast("bigint")
    if restart_us is not None:
        # The last step whose end is not after the restart.
        last = F.least(last, TS.bucket((F.col("epoch") + 1) * restart_us, step_us))
    series = [*labels, "epoch"]
    known = scan_before(counts, series, "step", {"sum_before": ("n", "sum"), "step_before": ("step", "last")}, span)
    before = F.coalesce("sum_before", F.lit(0))
    since = F.coalesce(F.col("step_before") + 1, F.col("step"))
    grown = known.select(
        *labels, F.explode(F.sequence(since, F.col("step"))).alias("at"), "step", before.alias("before"), "n",
    ).select(*labels, "at", (F.col("before") + F.when(F.col("at") == F.col("step"), F.col("n")).otherwise(0)).alias("value"))
    # Steps after the last event of a series.
    idle = counts.groupBy(*series).agg(F.max("step").alias("step"), F.sum("n").alias("value")).withColumn("last", last).filter(
        F.col("step") < F.col("last")
    ).select(*labels, F.explode(F.sequence(F.col("step") + 1, F.col("last"))).alias("at"), "value")
    return grown.unionByName(idle).select(
        *labels, TS.from_micros(F.col("at") * step_us).alias("ts"), F.col("value").cast("double").alias("value"))


def counter_increase(
    samples: DataFrame, labels: Sequence[str], window_us: int, bounds: tuple[datetime, datetime] | None = None
) -> DataFrame:
    """Increase and rate per second of each series in fixed windows over its samples.

    A value below the one before it means the counter restarted from zero. Values are compared within
    each window; of the windows only the first and last value meet, by ranges of windows. ``bounds``: times of
    the first and last sample, or earlier and later ones, where the caller knows them.
    """
    window = -TS.bucket(-TS.micros(F.col("ts")), window_us)
    inside = W.partitionBy(*labels, "w").orderBy("ts")

    def growth(now: Column, previous: Column) -> Column:
        return F.when(now < previous, now).otherwise(now - previous)

    # The first sample of a window has none before it here; its growth follows below.
    grown = samples.withColumn("w", window).withColumn("delta", growth(F.col("value"), F.lag("value").over(inside)))
    windows = grown.groupBy(*labels, "w").agg(
        F.coalesce(F.sum("delta"), F.lit(0.0)).alias("inner"),
        F.min_by("value", "ts").alias("first"), F.max_by("value", "ts").alias("latest"),
    )
    span = None if bounds is None else tuple(-(-TS.epoch_micros(t) // window_us) for t in bounds)
    met = scan_before(windows, labels, "w", {"previous": ("latest", "last")}, span)
    first = F.coalesce(growth(F.col("first"), F.col("previous")), F.col("first"))
    return met.withColumn("increase", F.col("inner") + first).select(
        *labels, TS.from_micros(F.col("w") * window_us).alias("window_end"), "increase",
        (F.col("increase") / F.lit(window_us / 1e6)).alias("rate"),
    )
