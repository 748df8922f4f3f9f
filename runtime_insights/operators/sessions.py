"""Time-gap sessions: captures around rule hits, and rate-limited drop alerts."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from runtime_insights import schema as S
from runtime_insights.functions import timestamps as TS
from runtime_insights.operators.scan import ordered_span, scan_before
from runtime_insights.operators.skew import cells
from runtime_insights.session import materialize


def capture_sessions(hits: DataFrame, duration_ms: int = S.CAPTURE_MS) -> DataFrame:
    """Captures per container: from a hit until ``duration_ms`` after the last one.

    Hits no further apart than the duration share a capture. Two hits in one cell of
    that width always do, so hits are reduced to their first and last per cell first;
    the cells of a container are scanned by ranges.
    """
    width = duration_ms * 1000
    us = TS.micros(F.col("ts"))
    marks = hits.groupBy("container_name", TS.bucket(us, width).alias("cell")).agg(
        F.min(us).alias("first_us"), F.max(us).alias("last_us"), F.count(F.lit(1)).alias("hits")
    )
    marks = materialize(marks, "capture-marks")
    span, key = ordered_span(marks, F.col("cell")), ["container_name"]
    known = scan_before(marks, key, "cell", {"last_before": ("last_us", "max")}, span)
    opens = F.coalesce(F.col("first_us") - F.col("last_before") > width, F.lit(True))
    opened = known.withColumn("opened_us", F.when(opens, F.col("first_us"))).drop("last_before")
    found = scan_before(opened, key, "cell", {"open_us": ("opened_us", "last")}, span)
    # Every hit belongs to the capture opened last, by it or before it.
    return found.withColumn("start_us", F.coalesce("opened_us", "open_us")).groupBy("container_name", "start_us").agg(
        (F.max("last_us") + width).alias("end_us"), F.sum("hits").alias("hits")
    ).select("container_name", "start_us", "end_us", "hits")


def captured_events(events: DataFrame, captures: DataFrame, duration_ms: int = S.CAPTURE_MS) -> DataFrame:
    """Events with start <= ts < end of a capture of their container.

    Both sides meet on (container, cell); a capture is repeated once per cell it covers,
    and at most two captures touch one cell.
    """
    width = duration_ms * 1000
    covered = captures.withColumn(
        "cell", F.explode(cells(F.col("start_us"), F.col("end_us") - 1, width))
    )
    us = TS.micros(F.col("ts"))
    rows = events.withColumn("us", us).withColumn("cell", TS.bucket(F.col("us"), width))
    inside = (F.col("us") >= F.col("start_us")) & (F.col("us") < F.col("end_us"))
    return rows.join(covered, ["container_name", "cell"]).filter(inside).drop("us", "cell")


def drop_ratios(
    events: DataFrame, dropped, host: str, width_us: int = 1_000_000
) -> DataFrame:
    """Dropped share of all events per host and tumbling window."""
    window = TS.bucket(TS.micros(F.col("ts")), width_us)
    return events.groupBy(F.col(host).alias("host"), window.alias("tick")).agg(
        F.count_if(dropped).alias("dropped"), F.count(F.lit(1)).alias("total")
    ).withColumn("ratio", F.col("dropped") / F.col("total"))


def drop_alerts(
    ratios: DataFrame, width_us: int = 1_000_000, threshold: float = S.DROP_THRESHOLD,
    rate_per_second: float = S.DROP_RATE_PER_SECOND, burst: int = S.DROP_MAX_BURST,
) -> DataFrame:
    """Windows over the threshold that a token bucket lets through.

    Credit is counted in ticks of waiting; a message costs ``1 / rate`` of them. After
    ``burst / rate`` quiet ticks the bucket is full, so a pause of that length splits a
    host's windows into runs that do not depend on each other. Only inside a run is the
    order followed, as a fold over its ticks: one per window, however many events.
    """
    over = materialize(ratios.filter(F.col("ratio") > threshold), "over-limit")
    cost = round(1e6 / (rate_per_second * width_us), 9)
    span = ordered_span(over, F.col("tick"))
    known = scan_before(over.select("host", "tick"), ["host"], "tick", {"tick_before": ("tick", "last")}, span)
    pause = F.coalesce(F.col("tick") - F.col("tick_before") >= F.lit(burst * cost), F.lit(True))
    opened = known.withColumn("opened", F.when(pause, F.col("tick"))).drop("tick_before")
    runs = scan_before(opened, ["host"], "tick", {"run": ("opened", "last")}, span).withColumn(
        "run", F.coalesce("opened", "run"))
    full = burst * cost

    def fold(run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values("tick")
        sent, _, _ = admit(run["tick"].tolist(), cost, full, full, None)
        return run[["host", "tick"]][sent]

    # The fold sees ticks alone; the counts join the few it lets through.
    sent = runs.select("host", "run", "tick").groupBy("host", "run").applyInPandas(
        fold, f"host {dict(ratios.dtypes)['host']}, tick bigint"
    )
    return over.join(sent, ["host", "tick"], "left_semi").select(
        "host", TS.from_micros(F.col("tick") * width_us).alias("window_start"),
        "dropped", "total", "ratio",
    )


def admit(
    times: Sequence[float], cost: float, full: float, credit: float, last: float | None
) -> tuple[list[bool], float, float | None]:
    """Which of the ordered ``times`` a token bucket lets through, and its state after.

    Credit is waiting time, at most ``full``; a message costs ``cost`` of it.
    """
    sent = []
    for now in times:
        credit = min(full, credit + (0.0 if last is None else now - last))
        last = now
        sent.append(credit >= cost)
        credit -= cost if sent[-1] else 0.0
    return sent, credit, last
