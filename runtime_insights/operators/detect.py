"""Detection of events outside the learned profile, and what follows from alerts."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from runtime_insights import schema as S
from runtime_insights.functions import timestamps as TS
from runtime_insights.operators.paths import known, path_rows
from runtime_insights.operators.profile import (
    Learning, learning_cut, novel_operations, novel_paths, path_rollup,
)
from runtime_insights.operators.skew import cells, salted_lookup
from runtime_insights.session import materialize

_EVENT = ("ts", "rule", "priority", "source")
EVENT_ID = "event_id"
_READ = (
    "container_name", "seq", *_EVENT, "category", "evt_type", "proc_name", "cmdline",
    "fd_type", "fd_name", "fd_directory",
)


def identified(events: DataFrame) -> DataFrame:
    """Events of known category as a stored table in which each row has an id of its own.

    Neither (container, time, sequence) nor content is one: sequence numbers count per
    host and may be missing, and lines may come twice. The id is given once, when the
    table is written, and read from there, so it never changes. Events that bring an
    ``event_id`` from their source keep it.
    """
    if EVENT_ID in events.columns:
        return events
    rows = known(events).select(*_READ).withColumn(EVENT_ID, F.monotonically_increasing_id())
    return materialize(rows, "identified")


def unlearned_paths(rollup: DataFrame, cuts: DataFrame) -> DataFrame:
    """Paths first met after the end of learning, with the level that is unknown.

    An event on such a path is after the cut by definition, so detection is one join of
    events with this table. Events are never joined with the (much larger) learned one.
    """
    novel = novel_paths(rollup)
    cut = cuts.filter(F.col("cut_ord").isNotNull()).select("container_name", "cut_ord")
    late = salted_lookup(
        novel, cut, ["container_name"], ["branch", "evt_type", "proc_name", "attr"], "inner"
    ).filter(F.col("first_ord") > F.col("cut_ord"))
    late_operations = salted_lookup(
        novel_operations(novel), cut, ["container_name"], ["branch", "evt_type"], "inner"
    ).filter(F.col("first_ord") > F.col("cut_ord")).select(
        "container_name", "branch", "evt_type", F.lit(True).alias("new_operation")
    )
    level = (
        F.when(F.col("attr") != "", 3).when(F.col("new_operation"), 1).otherwise(2)
    )
    return late.join(
        late_operations, ["container_name", "branch", "evt_type"], "left"
    ).select(*S.PATH, level.alias("level"))


def alerts_on(events: DataFrame, unlearned: DataFrame, branch: str | None = None) -> DataFrame:
    """One alert per event that touches an unlearned path, at its first unknown level.

    The hits are grouped by the event's id alone, as a hash minimum of (level, position)
    in one number; no other column passes the aggregate, so nothing is sorted.
    """
    if branch is not None:
        events = events.filter(F.col("category") == branch)
        unlearned = unlearned.filter(F.col("branch") == branch)
    turn = F.shiftleft(F.col("level").cast("bigint"), 40) + F.col("pos") + 1
    hits = path_rows(identified(events), EVENT_ID, *_EVENT).join(unlearned, list(S.PATH), "inner")
    hits = materialize(hits.drop("ord", "ts_us").withColumn("turn", turn), "hits")
    first = hits.groupBy(EVENT_ID).agg(F.min("turn").alias("turn"))
    missing = (
        F.when(F.col("level") == 1, F.col("evt_type"))
        .when(F.col("level") == 2, F.col("proc_name"))
        .otherwise(F.col("attr"))
    )
    return hits.join(first, [EVENT_ID, "turn"]).select(
        "container_name", "seq", "ts", "branch", "evt_type", "proc_name", "rule", "priority",
        "source", "level", missing.alias("missing_key"), F.lit("detect").alias("phase"),
    )


def detect_alerts(
    events: DataFrame, learning: Learning = Learning(), branch: str | None = None
) -> DataFrame:
    """Learn each container's profile, then alert on what falls outside it."""
    events = identified(events)
    rollup = materialize(path_rollup(events, learning.quiet_gap_ms), "path-rollup")
    cuts = learning_cut(events, learning, rollup)
    # Its size as a table decides the join: broadcast while small, so that the exploded
    # events are not shuffled; sort-merge with skew splitting beyond that.
    return alerts_on(events, materialize(unlearned_paths(rollup, cuts), "unlearned"), branch)


def profile_paths(nodes: DataFrame) -> DataFrame:
    """Path table (empty ``attr`` for processes) of a node table."""
    processes = nodes.filter(F.col("level") == 3).select(*S.PATH[:4], F.lit("").alias("attr"))
    return nodes.filter(F.col("level") == 4).select(*S.PATH).unionByName(processes)


def detect_against(events: DataFrame, learned: DataFrame, branch: str | None = None) -> DataFrame:
    """Alert on events outside a stored profile, given as its path table.

    Distinct paths of the events are compared with it, so a hot path is looked up once.
    """
    events = identified(events)
    if branch is not None:
        events = events.filter(F.col("category") == branch)
    seen = path_rows(events).select(*S.PATH).distinct()
    new = seen.join(learned.select(*S.PATH), list(S.PATH), "left_anti")
    operations = learned.filter(F.col("attr") == "").select(
        *S.PATH[:3], F.lit(True).alias("known_operation")
    ).distinct()
    level = (
        F.when(F.col("attr") != "", 3).when(F.col("known_operation"), 2).otherwise(1)
    )
    unlearned = new.join(operations, list(S.PATH[:3]), "left").select(*S.PATH, level.alias("level"))
    return alerts_on(events, unlearned)


def children_named(profile: DataFrame, parent: dict[str, str], name: str) -> DataFrame:
    """The child called ``name`` of the node at ``parent`` (container, branch, ...)."""
    level = len(parent)
    condition = (F.col("level") == level) & (F.col(S.PATH[level]) == name)
    for column, value in parent.items():
        condition &= F.col(column) == value
    return profile.filter(condition)


# ----------------------------------------------------------- after the alerts

def alert_context(alerts: DataFrame, events: DataFrame, width_ms: int) -> DataFrame:
    """Events of the same container within ``width_ms`` before or after each alert.

    Both sides meet on (container, time cell); an alert is repeated for the two or three
    cells its range touches, an event stays in one.
    """
    width = width_ms * 1000
    alert_us = TS.micros(F.col("ts"))
    centres = alerts.select(
        "container_name", F.col("seq").alias("alert_seq"), alert_us.alias("alert_us"),
        F.explode(cells(alert_us - width, alert_us + width, width)).alias("cell"),
    )
    event_us = TS.micros(F.col("ts"))
    rows = events.select(
        "container_name", "seq", "ts", "rule", "priority", "evt_type", "proc_name",
        event_us.alias("event_us"), TS.bucket(event_us, width).alias("cell"),
    )
    near = F.col("event_us").between(F.col("alert_us") - width, F.col("alert_us") + width)
    return rows.join(centres, ["container_name", "cell"]).filter(near).select(
        "container_name", "alert_seq", "seq", "ts", "rule", "priority", "evt_type", "proc_name",
        (F.col("event_us") - F.col("alert_us")).alias("offset_us"),
    )


def profile_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths that were added, removed or counted differently between two node tables."""
    keys = ["container_name", "level", "branch", "evt_type", "proc_name", "attr"]

    def side(nodes: DataFrame, name: str) -> DataFrame:
        text = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys]
        return nodes.filter(F.col("level") >= 2).select(*text, F.col("events_count").alias(name))

    both = side(before, "count_before").join(side(after, "count_after"), keys, "full_outer")
    change = (
        F.when(F.col("count_before").isNull(), "added")
        .when(F.col("count_after").isNull(), "removed")
        .when(F.col("count_before") != F.col("count_after"), "changed")
    )
    return both.withColumn("change", change).filter(F.col("change").isNotNull())


def phase_metrics(phased: DataFrame, alerts: DataFrame, period: timedelta) -> DataFrame:
    """Current phase, events per phase, event rate and anomalies of each container."""
    learning = phased.groupBy("container_name").agg(
        F.min("phase").alias("phase"),
        F.count_if(F.col("phase") == "learn").alias("learn_events"),
        F.count_if(F.col("phase") == "detect").alias("detect_events"),
        (F.count(F.lit(1)) / F.lit(period.total_seconds())).alias("event_rate"),
    )
    anomalies = alerts.groupBy("container_name").agg(F.count(F.lit(1)).alias("anomalies"))
    return learning.join(anomalies, "container_name", "left").withColumn(
        "anomalies", F.coalesce("anomalies", F.lit(0))
    )


def detector_quality(judged: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """Confusion counts and the rates that follow from them."""
    cells_ = judged.select(predicted.alias("p"), actual.alias("a")).agg(
        F.count_if(F.col("p") & F.col("a")).alias("tp"),
        F.count_if(F.col("p") & ~F.col("a")).alias("fp"),
        F.count_if(~F.col("p") & F.col("a")).alias("fn"),
        F.count_if(~F.col("p") & ~F.col("a")).alias("tn"),
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom != 0, top.cast("double") / bottom)

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells_.select(
        "*",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(tp * 2, tp * 2 + fp + fn).alias("f1"),
        ratio(fp, fp + tn).alias("false_positive_rate"),
    )
