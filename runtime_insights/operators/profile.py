"""Behaviour profiles: when learning ends, and what was learned by then.

Ordering is by (ts, seq). A node is *novel* at its first occurrence in the whole input;
novelty before the end of learning does not depend on where that end is, so the
learn/detect switch needs no sequential fold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from runtime_insights import schema as S
from runtime_insights.functions import branches as B, timestamps as TS
from runtime_insights.operators.paths import closes_learning, known, path_and_clock_rows, path_rows
from runtime_insights.operators.skew import salted_lookup
from runtime_insights.session import materialize


@dataclass(frozen=True)
class Learning:
    """Rule that ends learning: ``warmup`` over and nothing new for ``quiet_gap``."""

    quiet_gap_ms: int = S.QUIET_GAP_MS
    warmup_ms: int = S.WARMUP_MS
    scope: str = "container"  # or "global": the first container to finish ends it for all


def path_rollup(events: DataFrame, quiet_gap_ms: int) -> DataFrame:
    """All that learning needs from the events, in one pass and one shuffle.

    Two kinds of rows share it. Path rows (null ``cell``) hold the first occurrence of
    a process path (empty attr) or leaf path. Clock rows (null path) hold the first and
    last event that may end learning, per container and time cell of ``quiet_gap_ms``.
    Hash aggregation combines both on the map side: what is shuffled grows with paths
    and time, not with events, and hot containers or paths shrink before they move.
    """
    path = F.col("attr").isNotNull()
    cell = TS.bucket(TS.millis(F.col("ts_us")), quiet_gap_ms)
    return (
        path_and_clock_rows(events)
        .groupBy(
            "container_name",
            *[F.when(path, F.col(c)).alias(c) for c in S.PATH[1:]],
            F.when(~path, cell).alias("cell"),
        )
        .agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))
    )


def novel_paths(rollup: DataFrame) -> DataFrame:
    """First occurrence of each process path (empty attr) and leaf path."""
    return rollup.filter(F.col("cell").isNull()).select(*S.PATH, "first_ord")


def novel_operations(novel: DataFrame) -> DataFrame:
    return (
        novel.filter(F.col("attr") == "")
        .groupBy("container_name", "branch", "evt_type")
        .agg(F.min("first_ord").alias("first_ord"))
    )


def learning_grid(rollup: DataFrame, novel: DataFrame, learning: Learning) -> DataFrame:
    """Per container and time cell: where learning may end.

    Two novelties in one cell are less than a gap apart, so a cell needs only its first
    and last one. A cell either starts late enough after the last novelty before it
    (``full``: its first closing event ends learning), or the moment falls inside it
    (``probe``: events of that one cell must be looked at).
    The window sees one row per cell, a number bounded by time span / quiet gap.
    """
    gap = learning.quiet_gap_ms
    novelty = (
        novel.withColumn("first_ord", TS.order_event(F.col("first_ord")))
        .groupBy("container_name", _cell_of("first_ord", gap).alias("cell"))
        .agg(F.min("first_ord").alias("novel_first"), F.max("first_ord").alias("novel_last"))
    )
    closing = rollup.filter(F.col("cell").isNotNull()).select(
        "container_name", "cell", F.col("first_ord").alias("first_closing"),
        F.col("last_ord").alias("last_closing"),
    )
    cells = (
        novelty.unionByName(closing, allowMissingColumns=True)
        .groupBy("container_name", "cell")
        .agg(*[F.max(c).alias(c)
               for c in ("novel_first", "novel_last", "first_closing", "last_closing")])
    )
    order = W.partitionBy("container_name").orderBy("cell")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    start_ms = TS.order_millis(F.min("novel_first").over(so_far))
    quiet_ms = TS.order_millis(F.max("novel_last").over(before)) + gap
    grid = cells.select(
        "*",
        F.when(
            quiet_ms.isNotNull(), F.greatest(quiet_ms, start_ms + (learning.warmup_ms - 1))
        ).alias("after_ms"),
    )
    opens_ms = F.col("cell") * gap
    unbroken = F.col("novel_first").isNull()
    full = F.when(
        (F.col("after_ms") < opens_ms)
        & (unbroken | (F.col("first_closing") < F.col("novel_first"))),
        F.col("first_closing"),
    )
    probe = (
        (F.col("after_ms") >= opens_ms)
        & (F.col("after_ms") < TS.order_millis(F.col("last_closing")))
        & (unbroken | (F.col("after_ms") <= TS.order_millis(F.col("novel_first"))))
    )
    found = grid.select(
        "container_name", "cell", "novel_first", "after_ms", full.alias("full"),
        F.coalesce(probe, F.lit(False)).alias("probe"), F.row_number().over(order).alias("row"),
    )
    # Kept are a container's first cell (its start), its first full cell, and the probes
    # before that: a handful of rows, whose size as a table lets Spark broadcast them.
    return (
        found.withColumn("settled", F.min("full").over(before))
        .filter(F.col("settled").isNull()
                & ((F.col("row") == 1) | F.col("full").isNotNull() | F.col("probe")))
        .drop("settled")
    )


def _cell_of(key: str, gap: int) -> Column:
    return TS.bucket(TS.order_millis(F.col(key)), gap)


def learning_cut(
    events: DataFrame,
    learning: Learning = Learning(),
    rollup: DataFrame | None = None,
    novel: DataFrame | None = None,
) -> DataFrame:
    """Per container: order key of the last learned event, null while still learning.

    The result is a stored table, one row per container. ``novel`` (container_name, first_ord) are the moments of novelty, by default those of
    the rollup; a continued profile passes its own.
    """
    if rollup is None:
        rollup = materialize(path_rollup(events, learning.quiet_gap_ms), "path-rollup")
    if novel is None:
        novel = novel_paths(rollup)
    grid = materialize(learning_grid(rollup, novel, learning), "learning-grid")
    probes = grid.filter("probe").select("container_name", "cell", "after_ms", "novel_first")
    clock = known(events).filter(closes_learning()).select(
        "container_name", "seq", TS.micros(F.col("ts")).alias("ts_us")
    ).withColumn("cell", TS.bucket(TS.millis(F.col("ts_us")), learning.quiet_gap_ms))
    ord_ = TS.order_key(F.col("ts_us"), F.col("seq"))
    hits = (
        salted_lookup(clock, probes, ["container_name", "cell"], ["seq"], "inner")
        .filter(TS.millis(F.col("ts_us")) > F.col("after_ms"))
        .filter(F.col("novel_first").isNull() | (ord_ < F.col("novel_first")))
        .groupBy("container_name").agg(F.min(ord_).alias("cut_ord"))
    )
    settled = grid.select(
        "container_name", F.col("full").alias("cut_ord"), F.col("novel_first").alias("start_ord")
    )
    cuts = settled.unionByName(hits, allowMissingColumns=True).groupBy("container_name").agg(
        F.min("start_ord").alias("start_ord"), F.min("cut_ord").alias("cut_ord")
    )
    if learning.scope == "global":
        first = cuts.agg(F.min("cut_ord")).first()[0]
        cuts = cuts.withColumn("cut_ord", F.lit(first).cast("decimal(38,0)"))
    # The last slot of the event: all of its path rows are learned.
    last_slot = (F.col("cut_ord") + F.lit(TS.MAX_POS).cast("decimal(6,0)")).cast("decimal(38,0)")
    return materialize(cuts.withColumn("cut_ord", last_slot), "cut")


def describe_cut(cuts: DataFrame) -> DataFrame:
    return cuts.select(
        "container_name",
        TS.from_micros(TS.order_micros(F.col("start_ord"))).alias("start_ts"),
        TS.from_micros(TS.order_micros(F.col("cut_ord"))).alias("cut_ts"),
        TS.order_seq(F.col("cut_ord")).alias("cut_seq"),
    )


def with_phase(events: DataFrame, cuts: DataFrame) -> DataFrame:
    """Events of known category with their phase, ``learn`` or ``detect``."""
    ord_ = TS.order_key(TS.micros(F.col("ts")), F.col("seq"))
    phase = F.when(ord_ > F.col("cut_ord"), "detect").otherwise("learn")
    return (
        salted_lookup(known(events), cuts.select("container_name", "cut_ord"),
                      ["container_name"], ["seq"])
        .withColumn("phase", phase)
        .drop("cut_ord")
    )


def learned_events(events: DataFrame, cuts: DataFrame) -> DataFrame:
    return with_phase(events, cuts).filter(F.col("phase") == "learn").drop("phase")


# ------------------------------------------------------------------------ tree

def path_counts(events: DataFrame) -> DataFrame:
    """Occurrences, first and last time per process path (empty attr) and leaf path."""
    return path_rows(events).groupBy(*S.PATH).agg(
        F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"),
        F.max("ts_us").alias("last_us"),
    )


def leaf_counts(events: DataFrame) -> DataFrame:
    """Events counted at each attribute; every repeated token counts."""
    return path_counts(events).filter(F.col("attr") != "").select(
        *S.PATH, F.col("n").alias("events_count")
    )


def _leaf_type() -> Column:
    return B.leaf_type(F.col("branch"), TS.order_pos(F.col("first_ord")))


def _operation_type() -> Column:
    return B.operation_type(F.col("branch"))


def profile_nodes(events: DataFrame) -> DataFrame:
    """Node table of the trees that ``events`` (learned ones) build.

    Levels: 0 root, 1 branch, 2 operation, 3 process, 4 attribute. ``events_count`` is
    kept at the leaves only, as a tree walk would find it; ``subtree_events`` is its
    roll-up. All branches exist even if nothing was seen in one.
    """
    counts = path_counts(events)
    branches = counts.select("container_name").distinct().select(
        "container_name", F.explode(F.array(*map(F.lit, B.names()))).alias("branch")
    )
    level = F.lit(len(S.PATH) - 1) - F.bit_count(F.grouping_id())
    nodes = (
        # Grouping sets run over the reduced path table, not over events.
        counts.unionByName(branches, allowMissingColumns=True)
        .rollup(*S.PATH)
        .agg(
            level.cast("int").alias("level"),
            F.sum(F.when(F.col("attr") != "", F.col("n")).otherwise(0)).alias("subtree_events"),
            F.min("first_ord").alias("first_ord"),
            F.max("last_us").alias("last_us"),
        )
        .filter(
            (F.col("level") >= 0)
            & ((F.col("level") < 2) | F.col("evt_type").isNotNull())
            & ((F.col("level") < 4) | (F.col("attr") != ""))
        )
    )
    kind = (
        F.when(F.col("level") == 0, S.ROOT_TYPE)
        .when(F.col("level") == 1, S.BRANCH_TYPE)
        .when(F.col("level") == 2, _operation_type())
        .when(F.col("level") == 3, S.PROCESS_NODE_TYPE)
        .otherwise(_leaf_type())
    )
    return nodes.select(
        "container_name", "level", *S.PATH[1:], kind.alias("node_type"),
        F.when(F.col("level") == 4, F.col("subtree_events")).otherwise(0)
        .cast("bigint").alias("events_count"),
        F.col("subtree_events").cast("bigint").alias("subtree_events"),
        TS.order_seq(F.col("first_ord")).alias("first_seq"),
        TS.order_pos(F.col("first_ord")).alias("first_pos"),
        TS.from_micros(TS.order_micros(F.col("first_ord"))).alias("first_seen"),
        TS.from_micros(F.col("last_us")).alias("last_updated"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
    )


def rollup_counts(events: DataFrame) -> DataFrame:
    """Counts at branch, operation and process level of the tree."""
    is_leaf = F.col("attr") != ""
    return (
        path_counts(events).rollup("container_name", "branch", "evt_type", "proc_name")
        .agg(
            F.sum(F.when(is_leaf, F.col("n")).otherwise(0)).cast("bigint").alias("subtree_events"),
            F.sum(F.when(is_leaf, 0).otherwise(F.col("n"))).cast("bigint").alias("events"),
            F.grouping_id().alias("gid"),
        )
        .filter(F.col("gid") < 7)
        .select(
            "container_name", "branch", "evt_type", "proc_name",
            F.lit(0).cast("bigint").alias("events_count"), "subtree_events", "events",
        )
    )


def statistics(events: DataFrame) -> DataFrame:
    """Handled events per container and branch."""
    return known(events).groupBy(F.col("container_name").alias("container_id")).agg(
        F.count(F.lit(1)).alias("total_events"),
        *[F.count_if(F.col("category") == c).alias(f"{c}_events") for c in B.names()],
    )


def first_seen(events: DataFrame) -> DataFrame:
    """First occurrence of every operation, process and attribute key."""
    novel = path_counts(events).select(*S.PATH, "first_ord")
    return _keys_of(novel).select(
        "container_name", "branch", "level", "evt_type", "proc_name", "attr",
        TS.order_seq(F.col("first_ord")).alias("first_seq"),
        TS.from_micros(TS.order_micros(F.col("first_ord"))).alias("first_ts"),
    )


def _keys_of(novel: DataFrame) -> DataFrame:
    """Nodes of level 2 to 4 from the path table."""
    paths = novel.select(
        "container_name", "branch",
        F.when(F.col("attr") == "", 3).otherwise(4).alias("level"),
        "evt_type", "proc_name", F.nullif(F.col("attr"), F.lit("")).alias("attr"), "first_ord",
    )
    operations = novel_operations(novel).withColumn("level", F.lit(2))
    return paths.unionByName(operations, allowMissingColumns=True)


def learning_notices(rollup: DataFrame, cuts: DataFrame) -> DataFrame:
    """New nodes met while learning: all levels for processes, leaves for the others."""
    nodes = _keys_of(novel_paths(rollup)).filter(
        (F.col("branch") == "process") | (F.col("level") == 4)
    )
    joined = salted_lookup(
        nodes, cuts.select("container_name", "cut_ord"), ["container_name"],
        ["branch", "evt_type", "proc_name", "attr"],
    )
    key = F.coalesce(F.col("attr"), F.col("proc_name"), F.col("evt_type"))
    return joined.filter(
        F.col("cut_ord").isNull() | (F.col("first_ord") <= F.col("cut_ord"))
    ).select(
        "container_name", "branch", "level", key.alias("new_key"),
        TS.order_seq(F.col("first_ord")).alias("seq"),
        TS.from_micros(TS.order_micros(F.col("first_ord"))).alias("ts"),
    )


def novelty_rate(
    rollup: DataFrame, cuts: DataFrame, window_ms: int = S.QUIET_GAP_MS
) -> DataFrame:
    """Nodes that were new in the ``window_ms`` up to each moment with a new node.

    After the end of learning nothing is new: unknown nodes are alerts and stay unknown.

    Novelties are counted per millisecond first. Each row then also serves the next
    time cell, so the window splits by (container, cell) and no task holds more than
    two cells of one container.
    """
    met = salted_lookup(
        _keys_of(novel_paths(rollup)), cuts.select("container_name", "cut_ord"),
        ["container_name"], ["branch", "evt_type", "proc_name", "attr"],
    ).filter(F.col("cut_ord").isNull() | (F.col("first_ord") <= F.col("cut_ord")))
    per_ms = met.groupBy(
        "container_name", TS.order_millis(F.col("first_ord")).alias("ts_ms")
    ).agg(F.count(F.lit(1)).alias("new_nodes"))
    cell = TS.bucket(F.col("ts_ms"), window_ms)
    shared = per_ms.withColumn("home", cell).withColumn(
        "cell", F.explode(F.array(F.col("home"), F.col("home") + 1))
    )
    trailing = W.partitionBy("container_name", "cell").orderBy("ts_ms").rangeBetween(-window_ms, 0)
    return (
        shared.withColumn("novelty_count", F.sum("new_nodes").over(trailing))
        .filter(F.col("cell") == F.col("home"))
        .select("container_name", "ts_ms", "new_nodes", "novelty_count")
    )
