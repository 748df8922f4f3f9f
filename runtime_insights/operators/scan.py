"""Running values over one key's rows that no single task has to hold.

A window partitioned by a container or series puts all rows of a hot one in one task. Here the order is
cut into ranges: each (key, range) is scanned by itself, then one row per range is scanned the same way,
and what came before a range joins its rows. Levels are added until a range spans at most ``FAN`` places of
the order, so no task sorts more of one key than that.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from runtime_insights.functions import timestamps as TS
from runtime_insights.session import materialize

FAN = 65_536

#: How a row's value joins those before it: over a frame, over the rows of a range, and two results.
_WAYS = {
    "sum": (F.sum, lambda v, order: F.sum(v), lambda a, b: F.coalesce(a + b, a, b)),
    "max": (F.max, lambda v, order: F.max(v), lambda a, b: F.greatest(a, b)),
    "last": (
        lambda v: F.last(v, ignorenulls=True),
        lambda v, order: F.max_by(v, F.when(v.isNotNull(), order)),
        lambda a, b: F.coalesce(b, a),
    ),
}


def scan_before(
    rows: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, tuple[str, str]],
    span: tuple[int, int] | None = None,
) -> DataFrame:
    """``rows`` with, for each (name: (column, way)) of ``values``, what the earlier rows of the key come to.

    ``order`` is a whole number, unique per key; ways are ``sum``, ``max`` and ``last`` (latest that is
    not null); null where nothing came before. Nulls are a key like others. ``span`` is the smallest and largest ``order``
    where the caller knows it. Beyond one range ``rows`` are stored, as they are read twice.
    """
    if span is None:
        rows = materialize(rows, "scanned")
        span = tuple(rows.agg(F.min(order), F.max(order)).first())
    if span[0] is None:
        span = (0, 0)
    single = span[1] - span[0] < FAN
    if not single:
        rows = materialize(rows, "scan-rows")
    # A name of this level's own, as levels are scanned by their ranges.
    of = f"_{order}_range"
    marked = rows.withColumn(of, TS.bucket(F.col(order) - F.lit(span[0]), FAN))
    earlier = W.partitionBy(*keys, of).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    local = marked.select(
        "*", *[_WAYS[way][0](F.col(column)).over(earlier).alias(name) for name, (column, way) in values.items()])
    if single:
        return local.drop(of)
    totals = marked.groupBy(*keys, of).agg(
        *[_WAYS[way][1](F.col(column), F.col(order)).alias(f"_all_{name}") for name, (column, way) in values.items()])
    carried = scan_before(
        materialize(totals, "scan-ranges"), keys, of,
        {f"_carried_{name}": (f"_all_{name}", way) for name, (_, way) in values.items()},
        (0, (span[1] - span[0]) // FAN),
    )
    # Joined null-safe, under other names.
    carried = carried.select(
        *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], F.col(of).alias("_of_range"),
        *[f"_carried_{name}" for name in values])
    met = F.col(of) == F.col("_of_range")
    for i, key in enumerate(keys):
        met = met & F.col(key).eqNullSafe(F.col(f"_key_{i}"))
    joined = local.join(carried, met)
    whole = [
        _WAYS[way][2](F.col(f"_carried_{name}"), F.col(name)).alias(name) for name, (_, way) in values.items()]
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], *whole)


def ordered_span(rows: DataFrame, order: Column) -> tuple[int, int]:
    """The smallest and largest place of the order."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    return (0, 0) if low is None else (low, high)
