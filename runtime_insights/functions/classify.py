"""Event categories, priorities and severities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from runtime_insights import schema as S
from runtime_insights.functions.branches import branches


def lookup(entries: dict[str, str], key: Column) -> Column:
    """Value of a constant map of plain words, null if absent.

    Far less generated code than a CASE.
    """
    quoted = ", ".join(f"'{x}'" for pair in entries.items() for x in pair)
    return F.try_element_at(F.expr(f"map({quoted})"), key)


def _category(rule: Column, evt_type: Column, metric: bool) -> Column:
    by_rule = {w: b.name for b in branches() for w in b.rules}
    by_call = {w: b.name for b in branches() for w in b.calls + (b.metric_calls if metric else ())}
    return F.coalesce(
        lookup(by_rule, F.lower(rule)), lookup(by_call, F.lower(evt_type)), F.lit("unknown")
    )


def profile_category(rule: Column, evt_type: Column) -> Column:
    """Category that routes an event to a profile branch.

    ``evt_type`` is the event's top-level one; a null rule is malformed and is
    rejected at ingest, not here.
    """
    return _category(rule, evt_type, False)


def metrics_category(rule: Column, evt_type: Column) -> Column:
    """Category used as a counter label; also knows ``listen`` and ``bind``."""
    return _category(rule, evt_type, True)


def priority_rank(priority: Column) -> Column:
    """0 for the most severe level to 7 for the least; null for an unknown word."""
    word = F.lower(priority)
    word = F.when(word == "informational", "info").otherwise(word)
    position = F.array_position(F.array(*[F.lit(p) for p in S.PRIORITIES]), word)
    return F.when(position > 0, (position - 1).cast("int"))


def at_least(priority: Column, minimum: str) -> Column:
    """True where ``priority`` is as severe as ``minimum`` or more so."""
    return priority_rank(priority) <= F.lit(S.PRIORITIES.index(minimum.lower()))


def severity(priority: Column) -> Column:
    """info, warn or error tag for stream records."""
    rank = priority_rank(priority)
    return (
        F.when(rank <= S.PRIORITIES.index("error"), "error")
        .when(rank <= S.PRIORITIES.index("warning"), "warn")
        .otherwise("info")
    )
