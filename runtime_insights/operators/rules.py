"""Rules: matching, priorities, output templates and appended fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field as dataclass_field

from pyspark.sql import Column, DataFrame, functions as F

from runtime_insights import schema as S
from runtime_insights.functions import fields as X


@dataclass(frozen=True)
class Rule:
    """A named predicate with its output fields; the list order is the match order."""

    name: str
    predicate: Column
    output: Sequence[str] = ()
    priority: str = "DEBUG"
    source: str = "syscall"
    enabled: bool = True
    tags: Sequence[str] = dataclass_field(default_factory=tuple)


def default_rules(category: Column, proc_name: Column) -> list[Rule]:
    named = F.coalesce(proc_name, F.lit(S.MISSING_FIELD)) != S.MISSING_FIELD
    return [
        Rule("process", (category == "process") & named, S.PROCESS_RULE_FIELDS),
        Rule("net", (category == "network") & named, S.NETWORK_RULE_FIELDS),
        Rule("file", (category == "file") & named, S.FILE_RULE_FIELDS),
    ]


def _active(rules: Sequence[Rule]) -> list[Rule]:
    return [r for r in rules if r.enabled]


def first_match(rules: Sequence[Rule]) -> Column:
    """Name of the first enabled rule that holds, null if none does."""
    chain = F.lit(None).cast("string")
    for rule in reversed(_active(rules)):
        chain = F.when(rule.predicate, rule.name).otherwise(chain)
    return chain


def all_matches(rules: Sequence[Rule]) -> Column:
    """Names of all enabled rules that hold, in order."""
    hits = F.array(*[F.when(r.predicate, r.name) for r in _active(rules)])
    return F.filter(hits, lambda name: name.isNotNull())


def match(events: DataFrame, rules: Sequence[Rule], mode: str = "first") -> DataFrame:
    """Events with ``matched_rule``: one row per event, or per match in mode ``all``."""
    if mode == "first":
        matched = events.withColumn("matched_rule", first_match(rules))
        return matched.filter(F.col("matched_rule").isNotNull())
    return events.withColumn("matched_rule", F.explode(all_matches(rules)))


def _per_rule(rule: Column, rules: Sequence[Rule], make) -> Column:
    chain = None
    for r in _active(rules):
        chain = F.when(rule == r.name, make(r)) if chain is None else chain.when(rule == r.name, make(r))
    return chain


def rule_output(fields: Column, rule: Column, rules: Sequence[Rule]) -> Column:
    """The rule's formatted output line."""
    return _per_rule(rule, rules, lambda r: X.output_line(fields, r.output))


def rule_fields(fields: Column, rule: Column, rules: Sequence[Rule]) -> Column:
    """Only the fields the rule asks for."""
    return _per_rule(rule, rules, lambda r: X.keep_fields(fields, r.output))


@dataclass(frozen=True)
class Append:
    """Extra fields for events that meet all given conditions."""

    extra_fields: Mapping[str, Column]
    rule: str | None = None
    source: str | None = None
    tags: Sequence[str] = ()


def append_fields(
    fields: Column, rule: Column, source: Column, tags: Column, entries: Sequence[Append]
) -> Column:
    """``fields`` plus the extra ones; a later entry replaces an earlier value."""
    extras = []
    for entry in entries:
        holds = F.lit(True)
        if entry.rule is not None:
            holds &= F.coalesce(rule == entry.rule, F.lit(False))
        if entry.source is not None:
            holds &= F.coalesce(source == entry.source, F.lit(False))
        if entry.tags:
            wanted = F.array(*map(F.lit, entry.tags))
            present = F.coalesce(tags, F.array().cast("array<string>"))
            holds &= F.size(F.array_except(wanted, present)) == 0
        extras.append((holds, entry.extra_fields))
    added = fields
    for holds, values in extras:
        new = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
        kept = F.map_filter(added, lambda k, _: ~k.isin(*values))
        added = F.when(holds, F.map_concat(kept, new)).otherwise(added)
    return added


def record(
    rules: Sequence[Rule], include_output: bool = False, include_message: bool = False,
    include_fields: bool = True, include_tags: bool = True,
) -> Column:
    """JSON record of a matched event (``matched_rule``, ``fields``, envelope columns).

    ``message`` is the rule's formatted output, ``output`` the same after time and
    priority. A switched-off property is left out.
    """
    message = rule_output(F.col("fields"), F.col("matched_rule"), rules)
    parts = [F.col("hostname"), F.col("priority"), F.col("matched_rule").alias("rule"), F.col("source")]
    if include_output:
        head = F.concat(F.date_format("ts", "HH:mm:ss.SSSSSS"), F.lit(": "), F.initcap("priority"))
        parts.append(F.concat(head, F.lit(" "), message).alias("output"))
    if include_message:
        parts.append(message.alias("message"))
    if include_fields:
        kept = rule_fields(F.col("fields"), F.col("matched_rule"), rules)
        parts.append(kept.alias("output_fields"))
    if include_tags:
        parts.append(F.col("tags"))
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
