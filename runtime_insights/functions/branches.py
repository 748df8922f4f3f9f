"""The branches of a profile: which events belong to one, and what their attributes are.

A new branch is one registration; classification, paths, learning, trees and snapshots
go by the registry.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from runtime_insights import schema as S
from runtime_insights.functions import fields as X

_ATTRIBUTES = "array<struct<pos:int,attr:string,attr_type:string>>"


@dataclass(frozen=True)
class Branch:
    """``attributes`` gives an event's attributes as an array of (pos, attr, attr_type).

    ``leaf_type`` tells the node type of an attribute from the slot in which it first
    came (1 for the first attribute). ``closes`` tells which events may end learning.
    """

    name: str
    rules: tuple[str, ...]
    calls: tuple[str, ...]
    attributes: Callable[[], Column]
    leaf_type: Callable[[Column], Column]
    operation_type: str
    metric_calls: tuple[str, ...] = ()  # calls that only counters put into this category
    closes: Callable[[], Column] | None = None


_REGISTERED: dict[str, Branch] = {}


def register(branch: Branch) -> Branch:
    _REGISTERED[branch.name] = branch
    return branch


def unregister(name: str) -> None:
    _REGISTERED.pop(name, None)


def branches() -> tuple[Branch, ...]:
    return tuple(_REGISTERED.values())


def names() -> tuple[str, ...]:
    return tuple(_REGISTERED)


def attributes() -> Column:
    """Attributes of a flat event by its category; empty for an unknown one."""
    found = None
    for b in branches():
        one = b.attributes().cast(_ATTRIBUTES)
        is_it = F.col("category") == b.name
        found = F.when(is_it, one) if found is None else found.when(is_it, one)
    return F.coalesce(found, F.array().cast(_ATTRIBUTES))


def closes_learning() -> Column:
    """Whether an event may end learning."""
    found = F.lit(True)
    for b in branches():
        if b.closes is not None:
            found = found & ((F.col("category") != b.name) | b.closes())
    return found


def leaf_type(branch: Column, slot: Column) -> Column:
    found = None
    for b in branches():
        one = b.leaf_type(slot)
        found = F.when(branch == b.name, one) if found is None else found.when(branch == b.name, one)
    return found


def operation_type(branch: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for b in branches() for x in (b.name, b.operation_type)])
    return F.element_at(kinds, branch)


def _tokens() -> Column:
    return F.transform(
        X.command_tokens(F.col("cmdline")), lambda t, i: X.attribute(i, t, S.ARGUMENT_TYPE)
    )


def _peers() -> Column:
    remote = X.network_attribute(F.col("fd_name"), F.col("fd_type"))
    return F.filter(
        F.array(X.attribute(F.lit(0), remote, S.NETWORK_TYPE)), lambda a: a["attr"].isNotNull()
    )


register(Branch(
    "process", S.PROCESS_RULES, S.PROCESS_SYSCALLS, _tokens, lambda _: F.lit(S.ARGUMENT_TYPE),
    S.OPERATION_TYPES["process"],
))
register(Branch(
    "network", S.NETWORK_RULES, S.NETWORK_SYSCALLS, _peers, lambda _: F.lit(S.NETWORK_TYPE),
    S.OPERATION_TYPES["network"],
    metric_calls=tuple(c for c in S.NETWORK_SYSCALLS_METRICS if c not in S.NETWORK_SYSCALLS),
    closes=lambda: F.coalesce(F.col("fd_name"), F.lit("")) != "",
))
register(Branch(
    "file", S.FILE_RULES, S.FILE_SYSCALLS,
    lambda: X.file_attributes(F.col("fd_directory"), F.col("fd_name")),
    # A directory and a name may be the same text; the first one to come gives the type.
    lambda slot: F.when(slot == 1, S.DIRECTORY_TYPE).otherwise(S.FILE_TYPE),
    S.OPERATION_TYPES["file"],
))
