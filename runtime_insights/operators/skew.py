"""Joins that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from runtime_insights.functions.timestamps import bucket

SALTS = 16
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20


def is_small(dim: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``dim`` has at most ``rows`` rows and ``BROADCAST_BYTES`` bytes of values.

    Reads no more of it than ``rows`` + 1 rows.
    """
    text = [F.coalesce(F.octet_length(F.col(f"`{n}`").cast("string")), F.lit(8)) for n in dim.columns]
    width = sum(text[1:], text[0]).cast("bigint")
    found = dim.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return found[0] <= rows and found[1] <= BROADCAST_BYTES


def salted_lookup(
    facts: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """Join ``facts`` to ``dim``, a stored table that is unique on ``keys``.

    A ``dim`` counted to be small is broadcast, and the facts stay where they are.
    Beyond that the rows of one key are spread over ``salts`` tasks by a hash of the
    ``spread`` columns, and each ``dim`` row is repeated once per salt.
    """
    if is_small(dim):
        return facts.join(F.broadcast(dim), list(keys), how)
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def cells(lo: Column, hi: Column, width: int) -> Column:
    """Grid cells of ``width`` touched by the closed integer range [lo, hi]."""
    return F.sequence(bucket(lo, width), bucket(hi, width))
