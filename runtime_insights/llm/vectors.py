"""Vectors in packed blocks, shared by the exact and the approximate search."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from runtime_insights.llm.arrays import pack, unpack

QUERY_STEP = 20  # queries are the rows whose vec_id is divisible by this


def usable(vectors: DataFrame, nonzero: bool, copies: int) -> DataFrame:
    """``vec_id``, ``embedding`` (array<double>): the rows that take part.

    Out are rows without vec_id, null vectors, those with a null or non-finite component, and
    with ``nonzero`` zero and empty vectors. Rows that share a vec_id are rows of their own; of equal
    rows (same vec_id and vector) ``copies`` stay, as many as a list of results can hold.
    Vectors may differ in length: a component that one of two vectors lacks counts as zero.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite
    )
    if nonzero:
        rows = rows.filter(F.exists("embedding", lambda x: x != 0))
    counted = rows.groupBy("vec_id", "embedding").agg(F.least(F.count("*"), F.lit(copies)).cast("int").alias("n"))
    return counted.select("vec_id", "embedding", F.explode(F.array_repeat(F.lit(0), F.col("n")))).drop("col")


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix; shorter lists are filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(lengths.max(initial=0))
    if len(flat) == width * len(lengths):
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def widened(x: np.ndarray, width: int) -> np.ndarray:
    """``x`` with ``width`` columns, the new ones zero."""
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def stacked(held: list[np.ndarray]) -> np.ndarray:
    """Matrices one below another, all as wide as the widest."""
    width = max(x.shape[1] for x in held)
    return np.concatenate([widened(x, width) for x in held])


def load(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of one block."""
    ids, flat = unpack(body)
    return ids, flat.reshape(len(ids), -1)


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices without the columns that only one has: those add nothing to a product."""
    width = min(a.shape[1], b.shape[1])
    return a[:, :width], b[:, :width]


def block_of(id_name: str, number: int) -> Column:
    """The block of a row, by all of it: rows that share an id are spread."""
    return F.pmod(F.xxhash64(id_name, "embedding"), F.lit(number))


def blocks(rows: DataFrame, size: int, id_name: str, count: int | None = None) -> tuple[DataFrame, int]:
    """Rows packed by about ``size``: ``block``, ``body`` (ids, flat components); number of blocks."""
    number = max(1, math.ceil((rows.count() if count is None else count) / size))

    def packed(batches):
        current, ids, values = None, [], []

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([current], pa.int32()),
                 pa.array([pack(np.concatenate(ids), stacked(values).ravel())], pa.binary())], ["block", "body"],
            )

        for batch in batches:
            block = batch.column(0).to_numpy()
            for b in np.unique(block):
                at = np.flatnonzero(block == b)
                if b != current:
                    if current is not None:
                        yield row()
                    current, ids, values = int(b), [], []
                ids.append(batch.column(1).to_numpy()[at])
                values.append(matrix(batch.column(2))[at])
        if current is not None:
            yield row()

    return (
        rows.select(block_of(id_name, number).cast("int").alias("block"), id_name, "embedding")
        .repartition(number, "block").sortWithinPartitions("block").mapInArrow(packed, "block int, body binary")
    ), number
