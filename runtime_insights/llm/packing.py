"""Best-fit packing of documents into bins, with conflicts.

A bin holds at most ``capacity`` words, and no two documents of one source or of one
duplicate cluster (texts that are equal but for case and white space). A longer document is
cut: its full pieces have bins of their own, its rest is packed like a document.

Documents are dealt to shards of about ``SHARD`` rows by a hash of a number given once when the
lengths are stored, so a hot source or cluster is spread evenly; a task packs one shard.
Longest first, each piece goes to the tightest bin that can take it: bins are ordered by
what is left in them, and from the first with enough room on the search goes to the next one
until neither the source's bit nor the cluster's bit is set in the bin's bitmaps. If none is
left a new bin is opened. Ties go to the earlier bin; pieces of equal length to the
smaller doc_id.

Rows: ``doc_id``, ``piece`` (from 0), ``bin_id``, ``position`` (words before it in the bin),
``n_words``. Null and empty texts are pieces of 0 words. Null sources conflict with each other
like any source; rows without doc_id come first. Repeated rows are documents of their own and,
being copies, never share a bin. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from runtime_insights.llm.arrays import chunks, text_bytes, words
from runtime_insights.llm.tables import columns_or_null, store

CAPACITY, SHARD = 2_048, 4_096


def _lengths(batches):
    for chunk in chunks(batches, "text"):
        data, offsets = text_bytes(chunk.column("text"))
        _, _, first = words(data, offsets)
        raw = data.tobytes()
        clusters = [
            xxhash.xxh3_64_intdigest(b" ".join(raw[a:b].lower().split())) for a, b in zip(offsets[:-1], offsets[1:])
        ]
        yield pa.RecordBatch.from_arrays(
            [chunk.column("doc_id"), chunk.column("source"), pa.array(np.diff(first), pa.int64()),
             pa.array(np.array(clusters, np.uint64).view(np.int64), pa.int64())],
            ["doc_id", "source", "n_words", "cluster"],
        )


def pack_shard(rows: list[tuple], capacity: int) -> list[tuple]:
    """Rows (doc_id, source, n_words, cluster) to (doc_id, piece, bin, position, n_words)."""
    out, bins = [], 0
    left: list[tuple[int, int]] = []  # (room, bin), in order
    sources: list[int] = []  # bitmap of each bin
    clusters: list[int] = []
    source_bit: dict = {}
    cluster_bit: dict = {}
    pieces = []
    for doc_id, source, n, cluster in rows:
        full = max(0, -(-n // capacity) - 1) if n else 0
        for piece in range(full):
            out.append((doc_id, piece, bins, 0, capacity))
            sources.append(-1)
            clusters.append(-1)
            bins += 1
        pieces.append((n - full * capacity, doc_id, full, source, cluster))
    pieces.sort(key=lambda p: (-p[0], p[1] is not None, p[1] or 0, p[2]))
    for n, doc_id, piece, source, cluster in pieces:
        s = 1 << source_bit.setdefault(source, len(source_bit))
        c = 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        at = bisect_left(left, (n, -1))
        while at < len(left) and (sources[left[at][1]] & s or clusters[left[at][1]] & c):
            at += 1
        if at < len(left):
            room, bin_ = left.pop(at)
        else:
            room, bin_ = capacity, bins
            sources.append(0)
            clusters.append(0)
            bins += 1
        sources[bin_] |= s
        clusters[bin_] |= c
        out.append((doc_id, piece, bin_, capacity - room, n))
        insort(left, (room - n, bin_))
    return out


def _pack(capacity: int):
    def pack(batches):
        current, held = None, []

        def rows():
            done = pack_shard(held, capacity)
            doc_id, piece, bin_, position, n = zip(*done)
            return pa.RecordBatch.from_arrays(
                [pa.array(doc_id, pa.int64()), pa.array(piece, pa.int32()),
                 pa.array([(current << 32) + b for b in bin_], pa.int64()),
                 pa.array(position, pa.int64()), pa.array(n, pa.int64())],
                ["doc_id", "piece", "bin_id", "position", "n_words"],
            )

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "doc_id", "source", "n_words", "cluster")]
            for shard, *row in zip(*columns):
                if shard != current:
                    if held:
                        yield rows()
                    current, held = shard, []
                held.append(tuple(row))
        if held:
            yield rows()

    return pack


def best_fit(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    lengths = store(
        columns_or_null(docs, {"doc_id": "long", "source": "string", "text": "string"})
        .mapInArrow(_lengths, "doc_id long, source string, n_words long, cluster long")
        .withColumn("row", F.monotonically_increasing_id()), "packing-lengths",
    )
    shards = max(1, -(-lengths.count() // shard))
    return (
        lengths.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
        .repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "row")
        .mapInArrow(_pack(capacity), "doc_id long, piece int, bin_id long, position long, n_words long")
    )


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return best_fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
