"""SimHash fingerprints and their near-duplicate components, by anchor points.

Fingerprints: 64 bits, each 1 if set in more than half of the XXH64 hashes (seed 42) of a
document's 3-word shingles (lower-cased A-Z, words between ASCII white space, repeats
included). Documents of one or two words have one shingle; without words the fingerprint is 0.

Links, by anchor-point covering: two fingerprints that differ in at most t bits differ in
at most 1 bit in one of t // 2 + 1 blocks. For each block the anchors are the code words of
a Hamming code (31 of the block's bits; covering radius 1, no two closer than 3): every
fingerprint is within 1 of an anchor. Each is sent to all anchors within radius + 1 = 2
bits, at most 16 of 2^26 per block, so any two linked ones meet at the anchor nearest to one
of them, where whole fingerprints are compared. Copies are joined to one fingerprint before.

An anchor's members are compared in tiles, and an anchor reports a spanning tree of its
links, not its pairs; a distributed union-find makes components of the trees. Anchors with
more than ``DENSE`` members are dealt again: their members also agree, up to the bits left,
in one of the quarters of the other block, and are compared per quarter.

Rows: one per input row: ``doc_id``, ``fingerprint``, ``component_id`` (smallest doc_id that
can be reached). Null and empty texts have fingerprint 0 and link to each other. Rows without
a doc_id take part; a component of such rows only has a null ``component_id``. An empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from runtime_insights.llm.arrays import chunks, runs, text_bytes
from runtime_insights.llm.tables import columns_or_null, components, discard, parts, row_key, store, unused

SEED, SHINGLE = 42, 3
DENSE = 4_096


def fingerprint(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Majority bits of each run of ``hashes`` (unsigned); runs must not be empty."""
    size = np.diff(np.append(begin, len(hashes)))
    out = np.zeros(len(begin), np.uint64)
    for bit in range(64):
        ones = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(1), begin)
        out |= (2 * ones.astype(np.int64) > size).astype(np.uint64) << np.uint64(bit)
    return out


def _fingerprints(batches):
    digest = xxhash.xxh64_intdigest
    for chunk in chunks(batches, "text"):
        data, offsets = text_bytes(chunk.column("text"))
        raw = data.tobytes()
        hashes: list[int] = []
        begin, rows = [], []
        for i in range(len(offsets) - 1):
            # bytes.lower and bytes.split know ASCII letters and ASCII white space only.
            found = raw[offsets[i] : offsets[i + 1]].lower().split()
            if not found:
                continue
            rows.append(i)
            begin.append(len(hashes))
            if len(found) <= SHINGLE:
                hashes.append(digest(b" ".join(found), SEED))
            else:
                hashes += [digest(b"%b %b %b" % t, SEED) for t in zip(found, found[1:], found[2:])]
        out = np.zeros(chunk.num_rows, np.uint64)
        if rows:
            out[rows] = fingerprint(np.array(hashes, np.uint64), np.array(begin))
        others = [c for c in chunk.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*[chunk.column(c) for c in others], pa.array(out.view(np.int64))], [*others, "f"]
        )


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id``, the columns ``keep`` (long), ``f``: the fingerprint as a signed 64-bit number."""
    kinds = {"doc_id": "long", **dict.fromkeys(keep, "long")}
    return columns_or_null(docs, {**kinds, "text": "string"}).mapInArrow(
        _fingerprints, ", ".join(f"{c} {kind}" for c, kind in kinds.items()) + ", f long"
    )


def _syndrome(block: np.ndarray) -> np.ndarray:
    """Hamming(31, 26): the position (1-31) of the bit that leads to the code word, 0 if on it."""
    s = np.zeros(len(block), np.uint64)
    for i in range(31):
        s ^= ((block >> np.uint64(i)) & np.uint64(1)) * np.uint64(i + 1)
    return s


def anchors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All code words within 2 bits of each 31-bit value: index of the value, code word."""
    s = _syndrome(values)
    one = np.uint64(1)
    index, words = [], []
    on = np.flatnonzero(s == 0)
    index.append(on)
    words.append(values[on])
    off = np.flatnonzero(s != 0)
    flip = lambda v, p: v ^ (one << (p - one))
    index.append(off)
    words.append(flip(values[off], s[off]))
    for p in range(1, 32):  # two flips p < q with p xor q = the syndrome
        q = s[off] ^ np.uint64(p)
        ok = off[q > p]
        index.append(ok)
        words.append(flip(flip(values[ok], np.uint64(p)), s[ok] ^ np.uint64(p)))
    return np.concatenate(index), np.concatenate(words)


def _to_anchors(batches):
    low = np.uint64((1 << 31) - 1)
    for batch in batches:
        f = batch.column("f").to_numpy().view(np.uint64)
        for block in (0, 1):
            index, words = anchors((f >> np.uint64(32 * block)) & low)
            yield pa.RecordBatch.from_arrays(
                [pa.array((words << np.uint64(1) | np.uint64(block)).astype(np.int64)), pa.array(f[index].view(np.int64))],
                ["anchor", "f"],
            )


def tree(values: np.ndarray, distance: int, tile: int = 1_024) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct ``values``."""
    parent = np.arange(len(values))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for a in range(0, len(values), tile):
        for b in range(a, len(values), tile):
            near = np.bitwise_count(values[a : a + tile, None] ^ values[None, b : b + tile]) <= distance
            left, right = np.nonzero(near)
            left, right = left + a, right + b
            # Links inside known components are dropped at once; the rest is few.
            while len(left):
                label = np.array([root(i) for i in np.unique(np.concatenate((left, right)))])
                names = np.unique(np.concatenate((left, right)))
                x, y = label[np.searchsorted(names, left)], label[np.searchsorted(names, right)]
                keep = np.flatnonzero(x != y)
                if not len(keep):
                    break
                left, right, x, y = left[keep], right[keep], x[keep], y[keep]
                # One link per root joins it to its smallest partner; repeat on what is left.
                high, low = np.maximum(x, y), np.minimum(x, y)
                order = np.lexsort((low, high))
                first = order[runs(high[order])[:-1]]
                for h, w, i, j in zip(high[first], low[first], left[first], right[first]):
                    if root(h) != root(w):
                        parent[root(h)] = root(w)
                        edges.append((int(values[i]), int(values[j])))
    return edges


def _compare(distance: int):
    def compare(batches):
        def finish(values):
            found = tree(np.unique(np.concatenate(values)).view(np.uint64), distance)
            a, b = (np.array(x, np.uint64).view(np.int64) for x in zip(*found)) if found else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        key, held = None, []
        for batch in batches:
            k, f = batch.column("anchor").to_numpy(), batch.column("f").to_numpy()
            cut = runs(k)
            for begin, end in zip(cut[:-1], cut[1:]):
                if k[begin] != key:
                    if sum(map(len, held)) > 1:
                        yield finish(held)
                    key, held = k[begin], []
                held.append(f[begin:end])
        if sum(map(len, held)) > 1:
            yield finish(held)

    return compare


def links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """A spanning set of the links between fingerprints: ``a``, ``b`` (each anchor's trees).

    ``distinct``: one row ``f`` per fingerprint.
    """
    assert distance in (2, 3), "two blocks of which one differs in at most one bit"
    spark = distinct.sparkSession
    at = store(distinct.mapInArrow(_to_anchors, "anchor long, f long"), "simhash-anchors")
    loads = at.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    meet = store(loads, "simhash-loads")
    together = at.join(meet, "anchor")
    other = F.when(F.col("anchor") % 2 == 0, F.shiftrightunsigned("f", 32)).otherwise(
        F.col("f").bitwiseAND(F.lit((1 << 32) - 1))
    )
    quarter = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j")
    dense = together.filter(F.col("n") > DENSE).select("anchor", "f", quarter).withColumn(
        "anchor",
        F.xxhash64("anchor", "j", other.bitwiseAND(F.expr("shiftleft(255L, 8 * j)"))),
    ).select("anchor", "f")
    rows = together.filter(F.col("n") <= DENSE).select("anchor", "f").union(dense)
    found = (
        rows.repartition(2 * parts(spark), "anchor").sortWithinPartitions("anchor")
        .mapInArrow(_compare(distance), "a long, b long")
    )
    found = store(found.distinct(), "simhash-links")
    discard(at, meet)
    return found


def _labels(prints: DataFrame, distance: int) -> DataFrame:
    """``f``, ``component`` (its smallest fingerprint), ``component_id`` for every fingerprint."""
    per_print = store(prints.groupBy("f").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    member = components(links(per_print.select("f").repartition(parts(prints.sparkSession), "f"), distance))
    member = store(member.withColumnRenamed("node", "f"), "simhash-members")
    grouped = per_print.join(member, "f", "left").withColumn("component", F.coalesce("component", "f"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    label = store(grouped.join(least, "component").select("f", "component", "component_id"), "simhash-labels")
    discard(per_print, member)
    return label


def near_duplicates(docs: DataFrame, distance: int = 3) -> DataFrame:
    """Per input row: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``."""
    prints = store(fingerprints(docs), "simhash-prints")
    return prints.join(_labels(prints, distance), "f").select(
        "doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame, distance: int = 3) -> DataFrame:
    """``docs`` with one row of each component: smallest doc_id, then smallest content hash.

    Rows without doc_id come after all others. All columns as they are.
    """
    key, times = unused(docs.columns, "row", "times")
    keyed = docs.withColumn(key, row_key("doc_id", "text"))
    prints = store(fingerprints(keyed, key), "simhash-prints")
    labelled = prints.join(_labels(prints, distance), "f")
    best = labelled.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(key).alias("row"))).alias("best")
    ).select(F.col("best.row").alias(key))
    stay = store(prints.join(best, key).groupBy(key).agg(F.count("*").alias(times)), "simhash-stay")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # Equal rows share the key; only they have to be thinned out.
    single = keyed.join(stay.filter(F.col(times) == 1).select(key), key, "left_semi")
    repeated = keyed.join(stay.filter(F.col(times) > 1).select(key), key, "left_semi").dropDuplicates([key])
    return single.select(*columns).union(repeated.select(*columns))


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
