"""Removal of repeated word windows, counted exactly in super-k-mer buckets.

A window is ``window`` consecutive words of one document. A word goes if it lies in a window
whose word sequence also starts somewhere else, in this or another document. All windows are
judged on the input.

Plan. Every window has a minimiser: the smallest hash among its ``gram``-word grams, the
leftmost if several are equal. Consecutive windows with one minimiser form a super-k-mer;
its words travel once, as text, to the bucket of the minimiser, together with the others of
its block of documents and bucket in one packed row. Equal windows have equal minimisers, so
a bucket sees all copies of its windows; it sorts their 128-bit digests (of whole words) and
reports those that occur twice or more, as runs per document. Reports are joined to the
documents once.

Hot minimisers (a passage that very many documents hold) are found first: those that occur
at least ``_LOCAL`` times in a block and, over such blocks, in at least 1 of ``_HOT`` super-k-mers:
fewer than ``_HOT`` of them, so they are broadcast. Their windows do not travel as super-k-mers.
Each block sums them by digest, reports those it has twice itself, and sends one count per digest to the
digest's bucket: a bucket gets at most one row per block for any window.

Rows: one per input row: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``. Null or
empty text: no words. Repeated rows are documents of their own. Fewer words than a window:
nothing goes. Rows without doc_id take part. An empty table gives no rows. Equal digests of
different windows (two independent 64-bit hashes) are taken for equal; at 10^13 windows the
chance that any exist is below 10^-12.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from runtime_insights.llm.arrays import (
    chunks, gather, id_array, id_column, joined_words, mix, pack, runs, span_hashes, text_bytes, unpack, words,
)
from runtime_insights.llm.tables import columns_or_null, discard, parts, row_key, store

WINDOW, GRAM = 35, 6
_BLOCK = 6 << 20
_LOCAL, _HOT = 8, 4_096
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def rolling(h: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """A hash of every ``width`` consecutive values: sum of h[i + j] * base**j, mod 2**64."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(base, len(h)), out=sums[1:])
    inverse = np.uint64(pow(int(base), -1, 2**64))
    return (sums[width:] - sums[:n]) * _powers(inverse, n)


def super_kmers(h: np.ndarray, first: np.ndarray, window: int, gram: int):
    """First word, number of windows and minimiser of each super-k-mer.

    ``h``: word hashes of several texts; ``first``: index of each text's first word (n + 1).
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(h) - window + 1
    if n <= 0:
        return none
    g = mix(rolling(h, gram, _BASES[0]))
    value, place, length, span = g, np.arange(len(g)), 1, window - gram + 1

    def left_least(shift):
        count = len(value) - shift
        later = value[shift:] < value[:count]
        return np.where(later, value[shift:], value[:count]), np.where(later, place[shift:], place[:count])

    while 2 * length <= span:
        value, place = left_least(length)
        length *= 2
    if length < span:
        value, place = left_least(span - length)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.flatnonzero(doc[:n] == doc[window - 1 :])
    if not len(inside):
        return none
    at = place[inside]
    new = np.flatnonzero((inside[1:] != inside[:-1] + 1) | (at[1:] != at[:-1])) + 1
    begin = np.concatenate(([0], new))
    return inside[begin], np.diff(np.append(begin, len(inside))), g[at[begin]]


def _expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each run."""
    total = int(count.sum())
    return np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(total)


def _hashes(data, starts, ends):
    return span_hashes(data, starts, ends, 1), span_hashes(data, starts, ends, 2)


def _by_digest(d1: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal digests together, and where each group begins (and the end)."""
    order = np.argsort(d1, kind="stable")
    a, b = d1[order], d2[order]
    if np.any((a[1:] == a[:-1]) & (b[1:] != b[:-1])):
        order = np.lexsort((d2, d1))
        a, b = d1[order], d2[order]
    if not len(a):
        return order, np.zeros(1, np.int64)
    cut = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
    return order, np.concatenate(([0], cut, [len(a)]))


def _as_runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as runs of consecutive ones: document, first window, number."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.flatnonzero((doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    begin = np.concatenate(([0], new)) if len(doc) else np.zeros(0, np.int64)
    return doc[begin], start[begin], np.diff(np.append(begin, len(doc)))


def _hot_minimisers(docs: DataFrame, window: int, gram: int) -> np.ndarray:
    def count(batches):
        for chunk in chunks(batches, "text", _BLOCK):
            data, offsets = text_bytes(chunk.column("text"))
            starts, ends, first = words(data, offsets)
            _, _, least = super_kmers(span_hashes(data, starts, ends, 1), first, window, gram)
            value, n = np.unique(least, return_counts=True)
            often = n >= _LOCAL
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *value[often].view(np.int64).tolist()], pa.int64()),
                 pa.array([len(least), *n[often].tolist()], pa.int64())], ["least", "n"],
            )

    counted = store(
        docs.select("text").mapInArrow(count, "least long, n long").groupBy("least").agg(F.sum("n").alias("n")),
        "substring-hot",
    )
    total = counted.filter("least IS NULL").agg(F.sum("n")).head()[0] or 0
    # Fewer than _HOT rows: each has more than 1 of _HOT of all super-k-mers.
    hot = counted.filter(F.col("least").isNotNull() & (F.col("n") * _HOT > total)).toArrow().column("least")
    discard(counted)
    return np.sort(hot.to_numpy().astype(np.int64).view(np.uint64))


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Runs of repeated windows: ``doc_id``, ``row`` (key of the content), ``start``, ``n``.

    ``docs``: ``doc_id``, ``text``, ``row``.
    """
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(_hot_minimisers(docs, window, gram))
    buckets = 4 * parts(spark)

    def split(batches):
        for chunk in chunks(batches, "text", _BLOCK):
            data, offsets = text_bytes(chunk.column("text"))
            ids, keys = id_array(chunk.column("doc_id")), chunk.column("row").to_numpy()
            starts, ends, first = words(data, offsets)
            h1 = span_hashes(data, starts, ends, 1)
            start, count, least = super_kmers(h1, first, window, gram)
            doc = np.searchsorted(first, start, side="right") - 1
            rows = []
            is_hot = np.isin(least, hot.value) if len(hot.value) else np.zeros(len(least), bool)
            if is_hot.any():
                h2 = span_hashes(data, starts, ends, 2)
                at = _expand(start[is_hot], count[is_hot])
                d1, d2 = rolling(h1, window, _BASES[0])[at], rolling(h2, window, _BASES[1])[at]
                of = np.repeat(doc[is_hot], count[is_hot])
                order, cut = _by_digest(d1, d2)
                times = np.diff(cut)
                twice = order[np.repeat(times > 1, times)]
                if len(twice):
                    d, s, n = _as_runs(of[twice], at[twice] - first[of[twice]])
                    rows.append((int(keys[d[0]]) % buckets, 2, pack(ids[d], keys[d], s.astype(np.uint64), n.astype(np.uint64))))
                one = order[cut[:-1]]
                bucket = (mix(d1[one]) % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                edge = np.searchsorted(bucket[by], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(edge)):
                    p = by[edge[b] : edge[b + 1]]
                    w = one[p]
                    rows.append((int(b), 1, pack(
                        d1[w], d2[w], times[p].astype(np.uint64), (at[w] - first[of[w]]).astype(np.uint64),
                        ids[of[w]], keys[of[w]],
                    )))
            start, count, least, doc = (x[~is_hot] for x in (start, count, least, doc))
            text, begin = joined_words(data, starts, ends)
            bucket = (mix(least) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[by], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edge)):
                p = by[edge[b] : edge[b + 1]]
                body, _ = gather(text, begin[start[p]], begin[start[p] + count[p] + window - 1])
                used, local = np.unique(doc[p], return_inverse=True)
                rows.append((int(b), 0, pack(
                    body, count[p].astype(np.uint64), local.astype(np.uint64),
                    (start[p] - first[doc[p]]).astype(np.uint64), ids[used], keys[used],
                )))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))],
                    ["bucket", "kind", "body"],
                )

    def windows_of(blob):
        body, count, local, start, ids, keys = unpack(blob)
        count = count.astype(np.int64)
        starts, ends, _ = words(body, np.array([0, len(body)]))
        h1, h2 = _hashes(body, starts, ends)
        size = count + window - 1  # words of each super-k-mer
        at = _expand(np.concatenate(([0], np.cumsum(size)[:-1])), count)
        of = np.repeat(local.astype(np.int64), count)
        return (
            rolling(h1, window, _BASES[0])[at], rolling(h2, window, _BASES[1])[at],
            _expand(start.astype(np.int64), count), ids[of], keys[of],
        )

    def report(ids, keys, start, n):
        return pa.RecordBatch.from_arrays(
            [id_column(ids), pa.array(keys, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32())],
            ["doc_id", "row", "start", "n"],
        )

    def judge(parts_, counted):
        d1, d2, start, ids, keys = (np.concatenate(x) for x in zip(*[p[:5] for p in parts_]))
        times = np.concatenate([p[5] for p in parts_]) if counted else np.ones(len(d1), np.int64)
        order, cut = _by_digest(d1, d2)
        if not len(order):
            return None
        total = np.add.reduceat(times[order], cut[:-1])
        again = order[np.repeat(total > 1, np.diff(cut)) & (times[order] == 1)]
        if not len(again):
            return None
        # Documents by (key, id), so that runs do not join across documents.
        _, number = np.unique(keys[again].view(np.uint64) ^ mix(ids[again].view(np.uint64)), return_inverse=True)
        doc, begin, n = _as_runs(number, start[again])
        some = np.zeros(number.max() + 1, np.int64)
        some[number] = again
        return report(ids[some[doc]], keys[some[doc]], begin, n)

    def count_bucket(batches):
        current, held = None, {0: [], 1: []}

        def finish():
            for kind in (0, 1):
                if held[kind] and (found := judge(held[kind], kind == 1)) is not None:
                    yield found

        for batch in batches:
            for bucket, kind, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if bucket != current:
                    yield from finish()
                    current, held = bucket, {0: [], 1: []}
                if kind == 0:
                    held[0].append(windows_of(body.as_py()))
                elif kind == 1:
                    d1, d2, times, start, ids, keys = unpack(body.as_py())
                    held[1].append((d1.astype(np.uint64), d2.astype(np.uint64), start.astype(np.int64), ids, keys, times.astype(np.int64)))
                else:
                    ids, keys, start, n = unpack(body.as_py())
                    yield report(ids, keys, start.astype(np.int32), n.astype(np.int32))
        yield from finish()

    return (
        docs.select("doc_id", "row", "text").mapInArrow(split, "bucket int, kind int, body binary")
        .repartition(2 * parts(spark), "bucket").sortWithinPartitions("bucket")
        .mapInArrow(count_bucket, "doc_id long, row long, start int, n int")
    )


def _keep(window: int):
    def keep(batches):
        for chunk in chunks(batches, "text", _BLOCK):
            data, offsets = text_bytes(chunk.column("text"))
            starts, ends, first = words(data, offsets)
            lists = chunk.column("spans").cast(pa.large_list(pa.struct([("start", pa.int32()), ("n", pa.int32())])))
            spans = lists.flatten()
            of = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            begin = first[of] + spans.field(0).to_numpy()
            end = begin + spans.field(1).to_numpy() + window - 1
            cover = np.zeros(len(starts) + 1, np.int64)
            np.add.at(cover, begin, 1)
            np.add.at(cover, end, -1)
            kept = np.cumsum(cover[:-1]) == 0
            text, at = joined_words(data, starts[kept], ends[kept])
            before = np.concatenate(([0], np.cumsum(kept)))[first]  # kept words before each text
            raw = text.tobytes()
            digests = [
                hashlib.sha256(raw[at[a] : at[b] - 1] if b > a else b"").hexdigest()
                for a, b in zip(before[:-1], before[1:])
            ]
            n = np.diff(first)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array(n, pa.int64()), pa.array(n - np.diff(before), pa.int64()),
                 pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return keep


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    assert 1 <= gram <= window
    docs = columns_or_null(docs, {"doc_id": "long", "text": "string"}).withColumn("row", row_key("doc_id", "text"))
    found = store(repeated_windows(docs, window, gram), "substring-repeats")
    spans = found.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "n")).alias("spans")).select(
        F.col("doc_id").alias("d"), F.col("row").alias("r"), "spans"
    )
    joined = docs.join(spans, (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(
        _keep(window), "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 34)) AS i, ws FROM d WHERE len(ws) >= 35),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS h FROM w),
r AS (SELECT doc_id, i FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS i FROM r),
g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
t AS (SELECT d.doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
kept AS (SELECT t.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY t.i) AS body
         FROM t ANTI JOIN gone ON t.doc_id = gone.doc_id AND t.i = gone.i GROUP BY t.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
