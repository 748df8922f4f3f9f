"""Maximal periodic stretches of words (runs), found by internal pattern matching.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), at
least ``max(least, 2 * q)`` long, that no neighbouring word extends keeping the period. All runs
of a text are found; the text without the repetitions keeps the first q words of each.

Method, for the texts of a few megabytes at a time, with numpy over all their words at once:

* Prefix doubling sorts the suffixes. Words of different texts never are equal, so after a
  level only those suffixes are sorted again whose first 2**k words occur twice in one text.
  Each level leaves names: the interval of the suffix array that starts with a block of 2**k words.
* A wavelet matrix over the suffix array answers range successor queries: the next place,
  from a given one on, at which the block of an interval occurs.
* A run of period q and length n holds, in its first n - q words, a block of 2**k words whose place
  is a multiple of 2**k, for the largest k with 2 * 2**k - 1 <= n - q; then q < 4 * 2**k. So every such
  dyadic block asks for its own occurrences in the 4 * 2**k - 2 words behind it. Distances to
  them are candidate periods. Occurrences at most half a block apart form a progression, whose difference
  is the block's period p: of the progression that the block itself is in, p is the only
  candidate; of a later one, those members that align the two stretches of period p at an end, or all
  where the stretches meet. So a level takes a few rounds of queries, however periodic the text.
* Each candidate is extended to both sides by the names (longest common extension, by halving). Of
  equal stretches the smallest period is the run's.

Time is n log n per text, memory too where texts are periodic throughout, else n. One text is the
work of one task; nothing is shuffled.

Rows: one per input row: ``doc_id``, ``n_words``, ``runs`` (by start, then period), ``collapsed``
(the words no run drops, joined by one blank). Null or empty text: no words, no runs. Repeated
rows repeat. An empty table gives no rows. Other columns do not matter. Words are known by 64-bit
hashes within their text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from runtime_insights.llm.arrays import chunks, joined_words, mix, span_hashes, strings, text_bytes, words
from runtime_insights.llm.tables import columns_or_null

LEAST = 12
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = (
    "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
)


class Suffixes:
    """The suffix array of several texts and, for each level k, the repeated blocks of 2**k words.

    ``levels[k]``: places of the blocks (ascending), and the interval of the array each lies in.
    """

    def __init__(self, h: np.ndarray, first: np.ndarray):
        n = len(h)
        doc = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
        end = np.repeat(first[1:], np.diff(first))
        keys = mix(h + mix(doc + np.uint64(1)))
        self.array = np.argsort(keys, kind="stable")  # equal keys by place, so by text
        self.rank = np.zeros(n, np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        slots, keys, of, width = np.arange(n), keys[self.array], doc[self.array], 1
        while True:
            # Slots hold groups of equal keys one after another; name each by its first slot.
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(slots)))
            low = np.repeat(slots[begin], size)
            places = self.array[slots]
            self.rank[places] = low
            many = np.repeat(size > 1, size)
            slots, places, low, high = slots[many], places[many], low[many], (low + np.repeat(size, size))[many]
            if not len(slots):
                return
            order = np.argsort(places)
            self.levels.append((places[order], low[order], high[order]))
            then = places + width
            inside = then < end[places]
            after = np.where(inside, self.rank[np.minimum(then, n - 1)] + 1, 0)
            keys = low * (n + 1) + after
            order = np.argsort(keys, kind="stable")
            keys, self.array[slots] = keys[order], places[order]
            of = doc[self.array[slots]]
            width *= 2

    def _same(self, k: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        places, low, _ = self.levels[k]
        a = np.minimum(np.searchsorted(places, x), len(places) - 1)
        b = np.minimum(np.searchsorted(places, y), len(places) - 1)
        return (places[a] == x) & (places[b] == y) & (low[a] == low[b])

    def extend(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from ``x`` and ``y`` on are the same."""
        done = np.zeros(len(x), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            done += self._same(k, x + done, y + done).astype(np.int64) << k
        return done

    def extend_back(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words that end before ``x`` and ``y`` are the same."""
        done = np.zeros(len(x), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            more = done + (1 << k)
            done += self._same(k, x - more, y - more).astype(np.int64) << k
        return done


class WaveletMatrix:
    """Range successor over an array of numbers, for many queries at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.zeros = []
        for bit in range(self.bits - 1, -1, -1):
            zero = (values >> bit) & 1 == 0
            self.zeros.append(np.concatenate(([0], np.cumsum(zero))).astype(np.int32))
            values = np.concatenate((values[zero], values[~zero]))

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest number >= ``least`` in [low, high) of the array; -1 if there is none."""
        a, b, below = low.astype(np.int64), high.astype(np.int64), np.zeros(len(low), np.int64)
        for level, zeros in enumerate(self.zeros):
            one = (least >> (self.bits - 1 - level)) & 1 == 1
            za, zb = zeros[a], zeros[b]
            below += np.where(one, zb - za, 0)
            a = np.where(one, zeros[-1] + a - za, za)
            b = np.where(one, zeros[-1] + b - zb, zb)
        found = (least < 1 << self.bits) & (below < high - low)
        a, b, want = low[found].astype(np.int64), high[found].astype(np.int64), below[found]
        value = np.zeros(len(a), np.int64)
        for level, zeros in enumerate(self.zeros):
            za, zb = zeros[a], zeros[b]
            one = want >= zb - za
            want = np.where(one, want - (zb - za), want)
            value |= one.astype(np.int64) << (self.bits - 1 - level)
            a = np.where(one, zeros[-1] + a - za, za)
            b = np.where(one, zeros[-1] + b - zb, zb)
        out = np.full(len(low), -1, np.int64)
        out[found] = value
        return out


def _candidates(s: Suffixes):
    """Places and distances at which a dyadic block occurs again: every run has one in it."""
    if len(s.levels) < 2:
        return
    known = s.levels[1][0]  # places of the repeated pairs: no other suffix is ever asked for
    among = np.zeros(len(s.array) + 1, np.int64)
    repeated = np.zeros(len(s.array), bool)
    repeated[known] = True
    in_order = repeated[s.array]
    np.cumsum(in_order, out=among[1:])
    tree = WaveletMatrix(np.searchsorted(known, s.array[in_order]))

    for k in range(1, len(s.levels)):
        block = 1 << k
        places, low, high = s.levels[k]
        chosen = places % block == 0
        i, a, b = places[chosen], among[low[chosen]], among[high[chosen]]
        reach = i + 4 * block - 2

        def following(of, place):
            """The next occurrence of the blocks ``of`` from ``place`` on; -1 beyond their reach."""
            at = tree.successor(a[of], b[of], np.searchsorted(known, place))
            out = np.where(at >= 0, known[np.maximum(at, 0)], -1)
            return np.where(out <= reach[of], out, -1)

        # The progression that the block itself is in.
        of = np.arange(len(i))
        at = following(of, i + 1)
        of, at = of[at >= 0], at[at >= 0]
        close = at - i[of] <= block // 2
        yield i[of[close]], at[close] - i[of[close]]
        last = i[of[close]]
        end = at[close] + s.extend(last, at[close])
        at[close] = following(of[close], end - block + 1)
        of, at = of[at >= 0], at[at >= 0]
        while len(of):
            after = following(of, at + 1)
            close = (after >= 0) & (after - at <= block // 2)
            yield i[of[~close]], at[~close] - i[of[~close]]
            if close.any():
                mine, j, p = i[of[close]], at[close], (after - at)[close]
                my_start, my_end = mine - s.extend_back(mine, mine + p), mine + p + s.extend(mine, mine + p)
                start, end = j - s.extend_back(j, j + p), j + p + s.extend(j, j + p)
                members = (np.minimum(end - block, reach[of[close]]) - j) // p + 1
                meet = start <= my_end
                count = members[meet]
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                yield np.repeat(mine[meet], count), np.repeat((j - mine)[meet], count) + step * np.repeat(p[meet], count)
                for shift in (end - my_end, start - my_start):
                    member = shift - (j - mine)
                    good = ~meet & (member >= 0) & (member % p == 0) & (member // p < members)
                    yield mine[good], shift[good]
                after[close] = following(of[close], end - block + 1)
            of, at = of[after >= 0], after[after >= 0]


def runs_of(h: np.ndarray, first: np.ndarray, least: int = LEAST):
    """Start (among all words), length and period of every run, by start, then period.

    ``h``: word hashes of several texts; ``first``: index of each text's first word (n + 1).
    """
    s = Suffixes(h, first)
    found = [np.zeros((0, 3), np.int64)]
    for place, period in _candidates(s):
        if not len(place):
            continue
        start = place - s.extend_back(place, place + period)
        length = place + period + s.extend(place, place + period) - start
        good = length >= np.maximum(least, 2 * period)
        found.append(np.unique(np.stack([start[good], length[good], period[good]], 1), axis=0))
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    # Of one stretch the smallest period; the others are its multiples.
    new = np.ones(len(every), bool)
    new[1:] = np.any(every[1:, :2] != every[:-1, :2], axis=1)
    every = every[new]
    return every[np.lexsort((every[:, 2], every[:, 0]))].T


def find_runs(
    docs: DataFrame, least: int = LEAST, reorder: Callable[[int | None, int], np.ndarray | None] | None = None
) -> DataFrame:
    """All runs of each text, and the text without repetitions.

    ``reorder`` may give, for a doc_id and its number of words, the words to read instead, by number.
    ``least`` is at least 12: shorter runs need blocks of one word, which are not asked for.
    """
    if least < LEAST:
        raise ValueError(f"least is {LEAST} or more")

    def work(batches):
        for chunk in chunks(batches, "text"):
            data, offsets = text_bytes(chunk.column("text"))
            starts, ends, first = words(data, offsets)
            if reorder is not None:
                order = np.arange(len(starts))
                for doc_id, begin, end in zip(chunk.column("doc_id").to_pylist(), first[:-1], first[1:]):
                    if end > begin and (other := reorder(doc_id, int(end - begin))) is not None:
                        order[begin:end] = begin + other
                starts, ends = starts[order], ends[order]
            start, length, period = runs_of(span_hashes(data, starts, ends), first, least)
            gone = np.zeros(len(starts) + 1, np.int64)
            np.add.at(gone, start + period, 1)
            np.add.at(gone, start + length, -1)
            kept = np.cumsum(gone[:-1]) == 0
            text, at = joined_words(data, starts[kept], ends[kept])
            before = np.concatenate(([0], np.cumsum(kept)))[first]
            begin = at[before[:-1]]
            cut = np.searchsorted(start, first)
            of = np.repeat(np.arange(len(first) - 1), np.diff(cut))
            values = [start - first[of], length, period]
            yield pa.RecordBatch.from_arrays([
                chunk.column("doc_id"), pa.array(np.diff(first), pa.int64()),
                pa.ListArray.from_arrays(
                    pa.array(cut, pa.int32()),
                    pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in values], fields=list(_RUN)),
                ),
                strings(text, begin, np.maximum(at[before[1:]] - 1, begin)),
            ], ["doc_id", "n_words", "runs", "collapsed"])

    return columns_or_null(docs, {"doc_id": "long", "text": "string"}).mapInArrow(work, _SCHEMA)


def planted_period(doc_id: int | None, n: int) -> np.ndarray | None:
    """A tenth of the documents, chosen by checksum, get a periodic end; without doc_id none does."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = find_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), reorder=planted_period)
    # The longest run; of equally long ones the first, then the one of the smallest period.
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        (-F.col("best.shorter")).alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * -best.shorter div best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256)
        .alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
