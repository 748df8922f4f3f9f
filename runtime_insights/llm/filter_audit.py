"""How five quality filters overlap, in every order, from a sparse document-term matrix.

A document fails A if it has fewer than 200 words, B if fewer than half of its words are
different, C if more than 3 of 100 characters are capitals A-Z, D if it holds one of ``#$%&*|``,
E if its text is that of a document with a smaller doc_id, in the whole table.

Plan.

1. Documents are read once. Each block of them becomes a shard: its distinct words, sorted by
   hash, its matrix with local word numbers, and what C, D and E need of each text.
2. Words go to dictionary buckets, which are ranges of the hash, one packed row per shard and
   bucket, and come back as global numbers. A bucket meets a frequent word once per shard. The number
   of buckets follows from the number of distinct words, estimated from the smallest hashes of all shards.
3. Numbers are put into the shards: rows of the table are CSR matrices (``doc_id``, ``indptr``,
   ``indices``, ``data``). Row sums are the numbers of words, nonzero counts those of distinct ones.
4. Documents are counted by part and the set of filters they fail (with digest of the text first, so that
   a text of very many copies is a few rows before its smallest doc_id is looked up). All figures of
   all orders follow from these at most 32 counts per part.

Rows of ``audit``: for each part (language; null is the empty string), order and step one, see the
query. Null text is empty, fails A only. Rows without doc_id have no smaller doc_id and are none. Repeated rows
are documents of their own, none smaller than the other. A document with several labels counts as good
or toxic if one of them says so. An empty table gives no rows. Other columns do not matter. Texts are the same if
their SHA-256 is; words are compared as they are.
"""

from __future__ import annotations

import hashlib
import json
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from runtime_insights.llm.arrays import chunks, joined_words, pack, span_hashes, strings, text_bytes, unpack, words
from runtime_insights.llm.tables import columns_or_null, parts, store

FILTERS = "ABCDE"
SPECIAL = b"#$%&*|"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT = 200, 50, 3
_BLOCK = 4 << 20
_SKETCH = 256
#: Distinct words that one dictionary bucket should hold.
_BUCKET_WORDS = 500_000

_DOC = pa.struct([
    ("doc_id", pa.int64()), ("part", pa.string()), ("capitals", pa.int64()), ("points", pa.int64()),
    ("special", pa.bool_()), ("digest", pa.binary()),
])
_DOC_SQL = "struct<doc_id: long, part: string, capitals: long, points: long, special: boolean, digest: binary>"


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _shard(batches):
    """One row for each block of documents."""
    task, number = TaskContext.get().partitionId(), 0
    for chunk in chunks(batches, "text", _BLOCK):
        data, offsets = text_bytes(chunk.column("text"))
        starts, ends, first = words(data, offsets)
        coded = strings(data, starts, ends).dictionary_encode()
        body, at = text_bytes(coded.dictionary)
        h = span_hashes(body, at[:-1], at[1:])
        order = np.argsort(h, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc = np.repeat(np.arange(chunk.num_rows), np.diff(first))
        width = max(len(order), 1)
        cells, times = np.unique(doc * width + place[coded.indices.to_numpy()], return_counts=True)
        indptr = np.searchsorted(cells, np.arange(chunk.num_rows + 1) * width)

        def per_text(mark):
            return np.diff(np.concatenate(([0], np.cumsum(mark)))[offsets])

        raw = data.tobytes()
        docs = pa.StructArray.from_arrays([
            chunk.column("doc_id"), chunk.column("part"),
            pa.array(per_text((data >= 65) & (data <= 90)), pa.int64()),
            pa.array(per_text(data & 0xC0 != 0x80), pa.int64()),
            pa.array(per_text(np.isin(data, np.frombuffer(SPECIAL, np.uint8))) > 0),
            pa.array([hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary()),
        ], fields=list(_DOC))
        body, _ = joined_words(body, at[:-1][order], at[1:][order])
        yield pa.RecordBatch.from_arrays([
            pa.array([(task << 32) + number], pa.int64()), _one_list(docs),
            pa.array([pack(body)], pa.binary()),
            _one_list(pa.array((h[order[:_SKETCH]] >> np.uint64(1)).astype(np.int64))),
            pa.array([pack(*[x.astype(np.uint64) for x in (indptr, cells % width, times)])], pa.binary()),
        ], ["shard", "docs", "words", "least", "cells"])
        number += 1


def shards(docs: DataFrame) -> DataFrame:
    docs = columns_or_null(docs, {"doc_id": "long", "text": "string", "lang": "string"})
    return docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("part")).mapInArrow(
        _shard, f"shard long, docs array<{_DOC_SQL}>, words binary, least array<long>, cells binary"
    )


def _distinct_words(stored: DataFrame) -> int:
    """An estimate from the smallest hashes of all shards (exact if there are few)."""
    least = stored.select(F.explode("least").alias("h")).distinct().orderBy("h").limit(_SKETCH)
    n, top = least.agg(F.count("*"), F.max("h")).head()
    return n if n < _SKETCH else int((n - 1) * 2.0**63 / max(top, 1))


def dictionary(stored: DataFrame, buckets: int) -> DataFrame:
    """For each shard and bucket the global numbers of its words, in order, and the words first met there."""

    def deal(batches):
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                (body,) = unpack(blob.as_py())
                starts, ends, _ = words(body, np.array([0, len(body)]))
                h = span_hashes(body, starts, ends)
                bucket = (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                used, begin = np.unique(bucket, return_index=True)
                bound = np.append(begin, len(starts))
                rows = [pack(body[starts[a] : ends[b - 1]]) for a, b in zip(bound[:-1], bound[1:])]
                yield pa.RecordBatch.from_arrays([
                    pa.array(used, pa.int64()), pa.array([shard] * len(rows), pa.int64()), pa.array(rows, pa.binary()),
                ], ["bucket", "shard", "words"])

    def number(batches):
        current, known = None, {}
        for batch in batches:
            out, fresh = [], []
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(2)):
                if bucket != current:
                    current, known = bucket, {}
                before = len(known)
                found = unpack(blob.as_py())[0].tobytes().split(b" ")
                ids = [known.setdefault(word, len(known)) for word in found]
                out.append(pack(np.array(ids, np.uint64)))
                fresh.append([word.decode() for word, i in zip(found, ids) if i >= before])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.binary()), pa.array(fresh, pa.list_(pa.string()))],
                ["bucket", "shard", "ids", "new_words"],
            )

    spark = stored.sparkSession
    return (
        stored.select("shard", "words").mapInArrow(deal, "bucket long, shard long, words binary")
        .repartition(max(parts(spark), buckets), "bucket").sortWithinPartitions("bucket", "shard")
        .mapInArrow(number, "bucket long, shard long, ids binary, new_words array<string>")
    )


def document_term_matrix(docs: DataFrame) -> DataFrame:
    """CSR shards: ``shard``, ``docs`` (what is known of each row's text), ``indptr``, ``indices``
    (global word numbers: bucket * 2**40 + number in the bucket) and ``data``."""
    stored = store(shards(docs), "audit-shards")
    buckets = max(parts(docs.sparkSession), -(-_distinct_words(stored) // _BUCKET_WORDS))
    numbers = dictionary(stored, buckets)

    def assemble(batches):
        held, current = [], None
        for batch in batches:
            for i, (shard, bucket) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if shard != current:
                    held, current = [], shard
                if bucket is not None:
                    held.append((bucket << 40) + unpack(batch.column(2)[i].as_py())[0].astype(np.int64))
                    continue
                # The shard itself comes after its numbers.
                indptr, local, times = unpack(batch.column(4)[i].as_py())
                ids = np.concatenate(held) if held else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, 1), batch.column(3).slice(i, 1),
                    _one_list(pa.array(indptr.astype(np.int64))), _one_list(pa.array(ids[local])),
                    _one_list(pa.array(times.astype(np.int64))),
                ], ["shard", "docs", "indptr", "indices", "data"])
                held = []

    none = F.lit(None)
    rows = numbers.select("shard", "bucket", "ids", none.cast(f"array<{_DOC_SQL}>").alias("docs"),
                          none.cast("binary").alias("cells")).union(
        stored.select("shard", none.cast("long").alias("bucket"), none.cast("binary").alias("ids"), "docs", "cells"))
    return (
        rows.repartition("shard").sortWithinPartitions("shard", F.col("bucket").asc_nulls_last())
        .mapInArrow(assemble, f"shard long, docs array<{_DOC_SQL}>, indptr array<long>, indices array<long>, data array<long>")
    )


def _row_sums(batches):
    for batch in batches:
        for docs, indptr, data in zip(batch.column("docs"), batch.column("indptr"), batch.column("data")):
            indptr, data = indptr.values.to_numpy(), data.values.to_numpy()
            sums = np.diff(np.concatenate(([0], np.cumsum(data)))[indptr])
            docs = docs.values
            yield pa.RecordBatch.from_arrays(
                [*docs.flatten(), pa.array(sums, pa.int64()), pa.array(np.diff(indptr), pa.int64())],
                [*[f.name for f in _DOC], "n_words", "n_distinct"],
            )


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``part``, ``digest`` of the text and ``mask``: a bit for each of A to D that a row fails."""
    counted = document_term_matrix(docs).select("docs", "indptr", "data").mapInArrow(
        _row_sums,
        "doc_id long, part string, capitals long, points long, special boolean, digest binary, "
        "n_words long, n_distinct long",
    )
    tests = [
        F.col("n_words") < MIN_WORDS,
        100 * F.col("n_distinct") < MIN_DISTINCT_PERCENT * F.col("n_words"),
        100 * F.col("capitals") > MAX_CAPITALS_PERCENT * F.col("points"),
        F.col("special"),
    ]
    mask = sum((F.when(test, 1 << bit).otherwise(0) for bit, test in enumerate(tests)), F.lit(0))
    return counted.select("doc_id", "part", "digest", mask.alias("mask"))


def fail_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by ``part`` and ``mask`` of all five filters: ``n``, of them ``good`` and ``toxic``."""
    labels = columns_or_null(labels, {"doc_id": "long", "quality": "int", "toxic": "int"}).groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    marked = failures(docs).join(labels, "doc_id", "left").fillna(False, ["good", "toxic"])
    kinds = ["digest", "part", "mask", "good", "toxic", "known"]
    # Copies become few rows on the map side, before all of one text meet: the smallest doc_id of each kind.
    per_id = marked.withColumn("known", F.col("doc_id").isNotNull()).groupBy(*kinds, "doc_id").agg(F.count("*").alias("n"))
    per_kind = per_id.groupBy(*kinds).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least")
    )
    # Of one text the rows of the smallest doc_id pass E. Rows without doc_id pass too.
    first = F.min("least").over(Window.partitionBy("digest"))
    passing = F.when(~F.col("known"), F.col("n")).when(F.col("least") == first, F.col("n_least")).otherwise(0)
    both = per_kind.withColumn("passing", passing).select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct("mask", F.col("passing").alias("n")),
            F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n")),
        )).alias("s"),
    )
    return both.select("part", "good", "toxic", "s.*").filter("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def _orders() -> str:
    """All orders and steps, as a SQL literal: the bit of the step's filter and of those before it."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            rows.append({"filter_order": "".join(order), "step": step, "bit": bit, "before": before})
            before |= bit
    return f"from_json('{json.dumps(rows)}', 'array<struct<filter_order: string, step: int, bit: int, before: int>>')"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of the five filters and step: what the step's filter does there.

    ``kept`` after the step; ``removed`` by it; ``redundant``: fail it, but were removed earlier;
    ``unique_fails``: fail it alone; ``good_lost`` and ``toxic_lost`` of the removed; ``shapley``: removed
    by this filter over all orders.
    """
    sets = fail_sets(docs, labels)
    steps = sets.withColumn("step", F.explode(F.expr(_orders()))).select("part", "mask", "n", "good", "toxic", "step.*")
    fails = F.expr("mask & bit <> 0")
    earlier = F.expr("mask & before <> 0")

    def total(value, condition):
        return F.sum(F.when(condition, F.col(value)).otherwise(0)).cast("long")

    figures = steps.groupBy("part", "filter_order", "step", "bit").agg(
        total("n", F.expr("mask & (before | bit) = 0")).alias("kept"),
        total("n", fails & ~earlier).alias("removed"),
        total("n", fails & earlier).alias("redundant"),
        total("n", F.expr("mask = bit")).alias("unique_fails"),
        total("good", fails & ~earlier).alias("good_lost"),
        total("toxic", fails & ~earlier).alias("toxic_lost"),
    )
    # 120 orders for each part and filter, whatever the size of the input.
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit"))
    return figures.withColumn("shapley", shapley).drop("bit")


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ 	-]+') AS ws FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END
             + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
             + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
      FROM m GROUP BY part, mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT [a.letter, b.letter, c.letter, d.letter, e.letter] AS names, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM f a, f b, f c, f d, f e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT array_to_string(names, '') AS filter_order, step, bits[step] AS bit,
             coalesce(list_sum(bits[1 : step - 1]), 0)::INTEGER AS before
      FROM o, (SELECT unnest(generate_series(1, 5))::INTEGER AS step)),
r AS (SELECT part, filter_order, step, bit,
             coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
             coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
