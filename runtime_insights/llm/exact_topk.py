"""Exact top-k by inner product: distributed histogram selection.

Vectors are cut to integers, floor(64 x). Blocks of candidates meet blocks of queries; a task
scores one pair of blocks at a time by a matrix product. No scores are kept or sent: each
round sends, per query and candidate block, a histogram of the scores in the interval that
still holds the kth score, from its top down to where the block alone has enough. Their sums
locate the kth score in one of ``BINS`` bins, and the next round looks into that bin, until
it is one integer wide. A last pass sends what lies above, and of each block the smallest
vec_ids of those equal to the kth score; ties are cut by vec_id.

The state per query (bin, how many are still needed) stays in tables. Work is one product
of all queries with all rows per round, as an exact search with this score demands.

Rows: ``query_id``, ``rank``, ``vec_id``, ``score``. Which rows take part: see ``vectors.usable``.
Rows that share a vec_id are candidates each, never of each other; those among the queries
are one query, with the best of them all. A query with no other candidates has no rows; an empty
table gives none. Products are exact up to 64 bits; one beyond that, which a long cannot
hold, is an OverflowError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from runtime_insights.llm.tables import discard, parts, store
from runtime_insights.llm.vectors import QUERY_STEP, block_of, blocks, load, same_width, usable

SCALE, BINS = 64, 256
CANDIDATES, QUERIES = 8_192, 1_024  # vectors per block


def _floor(x: Column) -> Column:
    """The whole number below, as a double: beyond 2^53 every double is one, and need not fit 64 bits."""
    return F.when(F.abs(x) < F.lit(2.0**53), F.floor(x).cast("double")).otherwise(x)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer products of whole numbers held as doubles; in floating point where it is exact."""
    q, c = same_width(q, c)
    largest = float(np.abs(q).max(initial=0)), float(np.abs(c).max(initial=0))
    bound = largest[0] * largest[1] * max(1, q.shape[1])
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)
    if bound < 2**62 and max(largest) < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    exact = [np.array([int(v) for v in x.ravel()], object).reshape(x.shape) for x in (q, c)]
    score = exact[0] @ exact[1].T
    if any(not -(2**63) < v < 2**63 for v in score.ravel()):
        raise OverflowError("an inner product is beyond 64 bits")
    return score.astype(np.int64)


def _pairs(queries: DataFrame, candidates: DataFrame, number: int) -> DataFrame:
    """Each block of candidates beside each block of queries."""
    copies = candidates.select("block", "body").withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
    )
    return copies.join(queries, "q").repartition(4 * parts(queries.sparkSession), "block", "q")


def _histogram(k: int):
    def histogram(batches):
        for batch in batches:
            for c_body, q_body, state in zip(batch.column("body"), batch.column("q_body"), batch.column("state")):
                c_ids, c = load(c_body.as_py())
                q_ids, q = load(q_body.as_py())
                todo = {x["query_id"]: x for x in state.as_py()}
                rows = np.array([i for i, x in enumerate(q_ids.tolist()) if x in todo], np.int64)
                if not len(rows):
                    continue
                q_ids, q = q_ids[rows], q[rows]
                low = np.array([todo[x]["low"] for x in q_ids.tolist()], np.int64)
                width = np.array([todo[x]["width"] for x in q_ids.tolist()])
                need = np.array([todo[x]["need"] for x in q_ids.tolist()])
                score = _scores(q, c)
                # Unsigned, as an interval may be wider than a signed number can say.
                bin_ = (score.view(np.uint64) - low.view(np.uint64)[:, None]) // width.astype(np.uint64)[:, None]
                inside = (score >= low[:, None]) & (bin_ < BINS) & (c_ids[None, :] != q_ids[:, None])
                flat = (bin_.astype(np.int64) + np.arange(len(q))[:, None] * BINS)[inside]
                n = np.bincount(flat, minlength=len(q) * BINS).reshape(len(q), BINS)
                above = np.cumsum(n[:, ::-1], axis=1)[:, ::-1] - n
                i, b = np.nonzero((n > 0) & (above < need[:, None]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[i]), pa.array(b, pa.int64()), pa.array(n[i, b], pa.int64())],
                    ["query_id", "bin", "n"],
                )

    return histogram


def _select(k: int):
    def select(batches):
        for batch in batches:
            for c_body, q_body, state in zip(batch.column("body"), batch.column("q_body"), batch.column("state")):
                c_ids, c = load(c_body.as_py())
                q_ids, q = load(q_body.as_py())
                by_id = {x["query_id"]: x for x in state.as_py()}
                rows = np.array([i for i, x in enumerate(q_ids.tolist()) if x in by_id], np.int64)
                if not len(rows):
                    continue
                q_ids, q = q_ids[rows], q[rows]
                order = np.argsort(c_ids, kind="stable")
                c_ids, c = c_ids[order], c[order]
                score = _scores(q, c)
                low = np.array([by_id[x]["low"] for x in q_ids.tolist()], np.int64)
                need = np.array([by_id[x]["need"] for x in q_ids.tolist()])
                other = c_ids[None, :] != q_ids[:, None]
                tie = (score == low[:, None]) & other
                keep = (score > low[:, None]) & other
                keep |= tie & (np.cumsum(tie, axis=1) <= need[:, None])
                i, j = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[i]), pa.array(c_ids[j]), pa.array(score[i, j])], ["query_id", "vec_id", "score"]
                )

    return select


def top_k(vectors: DataFrame, k: int = 20, step: int = QUERY_STEP, scale: int = SCALE) -> DataFrame:
    """The ``k`` highest integer inner products of each query with all other rows."""
    spark = vectors.sparkSession
    rows = store(
        usable(vectors, nonzero=False, copies=k).select(
            "vec_id", F.transform("embedding", lambda x: _floor(x * F.lit(float(scale)))).alias("embedding")
        ), "topk-vectors",
    )
    largest = rows.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)), F.count("*")).head()
    asked = rows.filter(F.col("vec_id") % step == 0).withColumnRenamed("vec_id", "query_id")
    candidates, _ = blocks(rows, CANDIDATES, "vec_id", largest[1])
    queries, number = blocks(asked, QUERIES, "query_id")
    candidates, queries = store(candidates, "topk-candidates"), store(queries, "topk-queries")
    # No product is beyond the square of the longest vector (here with room for its rounding).
    square = (largest[0] or 0.0) * (1 + 1e-6) + 1
    reach, width = int(square) if square < 2.0**63 else 2**63 - 1, 1
    while BINS * width < 2 * reach + 1:
        width *= BINS
    # Rows that share a query_id may lie in several blocks; they are one query.
    places = store(asked.select("query_id", block_of("query_id", number).cast("int").alias("q")).distinct(), "topk-places")
    state = places.select("query_id").distinct().select(
        "query_id", F.lit(-reach).cast("long").alias("low"), F.lit(width).cast("long").alias("width"),
        F.lit(k).cast("long").alias("need"),
    )
    state = store(state, "topk-state")

    def with_state():
        packed = places.join(state, "query_id").groupBy("q").agg(F.collect_list(F.struct("query_id", "low", "width", "need")).alias("state"))
        sides = queries.select(F.col("block").alias("q"), F.col("body").alias("q_body")).join(packed, "q")
        return _pairs(sides, candidates, number).select("body", "q_body", "state")

    while True:
        counts = with_state().mapInArrow(_histogram(k), "query_id long, bin long, n long").groupBy(
            "query_id", "bin"
        ).agg(F.sum("n").alias("n"))
        # At most BINS rows per query.
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        found = state.join(counts, "query_id").withColumn("upto", F.sum("n").over(down)).withColumn(
            "last", F.min("bin").over(Window.partitionBy("query_id"))
        ).filter(
            # The bin that reaches the kth, or the lowest one if there are fewer than k.
            ((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
            | ((F.col("bin") == F.col("last")) & (F.col("upto") < F.col("need")))
        )
        new = store(
            found.select(
                "query_id",
                # The step alone may be beyond 64 bits, the sum is not.
                (F.col("low").cast("decimal(20,0)") + F.col("bin").cast("decimal(9,0)") * F.col("width").cast("decimal(19,0)"))
                .cast("long").alias("low"),
                F.greatest(F.floor(F.col("width") / BINS), F.lit(1)).cast("long").alias("width"),
                (F.col("need") - F.col("upto") + F.col("n")).alias("need"),
            ), "topk-state",
        )
        discard(state)
        state = new
        if width == 1:
            break
        width //= BINS

    best = with_state().mapInArrow(_select(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def op4_exact_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
