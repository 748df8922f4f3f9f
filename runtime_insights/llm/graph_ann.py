"""Approximate nearest neighbours by inner product: robust-pruned directed graphs in shards.

Vectors are dealt to shards by a hash of their id; a task builds the graph of one shard:
greedy searches from the shard's medoid propose neighbours for each vector, and robust
pruning keeps at most ``DEGREE`` of them, leaving out each candidate that a kept one is nearer to,
by the factor ``ALPHA`` (1 in the first pass, which gives short edges; above 1 in the second,
which keeps diverse long ones). Each edge is also tried backwards. The graphs are stored. Each block of
queries visits every shard; a beam search finds its nearest there, all queries of the block
in step. The best of all shards are merged per query.

Largest inner product is turned into smallest distance by one more component,
sqrt(M^2 - |x|^2) with M the largest norm, which is 0 for queries.

Copies of a vector would fill each other's neighbour lists, so a graph holds each distinct
vector once, with its smallest 2 ``k`` vec_ids: no query can need more of them, since
ties go to the smaller vec_id and at most ``k`` are its own. Returned scores are computed again from the original
vectors in double precision, component after component.

Every vector is indexed. Rows: ``query_id``, ``rank``, ``vec_id``, ``score``. Which rows
take part: ``vectors.usable``. Rows that share a vec_id are candidates each, never of each other;
those among the queries are one query, with the best of them all. A query without other candidates has no rows; an empty table
gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from runtime_insights.llm.arrays import pack, unpack
from runtime_insights.llm.tables import discard, parts, store
from runtime_insights.llm.vectors import QUERY_STEP, blocks, load, matrix, stacked, usable, widened

K, DEGREE, ALPHA = 20, 32, 1.2
BUILD_BEAM, SEARCH_BEAM = 48, 96
SHARD, QUERIES = 4_096, 512  # distinct vectors per shard, queries per block


def distances(points: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of queries (B, d) to points ids (B, m); ids below 0 give infinity."""
    found = points[np.maximum(ids, 0)]
    d = (found * found).sum(2) - 2 * np.matmul(found, queries[:, :, None])[:, :, 0]
    d += (queries * queries).sum(1)[:, None]
    return np.where(ids < 0, np.float32(np.inf), d)


def beam_search(points, graph, start: int, queries, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest found for each query (ids, -1 for none, and distances), in order."""
    n_queries, degree = len(queries), graph.shape[1]
    ids = np.full((n_queries, beam), -1, np.int32)
    dist = np.full((n_queries, beam), np.inf, np.float32)
    done = np.ones((n_queries, beam), bool)
    ids[:, 0], done[:, 0] = start, False
    dist[:, 0] = distances(points, ids[:, :1], queries)[:, 0]
    seen = np.zeros((n_queries, len(points) + 1), bool)  # the last column is for "none"
    seen[:, start] = seen[:, -1] = True
    active = np.arange(n_queries)
    while len(active):
        at = np.argmin(done[active], axis=1)  # beams are sorted: the nearest open one
        opened = ~done[active, at]
        active, at = active[opened], at[opened]
        if not len(active):
            break
        done[active, at] = True
        near = graph[ids[active, at]]
        near = np.where(seen[active[:, None], near], -1, near)
        seen[active[:, None], near] = True
        d = distances(points, near, queries[active])
        all_ids = np.concatenate((ids[active], near), 1)
        all_dist = np.concatenate((dist[active], d), 1)
        all_done = np.concatenate((done[active], np.zeros((len(active), degree), bool)), 1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(all_ids, order, 1)
        dist[active] = np.take_along_axis(all_dist, order, 1)
        done[active] = np.take_along_axis(all_done, order, 1) | (ids[active] < 0)
    return ids, dist


def robust_prune(points, own: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Out-edges of the points ``own`` from candidates (B, m; -1 for none)."""
    candidates = np.sort(candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    candidates = np.where(candidates == own[:, None], -1, candidates)
    d = distances(points, candidates, points[own])
    order = np.argsort(d, axis=1, kind="stable")
    candidates, d = np.take_along_axis(candidates, order, 1), np.take_along_axis(d, order, 1)
    vectors = points[np.maximum(candidates, 0)]
    square = (vectors * vectors).sum(2)
    between = square[:, :, None] + square[:, None, :] - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    alive = candidates >= 0
    out = np.full((len(own), degree), -1, np.int32)
    rows = np.arange(len(own))
    for i in range(degree):
        pick = np.argmax(alive, axis=1)  # the nearest that is left
        has = alive[rows, pick]
        if not has.any():
            break
        out[has, i] = candidates[rows, pick][has]
        alive &= ~(has[:, None] & (alpha * alpha * between[rows, pick] <= d))
        alive[rows, pick] = False
    return out


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, batch: int = 256):
    """Graph (n, degree; -1 for none) and start point."""
    n = len(points)
    random = np.random.default_rng(n)
    start = int(np.argmin(((points - points.mean(0)) ** 2).sum(1)))
    graph = np.full((n, degree), -1, np.int32)
    if n > 1:
        some = min(degree, n - 1)
        graph[:, :some] = (np.arange(n)[:, None] + random.integers(1, n, (n, some))) % n
    for a in (1.0, alpha):
        order = random.permutation(n)
        for begin in range(0, n, batch):
            own = order[begin : begin + batch]
            found, _ = beam_search(points, graph, start, points[own], beam)
            graph[own] = robust_prune(points, own, np.concatenate((found, graph[own]), 1), a, degree)
            source = np.repeat(own, degree)
            target = graph[own].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            heads, first, n_in = np.unique(target, return_index=True, return_counts=True)
            # All new in-edges beside the present out-edges; pruning picks among them.
            extra = np.full((len(heads), int(n_in.max(initial=0))), -1, np.int32)
            column = np.arange(len(target)) - np.repeat(first, n_in)
            extra[np.repeat(np.arange(len(heads)), n_in), column] = source
            for piece in range(0, len(heads), batch):
                p = slice(piece, piece + batch)
                graph[heads[p]] = robust_prune(
                    points, heads[p], np.concatenate((graph[heads[p]], extra[p]), 1), a, degree
                )
    return graph, start


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows, in double precision, added from the first component on."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        total += q[:, j] * c[:, j]
    return total


def _build_shards(top: float):
    def lift(x):
        rest = np.sqrt(np.maximum(top - (x * x).sum(1), 0))
        return np.concatenate((x, rest[:, None]), 1).astype(np.float32)

    def build_shards(batches):
        current, held = None, []

        def row():
            x = stacked([h[0] for h in held])
            members = np.concatenate([h[1] for h in held])
            sizes = np.concatenate([h[2] for h in held])
            graph, start = build(lift(x))
            return pa.RecordBatch.from_arrays(
                [pa.array([current], pa.int32()),
                 pa.array([pack(x.ravel(), members, sizes, graph.ravel(), np.array([start]))], pa.binary())],
                ["shard", "body"],
            )

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            for s in np.unique(shard):
                part = batch.filter(pa.array(shard == s))
                if s != current:
                    if current is not None:
                        yield row()
                    current, held = int(s), []
                members = part.column("members")
                held.append((matrix(part.column("embedding")), members.flatten().to_numpy(),
                             members.value_lengths().to_numpy().astype(np.int64)))
        if current is not None:
            yield row()

    return build_shards


def _search(k: int, top: float, beam: int):
    def search(batches):
        for batch in batches:
            for body, q_body in zip(batch.column("body"), batch.column("q_body")):
                flat, members, sizes, graph, start = unpack(body.as_py())
                x = flat.reshape(len(sizes), -1)
                q_ids, q = load(q_body.as_py())
                width = max(x.shape[1], q.shape[1])
                x, q = widened(x, width), widened(q, width)
                rest = np.sqrt(np.maximum(top - (x * x).sum(1), 0))
                points = np.concatenate((x, rest[:, None]), 1).astype(np.float32)
                asked = np.concatenate((q, np.zeros((len(q), 1))), 1).astype(np.float32)
                found, _ = beam_search(points, graph.reshape(len(sizes), -1), int(start[0]), asked, max(beam, k + 1))
                i, j = np.nonzero(found >= 0)
                node = found[i, j]
                # Every vec_id of each vector found.
                offset = np.concatenate(([0], np.cumsum(sizes)))
                times = sizes[node]
                at = np.repeat(offset[node] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
                vec_id = members[at]
                score = np.repeat(exact_scores(q[i], x[node]), times)
                i = np.repeat(i, times)
                other = vec_id != q_ids[i]
                i, vec_id, score = i[other], vec_id[other], score[other]
                order = np.lexsort((vec_id, -score, i))
                i, vec_id, score = i[order], vec_id[order], score[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                keep = rank < k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[i[keep]]), pa.array(vec_id[keep]), pa.array(score[keep])],
                    ["query_id", "vec_id", "score"],
                )

    return search


def nearest(vectors: DataFrame, k: int = K, step: int = QUERY_STEP, shard: int = SHARD, beam: int = SEARCH_BEAM) -> DataFrame:
    """The ``k`` nearest found of each query (vec_id divisible by ``step``) among all other rows."""
    spark = vectors.sparkSession
    rows = store(usable(vectors, nonzero=True, copies=k), "ann-vectors")
    same = Window.partitionBy("embedding").orderBy("vec_id")
    # Cut to 2 k rows per vector before the shuffle, so a very common vector is no hot key.
    # At most k of them have the query's own id.
    distinct = store(
        rows.withColumn("r", F.row_number().over(same)).filter(F.col("r") <= 2 * k)
        .groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("members")), "ann-distinct",
    )
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    top, number = distinct.agg(F.max(square), F.count("*")).head()
    shards = max(1, -(-number // shard))
    index = store(
        distinct.withColumn("shard", F.pmod(F.xxhash64(F.col("members")[0]), F.lit(shards)).cast("int"))
        .repartition(shards, "shard").sortWithinPartitions("shard").select("shard", "embedding", "members")
        .mapInArrow(_build_shards(float(top or 0)), "shard int, body binary"), "ann-index",
    )
    queries, _ = blocks(
        rows.filter(F.col("vec_id") % step == 0).withColumnRenamed("vec_id", "query_id"), QUERIES, "query_id"
    )
    asked = store(queries, "ann-queries").select(
        F.col("body").alias("q_body"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    )
    found = (
        asked.join(index, "shard").repartition(4 * parts(spark), F.xxhash64("q_body"), "shard").select("body", "q_body")
        .mapInArrow(_search(k, float(top or 0), beam), "query_id long, vec_id long, score double")
    )
    discard(distinct)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def op2_graph_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
