"""Matching by embedding similarity, and profiles and detection built on it.

A query is compared only with the candidates of its own block (the siblings under one
parent). Blocks are cut into tiles of bounded size, and groups of tiles meet in the cells of
a grid: a row goes once to each cell of its group, so what is moved grows with the rows and not
with the pairs of tiles. A cell is one task's matrix products, tile by tile; it returns one row
per query, never the pairs. Pairs of tiles whose angles to common pivots rule out a match are never made.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from runtime_insights import schema as S
from runtime_insights.functions.embed import Embedder, normalized, text_vectors
from runtime_insights.operators import profile as P
from runtime_insights.operators.detect import alerts_on, identified
from runtime_insights.operators.skew import salted_lookup
from runtime_insights.session import materialize

TILE = 2048
FRONT = 8192
#: Groups of tiles on each side of a block's grid, and rows of a group beyond which there are more groups.
GRID, CELL = 4, 32_768
#: Vectors per block that angles are measured from, and slices of the angle around each.
PIVOTS, PIVOT_SAMPLE, SLICES = 16, 256, 16
#: Room for rounding: products of single-precision unit vectors leave angles that uncertain.
SLACK = 2e-3


def _best_and_first(
    queries: np.ndarray, names: np.ndarray, candidates: np.ndarray, others: np.ndarray, threshold: float,
    skip_same: bool,
) -> tuple[np.ndarray, np.ndarray]:
    """Highest product of each query, and the place of its first match (the number of candidates for none).

    ``names`` and ``others`` are numbers of the keys; with ``skip_same`` equal ones never meet.
    """
    best, first = np.full(len(queries), -np.inf), np.full(len(queries), len(candidates))
    queries = queries.astype(np.float64)
    for begin in range(0, len(candidates), TILE):
        scores = queries @ candidates[begin:begin + TILE].astype(np.float64).T
        if skip_same:
            order = np.argsort(others[begin:begin + TILE], kind="stable")
            met = others[begin:begin + TILE][order]
            low, high = np.searchsorted(met, names), np.searchsorted(met, names, "right")
            for row in np.flatnonzero(low < high):
                scores[row, order[low[row]:high[row]]] = -2.0
        best = np.maximum(best, scores.max(axis=1))
        hits = scores >= threshold
        at = hits.argmax(axis=1)
        found = hits[np.arange(len(hits)), at] & (first == len(candidates))
        first[found] = begin + at[found]
    return best, first


def _numbered(queries: pd.Series, candidates: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Keys as numbers, equal where the keys are."""
    numbers, _ = pd.factorize(np.concatenate([queries.to_numpy(object), candidates.to_numpy(object)]))
    return numbers[:len(queries)], numbers[len(queries):]


def _found_rows(block, queries: pd.DataFrame, candidates: pd.DataFrame, best, first) -> pd.DataFrame:
    found = first < len(candidates)
    first = np.where(found, first, 0)
    return pd.DataFrame({
        "block": block, "key": queries["key"].to_numpy(), "best": best,
        "first_turn": np.where(found, candidates["turn"].to_numpy()[first], None),
        "first_key": np.where(found, candidates["key"].to_numpy()[first], None),
    })


_NO_ROWS = pd.DataFrame(columns=["block", "key", "best", "first_turn", "first_key"])


def _tile_scores(
    queries: pd.DataFrame, candidates: pd.DataFrame, threshold: float, skip_same: bool
) -> pd.DataFrame:
    """Best score and first match of each query, block by block."""
    parts = []
    by_block = dict(tuple(candidates.groupby("block")))
    for block, q in queries.groupby("block"):
        c = by_block.get(block)
        if c is None:
            continue
        c = c.iloc[np.argsort(c["turn"].to_numpy(), kind="stable")]
        found = _best_and_first(
            np.stack(q["vector"].to_numpy()), (numbers := _numbered(q["key"], c["key"]))[0],
            np.stack(c["vector"].to_numpy()), numbers[1], threshold, skip_same)
        parts.append(_found_rows(block, q, c, *found))
    return pd.concat(parts) if parts else _NO_ROWS


def _cell_scores(
    queries: pd.DataFrame, candidates: pd.DataFrame, threshold: float, skip_same: bool
) -> pd.DataFrame:
    """Best score and first match of the queries of one cell, among the tiles that face each one's tile.

    ``queries`` has, beside the rows, one row for each tile with the ``others`` that it meets.
    """
    facing = queries[queries["others"].notna()]
    rows = queries[queries["others"].isna()]
    if rows.empty or candidates.empty:
        return _NO_ROWS
    c = candidates.iloc[np.argsort(candidates["turn"].to_numpy(), kind="stable")]
    names, others = _numbered(rows["key"], c["key"])
    q_tile, c_tile = rows["tile"].to_numpy(object), c["tile"].to_numpy(object)
    q_vectors, c_vectors = np.stack(rows["vector"].to_numpy()), np.stack(c["vector"].to_numpy())
    parts = []
    for tile, met in zip(facing["tile"], facing["others"]):
        of = np.flatnonzero(q_tile == tile)
        to = np.flatnonzero(np.isin(c_tile, met))
        for begin in range(0, len(of) if len(to) else 0, TILE):
            at = of[begin:begin + TILE]
            found = _best_and_first(q_vectors[at], names[at], c_vectors[to], others[to], threshold, skip_same)
            parts.append(_found_rows(rows["block"].iloc[0], rows.iloc[at], c.iloc[to], *found))
    return pd.concat(parts) if parts else _NO_ROWS


def _found_schema(candidates: DataFrame) -> str:
    turn = dict(candidates.dtypes)["turn"]
    return f"block string, key string, best double, first_turn {turn}, first_key string"


def block_match(
    queries: DataFrame, candidates: DataFrame, threshold: float = S.SIMILARITY_THRESHOLD,
    skip_same: bool = False, exact_best: bool = True,
) -> DataFrame:
    """Compare ``queries`` (block, key, vector) with ``candidates`` (same and ``turn``).

    Returns (block, key, best, first_key): the highest product, and the match of lowest
    ``turn`` among those at or over the threshold. Blocks of up to a tile share tasks. Larger
    ones are cut into tiles around pivots; without ``exact_best`` only those pairs of tiles are
    scored in which the angles to the pivots allow a match, so ``best`` is right where
    it reaches the threshold, and else may be lower than the truth or the row missing.
    """
    sizes = queries.groupBy("block").agg(F.count(F.lit(1)).alias("q")).join(
        candidates.groupBy("block").agg(F.count(F.lit(1)).alias("c")), "block")
    most_q, most_c, total = sizes.agg(F.max("q"), F.max("c"), F.sum(F.col("q") + F.col("c"))).first()
    schema = _found_schema(candidates)
    if total is None:
        return queries.sparkSession.createDataFrame([], schema).drop("first_turn")
    if max(most_q, most_c) <= TILE:
        tiled = _small_blocks(queries, candidates, int(total), threshold, skip_same, schema)
    else:
        sizes = materialize(sizes.select("block", (F.greatest("q", "c") > TILE).alias("large")), "block-sizes")
        large = sizes.filter("large").select("block")

        def part(rows: DataFrame, how: str) -> DataFrame:
            return salted_lookup(rows, large, ["block"], ["key"], how)

        def rest(rows: DataFrame) -> DataFrame:
            marked = salted_lookup(rows, sizes, ["block"], ["key"], "inner")
            return marked.filter(~F.col("large")).drop("large")

        tiled = _small_blocks(rest(queries), rest(candidates), int(total), threshold, skip_same, schema).unionByName(
            _large_blocks(part(queries, "inner"), part(candidates, "inner"), threshold, skip_same, exact_best, schema))
    first = F.min(F.when(F.col("first_key").isNotNull(), F.struct("first_turn", "first_key")))
    return (
        tiled.groupBy("block", "key").agg(F.max("best").alias("best"), first.alias("f"))
        .select("block", "key", "best", F.col("f.first_key").alias("first_key"))
    )


def _small_blocks(queries, candidates, total: int, threshold: float, skip_same: bool, schema: str) -> DataFrame:
    """Each block's only tiles, many blocks to a task."""
    bin_ = F.pmod(F.xxhash64("block"), F.lit(max(1, total // (16 * TILE)))).alias("bin")
    # New attributes, because both sides may come from one table.
    left = queries.select(bin_, *[F.col(n).alias(n) for n in ("block", "key", "vector")])
    right = candidates.select(bin_, *[F.col(n).alias(n) for n in ("block", "key", "turn", "vector")])
    return left.groupBy("bin").cogroup(right.groupBy("bin")).applyInPandas(
        lambda q, c: _tile_scores(q, c, threshold, skip_same), schema
    )


def _far_apart(sample: pd.DataFrame) -> pd.DataFrame:
    """Each next pivot is the vector of the sample that is farthest from all before it."""
    sample = sample.sort_values("n")
    unit, _ = _unit(sample["vector"])
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(PIVOTS, len(unit)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return pd.DataFrame({
        "block": sample["block"].iloc[0], "pivot": np.arange(len(chosen)),
        "vector": sample["vector"].to_numpy()[chosen],
    })


def _pivots(candidates: DataFrame) -> DataFrame:
    """Vectors of each block to measure angles from: far apart among ``PIVOT_SAMPLE`` of it, by hash."""
    order = W.partitionBy("block").orderBy(F.xxhash64("key"), "key")
    sample = candidates.select("block", "key", "vector", F.row_number().over(order).alias("n")).filter(
        F.col("n") <= PIVOT_SAMPLE)
    schema = f"block string, pivot int, vector {dict(candidates.dtypes)['vector']}"
    return materialize(sample.groupBy("block").applyInPandas(_far_apart, schema), "pivots")


def _unit(vectors) -> tuple[np.ndarray, np.ndarray]:
    stacked = np.stack(vectors.to_numpy()).astype(np.float64)
    norms = np.linalg.norm(stacked, axis=1)
    return stacked / np.maximum(norms, 1e-12)[:, None], norms


def _nearest_pivot(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    if rows.empty:
        return rows.drop(columns="shard").assign(pivot=0, angle=0.0, norm=0.0)
    unit, norms = _unit(rows["vector"])
    axes, _ = _unit(pivots["vector"])
    products = np.clip(unit @ axes.T, -1.0, 1.0)
    nearest = products.argmax(axis=1)
    return rows.drop(columns="shard").assign(
        pivot=pivots["pivot"].to_numpy()[nearest],
        angle=np.arccos(products[np.arange(len(rows)), nearest]), norm=norms,
    )


def placed(rows: DataFrame, pivots: DataFrame, label: str) -> DataFrame:
    """Rows of large blocks with ``tile``: those near one pivot, by angle from it, at most about ``TILE``."""
    counts = materialize(
        rows.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).alias("shards")), "shards")
    dealt = salted_lookup(rows, counts, ["block"], ["key"], "inner").withColumn(
        "shard", F.pmod(F.xxhash64("key"), F.col("shards"))).drop("shards")
    copies = pivots.join(counts, "block").select(
        "block", "pivot", "vector", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)).alias("shard"))
    columns = [c for c in dealt.columns if c != "shard"]
    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in columns) + ", pivot int, angle double, norm double"
    near = materialize(
        dealt.groupBy("block", "shard").cogroup(copies.groupBy("block", "shard"))
        .applyInPandas(_nearest_pivot, schema), f"{label}-angles",
    ).withColumn("slice", F.floor(F.col("angle") * (SLICES / np.pi)))
    cells = materialize(near.groupBy("block", "pivot", "slice").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(TILE)).alias("parts")), f"{label}-cells")
    tile = F.concat_ws(":", "pivot", "slice", F.pmod(F.xxhash64("key"), F.col("parts")))
    return materialize(
        salted_lookup(near, cells, ["block", "pivot", "slice"], ["key"], "inner")
        .withColumn("tile", tile).drop("parts", "slice"), f"{label}-tiles")


def tile_pairs(
    queries: DataFrame, candidates: DataFrame, pivots: DataFrame, threshold: float | None
) -> DataFrame:
    """Pairs of tiles (block, qt, ct) of placed rows that may hold a match.

    The angle between a row near pivot p and one near pivot q is at least what the triangle inequality
    leaves of the angle between p and q and their own. With a threshold of None all pairs stay.
    """
    def tiles(rows: DataFrame, side: str) -> DataFrame:
        return rows.groupBy("block", F.col("tile").alias(f"{side}t")).agg(
            F.first("pivot").alias(f"{side}p"), F.min("angle").alias(f"{side}lo"),
            F.max("angle").alias(f"{side}hi"), F.max("norm").alias(f"{side}norm"))

    pairs = tiles(queries, "q").join(tiles(candidates, "c"), "block")
    if threshold is None or threshold <= 0:
        return pairs.select("block", "qt", "ct")
    unit = pivots.select("block", "pivot", normalized(F.col("vector")).alias("u"))
    product = F.aggregate(F.zip_with("u", "v", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    between = unit.withColumnRenamed("pivot", "qp").join(
        unit.select("block", F.col("pivot").alias("cp"), F.col("u").alias("v")), "block"
    ).select("block", "qp", "cp", F.acos(F.greatest(F.least(product, F.lit(1.0)), F.lit(-1.0))).alias("d"))
    least = F.greatest(
        F.col("d") - F.col("qhi") - F.col("chi"), F.col("qlo") - F.col("d") - F.col("chi"),
        F.col("clo") - F.col("d") - F.col("qhi"),
    )
    needed = F.lit(threshold) / F.greatest(F.col("qnorm") * F.col("cnorm"), F.lit(1e-12))
    return pairs.join(materialize(between, "pivot-angles"), ["block", "qp", "cp"]).filter(
        (needed <= 1 + SLACK) & (least <= F.acos(F.least(needed, F.lit(1.0))) + SLACK)
    ).select("block", "qt", "ct")


def _groups(rows: DataFrame, side: str) -> DataFrame:
    """Tiles of placed rows (block, qt or ct) in groups of about equal size, gq or gc; near ones together."""
    tiles = rows.groupBy("block", F.col("tile").alias(f"{side}t")).agg(
        F.count(F.lit(1)).alias("n"), F.first("pivot").alias("pivot"), F.min("angle").alias("angle"))
    block = W.partitionBy("block")
    before = F.sum("n").over(block.orderBy("pivot", "angle", f"{side}t")) - F.col("n")
    total = F.sum("n").over(block)
    groups = F.greatest(F.least(F.lit(GRID), F.ceil(total / TILE)), F.ceil(total / CELL))
    return tiles.select("block", f"{side}t", F.floor(before * groups / total).cast("int").alias(f"g{side}"))


def _large_blocks(
    queries: DataFrame, candidates: DataFrame, threshold: float, skip_same: bool, exact_best: bool, schema: str
) -> DataFrame:
    pivots = _pivots(candidates)
    queries, candidates = placed(queries, pivots, "query"), placed(candidates, pivots, "candidate")
    pairs = tile_pairs(queries, candidates, pivots, None if exact_best else threshold)
    pairs = materialize(
        pairs.join(_groups(queries, "q"), ["block", "qt"]).join(_groups(candidates, "c"), ["block", "ct"]), "tile-pairs")

    def side(rows: DataFrame, own: str, other: str, *names: str) -> DataFrame:
        """Rows in each cell (block, gq, gc) in which their tile meets another."""
        cells = pairs.groupBy("block", F.col(f"{own}t").alias("tile"), f"g{own}").agg(
            F.collect_set(f"g{other}").alias("cells"))
        named = rows.select("block", "tile", *[F.col(n).alias(n) for n in names])
        met = salted_lookup(named, materialize(cells, "cells"), ["block", "tile"], ["key"], "inner")
        return met.withColumn(f"g{other}", F.explode("cells")).drop("cells")

    cell = ("block", "gq", "gc")
    facing = pairs.groupBy(*cell, F.col("qt").alias("tile")).agg(F.collect_list("ct").alias("others"))
    left = side(queries, "q", "c", "key", "vector").unionByName(facing, allowMissingColumns=True)
    right = side(candidates, "c", "q", "key", "turn", "vector")
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(
        lambda q, c: _cell_scores(q, c, threshold, skip_same), schema)


def any_match(queries: DataFrame, candidates: DataFrame, threshold: float = S.SIMILARITY_THRESHOLD,
              skip_same: bool = False) -> DataFrame:
    """Per query whether some candidate of its block is similar enough."""
    scored = block_match(queries, candidates, threshold, skip_same, exact_best=False)
    return queries.select("block", "key").join(scored, ["block", "key"], "left").select(
        "block", "key", F.coalesce(F.col("best") >= threshold, F.lit(False)).alias("matched")
    )


def semi_match(queries: DataFrame, candidates: DataFrame,
               threshold: float = S.SIMILARITY_THRESHOLD, skip_same: bool = False) -> DataFrame:
    """Only the queries that match."""
    return any_match(queries, candidates, threshold, skip_same).filter("matched").drop("matched")


def match_key(queries: DataFrame, candidates: DataFrame,
              threshold: float = S.SIMILARITY_THRESHOLD, skip_same: bool = False) -> DataFrame:
    """The candidate a query stands for: the same key, else the first similar, else itself.

    Only queries without an equal key are scored.
    """
    rest = queries
    if not skip_same:
        rest = queries.join(candidates.select("block", "key"), ["block", "key"], "left_anti")
    scored = block_match(rest, candidates, threshold, skip_same, exact_best=False)
    return queries.select("block", "key").join(
        scored.select("block", "key", "first_key"), ["block", "key"], "left"
    ).select("block", "key", F.coalesce("first_key", "key").alias("match"))


# ------------------------------------------------------------- leader clustering

_STEP = 256  # keys of a fold that are met at once


def _greedy(group: pd.DataFrame, threshold: float, with_vectors: bool = False) -> pd.DataFrame:
    """Leaders among the first keys of one block, in order of arrival; ``with_vectors`` also the leaders' vectors."""
    group = group.sort_values("turn", kind="stable")
    vectors = np.stack(group["vector"].to_numpy()).astype(np.float64)
    leader = np.arange(len(group))
    is_open = np.ones(len(group), bool)
    for begin in range(0, len(group), _STEP):
        at = begin + np.flatnonzero(is_open[begin:begin + _STEP])
        similar = vectors[at] @ vectors[at].T >= threshold
        waiting, new = np.ones(len(at), bool), []
        for i in range(len(at)):
            if waiting[i]:
                # The first open key leads all open ones that are similar to it.
                joins = waiting & similar[i]
                joins[i] = True
                leader[at[joins]] = at[i]
                waiting &= ~joins
                new.append(at[i])
        rest = begin + _STEP + np.flatnonzero(is_open[begin + _STEP:])
        if new and len(rest):
            hits = vectors[rest] @ vectors[new].T >= threshold
            found = hits.any(axis=1)
            leader[rest[found]] = np.array(new)[hits[found].argmax(axis=1)]
            is_open[rest[found]] = False
    keys = group["key"].to_numpy()
    found = pd.DataFrame({
        "block": group["block"], "key": keys, "turn": group["turn"], "leader": keys[leader],
    })
    if with_vectors:
        found["vector"] = group["vector"].where(leader == np.arange(len(group)), None)
    return found


def _joined(later: pd.DataFrame, new: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """``later`` rows with the first leader of ``new`` that is similar; those that join one lose their vector."""
    later = later.drop(columns="shard")
    if later.empty or new.empty:
        return later.assign(leader=None, joined=False)
    new = new.iloc[np.argsort(new["turn"].to_numpy(), kind="stable")]
    leads, none = np.stack(new["vector"].to_numpy()), np.zeros(0)
    first = np.concatenate([
        _best_and_first(np.stack(later["vector"].to_numpy()[begin:begin + TILE]), none, leads, none, threshold, False)[1]
        for begin in range(0, len(later), TILE)])
    found = first < len(new)
    keys = new["key"].to_numpy(object)[np.where(found, first, 0)]
    return later.assign(vector=later["vector"].where(~found, None), leader=np.where(found, keys, None), joined=found)


def leaders(keys: DataFrame, threshold: float, front: int = FRONT) -> DataFrame:
    """Leader of every key: (block, key, turn, leader).

    Taken in order of ``turn``, a key joins the first leader of its block that is
    similar enough, else becomes a leader. Each round settles the first ``front`` open
    keys of every block in one small group, then lets all later keys of the block, dealt in
    shards, join the new leaders. A key left over matched none of the leaders so far, so the rounds
    give exactly the result of one long fold, and no task sees more than a front and a shard.
    Keys without a vector are leaders that nothing joins.
    """
    turn, vector = (dict(keys.dtypes)[name] for name in ("turn", "vector"))
    schema = f"block string, key string, turn {turn}, leader string"
    settled = keys.filter(F.col("vector").isNull()).select(
        "block", "key", "turn", F.col("key").alias("leader")
    )
    pending = keys.filter(F.col("vector").isNotNull()).select("block", "key", "turn", "vector")
    largest = pending.groupBy("block").count().agg(F.max("count")).first()[0]
    if (largest or 0) <= front:
        return settled.unionByName(
            pending.groupBy("block").applyInPandas(lambda group: _greedy(group, threshold), schema))
    # Rows without a block are a block of their own, which joins have to find.
    named = F.coalesce(F.concat(F.lit("="), "block"), F.lit("")).alias("block")
    pending = materialize(pending.select(named, "key", "turn", "vector"), "pending")
    rows = None
    place = F.struct("turn", "key")
    order = W.partitionBy("block").orderBy("turn", "key")
    while True:
        # The rank filter is applied in every task before the shuffle.
        edges = pending.select("block", "turn", "key", F.row_number().over(order).alias("rank")).filter(
            F.col("rank") <= front).groupBy("block").agg(F.max(place).alias("edge"))
        marked = salted_lookup(pending, materialize(edges, "edges"), ["block"], ["key"], "inner")
        found = materialize(
            marked.filter(place <= F.col("edge")).drop("edge").groupBy("block").applyInPandas(
                lambda group: _greedy(group, threshold, True), f"{schema}, vector {vector}"), "leaders")
        rows = found.drop("vector") if rows is None else rows.unionByName(found.drop("vector"))
        later = marked.filter(place > F.col("edge")).drop("edge")
        shards = materialize(later.groupBy("block").agg(
            F.ceil(F.count(F.lit(1)) / F.lit(2 * GRID * TILE)).alias("shards")), "shards")
        if shards.isEmpty():
            break
        dealt = salted_lookup(later, shards, ["block"], ["key"], "inner").withColumn(
            "shard", F.pmod(F.xxhash64("key", "turn"), F.col("shards"))).drop("shards")
        new = found.filter(F.col("vector").isNotNull()).join(shards, "block").select(
            "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)).alias("shard"),
            "key", "turn", "vector")
        met = materialize(
            dealt.groupBy("block", "shard").cogroup(new.groupBy("block", "shard")).applyInPandas(
                lambda q, c: _joined(q, c, threshold),
                f"block string, key string, turn {turn}, vector {vector}, leader string, joined boolean"), "joined-keys")
        rows = rows.unionByName(met.filter("joined").select("block", "key", "turn", "leader"))
        pending = met.filter("NOT joined").drop("leader", "joined")
        if pending.isEmpty():
            break
    unnamed = F.when(F.col("block") != "", F.expr("substring(block, 2)")).alias("block")
    return settled.unionByName(rows.select(unnamed, "key", "turn", "leader"))


# --------------------------------------------------- semantic profile and detect

_LEVELS = (
    # key column, its representative, columns of the parent in representatives
    ("evt_type", "operation", ("container_name", "branch")),
    ("proc_name", "process", ("container_name", "branch", "operation")),
    ("attr", "leaf", ("container_name", "branch", "operation", "process")),
)


def _blocked(rows: DataFrame, parent: Sequence[str]) -> DataFrame:
    """``block``: an unambiguous text of the parent's columns."""
    return rows.withColumn("block", F.to_json(F.array(*[F.col(c) for c in parent])))


def _distinct_keys(paths: DataFrame, key: str, parent: Sequence[str]) -> DataFrame:
    return paths.groupBy(*parent, F.col(key).alias("key")).agg(F.min("first_ord").alias("turn"))


class SemanticProfile:
    """Representatives of all keys, level by level, and the end of learning on them."""

    def __init__(
        self, events: DataFrame, embedder: Embedder, learning: P.Learning = P.Learning(),
        threshold: float = S.SIMILARITY_THRESHOLD,
    ):
        self.events, self.learning, self.threshold = events, learning, threshold
        self.rollup = materialize(P.path_rollup(events, learning.quiet_gap_ms), "path-rollup")
        self.novel = materialize(P.novel_paths(self.rollup), "novel-paths")
        texts = self.novel.select(F.explode(F.array("evt_type", "proc_name", "attr")).alias("t"))
        self.vectors = materialize(text_vectors(texts, "t", embedder), "text-vectors")
        # Representatives are chosen over all rows: a choice made before the end of
        # learning does not depend on keys that come later.
        self.maps: list[DataFrame] = []
        paths = self.novel
        for key, name, parent in _LEVELS:
            rows = paths.filter(F.col("attr") != "") if key == "attr" else paths
            chosen = leaders(self._keyed(_distinct_keys(rows, key, parent), parent), threshold)
            # ``turn`` of a leader is its own first occurrence under this parent.
            mapped = self._unblocked(chosen, parent, key, name)
            self.maps.append(materialize(mapped, f"representatives-{name}"))
            paths = self._mapped(paths, self.maps[-1], key, parent)
        self.paths = paths
        self.cuts = P.learning_cut(
            events, learning, materialize(self._mapped_rollup(), "mapped-rollup")
        )

    def _keyed(self, keys: DataFrame, parent: Sequence[str]) -> DataFrame:
        with_vectors = keys.join(self.vectors, keys["key"] == self.vectors["text"], "left").drop("text")
        return _blocked(with_vectors, parent)

    @staticmethod
    def _unblocked(rows: DataFrame, parent: Sequence[str], key: str, name: str) -> DataFrame:
        columns = F.from_json("block", "array<string>")
        return rows.select(
            *[columns[i].alias(c) for i, c in enumerate(parent)], F.col("key").alias(key),
            "turn", F.col("leader").alias(name),
        )

    @staticmethod
    def _mapped(rows: DataFrame, mapping: DataFrame, key: str, parent: Sequence[str]) -> DataFrame:
        mapping = mapping.drop("turn")
        if key == "attr":
            return rows.join(mapping, [*parent, key], "left")
        # One operation or process may have a third of all paths below it.
        return salted_lookup(rows, mapping, [*parent, key], ["proc_name", "attr"], "inner")

    def _representative_rows(self, rows: DataFrame) -> DataFrame:
        """Path rows with their keys replaced by representatives."""
        for (key, _, parent), mapping in zip(_LEVELS, self.maps):
            rows = self._mapped(rows, mapping, key, parent)
        return rows.withColumn("leaf", F.coalesce("leaf", F.lit("")))

    def _mapped_rollup(self) -> DataFrame:
        paths = self._representative_rows(self.novel).groupBy(
            "container_name", "branch", F.col("operation").alias("evt_type"),
            F.col("process").alias("proc_name"), F.col("leaf").alias("attr"),
        ).agg(F.min("first_ord").alias("first_ord"))
        clock = self.rollup.filter(F.col("cell").isNotNull())
        return clock.unionByName(paths, allowMissingColumns=True)

    def leaf_counts(self) -> DataFrame:
        """Learned counts at the representative leaves."""
        learned = P.learned_events(self.events, self.cuts)
        rows = self._representative_rows(P.path_counts(learned).select(*S.PATH, "n"))
        return rows.filter(F.col("leaf") != "").groupBy(
            "container_name", "branch", F.col("operation").alias("evt_type"),
            F.col("process").alias("proc_name"), F.col("leaf").alias("attr"),
        ).agg(F.sum("n").alias("events_count"))

    def unlearned_paths(self) -> DataFrame:
        """Paths on which detection alerts, with the level at which no match was found.

        A key known while learning keeps its representative; a later one takes the first
        learned sibling that is similar enough. The match is the parent for the next
        level, so levels go top down over distinct keys only.
        """
        cut = self.cuts.select("container_name", "cut_ord").filter(F.col("cut_ord").isNotNull())
        paths = salted_lookup(self.novel, cut, ["container_name"], list(S.PATH[1:]), "inner")
        lost = None
        for (key, name, parent), mapping in zip(_LEVELS, self.maps):
            rows = paths.filter(F.col("attr") != "") if key == "attr" else paths
            keys = _distinct_keys(rows, key, parent)
            known = salted_lookup(mapping, cut, ["container_name"], [key], "inner").filter(
                F.col("turn") <= F.col("cut_ord")).withColumnRenamed(key, "key")
            old = materialize(keys.drop("turn").join(
                known.select(*parent, "key", F.col(name).alias("match")), [*parent, "key"], "left"
            ), f"met-{name}")
            new = self._keyed(old.filter(F.col("match").isNull()).drop("match"), parent)
            learned = self._keyed(
                known.filter(F.col("key") == F.col(name)).select(*parent, "key", "turn"), parent
            )
            similar = block_match(
                new.filter(F.col("vector").isNotNull()).select("block", "key", "vector"),
                learned.filter(F.col("vector").isNotNull()).select("block", "key", "turn", "vector"),
                self.threshold, exact_best=False,
            ).filter(F.col("first_key").isNotNull())
            matched = old.filter(F.col("match").isNotNull()).select(
                *parent, F.col("key").alias(key), F.col("match").alias(name)
            ).unionByName(
                self._unblocked(similar.select(
                    "block", "key", F.lit(0).alias("turn"), F.col("first_key").alias("leader")
                ), parent, key, name).drop("turn")
            )
            matched = materialize(matched, f"matched-{name}")
            missing = rows.join(matched, [*parent, key], "left_anti").select(
                *S.PATH, F.lit(len(parent) - 1).alias("level"))
            lost = missing if lost is None else lost.unionByName(missing)
            if key != "attr":
                paths = salted_lookup(
                    paths, matched, [*parent, key], ["proc_name", "attr"], "inner")
        return lost


def detect_semantic(
    events: DataFrame, embedder: Embedder, learning: P.Learning = P.Learning(),
    threshold: float = S.SIMILARITY_THRESHOLD,
) -> DataFrame:
    """Alerts where neither an equal nor a similar key was learned."""
    events = identified(events)
    profile = SemanticProfile(events, embedder, learning, threshold)
    return alerts_on(events, materialize(profile.unlearned_paths(), "unlearned"))
