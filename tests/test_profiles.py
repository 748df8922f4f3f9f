"""Random streams against a plain sequential model; one container per stream."""

import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from runtime_insights import schema as S
from runtime_insights.functions.embed import NgramEmbedder
from runtime_insights.operators import detect as D, profile as P, semantic as M

GAP, WARMUP = 60_000, 45_000
START = datetime(2024, 1, 1)


def random_events(streams, length, seed, branches=("process", "network", "file")):
    rng = random.Random(seed)
    rows, seq = [], 0
    for stream in range(streams):
        now = START
        for _ in range(rng.randrange(4, length)):
            # Bursts, exact gaps, equal times, and long pauses.
            now += timedelta(milliseconds=rng.choice([0, 0, 1, 500, 9_000, 30_000, 60_000, 60_001, 130_000]))
            seq += 1
            category = rng.choice(branches)
            rare = rng.random() < 0.1
            key = rng.randrange(30) if rare else rng.randrange(3)
            fd = {
                "network": rng.choice(["", "1.1.1.1:80", f"a:1->10.0.0.{key}:443"]),
                "file": rng.choice(["", f"/d{key}", f"/d{key}/f{key % 4}"]),
            }.get(category, "")
            rows.append((
                seq, now, f"s{stream}", category, "Debug", "syscall", category,
                f"call{rng.choice([0, 0, 0, 1, key])}", f"p{key % 5}",
                f"run --opt{key} -b{key % 3} -b{key % 3}", "ipv4", fd,
                f"/d{key}" if category == "file" and rng.random() < 0.7 else "",
            ))
    rng.shuffle(rows)
    return rows


def attributes(row):
    category, cmdline, fd_type, fd, directory = row[6], row[9], row[10], row[11], row[12]
    if category == "process":
        return re.findall(r"-{1,2}[^\s-]+", cmdline)
    if category == "network":
        return [] if not fd else [(fd.split("->")[1] if "->" in fd else ":") + ":" + fd_type]
    return [a for a in (directory, fd) if a]


class Model:
    """One event at a time; ``same(a, b)`` says whether two keys are similar."""

    def __init__(self, same=lambda a, b: False, gap=GAP, warmup=WARMUP):
        self.same, self.gap, self.warmup = same, gap, warmup
        self.tree, self.counts = {}, {}
        self.start = self.novel = self.cut = None
        self.alerts = []

    def find(self, key, children):
        if key in children:
            return key
        return next((c for c in children if self.same(key, c)), None)

    def enter(self, key, children, ms):
        found = self.find(key, children)
        if found is None:
            children[key], self.novel, found = {}, ms, key
        return found

    def handle(self, row):
        ms = int(round((row[1] - START).total_seconds() * 1000))
        branch = self.tree.setdefault(row[6], {})
        keys = [row[7], row[8]]
        if self.cut is not None:
            node = branch
            for level, key in enumerate(keys, 1):
                found = self.find(key, node)
                if found is None:
                    self.alerts.append((row[0], level, key))
                    return
                node = node[found]
            for attr in attributes(row):
                if self.find(attr, node) is None:
                    self.alerts.append((row[0], 3, attr))
                    return
            return
        self.start = ms if self.start is None else self.start
        op = self.enter(keys[0], branch, ms)
        proc = self.enter(keys[1], branch[op], ms)
        attrs = attributes(row)
        for attr in attrs:
            leaf = self.enter(attr, branch[op][proc], ms)
            path = (row[6], op, proc, leaf)
            self.counts[path] = self.counts.get(path, 0) + 1
        if row[6] == "network" and not attrs:
            return
        if ms - self.start >= self.warmup and ms - self.novel > self.gap:
            self.cut = row[0]


def models(rows, **options):
    found = {}
    for row in sorted(rows, key=lambda r: (r[1], r[0])):
        found.setdefault(row[2], Model(**options)).handle(row)
    return found


def events_of(spark, rows):
    return spark.createDataFrame(rows, S.EVENT).repartition(4)


def check_alerts(alerts, expected):
    mine = sorted((r.container_name, r.seq, r.level, r.missing_key) for r in alerts.collect())
    theirs = sorted((c, *a) for c, m in expected.items() for a in m.alerts)
    assert mine == theirs
    return len(theirs)


@pytest.mark.parametrize("warmup", [0, WARMUP, 600_000])
def test_exact_learning_and_detection_equal_sequential_fold(spark, warmup):
    rows = random_events(60, 60, seed=warmup)
    events = events_of(spark, rows)
    expected = models(rows, warmup=warmup)
    learning = P.Learning(GAP, warmup)
    cuts = P.learning_cut(events, learning)
    found = {r.container_name: r.cut_seq for r in P.describe_cut(cuts).collect()}
    assert found == {c: m.cut for c, m in expected.items()}
    assert any(v is not None for v in found.values()) and None in found.values()
    assert check_alerts(D.detect_alerts(events, learning), expected) > 100
    counts = {
        (r.container_name, r.branch, r.evt_type, r.proc_name, r.attr): r.events_count
        for r in P.leaf_counts(P.learned_events(events, cuts)).collect()
    }
    assert counts == {(c, *p): n for c, m in expected.items() for p, n in m.counts.items()}


def test_global_scope_ends_learning_everywhere(spark):
    rows = random_events(8, 60, seed=4)
    cuts = P.learning_cut(events_of(spark, rows), P.Learning(GAP, WARMUP, "global"))
    own = P.learning_cut(events_of(spark, rows), P.Learning(GAP, WARMUP))
    first = own.agg(F.min("cut_ord")).first()[0]
    assert {r.cut_ord for r in cuts.collect()} == {first} and cuts.count() == 8


def test_default_stream_never_quiet_stays_learning(spark):
    rows = [(i, START + timedelta(seconds=i), "a", "file", "Debug", "s", "file", "open", "p",
             "", "file", f"/f{i}", "/d") for i in range(200)]
    cuts = P.learning_cut(events_of(spark, rows)).collect()
    assert [r.cut_ord for r in cuts] == [None]
    assert D.detect_alerts(events_of(spark, rows)).count() == 0


@pytest.mark.parametrize("threshold,front,tile", [(0.8, 1024, 2048), (0.6, 2, 3), (0.0, 1, 2)])
def test_semantic_learning_and_detection_equal_sequential_fold(
    spark, monkeypatch, threshold, front, tile
):
    monkeypatch.setattr(M, "TILE", tile)
    monkeypatch.setattr(M.leaders, "__defaults__", (front,))
    embedder = NgramEmbedder(64)
    cache = {}

    def vector(text):
        if text not in cache:
            cache[text] = embedder.encode([text])[0].astype(np.float32).astype(np.float64)
        return cache[text]

    def same(a, b):
        return bool(a.strip() and b.strip()) and float(vector(a) @ vector(b)) >= threshold

    rows = random_events(10, 60, seed=int(threshold * 100) + 3)
    expected = models(rows, same=same)
    profile = M.SemanticProfile(
        events_of(spark, rows), embedder, P.Learning(GAP, WARMUP), threshold
    )
    found = {r.container_name: r.cut_seq for r in P.describe_cut(profile.cuts).collect()}
    assert found == {c: m.cut for c, m in expected.items()}
    counts = {
        (r.container_name, r.branch, r.evt_type, r.proc_name, r.attr): r.events_count
        for r in profile.leaf_counts().collect()
    }
    assert counts == {(c, *p): n for c, m in expected.items() for p, n in m.counts.items()}
    check_alerts(D.alerts_on(profile.events, profile.unlearned_paths()), expected)


def test_block_match_scores_every_pair_of_a_block(spark, monkeypatch):
    monkeypatch.setattr(M, "TILE", 7)
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(90, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    # One block holds two thirds of all rows.
    blocks = ["hot"] * 60 + [f"b{i % 5}" for i in range(30)]
    rows = [(b, f"k{i}", i, [float(x) for x in v]) for i, (b, v) in enumerate(zip(blocks, vectors))]
    df = spark.createDataFrame(rows, "block string, key string, turn bigint, vector array<float>")
    found = {r.key: (r.best, r.first_key) for r in
             M.block_match(df.drop("turn"), df, 0.5, skip_same=True).collect()}
    scores = np.float32(vectors).astype(float) @ np.float32(vectors).astype(float).T
    for i, block in enumerate(blocks):
        others = [j for j in range(90) if blocks[j] == block and j != i]
        hit = next((f"k{j}" for j in others if scores[i, j] >= 0.5), None)
        best, first = found[f"k{i}"]
        assert first == hit and abs(best - max(scores[i, j] for j in others)) < 1e-9


def clustered(rng, groups, size, width=24):
    """Unit vectors in tight groups around far directions, and some between."""
    axes = np.linalg.qr(rng.normal(size=(width, width)))[0][:groups]
    vectors = np.repeat(axes, size, axis=0) + rng.normal(scale=0.03, size=(groups * size, width))
    vectors = np.vstack([vectors, rng.normal(size=(size, width))])
    return np.float32(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))


@pytest.mark.parametrize("threshold", [0.9, 0.4])
def test_pairs_of_tiles_that_cannot_match_are_not_made(spark, monkeypatch, threshold):
    monkeypatch.setattr(M, "TILE", 12)
    vectors = clustered(np.random.default_rng(5), 8, 18)
    blocks = ["hot" if i % 9 else f"b{i % 4}" for i in range(len(vectors))]
    rows = [(b, f"k{i}", i, [float(x) for x in v]) for i, (b, v) in enumerate(zip(blocks, vectors))]
    df = spark.createDataFrame(rows, "block string, key string, turn bigint, vector array<float>").repartition(3)
    scores = vectors.astype(float) @ vectors.astype(float).T
    first = {}
    for i, block in enumerate(blocks):
        first[f"k{i}"] = next(
            (f"k{j}" for j in range(len(rows)) if j != i and blocks[j] == block and scores[i, j] >= threshold), f"k{i}")
    found = M.match_key(df.drop("turn"), df, threshold, skip_same=True).collect()
    assert {r.key: r.match for r in found} == first
    hot = df.filter("block = 'hot'")
    pivots = M._pivots(hot)
    tiles = M.placed(hot, pivots, "test")
    assert tiles.groupBy("tile").count().agg(F.max("count")).first()[0] <= 3 * M.TILE
    every = M.tile_pairs(tiles, tiles, pivots, None).count()
    made = M.tile_pairs(tiles, tiles, pivots, threshold).count()
    assert made < every / 2 if threshold == 0.9 else made <= every


def test_vectors_longer_than_one_still_meet_all_their_matches(spark, monkeypatch):
    monkeypatch.setattr(M, "TILE", 5)
    rng = np.random.default_rng(2)
    vectors = np.float32(rng.normal(size=(60, 6)) * rng.choice([0.0, 0.1, 1, 5], size=(60, 1)))
    rows = [("b", f"k{i}", i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "block string, key string, turn bigint, vector array<float>")
    scores = vectors.astype(float) @ vectors.astype(float).T
    np.fill_diagonal(scores, -9)
    got = {r.key for r in M.semi_match(df.drop("turn"), df, 0.7, skip_same=True).collect()}
    assert got == {f"k{i}" for i in range(60) if scores[i].max() >= 0.7}


def test_ngram_vectors_are_the_same_in_built_ins(spark):
    from runtime_insights.functions.embed import embed

    texts = ["execve", "a", " padded\t", "10.0.0.1:443:ipv4", "/d0/f24", "é漢字😀", "x" * 300]
    for embedder in (NgramEmbedder(), NgramEmbedder(33, (1, 4))):
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", embed(embedder, F.col("t")).alias("v"))
        for row in got.collect():
            assert np.array_equal(np.float32(row.v), np.float32(embedder.encode([row.t.strip()])[0]))


def test_large_lookup_tables_are_salted_with_the_same_result(spark, monkeypatch):
    from runtime_insights.operators import skew

    rows = random_events(12, 60, seed=9)
    events, learning = events_of(spark, rows), P.Learning(GAP, WARMUP)
    monkeypatch.setattr(skew.is_small, "__defaults__", (2,))
    check_alerts(D.detect_alerts(events, learning), models(rows))


def test_child_lookup(spark):
    nodes = P.profile_nodes(events_of(spark, random_events(3, 30, seed=2)))
    some = nodes.filter("level = 3").first()
    parent = {"container_name": some.container_name, "branch": some.branch,
              "evt_type": some.evt_type}
    found = D.children_named(nodes, parent, some.proc_name).collect()
    assert [(r.proc_name, r.level, r.first_seq) for r in found] == [
        (some.proc_name, 3, some.first_seq)]
    assert D.children_named(nodes, parent, "absent").isEmpty()


def test_mean_pooling_skips_masked_tokens(spark):
    from runtime_insights.functions.embed import mean_pooled, normalized

    df = spark.createDataFrame(
        [([[1.0, 2.0], [3.0, 6.0], [9.0, 9.0]], [1, 1, 0])], "v array<array<float>>, m array<int>")
    pooled = mean_pooled(F.col("v"), F.col("m"))
    row = df.select(pooled.alias("p"), normalized(pooled).alias("u")).first()
    assert row.p == [2.0, 4.0]
    assert row.u == pytest.approx([2 / 20 ** 0.5, 4 / 20 ** 0.5])


def tables_made(monkeypatch):
    """The tables that the operators store from now on, by label."""
    made, store = {}, M.materialize

    def recorded(df, label):
        made.setdefault(label, []).append(store(df, label))
        return made[label][-1]

    monkeypatch.setattr(M, "materialize", recorded)
    return made


def test_rows_go_to_few_cells_however_many_tiles_they_meet(spark, monkeypatch):
    monkeypatch.setattr(M, "TILE", 4)
    made = tables_made(monkeypatch)
    vectors = np.float32(np.random.default_rng(9).normal(size=(300, 6)))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [("b", f"k{i}", i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "block string, key string, turn bigint, vector array<float>")
    scores = vectors.astype(float) @ vectors.astype(float).T
    np.fill_diagonal(scores, -2)
    found = {r.key: r.match for r in M.match_key(df.drop("turn"), df, 0.3, skip_same=True).collect()}
    assert found == {f"k{i}": f"k{s.argmax() if (s := scores[i] >= 0.3).any() else i}" for i in range(300)}
    assert len(made["tile-pairs"]) == 1 and made["tile-pairs"][0].count() > 1000
    for cells in made["cells"]:
        assert 1 < cells.agg(F.max(F.size("cells"))).first()[0] <= M.GRID


def fold(vectors, threshold):
    """Leader of each vector, one after another."""
    leads, out = [], []
    for i, v in enumerate(vectors):
        hit = next((j for j in leads if vectors[j] @ v >= threshold), None)
        if hit is None:
            leads.append(i)
        out.append(i if hit is None else hit)
    return out


def test_leaders_of_a_block_need_few_rounds(spark, monkeypatch):
    made = tables_made(monkeypatch)
    vectors = np.float32(np.random.default_rng(2).normal(size=(3000, 48)))
    vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(float)
    rows = [("b", f"k{i}", i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "block string, key string, turn bigint, vector array<double>")
    found = {r.key: r.leader for r in M.leaders(df, 0.45).collect()}
    assert found == {f"k{i}": f"k{j}" for i, j in enumerate(fold(vectors, 0.45))}
    assert len(set(found.values())) > 1024 and len(made.get("leaders", ())) <= 1


def test_leaders_keep_rows_that_share_a_key_or_have_no_block(spark):
    vectors = np.random.default_rng(4).normal(size=(20, 3))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [(None if i % 2 else "", f"k{i // 4}", i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "block string, key string, turn bigint, vector array<double>")
    expected = {}
    for odd in (0, 1):
        at = [i for i in range(20) if i % 2 == odd]
        for i, j in zip(at, fold(vectors[at], 0.7)):
            expected[i] = (None if odd else "", f"k{i // 4}", f"k{at[j] // 4}")
    assert {r.turn: (r.block, r.key, r.leader) for r in M.leaders(df, 0.7, 3).collect()} == expected
