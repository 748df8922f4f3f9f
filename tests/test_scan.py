"""Running values by ranges against plain loops, with ranges of a few places and of many levels."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runtime_insights import schema as S
from runtime_insights.operators import counters as K, scan, sessions


@pytest.mark.parametrize("fan", [2, 7, 65_536])
def test_scan_equals_a_loop(spark, monkeypatch, fan):
    monkeypatch.setattr(scan, "FAN", fan)
    rng = random.Random(fan)
    rows = [(k, o, rng.choice([None, rng.randrange(-9, 9)])) for k in ("hot", "b", None)
            for o in rng.sample(range(-500, 500), {"hot": 120, "b": 9}.get(k, 30))]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    ways = {"s": ("v", "sum"), "m": ("v", "max"), "l": ("v", "last"), "p": ("o", "last")}
    got = {(r.k, r.o): (r.s, r.m, r.l, r.p) for r in scan.scan_before(df, ["k"], "o", ways).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        seen, places = [], []
        for _, o, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            want[key, o] = (sum(seen) if seen else None, max(seen, default=None), seen[-1] if seen else None,
                            places[-1] if places else None)
            places.append(o)
            if v is not None:
                seen.append(v)
    assert got == want
    assert scan.scan_before(df.filter("false"), ["k"], "o", ways).collect() == []


def test_no_task_has_a_whole_key(spark, monkeypatch):
    """One key with 40,000 places in ranges of 500: windows are by range, and no range is larger."""
    monkeypatch.setattr(scan, "FAN", 500)
    df = spark.range(40_000).select(F.lit("hot").alias("k"), F.col("id").alias("o"), F.lit(1).cast("long").alias("v"))
    found = scan.scan_before(df, ["k"], "o", {"s": ("v", "sum")})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(k" in plan and all("_range" in x for x in plan.split("windowspecdefinition")[1:])
    assert found.filter("coalesce(s, 0) <> o").isEmpty() and found.count() == 40_000


@pytest.mark.parametrize("fan", [3, 65_536])
def test_samples_and_increases(spark, monkeypatch, fan):
    """Samples of every step, counters set back at times, and growth between samples over windows."""
    monkeypatch.setattr(scan, "FAN", fan)
    rng = random.Random(1)
    start, step, restart, window = datetime(2024, 1, 1), 3_600, 40 * 3_600, 24 * 3_600
    times = {c: sorted(rng.randrange(0, 200 * 3_600) for _ in range(n)) for c, n in (("hot", 300), ("few", 3), ("one", 1))}
    rows = [(start + timedelta(seconds=t), c) for c, ts in times.items() for t in ts]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, c string")
    base = int((start - datetime(1970, 1, 1)).total_seconds())
    end = max(-(-(base + t) // step) for ts in times.values() for t in ts)
    want = {}
    for c, ts in times.items():
        for s in range(min(-(-(base + t) // step) for t in ts), end + 1):
            epoch = (s * step * 10**6 - 1) // (restart * 10**6)
            n = sum(1 for t in ts if -(-(base + t) // step) <= s and ((-(-(base + t) // step)) * step * 10**6 - 1) // (restart * 10**6) == epoch)
            if n:
                want[c, s * step] = float(n)
    samples = K.counter_samples(df, ["c"], step * 10**6, restart * 10**6)
    got = {(r.c, int((r.ts - datetime(1970, 1, 1)).total_seconds())): r.value for r in samples.collect()}
    assert got == want
    grown = {}
    for c in times:
        previous = None
        for (_, s), v in sorted((k, v) for k, v in want.items() if k[0] == c):
            w = -(-s // window) * window
            delta = v if previous is None or v < previous else v - previous
            grown[c, w] = grown.get((c, w), 0.0) + delta
            previous = v
    found = {(r.c, int((r.window_end - datetime(1970, 1, 1)).total_seconds())): r.increase
             for r in K.counter_increase(samples, ["c"], window * 10**6).collect()}
    assert found == grown


@pytest.mark.parametrize("fan", [2, 65_536])
def test_captures(spark, monkeypatch, fan):
    monkeypatch.setattr(scan, "FAN", fan)
    rng = random.Random(2)
    start, rows, want = datetime(2024, 1, 1), [], []
    for container, n in (("hot", 200), ("b", 5)):
        times, now = [], 0
        for _ in range(n):
            now += rng.choice([0, 1, 4_999, 5_000, 5_001, 60_000])
            times.append(now)
        rows += [(container, start + timedelta(milliseconds=t)) for t in times]
        open_ = None
        for t in times:
            if open_ and t - open_[1] <= 5_000:
                open_[1], open_[2] = t, open_[2] + 1
            else:
                open_ = [t, t, 1]
                want.append((container, open_))
    base = int((start - datetime(1970, 1, 1)).total_seconds()) * 10**6
    df = spark.createDataFrame(rows, "container_name string, ts timestamp_ntz")
    got = sorted(tuple(r) for r in sessions.capture_sessions(df, S.CAPTURE_MS).collect())
    assert got == sorted((c, base + a * 1000, base + (b + 5_000) * 1000, n) for c, (a, b, n) in want)
