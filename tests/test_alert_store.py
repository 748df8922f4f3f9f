"""The kept alert table against plain lists."""

import random
from datetime import datetime, timedelta

import pytest

from runtime_insights.operators.alert_store import COLUMNS, AlertStore

START = datetime(2024, 3, 1)


def alert_rows(seed, n, first=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        container = "hot" if rng.random() < 0.6 else f"c{rng.randrange(4)}"
        ts = START + timedelta(hours=rng.choice([0, 1, 23, 24, 25, 47, 48, 90, 200]), microseconds=rng.randrange(3))
        rows.append((container, first + i, ts, "file", "open", "p", "r", rng.choice(["Debug", "Critical"]), "s", 3, f"k{i}", "detect"))
    return rows


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    store = AlertStore(spark, str(tmp_path_factory.mktemp("alerts")))
    assert not store.exists()
    first, second = alert_rows(1, 150), alert_rows(2, 120, first=150)
    frame = lambda rows: spark.createDataFrame(rows, COLUMNS)
    store.append(0, frame(first))
    store.sink()(frame(second[:50]), 1)
    store.sink()(frame(second), 1)  # tried again: replaces what the first try left
    store.append(2, frame([]))
    return store, first + second


def newest(rows, size, before=None):
    found = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1]), reverse=True):
        if before is None or (r[2], r[1]) < before:
            found.setdefault(r[0], []).append(r)
    return sorted((c, i, r[1]) for c, rs in found.items() for i, r in enumerate(rs[:size], 1))


def test_all_alerts_are_kept_once(kept):
    store, rows = kept
    assert sorted(r.seq for r in store.alerts().collect()) == sorted(r[1] for r in rows)
    assert sum(r.n for r in store.counts().collect()) == len(rows)
    assert store.day_count(START + timedelta(hours=30)).first().value == sum(
        r[2].date() == (START + timedelta(days=1)).date() for r in rows)


@pytest.mark.parametrize("hours", [(None, None), (0, 24), (24, 25), (30, 300), (500, 600)])
def test_search(kept, hours):
    store, rows = kept
    start, end = (None if h is None else START + timedelta(hours=h) for h in hours)
    for container, priority in ((None, None), ("hot", "critical"), ("absent", None)):
        got = sorted(r.seq for r in store.search(container, start, end, priority).collect())
        assert got == sorted(
            r[1] for r in rows if container in (None, r[0]) and (priority is None or r[7].lower() == priority)
            and (start is None or r[2] >= start) and (end is None or r[2] < end))


@pytest.mark.parametrize("size", [1, 7, 40, 20_000])
def test_pages_follow_one_another_to_the_end(kept, size):
    store, rows = kept
    assert sorted((r.container_name, r.position, r.seq) for r in store.page(size).collect()) == newest(rows, size)
    before = (START + timedelta(hours=48), 100)
    assert sorted((r.container_name, r.position, r.seq) for r in store.page(size, before).collect()) == newest(rows, size, before)
    assert store.page(size, (START, 0)).collect() == []
    if size == 40:
        seen, before = [], None
        while page := sorted(store.page(size, before, "hot").collect(), key=lambda r: r.position):
            seen += [r.seq for r in page]
            before = (page[-1].ts, page[-1].seq)
        hot = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (r[2], r[1]), reverse=True)
        assert seen == [r[1] for r in hot]


def test_days_out_of_range_are_not_read(kept):
    store, _ = kept
    files = store.search(start=START, end=START + timedelta(hours=24)).inputFiles()
    everything = store.alerts().inputFiles()
    plan = store.search(start=START, end=START + timedelta(hours=24))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and files and len(everything) > 5
