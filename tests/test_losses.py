"""Cases in which events or alerts once were lost."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runtime_insights import schema as S
from runtime_insights.functions import timestamps as TS
from runtime_insights.operators import counters as K, detect as D, profile as P, search, snapshot
from runtime_insights.plans.runtime_events import log_lines, runtime_events
from runtime_insights.session import materialize, require_local, scratch, work_dir
from runtime_insights.sources import lines as L, sinks
from runtime_insights.streaming.profile import ProfileStream

FOLDER = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)
QUICK = P.Learning(60_000, 0)


def event(minute, process="p", container="a", seq=0, name="/f", micros=0):
    ts = START + timedelta(minutes=minute, microseconds=micros)
    return (seq, ts, container, "file", "Debug", "s", "file", "open", process, "", "file", name, "/d")


def events(spark, *rows):
    return spark.createDataFrame(list(rows), S.EVENT)


def named(alerts):
    return sorted((r.container_name, r.level, r.missing_key) for r in alerts.collect())


def test_tied_events_alert_one_by_one_in_batch_and_stream(spark, tmp_path):
    learned = [event(0), event(5), event(6)]
    tied = [event(10, p) for p in ("x", "y", "z")] + [event(10, "x")]
    expected = [("a", 2, "x"), ("a", 2, "x"), ("a", 2, "y"), ("a", 2, "z")]
    assert named(D.detect_alerts(events(spark, *learned, *tied), QUICK)) == expected
    profiles = ProfileStream(f"{tmp_path}/state", QUICK)
    profiles.process(events(spark, *learned), 0)
    profiles.process(events(spark, *tied), 1)
    assert named(profiles.alerts(spark)) == expected


def test_numbers_and_times_of_any_size_are_taken(spark):
    lines = [json.dumps({"rule": "file", "time": time, "output_fields": {
        "evt.num": num, "evt.type": "open", "fd.name": "/a", "container.name": "c"}})
        for time, num in (("1969-05-01T00:00:00Z", 1), ("2024-01-01T00:00:00Z", 10**15),
                          ("2300-01-01T00:00:00Z", 9 * 10**18), ("2024-01-01T00:00:00Z", -5))]
    rows = L.parse_lines(spark.createDataFrame([(x,) for x in lines], "raw string"))
    assert L.rejects(rows).count() == 0
    typed = L.typed_events(rows)
    assert sorted(r.seq for r in typed.collect()) == [-5, 1, 10**15, 9 * 10**18]
    key = TS.order_key(TS.micros(F.col("ts")), F.col("seq"))
    assert [r.y for r in typed.select(F.year("ts").alias("y"), key.alias("k")).orderBy("k").collect()] == [
        1969, 2024, 2024, 2300]
    back = typed.select(TS.from_micros(TS.order_micros(key)) == F.col("ts")).collect()
    assert all(r[0] for r in back)
    P.path_rollup(typed, 60_000).collect()


def test_late_events_are_judged_and_learned(spark, tmp_path):
    profiles = ProfileStream(f"{tmp_path}/state", QUICK)
    assert profiles.paths(spark).count() == 0 and profiles.containers(spark).count() == 0
    profiles.process(events(spark, event(0), event(5), event(6)), 0)
    profiles.process(events(spark, event(9)), 1)
    profiles.process(events(spark, event(8.5, "late"), event(0.5, "later")), 2)
    assert named(profiles.alerts(spark)) == [("a", 2, "late"), ("a", 2, "later")]
    # An event of the far future ends learning, but does not make the container deaf.
    profiles.process(events(spark, event(0, container="b"), event(10**8, container="b")), 3)
    profiles.process(events(spark, event(1, "new", "b")), 4)
    assert ("b", 2, "new") in named(profiles.alerts(spark))


def test_global_end_of_learning_holds_for_later_containers(spark, tmp_path):
    learning = P.Learning(60_000, 0, "global")
    first, second = [event(0), event(5), event(6)], [event(20, container="new"), event(21, "q")]
    profiles = ProfileStream(f"{tmp_path}/state", learning)
    profiles.process(events(spark, *first), 0)
    profiles.process(events(spark, *second), 1)
    expected = named(D.detect_alerts(events(spark, *first, *second), learning))
    assert named(profiles.alerts(spark)) == expected and len(expected) == 2


def test_old_folders_are_removed(spark, tmp_path):
    import os

    profiles = ProfileStream(f"{tmp_path}/state", QUICK, compact_every=2)
    held = work_dir(spark)
    before = set(os.listdir(held))
    for batch in range(6):
        profiles.process(events(spark, event(batch / 10, f"p{batch}")), batch)
    assert set(os.listdir(held)) == before
    assert len([d for d in os.listdir(f"{tmp_path}/state/containers") if "batch" in d]) <= 2
    assert len([d for d in os.listdir(f"{tmp_path}/state/paths") if "batch" in d]) <= 4
    assert profiles.paths(spark).filter("attr = ''").count() == 6


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_sort_of_all_input(spark):
    parsed = L.parse_lines(log_lines(spark, FOLDER))
    gauge = K.last_event(K.labelled(parsed.drop("category", "fields", "reason"), F.col("ts").cast("timestamp")))
    assert "SortAggregate" not in plan(gauge)
    flat = runtime_events(spark, FOLDER)
    assert "SortAggregate" not in plan(D.detect_alerts(flat, QUICK))


def test_typed_events_are_deduplicated_with_their_map(spark):
    typed = L.typed_events(L.parse_lines(log_lines(spark, FOLDER)))
    one = search.dedupe(typed.union(typed), ["container_name", "seq"])
    assert one.columns == typed.columns and one.count() == typed.count()


def test_folders_of_one_machine_are_refused_on_a_cluster():
    require_local("local[4]")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            require_local(master)


def test_scratch_tables_go(spark):
    import os

    with scratch(spark):
        table = materialize(spark.range(3), "gone")
        path = table.inputFiles()[0].split(":", 1)[-1]
        assert os.path.exists("/" + path.lstrip("/"))
    assert not os.path.exists(os.path.dirname("/" + path.lstrip("/")))


def test_a_snapshot_has_one_shape_at_any_size(spark):
    many = events(spark, *[event(i, name=f"/f{i}") for i in range(300)], event(0, container="b"))
    assert sorted((r.container_name, r.part) for r in snapshot.documents(many).collect()) == [("a", 0), ("b", 0)]
    nodes = ["container_name", "level", "branch", "evt_type", "proc_name", "attr", "events_count"]
    whole, parts = (
        sorted(map(tuple, snapshot.rebuild(snapshot.documents(many, n)).select(nodes).collect()), key=repr) for n in (1, 4))
    assert whole == parts


def test_writing_one_profile_keeps_the_others(spark, tmp_path):
    path = f"{tmp_path}/profiles"
    both = P.profile_nodes(events(spark, event(0), event(0, container="b")))
    sinks.write_profile(both, path)
    sinks.write_profile(P.profile_nodes(events(spark, event(0, "other"))), path)
    found = spark.read.parquet(path)
    assert found.filter("container_name = 'b'").count() == both.filter("container_name = 'b'").count()
    assert found.filter("container_name = 'a' AND proc_name = 'p'").count() == 0
    alerts = spark.range(3)
    for _ in range(2):
        sinks.write_alerts(alerts, f"{tmp_path}/alerts", 7)
    assert spark.read.parquet(f"{tmp_path}/alerts").count() == 3
