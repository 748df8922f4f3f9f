"""Golden events of our own in the shape of sensor logs, malformed lines, event files."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from runtime_insights import schema as S
from runtime_insights.functions import fields as X, timestamps as TS
from runtime_insights.operators import counters as K, paths, profile as P, snapshot
from runtime_insights.sources import lines as L, sinks


def record(rule, fields, **top):
    return {"hostname": "n1", "output_fields": fields, "priority": "Debug", "rule": rule,
            "source": "syscall", "tags": [], "time": "2025-03-04T05:06:07.123456789Z", **top}


FILE = record("file", {
    "container.name": "web", "evt.num": 11, "evt.type": "close", "proc.name": ".loader",
    "proc.cmdline": ".loader --root /x", "fd.type": "file",
    "fd.directory": "/sys/group/abc", "fd.name": "/sys/group/abc/freeze", "proc.pname": None,
})
PROCESS = record("process", {
    "": "", "container.name": "web", "evt.num": 12, "evt.type": "prctl", "proc.name": "box-shim",
    "proc.cmdline": "box-shim -namespace blue -id ab-cd -address /run/box.sock",
    "fd.name": None, "fd.type": None,
})
NET = record("net", {
    "container.name": "db", "evt.num": 13, "evt.type": "shutdown", "proc.name": "dbadmin",
    "proc.cmdline": "dbadmin ping -h 127.0.0.1", "fd.type": "ipv4",
    "fd.name": "127.0.0.1:46130->127.0.0.1:3306",
})


def lines(spark, *raws):
    texts = [r if isinstance(r, str) else json.dumps(r) for r in raws]
    return spark.createDataFrame([(t,) for t in texts], "raw string")


def test_golden_events_give_their_paths(spark):
    events = L.typed_events(L.parse_lines(lines(spark, FILE, PROCESS, NET)))
    assert {r.category for r in events.collect()} == {"file", "process", "network"}
    assert events.first().ts == datetime(2025, 3, 4, 5, 6, 7, 123456)
    found = sorted((r.branch, r.evt_type, r.proc_name, r.pos, r.attr, r.attr_type)
                   for r in paths.event_paths(events).collect())
    assert found == sorted([
        ("file", "close", ".loader", 0, "/sys/group/abc", "directory_path"),
        ("file", "close", ".loader", 1, "/sys/group/abc/freeze", "file_name"),
        ("network", "shutdown", "dbadmin", 0, "127.0.0.1:3306:ipv4", "network_attribute"),
        *[("process", "prctl", "box-shim", i, a, "cmd_argument")
          for i, a in enumerate(["-shim", "-namespace", "-id", "-cd", "-address"])],
    ])


@pytest.mark.parametrize("line,reason", [
    ("no json", "not JSON"), ('{"rule": "file"} x', "not JSON"), ("[1,2]", "not an object"),
    ("7", "not an object"), (json.dumps(FILE) + " " + json.dumps(NET), "not JSON"),
    (json.dumps(record(None, {})), "null rule"),
    (json.dumps(record("file", None)), "null output_fields"),
    (json.dumps(record("file", "text")), "null output_fields"),
    (json.dumps(record("process", {"proc.cmdline": None})), "null command line"),
    (json.dumps(record("process", {"proc.name": None})), "null operation or process"),
    (json.dumps(record("net", {"fd.name": "a->b", "fd.type": None})), "null descriptor type"),
    (json.dumps(record("net", {"fd.name": "a->b->c", "fd.type": "ipv4"})), "two arrows"),
    (json.dumps(record("file", {}, time=None)), "no event time"),
    (json.dumps(record("file", {}, time="soon")), "no event time"),
])
def test_malformed_lines_are_rejected_with_a_reason(spark, line, reason):
    parsed = L.parse_lines(lines(spark, line, FILE, "", " \t ", "{}"))
    assert [tuple(r) for r in L.rejects(parsed).collect()] == [(line, reason)]
    assert L.typed_events(parsed).count() == 1


def test_ingest_statistics(spark):
    stats = L.ingest_stats(lines(spark, FILE, "", "x", "[1]", "{", " ")).first()
    assert (stats.lines_processed, stats.json_errors) == (4, 2)


def test_event_files(spark, tmp_path):
    (tmp_path / "lines.json").write_text("\n".join([json.dumps(FILE), "bad", "", json.dumps(NET)]))
    (tmp_path / "array.json").write_text(json.dumps([PROCESS, NET], indent=1))
    (tmp_path / "object.json").write_text(json.dumps(PROCESS, indent=2))
    joined = "\n".join(json.dumps(e, indent=2) for e in (FILE, PROCESS, NET))
    (tmp_path / "joined.json").write_text(joined)

    def rules(name):
        parsed = L.read_events_file(spark, f"{tmp_path}/{name}")
        events = L.typed_events(parsed)
        return sorted(r.rule for r in events.collect()), L.rejects(parsed).count()

    assert rules("lines.json") == (["file", "net"], 1)
    assert rules("array.json") == (["net", "process"], 0)
    assert rules("object.json") == (["process"], 0)
    events, rejected = rules("joined.json")
    assert events == [] and rejected > 0
    assert rules("nothing-here.json") == ([], 0)


def test_metric_golden_case(spark):
    event = {"rule": "process", "priority": "DEBUG", "output_fields": {
        "evt.type": "execve", "evt.time.iso8601": "2025-01-01T00:00:00Z", "container.name": "box",
        "container.image.repository": "lab/box", "proc.name": "bash",
        "k8s.ns.name": None, "k8s.pod.name": None}}
    parsed = L.parse_lines(lines(spark, event, event)).drop("category", "fields", "reason")
    rows = parsed.withColumn("ts", F.lit(datetime(2025, 1, 1)).cast("timestamp_ntz")).withColumn(
        "seq", F.monotonically_increasing_id())
    rows = K.labelled(rows, F.lit(None).cast("timestamp"))
    counters = K.event_counters(rows)
    found = counters.first().asDict()
    assert counters.count() == 1 and found["value"] == 2.0
    assert found["rule_category"] == "process"
    assert found["k8s_namespace"] == found["k8s_pod"] == "none"
    gauge = K.last_event(rows)
    assert gauge.first().value == 1735689600
    line = K.exposition(gauge, S.LAST_EVENT, ["container_name"]).first().line
    assert line == 'syscall_last_event_timestamp_seconds{container_name="box"} 1.7356896e+09'
    assert K.exposition(counters, S.EVENTS_TOTAL, ["rule"]).first().line == (
        'syscall_events_total{rule="process"} 2.0')


def test_labels_tell_missing_from_null(spark):
    full = {"rule": None, "output_fields": {"container.name": None}}
    bare = {"output_fields": {"k8s.ns.name": "", "x": 1}}
    flat = {"rule": "file", "container.name": "seen by profiles only"}
    parsed = L.parse_lines(lines(spark, full, bare, flat)).drop("category", "fields", "reason")
    rows = K.labelled(parsed, F.lit(datetime(2025, 1, 1)))
    found = {(r.rule, r.container_name, r.k8s_namespace) for r in rows.collect()}
    assert found == {("None", "None", "none"), ("unknown", "unknown", "none"),
                     ("file", "unknown", "none")}


def test_tokens_equal_python_regex(spark):
    import re

    texts = ["a -b --cd-e", "x -y --z", "--log-format --", "-\x1f-a\x1cb", "---x -", "",
             "ключ -ф--ы", "-a=b,c\t-d\n-e"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", X.command_tokens(F.col("t")).alias("found")).collect():
        assert row.found == re.findall(r"-{1,2}[^\s-]+", row.t), repr(row.t)


def test_order_key_round_trip_and_limits(spark):
    rows = [(1704067207179575, 0, 0), (1704067207179575, TS.MAX_SEQ, TS.MAX_POS), (0, 5, 3)]
    df = spark.createDataFrame(rows, "ts bigint, seq bigint, pos int")
    key = TS.order_key(F.col("ts"), F.col("seq"), F.col("pos"))
    keyed = df.withColumn("k", key)
    back = keyed.select(TS.order_micros(F.col("k")), TS.order_seq(F.col("k")), TS.order_pos(F.col("k")))
    assert [tuple(r) for r in back.collect()] == rows
    assert [r.seq for r in keyed.orderBy("k").collect()] == [5, 0, TS.MAX_SEQ]
    # Beyond the key's digits numbers are ties, not errors.
    far = df.select(TS.order_seq(TS.order_key(F.col("ts"), F.col("seq") + F.lit(10**17))).alias("s"))
    assert {r.s for r in far.collect()} == {TS.MAX_SEQ}


def test_snapshot_files_round_trip(spark, tmp_path):
    events = L.typed_events(L.parse_lines(lines(spark, FILE, PROCESS, PROCESS, NET)))
    sinks.write_snapshots(snapshot.documents(events), f"{tmp_path}/snap")
    stored = spark.read.text(f"{tmp_path}/snap").withColumnRenamed("value", "document")
    columns = ["container_name", "level", "branch", "evt_type", "proc_name", "attr", "node_type",
               "events_count"]
    nodes = P.profile_nodes(events)
    mine = sorted(map(str, snapshot.rebuild(stored).select(*columns).collect()))
    assert mine == sorted(map(str, nodes.select(*columns).collect()))
    web = json.loads(stored.filter("container_name = 'web'").first().document)
    process = web["hbt_structure"]["children"]["process_branch"]
    assert process["events_count"] == 0 and process["metadata"] == {}
    shim = process["children"]["prctl"]["children"]["box-shim"]["children"]
    assert list(shim) == ["-shim", "-namespace", "-id", "-cd", "-address"]
    assert shim["-id"] == {"name": "-id", "type": "cmd_argument", "events_count": 2,
                           "metadata": {}, "children": {}}
    lines_ = [r.line for r in snapshot.listing(nodes.filter("container_name = 'web'")).collect()]
    assert lines_[:7] == [
        "root (root)", "  process_branch (branch)", "    prctl (process_operation)",
        "      box-shim (process_name)", "        -shim (cmd_argument) (2 events)",
        "        -namespace (cmd_argument) (2 events)", "        -id (cmd_argument) (2 events)"]
