"""Streams give what the batch operators give."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runtime_insights import schema as S
from runtime_insights.operators import counters as K, detect as D, profile as P, sessions
from runtime_insights.plans.profile_queries import LEARNING
from runtime_insights.plans.runtime_events import raw_lines, runtime_events
from runtime_insights.sources import lines as L
from runtime_insights.streaming import queries as Q
from runtime_insights.streaming.profile import ProfileStream

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Events in time order, one parquet file per stretch of time."""
    path = str(tmp_path_factory.mktemp("feed"))
    events = runtime_events(spark, FOLDER).drop("k", "value")
    edges = [datetime(2024, 1, 1) + timedelta(days=d) for d in (0, 1, 2, 3, 5, 8, 12, 20, 40)]
    for a, b in zip(edges, edges[1:]):
        part = events.filter((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b)))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, feed, per_trigger=1):
    schema = spark.read.parquet(feed).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(feed)


def drain(query):
    query.awaitTermination(240)
    assert query.exception() is None and not query.isActive


@pytest.mark.parametrize("compact_every", [3, 50])
def test_profile_stream_equals_batch(spark, feed, tmp_path, compact_every):
    profiles = ProfileStream(f"{tmp_path}/state", LEARNING, compact_every)
    drain(profiles.start(stream(spark, feed), f"{tmp_path}/ck", once=True))
    events = runtime_events(spark, FOLDER)
    cuts = P.learning_cut(events, LEARNING)
    mine = {r.container_name: r.cut_ord for r in profiles.containers(spark).collect()}
    assert mine == {r.container_name: r.cut_ord for r in cuts.collect()}
    columns = ["container_name", "seq", "level", "missing_key"]
    found = sorted(map(tuple, profiles.alerts(spark).select(*columns).collect()))
    assert found == sorted(map(tuple, D.detect_alerts(events, LEARNING).select(*columns).collect()))
    learned = P.path_counts(P.learned_events(events, cuts)).select(*S.PATH, "n", "first_ord", "last_us")
    mine = sorted(map(tuple, profiles.paths(spark).select(*learned.columns).collect()))
    assert mine == sorted(map(tuple, learned.collect()))


def test_repeated_batch_changes_nothing_and_late_rows_are_learned(spark, tmp_path):
    profiles = ProfileStream(f"{tmp_path}/state", P.Learning(60_000, 0))
    start = datetime(2024, 1, 1)

    def batch(*minutes):
        rows = [(int(m), start + timedelta(minutes=m), "a", "file", "Debug", "s", "file", "open",
                 "p", "", "file", f"/f{m}", "/d") for m in minutes]
        return spark.createDataFrame(rows, S.EVENT)

    profiles.process(batch(1, 2), 0)
    for _ in range(2):
        profiles.process(batch(0, 3), 1)
        state = profiles.containers(spark).collect()
        assert [(r.late, r.cut_ord) for r in state] == [(1, None)]
        # The late event is learned too.
        assert profiles.paths(spark).filter("attr = '/d'").first().n == 4


def test_running_counters_and_gauge(spark, tmp_path):
    rows = raw_lines(spark, FOLDER)
    rows.coalesce(3).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    parsed = L.parse_lines(source).drop("category", "fields", "reason")
    labelled = K.labelled(parsed, F.col("ts").cast("timestamp"))
    kept = {}

    def take(name):
        def keep(batch, _):
            kept[name] = sorted(map(tuple, batch.collect()))
        return keep

    for name, df in (("counters", Q.running_counters(labelled)), ("last", Q.running_last_event(labelled))):
        drain(df.writeStream.outputMode("update").foreachBatch(take(name))
              .option("checkpointLocation", f"{tmp_path}/ck-{name}").trigger(availableNow=True).start())
    batch = K.labelled(
        L.parse_lines(rows).drop("category", "fields", "reason"), F.col("ts").cast("timestamp"))
    assert kept["counters"] == sorted(map(tuple, K.event_counters(batch).collect()))
    assert kept["last"] == sorted(map(tuple, K.last_event(batch).collect()))


def test_lines_are_followed_with_statistics(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    good = json.dumps({"rule": "file", "output_fields": {"evt.type": "open", "fd.name": "/a"}})
    for i in range(3):
        (folder / f"{i}.log").write_text(f"{good}\n\nbroken\n{good}\n")
    listener = Q.IngestListener()
    spark.streams.addListener(listener)
    source = Q.observed(L.stream_lines(spark, str(folder), files_per_trigger=1))
    parsed = L.parse_lines(source)
    seen = []
    drain(L.typed_events(parsed).writeStream.foreachBatch(lambda b, _: seen.extend(b.collect()))
          .option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start())
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(listener)
    assert len(seen) == 6 and all(r.category == "file" for r in seen)
    assert listener.stats["lines_processed"] == 9 and listener.stats["json_errors"] == 3


def test_sliding_rates_and_dedupe(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=30 * i), "a", i // 2) for i in range(40)]
    df = spark.createDataFrame(rows, "seq long, ts timestamp_ntz, container_name string, num long")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    found = {}

    def keep(batch, _):
        found.update({r.w.end: r.value for r in batch.collect()})

    rates = Q.sliding_rates(source, ["container_name"])
    drain(rates.writeStream.outputMode("update").foreachBatch(keep)
          .option("checkpointLocation", f"{tmp_path}/ck1").trigger(availableNow=True).start())
    at = start + timedelta(minutes=10)
    # (0:05:00, 0:10:00] holds ten events, one every half minute.
    assert found[at] == pytest.approx(10 / 300)
    kept = []
    drain(Q.dedupe_stream(source, ["container_name", "num"]).writeStream
          .foreachBatch(lambda b, _: kept.extend(b.collect()))
          .option("checkpointLocation", f"{tmp_path}/ck2").trigger(availableNow=True).start())
    assert sorted(r.num for r in kept) == list(range(20))


def test_envelopes_put_alerts_first(spark, feed, tmp_path):
    learned = P.path_counts(
        runtime_events(spark, FOLDER).filter(F.col("ts") < datetime(2024, 1, 2)))
    query = Q.write_envelopes(
        stream(spark, feed, 8), ["rule", "evt_type"], f"{tmp_path}/out", f"{tmp_path}/ck",
        lambda batch: D.detect_against(batch, learned), ["level", "missing_key"], once=True)
    drain(query)
    records = spark.read.parquet(f"{tmp_path}/out/batch=0").coalesce(1).collect()
    kinds = {r.type for r in records}
    assert kinds == {"event", "alert"} and len([r for r in records if r.type == "event"]) == 1000
    alert = next(r for r in records if r.type == "alert")
    assert set(json.loads(alert.payload)) == {"level", "missing_key", "severity"}
    by_batch = {}
    for r in spark.read.parquet(f"{tmp_path}/out/batch=0").orderBy("batch", "turn").collect():
        by_batch.setdefault(r.batch, []).append(r.type)
    assert all(sorted(v) == v for v in by_batch.values())


def bucket_model(rows, per_second, burst):
    sent, state = [], {}
    for host, second in sorted(rows, key=lambda r: (r[0], r[1])):
        tokens, last = state.get(host, (float(burst), None))
        tokens = min(burst, tokens + (0 if last is None else second - last) * per_second)
        if tokens >= 1:
            sent.append((host, second))
            tokens -= 1
        state[host] = (tokens, second)
    return sorted(sent)


@pytest.mark.parametrize("burst", [1, 3])
def test_drop_alerts_equal_token_bucket_in_batch_and_stream(spark, tmp_path, burst):
    import random

    rng, start, rows, over = random.Random(burst), datetime(2024, 1, 1), [], []
    for host in ("a", "b"):
        second = 0
        for _ in range(300):
            second += rng.choice([1, 1, 2, 7, 31, 200])
            dropped = rng.random() < 0.7
            if dropped:
                over.append((host, second))
            rows += [(host, start + timedelta(seconds=second), dropped)] * 3
    df = spark.createDataFrame(rows, "h string, ts timestamp_ntz, d boolean")
    # A power of two keeps the token sums exact in both forms.
    options = dict(burst=burst)
    expected = bucket_model(over, 1 / 32, burst)
    batch = sessions.drop_alerts(
        sessions.drop_ratios(df, F.col("d"), "h"), rate_per_second=1 / 32, **options)
    found = sorted((r.host, int((r.window_start - start).total_seconds())) for r in batch.collect())
    assert found == expected and len(found) < len(over)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    tail = spark.createDataFrame([("z", start + timedelta(days=9), False)], df.schema)
    tail.write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    seen = []
    limited = Q.drop_alert_stream(source, F.col("d"), "h", per_second=1 / 32, **options)
    drain(limited.writeStream.outputMode("append").foreachBatch(lambda b, _: seen.extend(b.collect()))
          .option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start())
    assert sorted(
        (r.host, int((r.window_start - start).total_seconds())) for r in seen) == expected


def test_stream_join_finds_alert_context(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=20 * i), "a" if i % 2 else "b") for i in range(60)]
    df = spark.createDataFrame(rows, "seq long, ts timestamp_ntz, container_name string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    seen = []
    joined = Q.alert_context_stream(source.filter("seq in (11, 40)"), source)
    drain(joined.writeStream.foreachBatch(lambda b, _: seen.extend(b.collect()))
          .option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start())
    assert sorted((r.alert_seq, r.seq) for r in seen) == [
        (a, s) for a, around in ((11, (9, 11, 13)), (40, (38, 40, 42))) for s in around]
