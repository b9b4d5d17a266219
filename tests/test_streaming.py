"""Streams run to their end give what the batch operators give."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from joulewright.operators import rules as batch
from joulewright.streaming import rules, windows

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def stream_of(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")


def collect(spark, df, path, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_safety_rules_with_timers(rocks, tmp_path):
    schema = "entity_id string, key string, ts timestamp, value double"
    rows = [
        [("p", "pump_state", at(0), 1.0), ("p", "water_flow_lpm", at(0), 9.0)],
        [("p", "water_flow_lpm", at(30), 0.0), ("q", "pump_state", at(30), 1.0), ("q", "tank_high", at(31), 1.0)],
        [("q", "tank_high", at(500), 0.0), ("r", "pump_state", at(700), 0.0)],
        [("r", "pump_state", at(800), 0.0)],
        [("p", "water_flow_lpm", at(900), 9.0), ("r", "pump_state", at(1500), 0.0)],
    ]
    stream = stream_of(rocks, tmp_path, rows, schema).withWatermark("ts", "10 seconds")
    got = collect(rocks, rules.alarms(stream, [rules.dry_run(60), rules.overflow("NO")]), tmp_path, "update", "alarms")
    told = {(r.entity_id, r.rule, r.start, r.end) for r in got}
    assert ("p", "dry_run", at(30), None) in told and ("p", "dry_run", at(30), at(900)) in told
    assert ("q", "overflow", at(31), None) in told and ("q", "overflow", at(31), at(500)) in told
    assert {r.severity for r in got} == {"critical"} and len(told) == 4
    # the same from the samples at rest
    wide = batch.wide_states(rocks.createDataFrame([x for b in rows for x in b], schema), ["pump_state", "water_flow_lpm", "tank_high"])
    rest = batch.dry_run(wide.withColumn("tank_low", F.lit(False)), 60).collect()
    assert [(r.entity_id, r.start, r.end) for r in rest] == [("p", at(30), at(900))]


def test_tank_contacts_are_silent_until_their_kind_is_told():
    on = {"pump_state": 1.0, "tank_low": 1.0, "tank_high": 1.0, "water_flow_lpm": 9.0}
    off = on | {"tank_low": 0.0, "tank_high": 0.0}
    assert [rules.overflow(p).holds(on) for p in (None, "NO", "NC")] == [False, True, False]
    assert [rules.dry_run(1, p).holds(off) for p in (None, "NO", "NC")] == [False, False, True]
    assert rules.dry_run(1).holds(on | {"water_flow_lpm": 0.0}) and not rules.overflow("NO").holds({"pump_state": 1.0})


def test_an_idle_site_alarms_by_the_clock(rocks, tmp_path):
    schema = "entity_id string, key string, ts timestamp, value double"
    stream = stream_of(rocks, tmp_path, [[("p", "pump_state", at(0), 1.0), ("p", "water_flow_lpm", at(0), 0.0)]], schema)
    q = rules.alarms(stream, [rules.dry_run(2)], at_once=True).writeStream.outputMode("update").format("memory").queryName("idle").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(0.5)
            if got := rocks.table("idle").collect():
                break
        time.sleep(3)  # no second alarm
        assert [(r.entity_id, r.rule, r.start, r.end) for r in got] == [("p", "dry_run", at(0), None)] and rocks.table("idle").count() == 1
    finally:
        q.stop()


def test_upserts_rewrite_only_the_days_they_touch(spark, tmp_path):
    path, schema = str(tmp_path / "events"), "entity_id string, rule string, start timestamp, end timestamp"
    merge = windows.upsert_events(path)
    day = 86400
    batches = [[("p", "r", at(0), None), ("q", "r", at(day), None)], [("p", "r", at(0), at(50))], [("p", "r", at(0), at(60)), ("s", "r", at(5), None)], [("t", "r", at(3 * day), None)]]
    for number, rows in enumerate(batches):
        for _ in range(2):  # a batch that runs again changes nothing
            merge(spark.createDataFrame(rows, schema), number)
    assert windows.batches_of(spark, path) == {"2024-01-01": [1, 2], "2024-01-02": [0], "2024-01-04": [3]}
    got = sorted((r.entity_id, r.start, r.end) for r in windows.latest_events(spark, path).collect())
    assert got == [("p", at(0), at(60)), ("q", at(day), None), ("s", at(5), None), ("t", at(3 * day), None)]
    assert {r.entity_id for r in windows.latest_events(spark, path, before=1).collect()} == {"q"}


def test_online_chart(rocks, tmp_path):
    rows = [[("e", at(i), 0.1) for i in range(5)], [("e", at(10 + i), 2.0) for i in range(4)]]
    stream = stream_of(rocks, tmp_path, rows, "entity_id string, ts timestamp, residual double")
    got = collect(rocks, rules.online_cusum(stream, 0.5, 4.0), tmp_path, "append", "chart")
    assert [(r.ts, r.cusum) for r in got] == [(at(12), 4.5)]


def test_windows_sessions_and_duplicates(spark, tmp_path):
    rows = [[("e", "k", at(s), float(s)) for s in (0, 10, 10, 1000)], [("e", "k", at(7300), 1.0)], [("e", "k", at(20000), 1.0)]]
    stream = windows.deduplicated(windows.timed(stream_of(spark, tmp_path, rows, "entity_id string, key string, ts timestamp, value double")), ["entity_id", "key", "ts"])
    got = collect(spark, windows.cells(stream, "1 hour"), tmp_path, "append", "cells")
    assert sorted((r.slot.hour, r.n_samples) for r in got) == [(0, 3), (2, 1)]


def test_sessions_and_sliding_hours(spark, tmp_path):
    schema = "entity_id string, ts timestamp"
    rows = [[("e", at(s)) for s in (0, 100, 5000)], [("e", at(30000))]]
    s = windows.timed(stream_of(spark, tmp_path, rows, schema))
    got = collect(spark, windows.sessions(s, "10 minutes"), tmp_path, "append", "sessions")
    assert sorted(r.n for r in got) == [1, 2]
    hours = collect(spark, windows.switch_counts(windows.timed(stream_of(spark, tmp_path / "b", rows, schema))), tmp_path / "b", "append", "switches")
    assert max(r.switches for r in hours) == 2


def test_static_join_and_upsert(spark, tmp_path):
    schema = "entity_id string, rule string, severity string, start timestamp, end timestamp"
    rows = [[("p", "dry_run", "critical", at(0), None), ("q", "overflow", "critical", at(5), None)], [("p", "dry_run", "critical", at(0), at(50))]]
    path = str(tmp_path / "events")
    stream = stream_of(spark, tmp_path, rows, schema)
    q = stream.writeStream.foreachBatch(windows.upsert_events(path)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.entity_id, r.end) for r in windows.latest_events(spark, path).collect()}
    assert got == {("p", at(50)), ("q", None)}
    assert windows.latest_events(spark, str(tmp_path / "nothing")) is None
    device = spark.createDataFrame([("p", "pump")], "entity_id string, device_type string")
    typed = windows.with_dimensions(stream_of(spark, tmp_path / "c", rows, schema).withColumnRenamed("start", "ts"), device)
    got = collect(spark, typed.select("entity_id", "device_type"), tmp_path / "c", "append", "typed")
    assert {(r.entity_id, r.device_type) for r in got} == {("p", "pump"), ("q", None)}


def test_late_samples_say_nothing_of_the_present(rocks, tmp_path):
    """Off at 100 s; then "on" of 90 s arrives: no dry run. A first sample of another key counts from what is known."""
    schema = "entity_id string, key string, ts timestamp, value double"
    batches = [
        [("p", "water_flow_lpm", at(0), 0.0), ("p", "pump_state", at(100), 0.0), ("q", "pump_state", at(100), 1.0)],
        [("p", "pump_state", at(90), 1.0), ("q", "water_flow_lpm", at(95), 0.0)],
        [("z", "pump_state", at(400), 0.0)],
        [("z", "pump_state", at(500), 0.0)],
    ]
    stream = stream_of(rocks, tmp_path, batches, schema).withWatermark("ts", "60 seconds")
    got = collect(rocks, rules.alarms(stream, [rules.dry_run(60)]), tmp_path, "update", "late")
    assert [(r.entity_id, r.start, r.end) for r in got] == [("q", at(100), None)]


def test_a_device_whose_clock_is_ahead_alarms(rocks, tmp_path):
    """By the cluster's clock the rule's time is over; that the device's start lies ahead of it does not matter."""
    schema = "entity_id string, key string, ts timestamp, value double"
    ahead = dt.datetime.now() + dt.timedelta(hours=30)
    stream = stream_of(rocks, tmp_path, [[("p", "pump_state", ahead, 1.0), ("p", "water_flow_lpm", ahead, 0.0)]], schema)
    q = rules.alarms(stream, [rules.dry_run(2)], at_once=True).writeStream.outputMode("update").format("memory").queryName("ahead").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(0.5)
            if got := rocks.table("ahead").collect():
                break
        assert [(r.entity_id, r.rule, r.end) for r in got] == [("p", "dry_run", None)]
    finally:
        q.stop()


def test_a_batch_and_the_stream_after_it_are_the_whole_stream(rocks, tmp_path):
    import random

    rng, schema = random.Random(3), "entity_id string, key string, ts timestamp, value double"
    told = [rules.dry_run(60), rules.overflow("NO"), rules.command_ignored(45)]
    rows = [(rng.choice("pqr"), rng.choice(("pump_state", "pump_state_cmd")), at(20 * i), float(rng.random() < 0.6)) for i in range(120)]
    rows += [(rng.choice("pqr"), rng.choice(("water_flow_lpm", "tank_high")), at(20 * i + 7), float(rng.random() < 0.4)) for i in range(120)]
    rows.sort(key=lambda r: r[2])
    end = [("z", "pump_state", at(9000), 0.0)], [("z", "pump_state", at(9999), 0.0)]
    parts = lambda x, n: [x[k : k + n] for k in range(0, len(x), n)]
    whole = stream_of(rocks, tmp_path / "a", [*parts(rows, 30), *end], schema).withWatermark("ts", "1 second")
    want = {tuple(r) for r in collect(rocks, rules.alarms(whole, told), tmp_path / "a", "update", "whole")}
    cut = rows[119][2]
    first = rocks.createDataFrame([r for r in rows if r[2] <= cut], schema)
    rest = stream_of(rocks, tmp_path / "b", [*parts([r for r in rows if r[2] > cut], 30), *end], schema).withWatermark("ts", "1 second")
    got = {tuple(r) for r in collect(rocks, rules.alarms(rest, told, initial=rules.states_at_end(first, told)), tmp_path / "b", "update", "rest")}
    before = {tuple(r) for r in want if (r[4] or r[3]) <= cut}
    assert len(want) > 20 and got <= want and want - got <= before
    # all that ends after the cut is told, and what begins after it
    assert {r for r in want if r[4] and r[4] > cut} <= got and {r for r in want if r[3] > cut} <= got


def test_a_gone_device_is_forgotten(rocks, tmp_path):
    schema = "entity_id string, key string, ts timestamp, value double"
    batches = [
        [("p", "pump_state", at(0), 1.0), ("p", "water_flow_lpm", at(0), 0.0)],
        [("q", "pump_state", at(500), 0.0)],
        [("q", "pump_state", at(5000), 0.0)],
        [("q", "pump_state", at(9000), 0.0)],
        [("p", "water_flow_lpm", at(9500), 0.0), ("q", "pump_state", at(9500), 0.0)],
        [("q", "pump_state", at(9900), 0.0)],
        [("q", "pump_state", at(9990), 0.0)],
    ]
    stream = stream_of(rocks, tmp_path, batches, schema).withWatermark("ts", "1 second")
    got = collect(rocks, rules.alarms(stream, [rules.dry_run(60)], keep_ms=3_600_000), tmp_path, "update", "gone")
    # told, ended with the last sample; the flow of 9500 s alone does not know of the pump any more
    assert [(r.entity_id, r.start, r.end) for r in got] == [("p", at(0), None), ("p", at(0), at(0))]


def test_a_chart_goes_on_from_a_batch(rocks, tmp_path):
    rows = [[("e", at(i), 1.0) for i in range(3)], [("f", at(5), 1.0)]]
    stream = stream_of(rocks, tmp_path, rows, "entity_id string, ts timestamp, residual double")
    initial = rocks.createDataFrame([("e", 3.2), ("g", 9.0)], "entity_id string, cusum double")
    got = collect(rocks, rules.online_cusum(stream, 0.5, 4.0, initial=initial), tmp_path, "append", "chart_on")
    assert [(r.entity_id, r.ts, round(r.cusum, 6)) for r in got] == [("e", at(1), 4.2)]


def test_a_chart_without_samples_is_forgotten(rocks, tmp_path):
    schema = "entity_id string, ts timestamp, residual double"
    stream = stream_of(rocks, tmp_path, [[("e", at(0), 4.0)]], schema)
    q = rules.online_cusum(stream, 0.5, 4.0, keep_ms=2000).writeStream.outputMode("append").format("memory").queryName("kept").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()

    def send(i, rows):
        rocks.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")

    def wait(e):
        for _ in range(60):
            time.sleep(0.5)
            if any(r.entity_id == e for r in rocks.table("kept").collect()):
                return

    try:
        send(1, [("a", at(0), 9.0)])
        wait("a")  # the first file has been read by now
        time.sleep(4)
        send(2, [("e", at(9), 1.0), ("b", at(9), 9.0)])
        wait("b")
        assert {r.entity_id for r in rocks.table("kept").collect()} == {"a", "b"}
    finally:
        q.stop()
