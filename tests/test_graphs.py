"""Identity, hierarchies, charts that begin again and exact thresholds against plain versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from joulewright.config import Config
from joulewright.operators import evaluate, graphs, windows

T0 = dt.datetime(2024, 1, 1)
RNG = random.Random(31)


def plain_units(devices):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    clean = lambda v: None if v is None or v.strip().upper() in graphs.BLANK else v.strip().upper()
    for s, e, *ids in devices:
        for i, v in enumerate(ids):
            if clean(v):
                parent[find((i, clean(v)))] = find((s, e))
        find((s, e))
    out = {}
    for s, e, *_ in devices:
        out.setdefault(find((s, e)), set()).add((s, e))
    told = {}
    for members in out.values():
        serials = {clean(d[2]) for d in devices if (d[0], d[1]) in members} - {None}
        sources = {s for s, _ in members}
        told |= {m: (min(f"{s}/{e}" for s, e in members), len(sources), len(members) > len(sources) or len(serials) > 1) for m in members}
    return told


def identified(spark, devices):
    df = spark.createDataFrame(devices, "source string, entity_id string, serial_number string, vendor_device_id string")
    return {(r.source, r.entity_id): (r.unit, r.n_sources, r.conflict) for r in graphs.identify(df).collect()}


def test_chains_of_numbers_meet(spark):
    devices = [("dmp", "a", "S1", None), ("noris", "b", "s1 ", "V1"), ("third", "c", None, "V1"), ("dmp", "d", "unknown", "-"), ("noris", "e", None, None), ("dmp", "f", "V1", None), ("noris", "g", "S9", "V9"), ("dmp", "h", "S8", "v9")]
    got = identified(spark, devices)
    assert got["dmp", "a"] == got["noris", "b"] == got["third", "c"] == ("dmp/a", 3, None)
    assert got["dmp", "d"] == ("dmp/d", 1, None) and got["noris", "e"] == ("noris/e", 1, None) and got["dmp", "f"] == ("dmp/f", 1, None)
    assert got["noris", "g"] == got["dmp", "h"] == ("dmp/h", 2, "2 values of serial_number")
    telemetry = spark.createDataFrame([("noris", "b", 1.0), ("noris", "g", 2.0), ("x", "y", 3.0)], "source string, entity_id string, value double")
    identity = graphs.identify(spark.createDataFrame(devices, "source string, entity_id string, serial_number string, vendor_device_id string"))
    assert {(r.entity_id, r.value) for r in graphs.by_unit(telemetry, identity).collect()} == {("dmp/a", 1.0), ("g", 2.0), ("y", 3.0)}


def test_random_devices(spark):
    devices = [(RNG.choice(("dmp", "noris", "phattai")), f"e{i}", RNG.choice([None, f"S{RNG.randrange(60)}"]), RNG.choice([None, "n/a", f"V{RNG.randrange(60)}"])) for i in range(90)]
    devices += [(s, e, "other", v) for s, e, _, v in devices[:5]]
    got = identified(spark, devices)
    assert {k: (u, n, c is not None) for k, (u, n, c) in got.items()} == plain_units(devices)


def test_a_long_chain(spark):
    devices = [("dmp" if i % 2 else "noris", f"e{i}", f"S{i // 2}", f"V{(i + 1) // 2}") for i in range(60)]
    assert {v[0] for v in identified(spark, devices).values()} == {"dmp/e1"}


def test_closure_of_depth_six_with_a_cycle(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(6)] + [("n0", "m"), ("m", "n4"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), (None, "n1"), ("q", None), ("n0", "n1")]
    df = spark.createDataFrame(edges, "child string, parent string")
    closed = graphs.closure(df)
    got = {(r.child, r.parent): r.depth for r in closed.collect()}
    up = {}
    for c, p in edges:
        if c and p:
            up.setdefault(c, set()).add(p)
    want = {}
    for c in up:
        level, depth = {c}, 0
        while level:
            depth += 1
            level = {p for x in level for p in up.get(x, ())} - {p for (a, p) in want if a == c}
            want |= {(c, p): depth for p in level}
    assert got == want and got["n0", "n6"] == 4 and got["n1", "n6"] == 5
    assert {(r.node, r.length) for r in graphs.cycles(closed).collect()} == {("x", 3), ("y", 3), ("z", 3)}
    assert [(r.child, r.parents) for r in graphs.several_parents(df.where("child IS NOT NULL AND parent IS NOT NULL")).collect()] == [("n0", ["m", "n1"])]
    kw = spark.createDataFrame([("n0", 1.0), ("n3", 2.0), ("x", 4.0), ("w", 8.0)], "entity string, kw double")
    total = {r.node: r.total for r in graphs.roll_up_all(kw, closed, "entity", "kw").collect()}
    assert total["n6"] == 3.0 and total["m"] == 1.0 and total["z"] == 12.0 and total["x"] == 12.0


def plain_closure(edges):
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)
    out = {}
    for c in up:
        level, depth = {c}, 0
        while level:
            depth += 1
            level = {p for x in level for p in up.get(x, ())} - {p for (a, p) in out if a == c}
            out |= {(c, p): depth for p in level}
    return out


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_closure_writes_a_pair_once(spark, monkeypatch, broadcast):
    """Of hierarchies with many ways to a parent, a long chain and cycles; a round adds to what is known and does not write it again."""
    rng = random.Random(5)
    two_ways = [(n, n // k) for n in range(400) for k in (3, 5) if n // k]
    chain = [(1000 + i, 1001 + i) for i in range(37)] + [(1005, 1021)]
    loops = [(2000 + rng.randrange(25), 2000 + rng.randrange(25)) for _ in range(40)]
    edges = two_ways + chain + loops
    written = []
    real = graphs.saved

    def spy(df, name):
        out = real(df, name)
        written.extend([out.count()] if name == "paths" else [])
        return out

    monkeypatch.setattr(graphs, "saved", spy)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        rows = graphs.closure(spark.createDataFrame(edges, "child long, parent long")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = plain_closure(edges)
    assert len(rows) == len(want) and {(r.child, r.parent): r.depth for r in rows} == want
    assert max(want.values()) > 16 and any(c == p for c, p in want)
    assert sum(written) == len(want)


def test_closure_of_nothing_and_of_a_loop(spark):
    assert graphs.closure(spark.createDataFrame([(None, "a")], "child string, parent string")).collect() == []
    looped = graphs.closure(spark.createDataFrame([("a", "a"), ("b", "a"), ("b", "a")], "child string, parent string"))
    assert looped.dtypes == [("child", "string"), ("parent", "string"), ("depth", "bigint")]
    assert sorted(map(tuple, looped.collect())) == [("a", "a", 1), ("b", "a", 1)]


def test_a_chart_begins_again_after_each_alarm(spark):
    rows = [(e, i, RNG.choice([None, RNG.uniform(-1, 2)])) for e in "abc" for i in range(300)]
    RNG.shuffle(rows)
    df = spark.createDataFrame(rows, "e string, i int, r double")
    got = {(r.e, r.i): (r.cusum, r.alarm) for r in windows.restarting_cusum(df, ("e",), "i", F.col("r"), 0.5, 3.0).collect()}
    alarms = 0
    for e in "abc":
        s = 0.0
        for _, i, r in sorted(x for x in rows if x[0] == e and True):
            s = max(0.0, s + (0.0 if r is None else r - 0.5))
            assert got[e, i] == (s, s > 3.0)
            alarms += s > 3.0
            s = 0.0 if s > 3.0 else s
    assert alarms > 5
    assert windows.restarting_cusum(df.limit(0), ("e",), "i", F.col("r"), 0.5, 3.0).count() == 0


def merged_events(cells, t, gap):
    at = sorted({h for h, s in cells if s > t})
    return sum(1 for k, h in enumerate(at) if not k or h - at[k - 1] > gap)


@pytest.mark.parametrize("budget,gap", [(0.2, 1), (1.0, 3), (3.0, 1), (0.0, 2)])
def test_the_threshold_is_the_least_of_all_scores(spark, budget, gap):
    rows = [(e, RNG.randrange(200), RNG.choice([1.0, 1.5, 2.0, 25.0, round(RNG.uniform(1, 40), 2)])) for e in "abcd" for _ in range(80)]
    df = spark.createDataFrame([(e, T0 + dt.timedelta(hours=h), s) for e, h, s in rows], "entity_id string, slot timestamp, score double")
    days = spark.createDataFrame([(e, 9) for e in "abcd"], "entity_id string, n_days int")
    got = {r.entity_id: (r.threshold, r.alarms_per_day) for r in evaluate.calibrate_exactly(df, days, Config(alarm_budget=budget, merge_gap=gap * 60)).collect()}
    counts = {(r.entity_id, r.threshold): r.n for r in evaluate.events_by_threshold(df, gap * 60).collect()}
    for e in "abcd":
        cells = {}
        for x, h, s in rows:
            if x == e:
                cells[h] = max(s, cells.get(h, 0))
        cells = list(cells.items())
        fits = [t for t in (0.0, *sorted({s for _, s in cells})) if merged_events(cells, t, gap) / 9 <= budget]
        want = min(fits)
        threshold, rate = got[e]
        assert (threshold or 0.0) == want or merged_events(cells, threshold or 0.0, gap) == merged_events(cells, want, gap) == round(rate * 9)
        assert merged_events(cells, threshold or 0.0, gap) <= budget * 9
        assert all(n == merged_events(cells, t or 0.0, gap) for (x, t), n in counts.items() if x == e)


def test_attribute_history_of_late_and_repeated_snapshots(spark):
    from joulewright.operators import normalize

    at = lambda d: T0 + dt.timedelta(days=d)
    rows = [("a", at(1), "v1", None), ("a", at(3), "v1", None), ("a", at(5), "v2", None), ("a", at(6), "v2", "x"), ("b", at(2), None, None), ("b", at(4), None, None), (None, at(1), "z", None), ("c", None, "z", None)]
    schema = "entity_id string, seen_at timestamp, firmware_version string, label string"
    told = lambda r: {tuple(x) for x in normalize.attribute_history(spark.createDataFrame(r, schema), ["firmware_version", "label"]).collect()}
    want = {("a", "v1", None, at(1), at(5), at(3)), ("a", "v2", None, at(5), at(6), at(5)), ("a", "v2", "x", at(6), None, at(6)), ("b", None, None, at(2), None, at(4))}
    assert told(rows) == told(rows * 3) == want
    late = rows + [("a", at(2), "v0", None)]
    assert told(late) == want - {("a", "v1", None, at(1), at(5), at(3))} | {("a", "v1", None, at(1), at(2), at(1)), ("a", "v0", None, at(2), at(3), at(2)), ("a", "v1", None, at(3), at(5), at(3))}
    history = normalize.attribute_history(spark.createDataFrame(rows, schema), ["firmware_version"])
    kept = normalize.outside_firmware_steps(spark.createDataFrame([("a", at(5)), ("a", at(7))], "entity_id string, ts timestamp"), history, 24)
    assert [r.ts for r in kept.collect()] == [at(7)]


def test_a_run_that_is_repeated_leaves_one_copy(spark, tmp_path):
    from joulewright.sources import tables

    path, schema = str(tmp_path / "out"), "v int, module string, date string"
    docs = lambda n: spark.createDataFrame([(n, "M1", "2024-01-01"), (n + 1, "M2", "2024-01-02")], schema)
    assert tables.read_runs(spark, path, schema).count() == 0
    tables.write_run(docs(1), path, "1")
    tables.write_run(docs(1), path, "1")
    tables.write_run(docs(5), path, "2")
    assert sorted((r.v, r.run) for r in tables.read_runs(spark, path, schema).collect()) == [(1, "1"), (2, "1"), (5, "2"), (6, "2")]
    # killed halfway: files, but no commit; then repeated
    bad = docs(8).withColumn("v", F.when(F.col("v") == 9, F.raise_error(F.lit("killed")).cast("int")).otherwise(F.col("v"))).repartition(2, "module")
    with pytest.raises(Exception, match="killed"):
        tables.write_run(bad, path, "3")
    docs(8).write.partitionBy("module", "date").mode("overwrite").parquet(f"{path}/run=3")
    assert tables.read_runs(spark, path, schema).count() == 4
    tables.write_run(docs(8), path, "3")
    assert sorted(r.v for r in tables.read_runs(spark, path, schema).where("module = 'M1'").collect()) == [1, 5, 8]
    with pytest.raises(ValueError):
        tables.write_run(docs(1), path, "../x")
