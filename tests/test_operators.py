"""Properties of operators on small made-up series, with nulls, ties, repeats and empty tables."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from joulewright.config import Config
from joulewright.functions import expressions as X
from joulewright.operators import baseline, detect, evaluate, forecast, joins, normalize, quality, recommend, report, rules, windows
from joulewright.sources import registry, tables

T0 = dt.datetime(2024, 1, 1)


def hours(spark, values, entity="e", start=T0, step=60):
    rows = [(entity, "k", start + dt.timedelta(minutes=step * i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "entity_id string, key string, slot timestamp, value double")


def test_registry_is_the_catalogue(spark):
    g = registry.groups()
    core = [n for n in g if n not in ("Plant system", "Air station", "Attribute")]
    assert sum(len(g[n]) for n in core) == 132 and [len(g[n]) for n in ("Plant system", "Air station", "Attribute")] == [13, 12, 16]
    r = {x.key: x for x in registry.registry(spark).collect()}
    assert len(r) == 173 and r["run_hours"].factor == 60.0 and r["record_count"].kind == "counter" and r["pump_state_cmd"].kind == "command"
    assert all(k in r for k in registry.roles())
    assert not registry.may_write("pump_speed_pct_sp") and registry.may_write("pump_state")
    with pytest.raises(PermissionError):
        tables.guard_write("chiller_state_cmd")


def test_grid_keeps_zero_and_missing_apart(spark):
    t = [("e", "k", T0, 0.0), ("e", "k", T0 + dt.timedelta(hours=2), 4.0), ("e", "k", T0 + dt.timedelta(hours=2, minutes=1), 6.0), ("f", "k", T0, None)]
    df = spark.createDataFrame(t, "entity_id string, key string, ts timestamp, value double")
    got = {(r.entity_id, r.slot): (r.value, r.n_samples) for r in normalize.complete(normalize.resample(df, 60), 60).collect()}
    assert got == {("e", T0): (0.0, 1), ("e", T0 + dt.timedelta(hours=1)): (None, 0), ("e", T0 + dt.timedelta(hours=2)): (5.0, 2), ("f", T0): (None, 0)}
    last = normalize.resample(df, 60, F.lit("state")).where("entity_id = 'e'").orderBy(F.desc("slot")).first()
    assert last.value == 6.0


def test_counter_amounts_are_never_negative(spark):
    rng = random.Random(1)
    values = list(itertools.accumulate(rng.random() * 5 if rng.random() > 0.1 else -rng.random() * 50 for _ in range(200)))
    got = normalize.counter_amounts(hours(spark, values), 60).orderBy("slot").collect()
    for i, r in enumerate(got):
        d = values[i] - values[i - 1] if i else None
        assert r.amount == (d if d is not None and d >= 0 else None) and r.reset == (d is not None and d < 0)
    gap = hours(spark, [1.0, None, 5.0])
    assert [(r.amount, r.gap_span) for r in normalize.counter_amounts(gap, 60).orderBy("slot").collect()] == [(None, False), (None, True)]


def test_cusum_is_the_recursion(spark):
    rng = random.Random(2)
    values = [None if rng.random() < 0.05 else rng.gauss(0, 1) for _ in range(300)]
    got = windows.cusum(hours(spark, values), ("entity_id",), "slot", F.col("value"), 0.5).orderBy("slot").collect()
    s = 0.0
    for r, v in zip(got, values):
        s = max(0.0, s + (0 if v is None else v - 0.5))
        assert abs(r.cusum - s) < 1e-9


def test_merged_events_are_apart_and_long_enough(spark):
    rng = random.Random(3)
    at = sorted(rng.sample(range(300), 90))
    cells = hours(spark, [float(i in at) for i in range(300)]).where("value = 1")
    got = windows.merge_cells(cells, ("entity_id",), "slot", 60, 120, 120, "value").orderBy("start").collect()
    assert sum(r.n_cells for r in windows.merge_cells(cells, ("entity_id",), "slot", 60, 120, 0).collect()) == 90
    for a, b in itertools.pairwise(got):
        assert (b.start - a.end).total_seconds() > 3600
    assert all((r.end - r.start).total_seconds() >= 7200 for r in got)


def test_asof_takes_the_last_mark_at_or_before(spark):
    left = spark.createDataFrame([("a", T0 + dt.timedelta(hours=h), h) for h in range(6)] + [("b", T0, 9), (None, T0, 8)], "entity_id string, ts timestamp, v int")
    right = spark.createDataFrame([("a", T0 + dt.timedelta(hours=h)) for h in (1, 3, 3)], "entity_id string, ts timestamp")
    got = {r.v: r.m and r.m.hour for r in joins.asof(left, right, "entity_id", "ts", "m").collect()}
    assert got == {0: None, 1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 9: None, 8: None}
    assert joins.asof(left, right.limit(0), "entity_id", "ts", "m").where("m IS NOT NULL").count() == 0


def test_overlaps_and_open_events(spark):
    ev = lambda rows: spark.createDataFrame([(i, e, T0 + dt.timedelta(hours=a), b and T0 + dt.timedelta(hours=b)) for i, e, a, b in rows], "id long, entity_id string, start timestamp, end timestamp")
    got = joins.overlaps(ev([(1, "x", 0, 2), (2, "x", 5, None), (3, "y", 0, 9)]), ev([(7, "x", 2, 3), (8, "x", 1, 3), (9, "x", 100, 101)]), "entity_id").collect()
    assert sorted((r.a_id, r.b_id) for r in got) == [(1, 8), (2, 9)]


def test_bands_over_midnight(spark):
    tariff = tables.split_midnight(spark.createDataFrame([("workday", 1320, 240, "off", 1.0), ("workday", 540, 660, "peak", 3.0)], "day_type string, from_min int, to_min int, band string, vnd_per_kwh double"))
    df = spark.createDataFrame([("workday", m) for m in (0, 239, 240, 540, 659, 660, 1320, 1439)] + [("off", 10), (None, 10)], "day_type string, m int")
    got = {(r.day_type, r.m): r.band for r in joins.with_band(df, tariff, F.col("m")).collect()}
    assert [got["workday", m] for m in (0, 239, 240, 540, 659, 660, 1320, 1439)] == ["off", "off", None, "peak", "peak", None, "off", "off"] and got["off", 10] is None


def test_no_refit_sees_its_own_future(spark):
    values = [1.0] * (24 * 28) + [100.0] * (24 * 14)
    grid = hours(spark, values).withColumn("day_type", F.lit("workday")).withColumn("tod_slot", F.hour("slot"))
    c = Config(fit_weeks=2, refit_weeks=1)
    for r in baseline.rolling_profile(grid, c).collect():
        lo, hi = r.refit_on - dt.timedelta(weeks=2), r.refit_on
        seen = [v for i, v in enumerate(values) if lo <= (T0 + dt.timedelta(hours=i)).date() < hi and (T0 + dt.timedelta(hours=i)).hour == r.tod_slot]
        assert len(seen) == r.n and min(seen) <= r.lower <= r.expected <= r.upper <= max(seen)


def test_linear_fit(spark):
    rng = random.Random(4)
    rows = [("e", a := rng.random(), b := rng.random() * 3, 2 + 3 * a - 1.5 * b) for _ in range(50)] + [("flat", 1.0, 2.0, 5.0)] * 3 + [("e", None, 1.0, 9.0)]
    got = {r.entity_id: r for r in baseline.fit_linear(spark.createDataFrame(rows, "entity_id string, a double, b double, y double"), ("entity_id",), "y", ["a", "b"]).collect()}
    e = got["e"]
    assert e.n == 50 and abs(e.b_0 - 2) < 1e-9 and abs(e.b_1 - 3) < 1e-9 and abs(e.b_2 + 1.5) < 1e-9
    assert got["flat"].b_1 is None


def test_fixed_window_finds_what_a_rolling_one_absorbs(spark):
    """A loss of efficiency of 12 % that creeps in over weeks after the reference window."""
    rng, rows = random.Random(5), []
    for day in range(150):
        load = 40 + 30 * rng.random()
        loss = 1 + 0.12 * min(1.0, max(0.0, (day - 70) / 60))
        rows.append(("CH", T0 + dt.timedelta(days=day), load, (0.2 + 0.001 * (60 - load)) * loss * (1 + rng.gauss(0, 0.005))))
    df = spark.createDataFrame(rows, "entity_id string, ts timestamp, load double, ratio double")
    log = spark.createDataFrame([("CH", T0 - dt.timedelta(days=1), "clean")], "entity_id string, ts timestamp, kind string")
    parts = baseline.split_by_maintenance(df, log)
    assert {r.part for r in parts.select("part").distinct().collect()} == {"settling", "reference", "current"}
    late = parts.where(F.col("part") != "current").unionByName(parts.where("ts >= '2024-05-15'"))
    fixed = detect.ratio_degradation(late, "ratio", ["load"]).first()
    assert fixed.degraded and 10 <= fixed.deviation_pct <= 14
    rolling = df.withColumn("part", F.when(F.col("ts") >= "2024-05-23", "current").when(F.col("ts") >= "2024-04-25", "reference"))
    assert not detect.ratio_degradation(rolling, "ratio", ["load"]).first().degraded
    assert detect.ratio_degradation(baseline.split_by_maintenance(df, log.limit(0)), "ratio", ["load"]).count() == 0


def daily_wave(days, rng):
    return [10 + 5 * (8 <= h < 18) + rng.gauss(0, 0.3) for _ in range(days) for h in range(24)]


def labelled(grid):
    return grid.withColumn("day_type", F.lit("workday")).withColumn("tod_slot", F.hour("slot"))


def test_injected_faults(spark):
    rng = random.Random(6)
    clean = daily_wave(28, rng)
    spike, night, leak, flat = list(clean), list(clean), list(clean), list(clean)
    spike[24 * 20 + 10] *= 3
    for h in (1, 2, 3):
        night[24 * 21 + h] += 6
    for i in range(24 * 22, 24 * 28):
        leak[i] += 0.8
    for i in range(24 * 20 + 4, 24 * 20 + 12):
        flat[i] = flat[24 * 20 + 3]
    prof = baseline.profile(labelled(hours(spark, clean)), Config(quantiles=(0.0, 0.5, 1.0)))
    found = lambda v: [(r.start, r.n_cells) for r in detect.violation_events(labelled(hours(spark, v)), prof).collect()]
    assert found(clean) == []
    assert found(spike) == [(T0 + dt.timedelta(days=20, hours=10), 1)]
    assert found(night) == [(T0 + dt.timedelta(days=21, hours=1), 3)]
    rest = labelled(hours(spark, leak)).join(prof, ["entity_id", "day_type", "tod_slot"]).withColumn("r", (F.col("value") - F.col("expected")) / 0.3)
    first = detect.cusum_events(rest, ("entity_id",), "slot", "r", 12.0, Config()).orderBy("start").first()
    assert T0 + dt.timedelta(days=22) <= first.start <= T0 + dt.timedelta(days=22, hours=12)
    assert [r.n for r in quality.stuck(hours(spark, flat), 4).collect()] == [9]


def test_odd_day_stands_out_in_pca(spark):
    rng = random.Random(7)
    v = daily_wave(40, rng)
    v[24 * 30 : 24 * 31] = [10.0 + 5 * (0 <= h < 8) for h in range(24)]
    top = detect.pca_scores(labelled(hours(spark, v)), 1).orderBy(F.desc("error")).first()
    assert top.date == (T0 + dt.timedelta(days=30)).date()


def test_boosted_band_is_ordered_and_covers(spark):
    rng = random.Random(8)
    g = labelled(hours(spark, daily_wave(30, rng)))
    rows = detect.boosted_band(g, ["tod_slot"]).collect()
    assert all(r.lower <= r.expected <= r.upper for r in rows)
    assert 0.8 < sum(r.lower <= r.value <= r.upper for r in rows) / len(rows) <= 1


def test_quality_checks(spark):
    df = spark.createDataFrame([("e", "power_factor", T0 + dt.timedelta(hours=i), v) for i, v in enumerate([5.0, 7.0, 3.0, None, 4.0])], "entity_id string, key string, ts timestamp, value double")
    assert [r.fall for r in quality.backwards(df.where("value IS NOT NULL")).collect()] == [4.0]
    lim = spark.createDataFrame([("power_factor", 0.0, 6.0)], "key string, lo double, hi double")
    assert [r.value for r in quality.out_of_range(df, lim).collect()] == [7.0]
    assert quality.stuck(df.limit(0), 2, order="ts").count() == 0


def test_a_gap_breaks_a_run_of_equal_values(spark):
    def runs(values, only=None):
        df = hours(spark, values).withColumn("power", F.when(F.hour("slot") == 2, 0.0).otherwise(1.0))
        return sorted((r.start.hour, r.n, r.value) for r in quality.stuck(df, 2, only=only).collect())

    assert runs([5.0, 5.0, None, 5.0, 5.0]) == [(0, 2, 5.0), (3, 2, 5.0)]
    assert runs([None, None, 5.0, None, 5.0]) == []
    assert runs([5.0, 5.0, 5.0, 5.0, 5.0], F.col("power") > 0) == [(0, 2, 5.0), (3, 2, 5.0)]
    assert runs([5.0, 5.0, 5.0, 5.0, 6.0]) == [(0, 4, 5.0)]


def test_budget_calibration_is_the_least_threshold_that_fits(spark):
    rng = random.Random(9)
    scores = [rng.random() for _ in range(24 * 20)]
    df = hours(spark, scores).withColumn("score", F.col("value"))
    options, days = [0.2, 0.5, 0.8, 0.9, 0.95, 0.99], 20

    def alarms(t):
        on = [i for i, s in enumerate(scores) if s > t]
        return sum(1 for k, i in enumerate(on) if k == 0 or i - on[k - 1] > 1)

    n = spark.createDataFrame([("e", days)], "entity_id string, n_days int")
    got = evaluate.calibrate(df, options, n, Config(alarm_budget=1.0)).first()
    fits = [t for t in options if all(alarms(u) / days <= 1.0 for u in options if u >= t)]
    assert got.threshold == min(fits) and abs(got.alarms_per_day - alarms(min(fits)) / days) < 1e-12


def test_rules_on_raw_samples(spark):
    sec = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [("p", sec(s), float(on), low, float(flow)) for s, on, low, flow in ((0, 1, False, 9), (10, 1, True, 9), (40, 1, None, 0), (90, 1, False, 5), (100, 0, True, 0))]
    df = spark.createDataFrame(rows, "entity_id string, ts timestamp, pump_state double, tank_low boolean, water_flow_lpm double")
    got = rules.dry_run(df, 60).collect()
    assert [(r.start, r.end, r.severity) for r in got] == [(sec(10), sec(90), "critical")]
    assert rules.dry_run(df, 80).count() == 0 and rules.dry_run(df.limit(0), 1).count() == 0
    c = df.select(rules.contact(F.lit(1.0), F.lit("NO")).alias("a"), rules.contact(F.lit(1.0), F.lit("NC")).alias("b"), rules.contact(F.lit(1.0), F.lit(None)).alias("c")).first()
    assert (c.a, c.b, c.c) == (True, False, None)
    flips = spark.createDataFrame([("p", sec(60 * i), i % 2) for i in range(10)], "entity_id string, ts timestamp, pump_state int")
    assert max(r.switches for r in rules.rapid_cycling(flips, 5).collect()) == 9


def test_best_combination_is_exhaustive(spark):
    machines = [("A", 500.0, 0.2), ("B", 700.0, 0.15), ("C", 900.0, 0.18)]
    curves = spark.createDataFrame([("P", *m) for m in machines], "plant string, entity_id string, capacity double, kw_per_kw double")
    loads = [100.0, 650.0, 1300.0, 2000.0, 2500.0]
    got = {r.load_kw: r for r in recommend.best_combination(spark.createDataFrame([("P", x) for x in loads], "plant string, load_kw double"), curves).collect()}
    for load in loads:
        best = None
        for k in range(1, 4):
            for s in itertools.combinations(machines, k):
                cap = sum(m[1] for m in s)
                if cap >= load:
                    cost = (round(load * sum(m[1] * m[2] for m in s) / cap, 6), k, [m[0] for m in s])
                    best = cost if best is None else min(best, cost)
        assert (got[load].machines, got[load].est_kw) == ((best[2], best[0]) if best else (None, None))


def test_a_plant_of_many_machines_is_searched_too(spark):
    curves = [("big", f"m{i:02}", 100.0 + i % 3 * 50, 0.2 + i % 7 / 100) for i in range(40)] + [("P", "A", 500.0, 0.2)]
    demand = [("big", 50.0), ("big", 4000.0), ("P", 50.0), ("P", 900.0), ("Q", 1.0)]
    got = recommend.best_combination(spark.createDataFrame(demand, "plant string, load_kw double"), spark.createDataFrame(curves, "plant string, entity_id string, capacity double, kw_per_kw double")).collect()
    by = {(r.plant, r.load_kw): (r.machines, r.note) for r in got}
    assert by["big", 50.0] == (["m00"], None) and by["P", 50.0] == (["A"], None) and by["P", 900.0] == (None, "no combination covers the load") and by["Q", 1.0] == (None, "no curves of this plant")
    sizes = {m: (c, r) for p, m, c, r in curves if p == "big"}
    names, note = by["big", 4000.0]
    assert note is None and sum(sizes[m][0] for m in names) >= 4000
    # machines of one rate are alike, so the best are the cheapest rates, and no smaller set of the dearest of them does
    dearest = max(sizes[m][1] for m in names)
    assert all(m in names for m in sizes if sizes[m][1] < dearest - 1e-9)


def test_machine_plan_is_the_cheapest_of_all(spark):
    machines, rng = [("A", 500.0, 0.2), ("B", 700.0, 0.15), ("C", 900.0, 0.18)], random.Random(8)
    every = [s for k in range(4) for s in itertools.combinations(range(3), k)]

    def cheapest(loads, least_on, start_cost):
        best = None
        for path in itertools.product(every, repeat=len(loads)):
            cost, must, before = 0.0, [0, 0, 0], ()
            for s, load in zip(path, loads):
                cap = sum(machines[i][1] for i in s)
                if cap < load or any(m and i not in s for i, m in enumerate(must)):
                    break
                cost += (load * sum(machines[i][1] * machines[i][2] for i in s) / cap if cap else 0) + start_cost * len(set(s) - set(before))
                must = [0 if i not in s else max(0, must[i] - 1) if i in before else least_on - 1 for i in range(3)]
                before = s
            else:
                best = cost if best is None else min(best, cost)
        return best

    for least_on, start_cost in ((1, 0.0), (2, 30.0), (3, 0.0), (3, 80.0)):
        loads = [rng.choice([0.0, 300.0, 600.0, 1300.0, 2000.0]) for _ in range(4)]
        df = spark.createDataFrame([("P", T0 + dt.timedelta(hours=i), x) for i, x in enumerate(loads)], "plant string, slot timestamp, load_kw double")
        got = recommend.plan_machines(df, machines, least_on, start_cost).orderBy("slot").collect()
        starts = sum(len(set(b.machines) - set(a.machines)) for a, b in itertools.pairwise(got)) + len(got[0].machines)
        assert abs(sum(r.est_kw for r in got) + start_cost * starts - cheapest(loads, least_on, start_cost)) < 1e-6
    many = recommend.plan_machines(df, [(str(i), 1.0, 0.1) for i in range(30)]).collect()
    assert len(many) == 4 and {r.machines for r in many} == {None} and {r.note for r in many} == {"30 machines: not planned"}


def test_backtest_is_the_join_by_range(spark):
    rng = random.Random(12)
    g = hours(spark, [rng.random() for _ in range(24 * 40)]).withColumns({"day_type": F.lit("workday"), "tod_slot": F.hour("slot")})
    got = forecast.backtest(g, "2024-01-10", 5, 4, 7)
    assert not any("Nested" in x or "<" in x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x)
    rows = g.collect()
    for r in got.collect():
        past = sorted(x.value for x in rows if x.tod_slot == r.tod_slot and r.issued_at - dt.timedelta(days=7) <= x.slot < r.issued_at)
        assert r.issued_at.date() == r.slot.date() and len(past) == 7 and abs(r.p50 - past[3]) < 1e-12
    assert got.count() == 4 * 24


def test_numbers_of_blocks_are_those_of_one_sort(spark):
    rng = random.Random(10)
    rows = [(rng.choice("ab"), T0 + dt.timedelta(hours=rng.randrange(300)), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, at timestamp, i int")
    got = windows.numbered(df, F.col("k"), F.to_date("at"), ("at", "i")).collect()
    for k in "ab":
        assert [r.i for r in sorted((r for r in got if r.k == k), key=lambda r: r.number)] == [i for kk, at, i in sorted((x for x in rows if x[0] == k), key=lambda x: x[1:])]
        assert sorted(r.number for r in got if r.k == k) == list(range(1, 1 + sum(x[0] == k for x in rows)))


def test_feeds_are_united_by_priority(spark):
    schema = "entity_id string, key string, ts timestamp, value double"
    a = spark.createDataFrame([("e", "k", T0, None), ("f", "k", T0, 1.0), ("g", "k", T0, None)], schema)
    b = spark.createDataFrame([("e", "k", T0, 2.0), ("f", "k", T0, 3.0), ("h", "k", T0, 4.0), ("h", "k", T0, 4.0)], schema)
    got = {(r.entity_id, r.value, r.source) for r in joins.unite({"first": a, "second": b}).collect()}
    assert got == {("e", 2.0, "second"), ("f", 1.0, "first"), ("g", None, "first"), ("h", 4.0, "second")}


def test_pump_schedule_is_optimal_and_safe(spark):
    price = [3.0, 1.0, 1.0, 3.0, 3.0, 2.0, 1.0, 3.0]
    rows = [("t", T0 + dt.timedelta(hours=i), 4.0, p, 10.0, 40.0, 0.0, 12.0) for i, p in enumerate(price)]
    df = spark.createDataFrame(rows, "entity_id string, slot timestamp, use_m3 double, price double, pump_m3 double, tank_m3 double, low_m3 double, start_m3 double")
    got = recommend.schedule_pump(df).orderBy("slot").collect()
    plan = [r.on for r in got]

    def cost(p):
        level = 12.0
        for on in p:
            level += 10 * on - 4
            if not 0 <= level <= 40:
                return None
        runs = [(k, len(list(g))) for k, g in itertools.groupby(p)]
        if any(n < 2 for i, (k, n) in enumerate(runs) if k and i < len(runs) - 1):
            return None
        return sum(c for c, on in zip(price, p) if on)

    best = min(c for p in itertools.product((0, 1), repeat=8) if (c := cost(p)) is not None)
    assert cost(plan) == best
    dry = df.withColumn("use_m3", F.lit(50.0))
    assert {r.on for r in recommend.schedule_pump(dry).collect()} == {None}


def test_golden_documents(spark):
    at = F.to_timestamp(F.lit("2026-09-16 14:00:00"))
    r = spark.range(1).select(X.tod_slot(at, 15).alias("slot"), X.deviation_pct(F.lit(0.213), F.lit(0.187)).alias("dev"), X.document_id("A", at, F.lit(42), 4).alias("id")).first()
    assert (r.slot, r.dev, r.id) == (56, 13.9, "A-20260916-0042")
    e = spark.createDataFrame([("e",)], "entity_id string")
    points = forecast.horizon(e, at, 24, 15)
    assert points.count() == 96
    docs = forecast.documents(points.withColumns({c: F.lit(1.0) for c in ("p10", "p50", "p90")}), "cooling_kw", 24, 15).first()
    assert (len(docs.points), docs.horizon, docs.step) == (96, "24h", "15min")
    ev = spark.createDataFrame([("CH-02", T0, None)], "entity_id string, start timestamp, end timestamp")
    out = detect.as_events(ev, "B_efficiency", "M2_chiller", "cop_degradation", "m", at, "check", {"x": F.lit(1)})
    doc = out.select(tables.as_document(F.struct("*")).alias("j")).first().j
    assert '"end":null' in doc and '"severity":"info"' in doc
    p = spark.createDataFrame([(T0, T0, "a", "b", ["c"], 96.0)], "valid_from timestamp, valid_to timestamp, action string, reason string, constraints_checked array<string>, est_saving_kwh double")
    assert recommend.documents(p, "M2", at, F.lit(2604.17)).first().status == "pending_operator"


def test_division_by_zero_is_null(spark):
    r = spark.range(1).select(X.cop(F.lit(0.0), F.lit(5.0)).alias("a"), X.kw_per_kw(F.lit(1.0), F.lit(0.0)).alias("b"), X.unbalance_pct(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("c"), X.pump_head(F.lit(1.0), F.lit(0.5), F.lit(0.0)).alias("d")).first()
    assert list(r) == [None] * 4


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("timestamp,m1,m.2\n2016-01-01 00:00:00,1.5,\n2016-01-01 01:00:00,0,7\n")
    got = sorted((r.entity_id, r.ts.hour, r.value) for r in tables.read_wide_meters(spark, str(tmp_path / "wide.csv")).collect())
    assert got == [("m.2", 1, 7.0), ("m1", 0, 1.5), ("m1", 1, 0.0)]
    (tmp_path / "cal.csv").write_text("site,date,day_type,op_start_min,op_end_min\ns,2024-01-01,holiday,480,1080\n")
    assert tables.read_table(spark, "calendar", str(tmp_path / "cal.csv"), "csv").first().day_type == "holiday"
    out = str(tmp_path / "events")
    tables.write_documents(spark.createDataFrame([("M1", "2024-01-01", "x", "power_active_kw")], "module string, date string, end string, key string"), out)
    assert spark.read.parquet(out).count() == 1
    with pytest.raises(ValueError):
        tables.write_documents(spark.createDataFrame([("pump_state_cmd", 1)], "key string, v int"), out)


def test_report_tables_of_a_period_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "report")
    for n in (3, 5):
        tables.write_report({"totals": spark.range(n), "events": spark.range(1)}, path, "2024-01-01")
    tables.write_report({"totals": spark.range(2)}, path, "2024-01-08")
    got = spark.read.parquet(f"{path}/totals")
    assert {(str(r.period), r["count"]) for r in got.groupBy("period").count().collect()} == {("2024-01-01", 5), ("2024-01-08", 2)}


def test_report_caps_and_counts(spark):
    days = spark.createDataFrame([("e", dt.date(2024, 1, 1 + i), float(i % 4)) for i in range(10)], "entity_id string, date date, s double")
    assert [r.rank for r in report.capped_days(days, "s", 3).orderBy("rank").collect()] == [1, 2, 3]
    assert report.capped_days(days.limit(0), "s", 3).count() == 0


def test_document_ids_stay_unique_beyond_their_width(spark):
    at = F.to_timestamp(F.lit("2026-09-16 14:00:00"))
    p = spark.range(1050).select(
        F.lit(T0).alias("valid_from"), F.lit(T0).alias("valid_to"), F.format_string("run %05d", "id").alias("action"), F.lit("cheaper").alias("reason"),
        F.array(F.lit("comfort")).alias("constraints_checked"), F.lit(1.0).alias("est_saving_kwh"),
    )
    ids = {r.action: r.rec_id for r in recommend.documents(p, "M2", at, F.lit(1.0)).collect()}
    assert len(set(ids.values())) == 1050
    assert (ids["run 00006"], ids["run 00998"], ids["run 01009"]) == ("R-20260916-007", "R-20260916-999", "R-20260916-1010")
    numbers = spark.createDataFrame([(9999,), (10000,), (10001,)], "n int")
    assert [r.id for r in numbers.orderBy("n").select(X.document_id("A", at, F.col("n"), 4).alias("id")).collect()] == ["A-20260916-9999", "A-20260916-10000", "A-20260916-10001"]


def test_pump_schedule_of_each_horizon(spark):
    rows = [("t", d, T0 + dt.timedelta(days=d, hours=i), use, p, 10.0, 40.0, 0.0, 12.0) for d, use in enumerate((4.0, 50.0, 4.0)) for i, p in enumerate([3.0, 1.0, 1.0, 3.0, 2.0])]
    df = spark.createDataFrame(rows, "entity_id string, day int, slot timestamp, use_m3 double, price double, pump_m3 double, tank_m3 double, low_m3 double, start_m3 double")
    got = [(r.on, r.level) for r in recommend.schedule_pump(df, by=("entity_id", "day")).orderBy("slot").collect()]
    alone = [(r.on, r.level) for r in recommend.schedule_pump(df.where("day = 0")).orderBy("slot").collect()]
    assert got[:5] == got[10:] == alone and all(on is not None for on, _ in alone) and {on for on, _ in got[5:10]} == {None}


def test_interval_joins_have_a_time_bucket(spark):
    rng = random.Random(7)
    ends = [None, dt.datetime(9999, 1, 1), *[T0 + dt.timedelta(minutes=rng.randrange(6000)) for _ in range(60)]]

    def intervals(n):
        return [(i, rng.choice("xy"), T0 + dt.timedelta(minutes=rng.randrange(6000)), rng.choice(ends)) for i in range(n)]

    a, b = intervals(120), intervals(120)
    x, y = (spark.createDataFrame(r, "id long, entity_id string, start timestamp, end timestamp") for r in (a, b))
    got = joins.overlaps(x, y, "entity_id")
    far = dt.datetime(9999, 1, 1)
    want = [(p[0], q[0]) for p in a for q in b if p[1] == q[1] and p[2] < (q[3] or far) and q[2] < (p[3] or far)]
    assert sorted((r.a_id, r.b_id) for r in got.collect()) == sorted(want)
    alarms = [(q[1], q[2]) for q in b]
    late = evaluate.delays(spark.createDataFrame(alarms, "entity_id string, slot timestamp"), x)
    first = {p[0]: min((t for e, t in alarms if e == p[1] and p[3] and p[2] <= t < p[3]), default=None) for p in a}
    assert {r.id: r.delay_min for r in late.collect()} == {p[0]: first[p[0]] and (first[p[0]] - p[2]).total_seconds() / 60 for p in a}
    none = evaluate.delays(spark.createDataFrame([], "entity_id string, slot timestamp"), x).collect()
    assert len(none) == len(a) and all(r.delay_min is None for r in none)
    for df in (got, late):
        assert "Join" in (plan := df._jdf.queryExecution().optimizedPlan().toString()) and "_bucket" in plan
