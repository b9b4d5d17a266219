"""The flows from end to end on a made-up building of a few weeks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from joulewright.config import Config
from joulewright.operators import baseline, detect, recommend
from joulewright.plans import flows
from joulewright.sources import registry

T0 = dt.datetime(2024, 1, 1)
WEEKS = 5


@pytest.fixture(scope="module")
def building(spark):
    rng, rows, total = random.Random(1), [], 1000.0
    for i in range(24 * 7 * WEEKS):
        at = T0 + dt.timedelta(hours=i)
        load = 20 + (30 if at.weekday() < 5 and 8 <= at.hour < 18 else 0) + rng.gauss(0, 1)
        if i == 24 * 30 + 2:
            load += 60  # after hours
        total = total + load if i != 400 else 5.0
        if i not in (200, 201):
            rows.append(("M", "Plant system", "active_energy_kwh", at, total))
            rows.append(("M", "platform", "power_active_kw", at, load))
    days = [(T0.date() + dt.timedelta(days=k), ["workday"] * 5 + ["saturday", "off"]) for k in range(7 * WEEKS)]
    cal = [("s", d, kinds[d.weekday()], 480, 1080 if d.weekday() < 5 else 480) for d, kinds in days]
    telemetry = spark.createDataFrame(rows, "entity_id string, source string, key string, ts timestamp, value double")
    return telemetry, spark.createDataFrame(cal, "site string, date date, day_type string, op_start_min int, op_end_min int")


def test_consumption_and_report(spark, building):
    telemetry, calendar = building
    c = Config(fit_weeks=3, refit_weeks=1, quantiles=(0.0, 0.5, 1.0), min_samples=2)
    flow = flows.consumption(telemetry, registry.registry(spark), calendar, F.to_timestamp(F.lit("2024-02-05")), config=c)
    grid = {(r.key, r.slot): r for r in flow.grid.collect()}
    gap, reset = T0 + dt.timedelta(hours=200), T0 + dt.timedelta(hours=400)
    assert grid["power_active_kw", gap].value is None and grid["power_active_kw", gap].flags == ["missing"]
    assert grid["energy_active_kwh_total", reset].value is None and "backwards" in grid["energy_active_kwh_total", reset].flags
    assert grid["energy_active_kwh_total", T0 + dt.timedelta(hours=202)].flags == ["after_gap"]
    events = flow.events.where("start <= timestamp'2024-01-31 02:00:00' AND end > timestamp'2024-01-31 02:00:00' AND double(evidence['peak_score']) > 10").collect()
    assert {r.evidence["key"] for r in events} == {"power_active_kw", "energy_active_kwh_total"} and {r.severity for r in events} == {"warning"}
    b = flow.baselines.where("key = 'power_active_kw'").first()
    assert b.window.type == "rolling" and b.baseline_layer == "history" and b.lower <= b.expected <= b.upper and b.window.refit_on <= str(b.ts.date())
    area = spark.createDataFrame([("M", "floor 1")], "entity_id string, area_id string")
    props = spark.createDataFrame([("M1", "accepted", 5.0, 100), ("M1", "pending_operator", 7.0, 9)], "module string, status string, est_saving_kwh double, est_saving_vnd long")
    parts = flows.periodic_report(flow, area, props)
    assert {n: d.count() > 0 for n, d in parts.items()} == dict.fromkeys(parts, True)
    assert parts["valid_samples"].first().n_missing == 4
    empty = flows.consumption(telemetry.limit(0), registry.registry(spark), calendar, F.current_timestamp(), config=c)
    assert empty.events.count() == 0 and empty.grid.count() == 0


def test_chiller_efficiency(spark):
    rng, rows = random.Random(2), []
    for day in range(90):
        for h in range(8, 18):
            at = T0 + dt.timedelta(days=day, hours=h)
            for m, bad in (("CH-1", 0.0), ("CH-2", 0.15), ("CH-3", 0.3)):
                load = 40 + 30 * rng.random()
                loss = 1 + (bad if day > 60 else 0)
                cooling = load * 10
                ratio = (0.2 + 0.001 * (60 - load)) * loss
                rows += [(m, k, at, v) for k, v in (("power_active_kw", cooling * ratio), ("cooling_kw", cooling), ("chiller_load_pct", load), ("chiller_state", 1.0))]
    grid = spark.createDataFrame(rows, "entity_id string, key string, slot timestamp, value double")
    rating = spark.createDataFrame([(m, 1000.0) for m in ("CH-1", "CH-2", "CH-3")], "entity_id string, rated_cooling_kw double")
    log = spark.createDataFrame([(m, T0, "clean") for m in ("CH-1", "CH-2")], "entity_id string, ts timestamp, kind string")
    got = flows.chiller_efficiency(grid, rating, log, F.to_timestamp(F.lit("2024-04-01")), Config(reference_weeks=8)).collect()
    assert [(r.entity_id, r.severity, r.end, r.group) for r in got] == [("CH-2", "info", None, "B_efficiency")]
    assert got[0].evidence["reference_window"] == "2024-01-03..2024-02-27"
    assert got[0].start.date() == T0.date() + dt.timedelta(days=61) and (got[0].evidence["detected_on"] - got[0].start.date()).days < 7
    assert 13 < got[0].evidence["deviation_pct"] < 17 and got[0].evidence["load_pct_range"] == [40.0, 70.0] and got[0].estimated_waste_kwh_per_month > 0


@pytest.mark.parametrize("loss,begins", [(0.10, 0), (0.10, 60), (0.15, 60), (0.0, 0)])
def test_a_loss_is_found_within_seven_days_whenever_it_begins(spark, loss, begins):
    rng, rows = random.Random(5), []
    for day in range(70 + begins + 12):
        for h in range(8, 18):
            load = 40 + 30 * rng.random()
            ratio = (0.2 + 0.001 * (60 - load)) * (1 + rng.gauss(0, 0.02)) * (1 + (loss if day >= 70 + begins else 0))
            rows.append(("CH", T0 + dt.timedelta(days=day, hours=h), load, ratio, "reference" if day < 56 else "current"))
    df = spark.createDataFrame(rows, "entity_id string, slot timestamp, load double, ratio double, part string")
    got = detect.degradation_events(df, "ratio", ["load"]).collect()
    if not loss:
        assert got == []
        return
    began = T0.date() + dt.timedelta(days=70 + begins)
    assert len(got) == 1 and abs((got[0].start - began).days) <= 1 and (got[0].detected_on - began).days < 7
    assert abs(got[0].deviation_pct - loss * 100) < 2.5
    falling = df.withColumn("ratio", 1 / F.col("ratio"))
    assert detect.degradation_events(falling, "ratio", ["load"], sign=-1).count() == 1 and detect.degradation_events(falling, "ratio", ["load"]).count() == 0


def test_pump_degradation(spark):
    rng, rows = random.Random(6), []
    for day in range(90):
        for h in range(8, 14):
            at = T0 + dt.timedelta(days=day, hours=h)
            for pump, bad in (("P-1", 0.0), ("P-2", 0.2)):
                loss, speed = (bad if day >= 70 else 0), 60 + 30 * rng.random()
                flow = 100 + 2 * speed + rng.gauss(0, 2)
                rise = 3 * (speed / 100) ** 2 * (1 - loss)
                rows += [(pump, k, at, v) for k, v in (("pump_state", 1.0), ("pump_speed_pct", speed), ("pressure_supply_bar", 1 + rise), ("pressure_return_bar", 1.0), ("water_flow_lpm", flow), ("power_active_kw", 0.3 * flow * 60 / 1000))]
    grid = spark.createDataFrame(rows, "entity_id string, key string, slot timestamp, value double")
    log = spark.createDataFrame([(m, T0, "clean") for m in ("P-1", "P-2")], "entity_id string, ts timestamp, kind string")
    got = flows.pump_degradation(grid, log, F.to_timestamp(F.lit("2024-04-01"))).collect()
    assert [(r.entity_id, r.type, r.severity) for r in got] == [("P-2", "pump_head_loss", "info")]
    assert abs((got[0].start.date() - T0.date()).days - 70) <= 1 and '"deviation_pct":-' in got[0].evidence


def test_odd_shapes_and_rule_documents(spark):
    rng, rows = random.Random(9), []
    for day in range(28):
        date = T0 + dt.timedelta(days=day)
        kind = ["workday"] * 5 + ["saturday", "off"]
        for h in range(24):
            busy = date.weekday() < 5 and 8 <= h < 18
            load = 10 + (20 + (15 if h == (18 if day == 9 else 14) else 0) if busy or day == 9 and h == 18 else 0) + rng.random()
            rows.append(("M", date + dt.timedelta(hours=h), 10 + rng.random() if day == 16 else load, kind[date.weekday()], h))
    grid = spark.createDataFrame(rows, "entity_id string, slot timestamp, value double, day_type string, tod_slot int")
    shapes = flows.odd_shapes(grid, [18, 19], 20.0, F.to_timestamp(F.lit("2024-02-01")))
    told = {r.start.day: set(r.evidence["kinds"]) for r in shapes.collect()}
    assert "peak_moved" in told[10] and "wrong_day_type" in told[17] and len(told) <= 3
    alarms = spark.createDataFrame([("p", T0, T0 + dt.timedelta(minutes=5), "dry_run", "critical"), ("v", T0, None, "stuck_valve", "warning")], "entity_id string, start timestamp, end timestamp, rule string, severity string")
    at = F.to_timestamp(F.lit("2024-02-01"))
    both = detect.combined([shapes, detect.rule_documents(alarms, "M3_water", at)], at).collect()
    assert len({r.event_id for r in both}) == len(both) == len(told) + 2
    assert {(r.type, r.severity, r.evidence) for r in both if r.group == "S_state"} == {("dry_run", "critical", '{"seconds":300}'), ("stuck_valve", "warning", '{"seconds":null}')}


def test_events_of_one_second_are_numbered_in_order_of_their_ends(spark):
    """However the rows are dealt out; an open event comes last."""
    at = F.to_timestamp(F.lit("2024-02-01"))
    rows = [("p", T0, T0 + dt.timedelta(seconds=s) if s < 40 else None, "overflow", "critical") for s in range(41)]
    for given in (rows, rows[::-1]):
        alarms = spark.createDataFrame(given, "entity_id string, start timestamp, end timestamp, rule string, severity string")
        docs = detect.rule_documents(alarms, "M3_water", at)
        for told in (docs, detect.combined([docs], at)):
            assert [r.end for r in told.orderBy("event_id").collect()] == [r[2] for r in rows]


def test_water_plan(spark):
    rows = [("T", T0 + dt.timedelta(hours=i), 2.0 + (3.0 if 6 <= i % 24 < 9 else 0.0), "workday", i % 24) for i in range(24 * 14)]
    history = spark.createDataFrame(rows, "entity_id string, slot timestamp, value double, day_type string, tod_slot int")
    tanks = spark.createDataFrame([("T", 8.0, 40.0, 5.0, 20.0)], "entity_id string, pump_m3 double, tank_m3 double, low_m3 double, start_m3 double")
    price = F.when(F.col("tod_slot").between(9, 11), 3.0).otherwise(1.0)
    docs, plan = flows.water_plan(history, tanks, price, F.to_timestamp(F.lit("2024-01-15 00:00:00")))
    assert len(docs.first().points) == 24
    got = plan.orderBy("slot").collect()
    assert len(got) == 24 and all(r.on in (0, 1) and 5 <= r.level <= 40 for r in got) and not any(r.on for r in got[9:12])


def test_layers_of_the_consumption_flow(spark):
    rng, rows = random.Random(11), []
    for i in range(24 * 7 * 6):
        at = T0 + dt.timedelta(hours=i)
        heat = 25 + 8 * rng.random()
        for m in ("M1", "M2", "M3"):
            load = 20 + 3 * (heat - 25) + rng.gauss(0, 0.3) + (14 if m == "M2" and i == 24 * 40 + 3 else 0)
            rows.append((m, "power_active_kw", at, load, heat))
    df = spark.createDataFrame(rows, "entity_id string, key string, ts timestamp, value double, heat double")
    calendar = spark.createDataFrame([], "site string, date date, day_type string, op_start_min int, op_end_min int")
    conditions = df.select("entity_id", F.col("ts").alias("slot"), "heat")
    device = df.select("entity_id").distinct().withColumn("device_model", F.lit("x"))
    c = Config(fit_weeks=3, refit_weeks=1, min_samples=2, alarm_budget=0.2)
    run = lambda **k: flows.consumption(df.drop("heat").withColumn("source", F.lit("platform")), registry.registry(spark), calendar, F.to_timestamp(F.lit("2024-03-01")), config=c, **k).events
    plain, told = run(), run(conditions=conditions, x=["heat"], device=device)
    found = told.where("entity_id = 'M2' AND start = timestamp'2024-02-10 03:00:00'").collect()
    assert len(found) == 1 and found[0].evidence["layers"] == ["peers", "profile_band"] and found[0].rule_or_model == "peers+profile_band"
    assert found[0].estimated_waste_kwh_per_month > 300 and found[0].evidence["peak_score"] > 2
    days = 42
    assert max(r["count"] for r in plain.groupBy("entity_id").count().collect()) <= 0.2 * days
    assert all(r["count"] <= 0.2 * days for r in told.groupBy("entity_id").count().collect())


def test_cooling_proposals(spark):
    rng = random.Random(3)
    rows = [("P", T0 + dt.timedelta(hours=i), 300 + 20 * (i % 24) + rng.gauss(0, 5), "workday", i % 24, 25.0 + (i % 24) / 4) for i in range(24 * 28)]
    history = spark.createDataFrame(rows, "entity_id string, slot timestamp, value double, day_type string, tod_slot int, temperature double")
    curves = spark.createDataFrame([("P", "A", 500.0, 0.2), ("P", "B", 700.0, 0.16)], "plant string, entity_id string, capacity double, kw_per_kw double")
    tariff = spark.createDataFrame([("workday", 0, 1440, "all", 2000.0)], "day_type string, from_min int, to_min int, band string, vnd_per_kwh double")
    docs, props = flows.cooling_proposals(history, None, curves, tariff, F.to_timestamp(F.lit("2024-01-29 00:00:00")), 0.21)
    d = docs.first()
    assert len(d.points) == 24 and all(p.p10 <= p.p50 <= p.p90 for p in d.points)
    p = props.orderBy("valid_from").collect()
    assert p[0].action == "Run B" and p[-1].action == "Run A + B" and all(x.status == "pending_operator" and x.est_saving_kwh > 0 for x in p)
    assert p[0].est_saving_vnd == pytest.approx(p[0].est_saving_kwh * 2000, abs=1)


def test_machine_plan_holds_minimum_times(spark):
    machines = [("A", 500.0, 0.2), ("B", 700.0, 0.15), ("C", 900.0, 0.18)]
    loads = [600.0, 1400.0, 600.0, 0.0, 600.0, 5000.0]
    df = spark.createDataFrame([("P", T0 + dt.timedelta(hours=i), x) for i, x in enumerate(loads[:5])] + [("Q", T0, loads[5])], "plant string, slot timestamp, load_kw double")
    got = recommend.plan_machines(df, machines, least_on=2).orderBy("plant", "slot").collect()
    plan = [set(r.machines) for r in got[:5]]
    assert plan[0] == {"B"} and all(sum(m[1] for m in machines if m[0] in s) >= x for s, x in zip(plan, loads))
    for m in "ABC":
        on = "".join("1" if m in s else "0" for s in plan)
        assert all(len(run) >= 2 for run in on.split("0")[:-1] if run)
    assert got[5].machines is None
    free = recommend.plan_machines(df.where("plant = 'P'"), machines, least_on=1).collect()
    assert sum(r.est_kw for r in free) <= sum(r.est_kw for r in got[:5])


def test_savings_state_their_assumptions(spark):
    a = spark.createDataFrame([(1, 10.0, 2.0), (2, 5.0, 3.0), (3, 1.0, 1.0)], "slot int, kw double, price double")
    b = spark.createDataFrame([(1, 8.0), (2, 6.0)], "slot int, kw double")
    r = recommend.savings(a, b, F.col("price"), ["slot"], 0.5, "P90 load").first()
    assert (r.kwh, r.vnd, r.n_slots, r.assumptions) == (0.5, 1, 2, "P90 load")


def test_two_layers(spark):
    rng = random.Random(4)
    rows = [("e", T0 + dt.timedelta(hours=i), 10 + rng.gauss(0, 1) + (1.5 if i > 24 * 40 else 0) + (12 if i == 500 else 0), "workday", i % 24) for i in range(24 * 45)]
    g = spark.createDataFrame(rows, "entity_id string, slot timestamp, value double, day_type string, tod_slot int")
    layers = {r.layer: r.n for r in detect.two_layers(g, baseline.profile(g, Config(quantiles=(0.01, 0.5, 0.99)))).groupBy("layer").agg(F.count("slot").alias("n")).collect()}
    assert layers["short"] > 0 and layers["slow"] > 50


def meters(spark, days, change, names=("M1", "M2"), seed=5):
    """Hourly power of some meters: a shape of the day, noise, and what change(name, day, hour) adds."""
    rng = random.Random(seed)
    rows = [(m, "platform", "power_active_kw", T0 + dt.timedelta(days=d, hours=h), 100 + 30 * (8 <= h < 18) + rng.gauss(0, 3) + change(m, d, h), T0 + dt.timedelta(days=d, hours=h)) for m in names for d in range(days) for h in range(24)]
    return spark.createDataFrame(rows, "entity_id string, source string, key string, ts timestamp, value double, ingest_ts timestamp")


def run_consumption(spark, telemetry, days, **more):
    dates = [(T0 + dt.timedelta(days=d)).date() for d in range(days)]
    kinds = ["saturday" if x.weekday() == 5 else "off" if x.weekday() == 6 else "workday" for x in dates]
    calendar = spark.createDataFrame([(x, k, 480, 1080) for x, k in zip(dates, kinds)], "date date, day_type string, op_start_min int, op_end_min int")
    return flows.consumption(telemetry, registry.registry(spark), calendar, F.to_timestamp(F.lit("2024-06-01")), config=Config(fit_weeks=4, refit_weeks=2), **more)


def test_a_creeping_load_within_the_band_is_found(spark):
    """A fifth more than the noise's deviation: no single hour is odd, and the budget holds for both layers together."""
    loss = lambda m, d, h: 4.0 if m == "M1" and d >= 50 else 0.0
    events = run_consumption(spark, meters(spark, 63, loss), 63).events.collect()
    slow = [r for r in events if r.type == "slow_drift"]
    assert {r.entity_id for r in slow if r.start >= T0 + dt.timedelta(days=49)} == {"M1"}
    first = min((r for r in slow if r.entity_id == "M1" and r.end > T0 + dt.timedelta(days=50)), key=lambda r: r.start)
    assert first.rule_or_model == "control_chart" and first.start <= T0 + dt.timedelta(days=52) and first.estimated_waste_kwh_per_month > 300
    assert all(sum(r.entity_id == m for r in events) <= 0.2 * 63 for m in ("M1", "M2"))
    assert len({r.event_id for r in events}) == len(events)


def test_later_rows_change_no_earlier_document(spark):
    """The conditions of a refit are fitted on the rows before it."""
    all_ = meters(spark, 63, lambda m, d, h: (h % 5) * 2.0, names=("M1",))
    heat = spark.createDataFrame([("M1", T0 + dt.timedelta(days=d, hours=h), float(h % 5 + d % 7 / 10)) for d in range(63) for h in range(24)], "entity_id string, slot timestamp, heat double")
    wild = all_.withColumn("value", F.when(F.col("ts") >= T0 + dt.timedelta(days=50), F.col("value") * 3).otherwise(F.col("value")))
    told = []
    for telemetry in (all_, wild):
        b = run_consumption(spark, telemetry, 63, conditions=heat, x=["heat"]).baselines
        told.append(sorted((r.ts, round(r.expected, 6), round(r.lower, 6), round(r.upper, 6)) for r in b.where(F.col("ts") < T0 + dt.timedelta(days=50)).collect()))
    assert len(told[0]) > 300 and told[0] == told[1]


def test_saved_tables_have_an_owner(spark):
    import os

    from joulewright.sources import tables

    with tables.saving() as paths:
        df = tables.saved(spark.range(5), "some")
    at = paths[0].removeprefix("file://")
    assert len(paths) == 1 and df.count() == 5 and os.path.isdir(at)
    tables.discard(spark, paths)
    assert not os.path.exists(at)
