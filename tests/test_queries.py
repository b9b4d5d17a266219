"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from joulewright.plans import registry

D = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_is_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, D)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    mine = sorted([cell(r[c]) for c in order] for r in got.collect())
    at = [want.columns.index(c) for c in order]
    assert mine == sorted([cell(r[i]) for i in at] for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_give_rows(spark, name):
    assert registry.QUERIES[name](spark, D).count() > 0


def test_plans_are_of_every_hour(spark):
    e = spark.read.parquet(f"{D}/events.parquet").selectExpr("event_type", "date_trunc('hour', ts) AS slot")
    hours = sorted(str(r.slot) for r in e.select("slot").distinct().collect())
    plan = registry.QUERIES["machine_plan"](spark, D).orderBy("slot").collect()
    assert [str(r.slot) for r in plan] == hours and all(r.est_kw is not None for r in plan)
    for m in "ABC":
        on = "".join("1" if m in r.machines else "0" for r in plan)
        assert all(len(run) >= 2 for run in on.split("0")[:-1] if run)
    cells = sorted((r.event_type, str(r.slot)) for r in e.distinct().collect())
    assert sorted((r.entity_id, str(r.slot)) for r in registry.QUERIES["pump_schedule_dp"](spark, D).collect()) == cells


def test_pump_plans_hold_the_tank_and_are_the_cheapest(spark):
    """Each planned day against every way to switch the pump; a day without a plan has none."""
    from itertools import product

    from joulewright.plans.testdata import hourly

    price = lambda h: 3.0 if h in (9, 10, 17, 18, 19) else 1.0 if h >= 22 or h < 4 else 2.0
    days, plans = {}, {}
    for r in hourly(spark, D).orderBy("slot").collect():
        days.setdefault((r.entity_id, r.slot.date()), []).append((r.slot, r.value))
    for r in registry.QUERIES["pump_schedule_dp"](spark, D).collect():
        plans[r.entity_id, r.slot] = (r.on, r.level)
    tried, planned = 0, 0
    for (e, _), rows in days.items():
        mean = sum(v for _, v in rows) / len(rows)
        uses = [v / mean * 6 for _, v in rows]
        got = [plans[e, s] for s, _ in rows]
        assert len({on is None for on, _ in got}) == 1
        planned += got[0][0] is not None

        def cost(on):
            level, before, age, total = 20, 0, 9, 0.0  # in parts of 1.25 m3 above 10, rounded down
            for (slot, _), use, x in zip(rows, uses, on):
                if x != before and age < (2 if before else 1):
                    return None
                age, before = (1 if x != before else age + 1), x
                level = math.floor(level + (8 * x - use) / 1.25 + 1e-9)
                if not 0 <= level <= 40:
                    return None
                total += price(slot.hour) * x
            return total

        if got[0][0] is not None:
            assert all(10 <= level <= 60 for _, level in got) and cost([on for on, _ in got]) is not None
        if len(rows) <= 9:
            tried += 1
            best = min((c for on in product((0, 1), repeat=len(rows)) if (c := cost(on)) is not None), default=None)
            assert best == (cost([on for on, _ in got]) if got[0][0] is not None else None)
    assert tried > 50 and planned > 0.9 * len(days)


def test_machines_are_proposed(spark):
    for name in ("chiller_combo_argmin", "chiller_dispatch"):
        rows = registry.QUERIES[name](spark, D).collect()
        assert sum(r.machines is not None for r in rows) > len(rows) / 2 and len({r.machines for r in rows}) > 3
