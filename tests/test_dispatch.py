"""Dispatch on curves, and combinations without a limit, against trying everything."""

import itertools
import random

import numpy as np
import pytest

from joulewright.operators import baseline, dispatch, recommend

RNG = random.Random(21)


def cost_of(points, x):
    loads, powers = zip(*sorted(points))
    return int(np.floor(np.interp(x, loads, powers) * 1000 + 0.500001))


def everything(machines, load):
    """Each way to share whole units of load: (watts, number, names), and the loads."""
    names = sorted(machines)
    caps = [max(p[0] for p in machines[n]) for n in names]
    best = None
    for xs in itertools.product(*[range(int(c) + 1) for c in caps[:-1]]):
        last = load - sum(xs)
        if 0 <= last <= caps[-1]:
            on = [(n, x) for n, x in zip(names, (*xs, last)) if x]
            told = (sum(cost_of(machines[n], x) for n, x in on), len(on), [n for n, _ in on])
            best = told if best is None else min(best, told)
    return best


def frame(spark, plants):
    rows = [(p, n, float(x), float(y)) for p, m in plants.items() for n, pts in m.items() for x, y in pts]
    return spark.createDataFrame(rows, "plant string, entity_id string, load_kw double, power_kw double")


def test_equals_trying_all_shares(spark):
    """Curves with a minimum in the middle, straight ones that tie, and ones that are not convex."""
    plants = {
        "convex": {"a": [(4, 2.0), (8, 3.0), (12, 5.5)], "b": [(3, 1.0), (9, 4.0)], "c": [(5, 1.9), (10, 4.9)]},
        "ties": {"a": [(6, 3.0)], "b": [(6, 3.0)], "c": [(6, 3.0)]},
        "wavy": {n: [(k * 3 + 2, round(RNG.uniform(0.5, 6), 3)) for k in range(3)] for n in "abcd"},
    }
    demand = [(p, float(x)) for p, m in plants.items() for x in range(1, sum(int(max(q[0] for q in pts)) for pts in m.values()) + 2)]
    got = dispatch.dispatch(spark.createDataFrame(demand, "plant string, load_kw double"), frame(spark, plants)).collect()
    assert len(got) == len(demand)
    for r in got:
        want = everything(plants[r.plant], int(r.load_kw))
        if want is None:
            assert (r.machines, r.est_kw, r.note) == (None, None, "no combination covers the load")
        else:
            assert (round(r.est_kw * 1000), r.n_machines, r.machines) == want and r.note is None
            assert sum(r.loads_kw) == r.load_kw and sum(cost_of(plants[r.plant][m], x) for m, x in zip(r.machines, r.loads_kw)) == want[0]


def test_part_load_moves_the_choice(spark):
    """At constant efficiency the better machine runs alone; on its curve two at their best load are cheaper."""
    plants = {"P": {"a": [(50, 10.0), (100, 30.0)], "b": [(50, 11.0), (100, 31.0)]}}
    got = dispatch.dispatch(spark.createDataFrame([("P", 100.0), ("P", 50.0), ("P", 0.0), ("Q", 1.0), ("P", None)], "plant string, load_kw double"), frame(spark, plants)).collect()
    by = {(r.plant, r.load_kw): (r.machines, r.loads_kw, r.est_kw, r.note) for r in got}
    assert by["P", 100.0] == (["a", "b"], [50.0, 50.0], 21.0, None) and by["P", 50.0] == (["a"], [50.0], 10.0, None)
    assert by["P", 0.0] == ([], [], 0.0, None) and by["Q", 1.0][3] == "no curves of this plant" and by["P", None][3] == "no load"


@pytest.mark.parametrize("n", [20, 70])
def test_many_machines(spark, n):
    plants = {"big": {f"m{k:02}": [(10, 2 + k % 5 / 10), (20, 3 + k % 7 / 10), (30, 7.0)] for k in range(n)}}
    loads = [1.0, 137.0, 20.0 * n, 30.0 * n, 30.0 * n + 1]
    got = {r.load_kw: r for r in dispatch.dispatch(spark.createDataFrame([("big", x) for x in loads], "plant string, load_kw double"), frame(spark, plants)).collect()}
    assert got[loads[-1]].note == "no combination covers the load" and got[30.0 * n].n_machines == n
    for x in loads[:-1]:
        assert sum(got[x].loads_kw) == x and round(got[x].est_kw * 1000) == sum(cost_of(plants["big"][m], y) for m, y in zip(got[x].machines, got[x].loads_kw))
    # a machine's best load is 20, so 20 a machine is the cheapest way to carry 20 n, whoever carries it
    assert got[20.0 * n].est_kw == pytest.approx(sum(3 + k % 7 / 10 for k in range(n)))


def test_curves_of_measured_rows_feed_it(spark):
    """From rows of load and efficiency to bins, points and a choice."""
    rows = [(m, float(p), 0.2 + (0.1 if m == "b" else 0.0) + abs(p - 50) / 500) for m in "ab" for p in range(5, 100, 10) for _ in range(3)]
    curve = baseline.efficiency_curve(spark.createDataFrame(rows, "entity_id string, pct double, ratio double"), "pct", "ratio", 10.0)
    points = dispatch.curve_points(curve, spark.createDataFrame([("a", 200.0), ("b", 200.0)], "entity_id string, rated_cooling_kw double"), 10.0)
    got = {(r.entity_id, r.load_kw): r.power_kw for r in points.collect()}
    assert len(got) == 20 and got["a", 100.0] == pytest.approx(100 * 0.21)


def by_subsets(machines, load):
    best = None
    for k in range(1, len(machines) + 1):
        for s in itertools.combinations(sorted(machines), k):
            cap = sum(m[1] for m in s)
            if cap >= load:
                told = (round(sum(m[1] * m[2] for m in s) / cap * 1e9), k, [m[0] for m in s])
                best = told if best is None else min(best, told)
    return best


def test_frontier_of_combinations_is_exhaustive(spark):
    plants = {f"p{i}": [(f"m{k}", float(RNG.choice((100, 150, 333, 400))), RNG.choice((0.1, 0.15, 0.2, 0.213))) for k in range(1 + i % 9)] for i in range(18)}
    curves = spark.createDataFrame([(p, *m) for p, ms in plants.items() for m in ms], "plant string, entity_id string, capacity double, kw_per_kw double")
    demand = [(p, float(x)) for p in plants for x in (1, 120, 480, 900, 1500)]
    for r in recommend.best_combination(spark.createDataFrame(demand, "plant string, load_kw double"), curves).collect():
        want = by_subsets(plants[r.plant], r.load_kw)
        assert (r.machines, r.n_machines) == ((want[2], want[1]) if want else (None, None)), r
        assert want is None or abs(r.est_kw - r.load_kw * want[0] / 1e9) < 1e-6
