"""Scans in blocks give what plain windows give, and no window holds a whole series."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from joulewright.operators import blocks, joins, windows

T0 = dt.datetime(2024, 1, 1)
RNG = random.Random(41)


@pytest.fixture(scope="module")
def series(spark):
    rows = [(e, T0 + dt.timedelta(minutes=m), RNG.choice([None, 0, 1]), RNG.gauss(0, 1) if RNG.random() < 0.9 else None) for e in ("a", "b", None) for m in sorted(RNG.sample(range(20000), 400))]
    return spark.createDataFrame(rows, "e string, ts timestamp, v int, r double").repartition(3)


def rows_of(df, digits=9):
    clean = lambda x: round(x, digits) if isinstance(x, float) else x
    return sorted(repr([clean(r[c]) for c in sorted(df.columns)]) for r in df.collect())


def whole_series_windows(df):
    """Windows over rows (not over one row a block) that are partitioned by the entity alone."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [x for x in plan.split("\n") if "Window [" in x and "_block" not in x]


@pytest.mark.parametrize("seconds", [600, 86400, 10**9])
def test_as_plain_windows(series, seconds):
    assert rows_of(blocks.state_runs_in_blocks(series, ("e",), "ts", "v", seconds)) == rows_of(windows.state_runs(series, ("e",), "ts", "v"))
    assert rows_of(blocks.cusum_in_blocks(series, ("e",), "ts", F.col("r"), 0.1, "c", seconds)) == rows_of(windows.cusum(series, ("e",), "ts", F.col("r"), 0.1, "c"))


def test_asof(spark, series):
    marks = spark.createDataFrame([(e, T0 + dt.timedelta(minutes=m)) for e in ("a", "c") for m in (5000, 5001, 15000)], "e string, ts timestamp")
    marks = marks.union(series.where("e = 'b'").select("e", "ts").limit(3))
    assert rows_of(blocks.asof_in_blocks(series.where("e IS NOT NULL"), marks, "e", "ts", "at", 3600)) == rows_of(joins.asof(series.where("e IS NOT NULL"), marks, "e", "ts", "at"))


def test_running_values_pass_over_nulls(spark):
    rows = [("a", T0 + dt.timedelta(hours=h), v) for h, v in ((1, None), (2, 3.0), (30, None), (31, 1.0), (60, None), (61, 5.0), (61, 7.0))]
    df = spark.createDataFrame(rows, "e string, ts timestamp, v double")
    got = blocks.running(df, ("e",), "ts", {"s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}).orderBy("ts", "v").collect()
    assert [(r.s, r.lo, r.hi) for r in got] == [(None, None, None), (3.0, 3.0, 3.0), (3.0, 3.0, 3.0), (4.0, 1.0, 3.0), (4.0, 1.0, 3.0), (16.0, 1.0, 7.0), (16.0, 1.0, 7.0)]


def test_no_window_holds_a_series(series):
    for out in (blocks.state_runs_in_blocks(series, ("e",), "ts", "v"), blocks.cusum_in_blocks(series, ("e",), "ts", F.col("r"), 0.1)):
        assert whole_series_windows(out) == []


def test_day_shapes_of_few_days(spark):
    """Eight Saturdays of a device: an odd one stands out, and so it does not where its own eight days are all there is."""
    import numpy as np

    from joulewright.operators import detect

    rng = np.random.default_rng(3)
    shape = {"workday": 1 + np.sin(np.arange(24) / 24 * 2 * np.pi), "saturday": 1 + 0.3 * np.cos(np.arange(24) / 24 * 2 * np.pi)}
    rows = []
    for k, e in enumerate(("m1", "m2", "m3", "m4")):
        for day in range(56):
            date = T0 + dt.timedelta(days=day)
            kind = "saturday" if date.weekday() == 5 else "workday"
            v = 50 * (k + 1) * (shape[kind] + 0.05 * rng.normal() * np.arange(24) / 24) * (1 + 0.03 * rng.normal(size=24))
            if e == "m2" and day == 33:  # a Saturday
                v[2:6] *= 1.6
            rows += [(e, date + dt.timedelta(hours=h), kind, h, float(x)) for h, x in enumerate(v) if not (e == "m3" and h == 4 and day % 9 == 0)]
    grid = spark.createDataFrame(rows, "entity_id string, slot timestamp, day_type string, tod_slot int, value double")
    device = spark.createDataFrame([(e, "x") for e in ("m1", "m2", "m3", "m4")], "entity_id string, device_model string")
    got = detect.pooled_shapes(grid, device).collect()
    assert len(got) == 4 * 56 and {r.n_days for r in got if r.day_type == "saturday"} == {8}
    saturdays = sorted((r.score, r.entity_id, r.date) for r in got if r.day_type == "saturday")
    assert saturdays[-1][1:] == ("m2", (T0 + dt.timedelta(days=33)).date()) and saturdays[-1][0] > 3 and saturdays[-2][0] < 2
    # a constant factor of a device changes nothing, and a zero day has no shape
    scaled = detect.pooled_shapes(grid.withColumn("value", F.col("value") * F.when(F.col("entity_id") == "m1", 7.0).otherwise(1.0)), device).collect()
    assert {(r.entity_id, r.date): round(r.score, 6) for r in got} == {(r.entity_id, r.date): round(r.score, 6) for r in scaled}
    dead = grid.withColumn("value", F.when(F.col("slot") < T0 + dt.timedelta(days=1), 0.0).otherwise(F.col("value")))
    assert detect.pooled_shapes(dead, device).count() == 4 * 55
