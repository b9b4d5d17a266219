"""Queries of steps 2 and 3: joins by time, baselines, detectors, events and their evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from joulewright.config import Config
from joulewright.operators import baseline, blocks, detect, evaluate, graphs, joins, windows
from joulewright.plans.testdata import OFF_EDGE, SQL_HOURLY, SQL_LINES, daily_lines, hourly, r4, samples, sql4, table, text

QUERIES, ORACLES = {}, {}
HOURLY = Config(step=60, min_samples=2)


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql4(sql)
        return f

    return add


def maintenance(spark, d):
    """error events as the maintenance log of the user they belong to."""
    return samples(spark, d).where("entity_id = 'error'").select(F.col("user_id").cast("string").alias("entity_id"), "ts")


SQL_ASOF = (
    "m AS (SELECT DISTINCT user_id, ts AS mts FROM events WHERE event_type = 'error'), s AS (SELECT * FROM events WHERE event_type <> 'error'), "
    "a AS (SELECT s.*, m.mts FROM s ASOF LEFT JOIN m ON s.user_id = m.user_id AND s.ts >= m.mts)"
)


@query("WITH " + SQL_ASOF + " SELECT event_id, strftime(mts, '%Y-%m-%d %H:%M:%S') AS maintained_at FROM a")
def asof_maintenance(spark, d):
    s = samples(spark, d).where("entity_id != 'error'").withColumn("entity_id", F.col("user_id").cast("string"))
    return joins.asof(s, maintenance(spark, d), "entity_id", "ts", "maintained_at").select("event_id", text("maintained_at"))


SQL_PARTS = SQL_ASOF + ", p AS (SELECT *, CASE WHEN mts IS NULL THEN NULL WHEN (epoch_us(ts) // 1000000 - epoch_us(mts) // 1000000) < 86400 THEN 'settling' WHEN (epoch_us(ts) // 1000000 - epoch_us(mts) // 1000000) < 86400 * 8 THEN 'reference' ELSE 'current' END AS part FROM a)"


@query("WITH " + SQL_PARTS + " SELECT CAST(user_id AS VARCHAR) AS entity_id, part, count(*) AS n, round(avg(value), 4) AS mean FROM p WHERE part IS NOT NULL GROUP BY 1, 2")
def fixed_window_reference(spark, d):
    s = samples(spark, d).where("entity_id != 'error'").withColumn("entity_id", F.col("user_id").cast("string"))
    parts = baseline.split_by_maintenance(s, maintenance(spark, d), Config(settle_days=1, reference_weeks=1))
    return parts.where("part IS NOT NULL").groupBy("entity_id", "part").agg(F.count(F.lit(1)).alias("n"), r4(F.avg("value"), "mean"))


@query("WITH " + SQL_HOURLY + ", w AS (SELECT slot, value AS outdoor FROM g WHERE entity_id = 'view') SELECT g.entity_id, strftime(g.slot, '%Y-%m-%d %H:%M:%S') AS slot, round(g.value, 4) AS value, round(w.outdoor, 4) AS outdoor FROM g LEFT JOIN w ON g.slot = w.slot WHERE g.entity_id <> 'view'")
def weather_context(spark, d):
    g = hourly(spark, d)
    w = g.where("entity_id = 'view'").select("slot", F.col("value").alias("outdoor"))
    return g.where("entity_id != 'view'").join(w, "slot", "left").select("entity_id", text("slot"), r4("value"), r4("outdoor"))


@query("SELECT r_name AS level_2, n_name AS level_1, count(*) AS n, round(sum(s_acctbal), 4) AS kw FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def topology_rollup(spark, d):
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    devices = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("child"), F.col("n_name").alias("parent"))
    floors = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    rolled = joins.roll_up(s.select("s_name", "s_acctbal"), devices.unionByName(floors), "s_name", 2)
    return rolled.groupBy("level_2", "level_1").agg(F.count(F.lit(1)).alias("n"), r4(F.sum("s_acctbal"), "kw"))


@query("WITH RECURSIVE e AS (SELECT s_name AS child, n_name AS parent FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), t AS (SELECT child, parent, 1 AS depth FROM e UNION ALL SELECT t.child, e.parent, depth + 1 FROM t JOIN e ON t.parent = e.child) SELECT child, parent, depth FROM t")
def topology_closure(spark, d):
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    edges = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("child"), F.col("n_name").alias("parent")).unionByName(
        n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    )
    first = edges.withColumn("depth", F.lit(1))
    second = edges.alias("a").join(edges.alias("b"), F.col("a.parent") == F.col("b.child")).select("a.child", "b.parent", F.lit(2).alias("depth"))
    return first.unionByName(second)


SQL_PEER = "i AS (SELECT l_partkey, p_brand, month(l_shipdate)::INT AS m, avg(l_extendedprice / l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3), b AS (SELECT p_brand, m, quantile_cont(value, 0.05) AS lo, median(value) AS mid, quantile_cont(value, 0.95) AS hi, count(DISTINCT l_partkey) AS n_peers FROM i GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) >= 2)"


def by_model(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    joined = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("l_partkey").alias("entity_id"), F.col("p_brand").alias("device_model"), F.month("l_shipdate").alias("m")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("value"))


@query("WITH " + SQL_PEER + " SELECT p_brand AS device_model, m, round(lo, 4) AS lower, round(mid, 4) AS expected, round(hi, 4) AS upper, n_peers FROM b")
def peer_compare_model(spark, d):
    return baseline.peer_band(by_model(spark, d), "device_model", "m").select("device_model", "m", r4("lower"), r4("expected"), r4("upper"), "n_peers")


@query("WITH " + SQL_PEER + " SELECT l_partkey AS entity_id, i.m, round(value, 4) AS value FROM i JOIN b ON i.p_brand = b.p_brand AND i.m = b.m WHERE value > hi")
def peer_outliers(spark, d):
    g = by_model(spark, d)
    return detect.peer_outliers(g, baseline.peer_band(g, "device_model", "m"), "device_model", "m").select("entity_id", "m", r4("value"))


SQL_PROFILE = SQL_HOURLY + ", prof AS (SELECT entity_id, day_type, tod_slot, quantile_cont(value, 0.05) AS lower, median(value) AS expected, quantile_cont(value, 0.95) AS upper, count(*) AS n FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 2)"


@query("WITH " + SQL_PROFILE + " SELECT entity_id, day_type, tod_slot, round(lower, 4) AS lower, round(expected, 4) AS expected, round(upper, 4) AS upper, n FROM prof")
def profile_band(spark, d):
    return baseline.profile(hourly(spark, d), HOURLY).select("entity_id", "day_type", "tod_slot", r4("lower"), r4("expected"), r4("upper"), "n")


@query(
    "WITH " + SQL_HOURLY + ", r AS (SELECT g.*, DATE '1970-01-05' + CAST(k * 7 AS INT) AS refit_on FROM (SELECT *, date_diff('day', DATE '1970-01-05', CAST(slot AS DATE)) AS dd FROM g) g, unnest(range(dd // 7 + 1, (dd + 14) // 7 + 1)) u(k)) "
    "SELECT entity_id, refit_on::VARCHAR AS refit_on, tod_slot, round(quantile_cont(value, 0.05), 4) AS lower, round(median(value), 4) AS expected, round(quantile_cont(value, 0.95), 4) AS upper, count(*) AS n FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 2"
)
def profile_band_rolling_refit(spark, d):
    weekly = Config(fit_weeks=2, refit_weeks=1, min_samples=2)
    p = baseline.rolling_profile(hourly(spark, d), weekly, ("entity_id", "tod_slot"))
    return p.select("entity_id", F.col("refit_on").cast("string").alias("refit_on"), "tod_slot", r4("lower"), r4("expected"), r4("upper"), "n")


@query(
    "WITH " + SQL_HOURLY + ", r AS (SELECT g.*, DATE '1970-01-05' + CAST(k * 7 AS INT) AS refit_on FROM (SELECT *, date_diff('day', DATE '1970-01-05', CAST(slot AS DATE)) AS dd FROM g) g, unnest(range(dd // 7 + 1, (dd + 14) // 7 + 1)) u(k)), "
    "p AS (SELECT entity_id, refit_on, tod_slot, quantile_cont(value, 0.95) AS upper FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 2) "
    "SELECT g.entity_id, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, round(value, 4) AS value, round(upper, 4) AS upper FROM g JOIN p ON g.entity_id = p.entity_id AND g.tod_slot = p.tod_slot AND p.refit_on = DATE '1970-01-05' + CAST(date_diff('day', DATE '1970-01-05', CAST(slot AS DATE)) // 7 * 7 AS INT) WHERE value > upper"
)
def rolling_violations(spark, d):
    weekly = Config(fit_weeks=2, refit_weeks=1, min_samples=2)
    g = hourly(spark, d)
    p = baseline.rolling_profile(g, weekly, ("entity_id", "tod_slot"))
    judged = g.withColumn("refit_on", baseline.in_force(F.col("slot"), weekly))
    return detect.violations(judged, p, ("entity_id", "tod_slot", "refit_on"), above_only=True).select("entity_id", text("slot"), r4("value"), r4("upper"))


SQL_VIOLATIONS = SQL_PROFILE + ", v AS (SELECT g.*, abs(value - expected) / (greatest(upper - lower, 1e-9) / 2) AS score FROM g JOIN prof USING (entity_id, day_type, tod_slot) WHERE value > upper OR value < lower)"


def sql_merge(source: str, by: str = "entity_id", score: str = "score", out: str = "ev") -> str:
    """Cells an hour apart at most as events, as SQL."""
    return (
        f"{out}1 AS (SELECT *, CASE WHEN slot - lag(slot) OVER (PARTITION BY {by} ORDER BY slot) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS edge FROM {source}), "
        f"{out}2 AS (SELECT *, sum(edge) OVER (PARTITION BY {by} ORDER BY slot) AS island FROM {out}1), "
        f'{out} AS (SELECT {by}, min(slot) AS start, max(slot) + INTERVAL 1 HOUR AS "end", count(*) AS n_cells, max({score}) AS peak FROM {out}2 GROUP BY {by}, island)'
    )


@query("WITH " + SQL_VIOLATIONS + ", " + sql_merge("v") + " SELECT entity_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, strftime(\"end\", '%Y-%m-%d %H:%M:%S') AS \"end\", n_cells, round(peak, 4) AS peak FROM ev")
def profile_violation_events(spark, d):
    g = hourly(spark, d)
    return detect.violation_events(g, baseline.profile(g, HOURLY), HOURLY).select("entity_id", text("start"), text("end"), "n_cells", r4("peak"))


@query("WITH " + SQL_HOURLY + " SELECT entity_id, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot FROM g WHERE value < 0.5 OR value > 30")
def physical_rule_band(spark, d):
    return hourly(spark, d).where("value < 0.5 OR value > 30").select("entity_id", text("slot"))


SQL_STD = SQL_HOURLY + ", z AS (SELECT *, (value - avg(value) OVER (PARTITION BY entity_id)) / stddev_samp(value) OVER (PARTITION BY entity_id) AS residual FROM g)"
SQL_CUSUM = SQL_STD + ", cs AS (SELECT *, sum(residual - 0.5) OVER (PARTITION BY entity_id ORDER BY slot) AS p FROM z), c AS (SELECT *, p - least(0, min(p) OVER (PARTITION BY entity_id ORDER BY slot)) AS cusum FROM cs)"


@query("WITH " + SQL_CUSUM + " SELECT entity_id, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, round(cusum, 4) AS cusum FROM c")
def cusum_residual(spark, d):
    z = detect.standardized(hourly(spark, d), ("entity_id",), "value")
    return windows.cusum(z, ("entity_id",), "slot", F.col("residual"), 0.5).select("entity_id", text("slot"), r4("cusum"))


@query("WITH " + SQL_CUSUM + ", a AS (SELECT * FROM c WHERE cusum > 4), " + sql_merge("a", score="cusum") + " SELECT entity_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, strftime(\"end\", '%Y-%m-%d %H:%M:%S') AS \"end\", n_cells, round(peak, 4) AS peak FROM ev")
def cusum_events(spark, d):
    z = detect.standardized(hourly(spark, d), ("entity_id",), "value")
    return detect.cusum_events(z, ("entity_id",), "slot", "residual", 4.0, HOURLY).select("entity_id", text("start"), text("end"), "n_cells", r4("peak"))


@query("WITH " + SQL_HOURLY + ", a AS (SELECT *, 0 AS score FROM g WHERE value < 30), " + sql_merge("a") + " SELECT entity_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, n_cells FROM ev WHERE \"end\" - start >= INTERVAL 2 HOURS")
def low_delta_t_events(spark, d):
    return detect.static_low(hourly(spark, d), "value", 30.0, Config(min_duration=120)).select("entity_id", text("start"), "n_cells")


@query("WITH " + SQL_HOURLY + ", a AS (SELECT *, 0 AS score FROM g WHERE n_samples = 1), " + sql_merge("a") + " SELECT entity_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, n_cells FROM ev WHERE n_cells >= 4")
def prolonged_low_load(spark, d):
    low = hourly(spark, d).where("n_samples = 1")
    return windows.merge_cells(low, ("entity_id",), "slot", 60, 60, 240).where("n_cells >= 4").select("entity_id", text("start"), "n_cells")


@query("WITH " + SQL_HOURLY + ", n AS (SELECT entity_id, CAST(slot AS DATE) AS date, min(value) AS night_min FROM g WHERE hour(slot) >= 1 AND hour(slot) < 4 GROUP BY 1, 2), u AS (SELECT entity_id, quantile_cont(night_min, 0.9) AS hi FROM n GROUP BY 1) SELECT entity_id, date::VARCHAR AS date, round(night_min, 4) AS night_min FROM n JOIN u USING (entity_id) WHERE night_min > hi")
def night_leak(spark, d):
    n = detect.night_minimum(hourly(spark, d))
    usual = n.groupBy("entity_id").agg(F.percentile("night_min", F.lit(0.9)).alias("hi"))
    return n.join(usual, "entity_id").where("night_min > hi").select("entity_id", F.col("date").cast("string").alias("date"), r4("night_min"))


@query("SELECT l_returnflag AS entity_id, count(*) AS n, round(regr_intercept(y, x), 4) AS b_0, round(regr_slope(y, x), 4) AS b_1 FROM (SELECT l_returnflag, l_extendedprice / l_quantity AS y, l_quantity AS x FROM lineitem) GROUP BY 1")
def efficiency_ratio_regression(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("entity_id"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("y"), F.col("l_quantity").alias("x"))
    return baseline.fit_linear(li, ("entity_id",), "y", ["x"]).select("entity_id", "n", r4("b_0"), r4("b_1"))


@query(
    "WITH s AS (SELECT l_returnflag AS entity_id, count(*) n, avg(l_quantity) mx, avg(l_tax * 100) mz, avg(l_extendedprice / 1000) my, covar_pop(l_quantity, l_tax * 100) xz, var_pop(l_quantity) xx, var_pop(l_tax * 100) zz, covar_pop(l_extendedprice / 1000, l_quantity) yx, covar_pop(l_extendedprice / 1000, l_tax * 100) yz FROM lineitem GROUP BY 1), "
    "b AS (SELECT *, (yx * zz - yz * xz) / (xx * zz - xz * xz) AS b1, (yz * xx - yx * xz) / (xx * zz - xz * xz) AS b2 FROM s) SELECT entity_id, n, round(my - b1 * mx - b2 * mz, 4) AS b_0, round(b1, 4) AS b_1, round(b2, 4) AS b_2 FROM b"
)
def two_predictor_regression(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("entity_id"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("z"))
    return baseline.fit_linear(li, ("entity_id",), "y", ["x", "z"]).select("entity_id", "n", r4("b_0"), r4("b_1"), r4("b_2"))


@query(
    "WITH " + SQL_HOURLY + ", p AS (SELECT entity_id, tod_slot, median(value) AS usual FROM g GROUP BY 1, 2 HAVING count(*) >= 2), j AS (SELECT g.*, usual, value - usual AS rest FROM g JOIN p USING (entity_id, tod_slot)), "
    "f AS (SELECT entity_id, regr_intercept(rest, n_samples) AS a, regr_slope(rest, n_samples) AS b FROM j GROUP BY 1) SELECT entity_id, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, round(usual + coalesce(a + b * n_samples, 0), 4) AS expected FROM j LEFT JOIN f USING (entity_id)"
)
def conditional_baseline(spark, d):
    g = hourly(spark, d)
    p = baseline.profile(g, HOURLY, ("entity_id", "tod_slot"))
    return baseline.conditional_baseline(g, p, ["n_samples"], ("entity_id", "tod_slot")).select("entity_id", text("slot"), r4("expected"))


@query("SELECT l_returnflag AS entity_id, CAST(floor(l_quantity / 10) AS INT) AS load_bin, round(quantile_cont(r, 0.25), 4) AS p25, round(median(r), 4) AS p50, round(quantile_cont(r, 0.75), 4) AS p75, count(*) AS n FROM (SELECT *, l_extendedprice / l_quantity AS r FROM lineitem) GROUP BY 1, 2")
def efficiency_curve_binned(spark, d):
    li = table(spark, d, "lineitem").withColumn("entity_id", F.col("l_returnflag")).withColumn("r", F.try_divide("l_extendedprice", "l_quantity"))
    return baseline.efficiency_curve(li, "l_quantity", "r", 10).select("entity_id", "load_bin", r4("p25"), r4("p50"), r4("p75"), "n")


SQL_DEGRADE = SQL_LINES + ", q AS (SELECT *, CASE WHEN day < DATE '1998-01-01' THEN 'reference' ELSE 'current' END AS part FROM l), f AS (SELECT entity_id, regr_intercept(value, qty) AS a, regr_slope(value, qty) AS b FROM q WHERE part = 'reference' GROUP BY 1)"


@query("WITH " + SQL_DEGRADE + " SELECT entity_id, round(avg(a + b * qty), 4) AS expected, round(avg(value), 4) AS observed, count(*) AS n, round((avg(value) - avg(a + b * qty)) / avg(a + b * qty) * 100, 1) AS deviation_pct FROM q JOIN f USING (entity_id) WHERE part = 'current' GROUP BY 1")
def efficiency_degradation(spark, d):
    parts = daily_lines(spark, d).withColumn("part", F.when(F.col("day") < F.lit("1998-01-01").cast("date"), "reference").otherwise("current"))
    out = detect.ratio_degradation(parts, "value", ["qty"])
    return out.select("entity_id", r4("expected"), r4("observed"), "n", "deviation_pct")


def sql_onset(factor: float, sign: int) -> str:
    """A loss that begins two years after the reference window, found by the chart of its daily deviation, as SQL."""
    return (
        "WITH " + SQL_LINES + f", q AS (SELECT *, value * CASE WHEN day >= DATE '2000-06-01' THEN {factor} ELSE 1.0 END AS v FROM l), f AS (SELECT entity_id, regr_intercept(v, qty) AS a, regr_slope(v, qty) AS b FROM q WHERE day < DATE '1998-01-01' GROUP BY 1), "
        f"n AS (SELECT entity_id, day, v, a + b * qty AS told, {sign} * (v / (a + b * qty) - 1) * 100 - 7.5 AS r FROM q JOIN f USING (entity_id) WHERE day >= DATE '1998-01-01'), s AS (SELECT *, sum(r) OVER (PARTITION BY entity_id ORDER BY day) AS p FROM n), "
        "c AS (SELECT *, p - least(0, min(p) OVER (PARTITION BY entity_id ORDER BY day)) AS s FROM s), a AS (SELECT *, min(day) FILTER (s > 10) OVER (PARTITION BY entity_id) AS det FROM c), "
        "z AS (SELECT *, max(day) FILTER (s <= 0 AND day < det) OVER (PARTITION BY entity_id) AS zero FROM a WHERE det IS NOT NULL) "
        "SELECT entity_id, min(day)::VARCHAR AS start, det::VARCHAR AS detected_on, count(*) AS n_days, round(avg(told), 4) AS expected, round(avg(v), 4) AS observed, round((avg(v) - avg(told)) / avg(told) * 100, 1) AS deviation_pct FROM z WHERE zero IS NULL OR day > zero GROUP BY entity_id, det"
    )


def onset(spark, d, factor, sign):
    late = F.when(F.col("day") >= F.lit("2000-06-01").cast("date"), factor).otherwise(1.0)
    q = daily_lines(spark, d).withColumn("v", F.col("value") * late).withColumn("part", F.when(F.col("day") < F.lit("1998-01-01").cast("date"), "reference").otherwise("current"))
    out = detect.degradation_events(q, "v", ["qty"], sign=sign, ts="day")
    return out.select("entity_id", F.col("start").cast("string").alias("start"), F.col("detected_on").cast("string").alias("detected_on"), "n_days", r4("expected"), r4("observed"), "deviation_pct")


@query(sql_onset(0.85, -1))
def pump_head_loss(spark, d):
    """Price per quantity as the head of a pump that falls by 15 per cent two years after its reference window."""
    return onset(spark, d, 0.85, -1)


@query(sql_onset(1.15, 1))
def kwh_per_m3_rise(spark, d):
    """The same as the energy of a cubic metre, which rises by 15 per cent."""
    return onset(spark, d, 1.15, 1)


@query(
    "WITH " + SQL_HOURLY + ", x AS (SELECT *, lag(value) OVER (PARTITION BY entity_id ORDER BY slot) AS l1 FROM g) SELECT entity_id, count(*) AS n, round(regr_intercept(value, l1), 4) AS b_0, round(regr_slope(value, l1), 4) AS b_1 FROM x WHERE l1 IS NOT NULL GROUP BY 1"
)
def lag_regression(spark, d):
    x = detect.lagged(hourly(spark, d), ("entity_id",), "slot", "value", (1,))
    return baseline.fit_linear(x, ("entity_id",), "value", ["value_lag_1"]).select("entity_id", "n", r4("b_0"), r4("b_1"))


SQL_DAYS = (
    "o AS (SELECT *, CASE WHEN value > 12 THEN 1 ELSE 0 END AS on_ FROM g), sw AS (SELECT *, CASE WHEN lag(on_) OVER (PARTITION BY entity_id, CAST(slot AS DATE) ORDER BY slot) <> on_ THEN 1 ELSE 0 END AS sw FROM o), "
    "f AS (SELECT entity_id, CAST(slot AS DATE) AS date, any_value(day_type) AS day_type, sum(value) AS total, CAST(arg_max(hour(slot), value) AS INT) AS peak_hour, CAST(min(CASE WHEN on_ = 1 THEN hour(slot) END) AS INT) AS first_on, CAST(max(CASE WHEN on_ = 1 THEN hour(slot) END) AS INT) AS last_on, CAST(sum(on_) AS BIGINT) AS hours_on, CAST(sum(sw) AS BIGINT) AS switches FROM sw GROUP BY 1, 2)"
)


def days(spark, d):
    g = hourly(spark, d)
    types = g.select("entity_id", F.to_date("slot").alias("date"), "day_type").distinct()
    return detect.day_features(g, F.col("value") > 12).join(types, ["entity_id", "date"])


@query("WITH " + SQL_HOURLY + ", " + SQL_DAYS + " SELECT entity_id, date::VARCHAR AS date, round(total, 4) AS total, peak_hour, first_on, last_on, hours_on, switches FROM f")
def day_shape_features(spark, d):
    return days(spark, d).select("entity_id", F.col("date").cast("string").alias("date"), r4("total"), "peak_hour", "first_on", "last_on", "hours_on", "switches")


SQL_ODD = SQL_HOURLY + ", " + SQL_DAYS + ", u AS (SELECT entity_id, day_type, quantile_cont(total, 0.05) AS lo, quantile_cont(total, 0.95) AS hi FROM f GROUP BY 1, 2), od AS (SELECT f.* FROM f JOIN u USING (entity_id, day_type) WHERE total < lo OR total > hi)"


@query("WITH " + SQL_ODD + " SELECT entity_id, date::VARCHAR AS date, round(total, 4) AS total FROM od")
def odd_days(spark, d):
    return detect.odd_features(days(spark, d), "total").select("entity_id", F.col("date").cast("string").alias("date"), r4("total"))


@query("WITH " + SQL_HOURLY + ", " + SQL_DAYS + ", u AS (SELECT entity_id, day_type, avg(CASE WHEN peak_hour IN (9, 10, 17, 18, 19) THEN 1.0 ELSE 0.0 END) AS share FROM f GROUP BY 1, 2) SELECT entity_id, date::VARCHAR AS date, peak_hour FROM f JOIN u USING (entity_id, day_type) WHERE peak_hour IN (9, 10, 17, 18, 19) AND share < 0.5")
def moved_peak_days(spark, d):
    return detect.moved_peaks(days(spark, d), [9, 10, 17, 18, 19]).select("entity_id", F.col("date").cast("string").alias("date"), "peak_hour")


@query("WITH " + SQL_ODD + ", r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, date_trunc('month', date) ORDER BY total DESC, date) AS rank FROM od) SELECT entity_id, date::VARCHAR AS date, round(total, 4) AS total, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3")
def odd_days_capped(spark, d):
    from joulewright.operators.report import capped_days

    return capped_days(detect.odd_features(days(spark, d), "total"), "total", 3).select("entity_id", F.col("date").cast("string").alias("date"), r4("total"), "rank")


@query(
    "WITH " + SQL_HOURLY + ", m AS (SELECT entity_id, day_type AS nearest, tod_slot, avg(value) AS mean FROM g GROUP BY 1, 2, 3), a AS (SELECT g.entity_id, CAST(slot AS DATE) AS date, g.day_type, nearest, round(avg((value - mean) * (value - mean)), 9) AS dist FROM g JOIN m ON g.entity_id = m.entity_id AND g.tod_slot = m.tod_slot GROUP BY ALL) "
    "SELECT entity_id, date::VARCHAR AS date, day_type, arg_min(nearest, dist) AS nearest, arg_min(nearest, dist) <> day_type AS wrong FROM a GROUP BY 1, 2, 3"
)
def wrong_day_type(spark, d):
    return detect.nearest_day_type(hourly(spark, d)).withColumn("date", F.col("date").cast("string"))


@query("WITH " + SQL_HOURLY + " SELECT entity_id, CAST(slot AS DATE)::VARCHAR AS date, array_to_string(list(round(value + 0.00003173, 2)::DECIMAL(18, 2) ORDER BY tod_slot), ',') AS profile, count(*) AS n FROM g GROUP BY 1, 2")
def day_vectors(spark, d):
    v = detect.day_vectors(hourly(spark, d))
    shown = F.array_join(F.transform("profile", lambda x: F.round(x + OFF_EDGE, 2).cast("decimal(18,2)").cast("string")), ",")
    return v.select("entity_id", F.col("date").cast("string").alias("date"), shown.alias("profile"), F.size("profile").cast("long").alias("n"))


@query(
    "WITH " + SQL_VIOLATIONS + ", days AS (SELECT entity_id, count(DISTINCT CAST(slot AS DATE)) AS n_days FROM g GROUP BY 1), th AS (SELECT CAST(unnest([0.5, 0.8, 1.0, 1.2, 1.5, 2.0, 3.0]) AS DOUBLE) AS threshold), x AS (SELECT v.*, threshold FROM v, th WHERE score > threshold), "
    + sql_merge("x", "entity_id, threshold")
    + ", c AS (SELECT entity_id, threshold, count(*) AS n FROM ev GROUP BY 1, 2), r AS (SELECT d.entity_id, th.threshold, coalesce(n, 0) / n_days AS rate FROM days d CROSS JOIN th LEFT JOIN c ON c.entity_id = d.entity_id AND c.threshold = th.threshold), "
    "w AS (SELECT *, max(CASE WHEN rate > 0.3 THEN threshold END) OVER (PARTITION BY entity_id) AS worst FROM r) SELECT entity_id, min(threshold) AS threshold, round(arg_min(rate, threshold), 4) AS alarms_per_day FROM w WHERE worst IS NULL OR threshold > worst GROUP BY 1"
)
def alarm_budget_calibration(spark, d):
    g = hourly(spark, d)
    v = detect.violations(g, baseline.profile(g, HOURLY))
    n = g.groupBy("entity_id").agg(F.countDistinct(F.to_date("slot")).alias("n_days"))
    out = evaluate.calibrate(v, [0.5, 0.8, 1.0, 1.2, 1.5, 2.0, 3.0], n, Config(alarm_budget=0.3))
    return out.select("entity_id", "threshold", r4("alarms_per_day"))


def two_detectors(spark, d):
    g = hourly(spark, d)
    z = windows.cusum(detect.standardized(g, ("entity_id",), "value"), ("entity_id",), "slot", F.col("residual"), 0.5)
    return {"band": detect.violations(g, baseline.profile(g, HOURLY)), "cusum": z.where("cusum > 2")}


SQL_FUSE = SQL_VIOLATIONS + ", cs AS (SELECT *, sum(residual - 0.5) OVER (PARTITION BY entity_id ORDER BY slot) AS p FROM (SELECT *, (value - avg(value) OVER (PARTITION BY entity_id)) / stddev_samp(value) OVER (PARTITION BY entity_id) AS residual FROM g)), c AS (SELECT * FROM (SELECT *, p - least(0, min(p) OVER (PARTITION BY entity_id ORDER BY slot)) AS cusum FROM cs) WHERE cusum > 2), fu AS (SELECT entity_id, slot, count(*) AS n_detectors FROM (SELECT entity_id, slot FROM v UNION ALL SELECT entity_id, slot FROM c) GROUP BY 1, 2)"


@query("WITH " + SQL_FUSE + " SELECT entity_id, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, n_detectors FROM fu")
def detector_fusion_or(spark, d):
    return detect.fuse(two_detectors(spark, d), "or").select("entity_id", text("slot"), "n_detectors")


@query("WITH " + SQL_FUSE + " SELECT entity_id, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, n_detectors FROM fu WHERE n_detectors = 2")
def detector_fusion_and(spark, d):
    return detect.fuse(two_detectors(spark, d), "and").select("entity_id", text("slot"), "n_detectors")


#: Faults: two hours after each error event.
SQL_FAULTS = "fl AS (SELECT event_id AS id, ['click', 'view', 'purchase', 'signup'][1 + user_id % 4] AS entity_id, date_trunc('second', ts) AS start, date_trunc('second', ts) + INTERVAL 2 HOURS AS \"end\" FROM events WHERE event_type = 'error')"


def faults(spark, d):
    names = F.array(*[F.lit(x) for x in ("click", "view", "purchase", "signup")])
    e = samples(spark, d).where("entity_id = 'error'")
    at = F.timestamp_seconds(F.unix_timestamp("ts"))
    return e.select(F.col("event_id").alias("id"), F.get(names, (F.col("user_id") % 4).cast("int")).alias("entity_id"), at.alias("start"), (at + F.expr("INTERVAL 2 HOURS")).alias("end"))


@query(
    "WITH " + SQL_VIOLATIONS + ", " + sql_merge("v") + ", " + SQL_FAULTS + ", h AS (SELECT ev.entity_id || ev.start::VARCHAR AS a, fl.id AS b FROM ev JOIN fl ON ev.entity_id = fl.entity_id AND ev.start < fl.\"end\" AND fl.start < ev.\"end\") "
    "SELECT (SELECT count(*) FROM ev) AS n_predicted, (SELECT count(*) FROM fl) AS n_labelled, count(DISTINCT a) AS n_true, count(DISTINCT b) AS n_found, round(count(DISTINCT a) / (SELECT count(*) FROM ev), 4) AS precision, round(count(DISTINCT b) / (SELECT count(*) FROM fl), 4) AS recall FROM h"
)
def event_precision_recall(spark, d):
    g = hourly(spark, d)
    ev = detect.violation_events(g, baseline.profile(g, HOURLY), HOURLY).withColumn("id", F.concat("entity_id", F.col("start").cast("string")))
    return evaluate.event_scores(ev, faults(spark, d)).withColumns({c: r4(c) for c in ("precision", "recall")})


@query("WITH " + SQL_VIOLATIONS + ", " + SQL_FAULTS + " SELECT fl.entity_id, fl.id, CAST(date_diff('second', any_value(fl.start), min(v.slot)) / 60.0 AS DOUBLE) AS delay_min FROM fl LEFT JOIN v ON v.entity_id = fl.entity_id AND v.slot >= fl.start AND v.slot < fl.\"end\" GROUP BY 1, 2")
def detection_delay(spark, d):
    g = hourly(spark, d)
    return evaluate.delays(detect.violations(g, baseline.profile(g, HOURLY)), faults(spark, d))


@query("WITH " + SQL_PROFILE + ", x AS (SELECT value > upper AS alarm, value > 20 AS truth FROM g JOIN prof USING (entity_id, day_type, tod_slot)) SELECT round(count(*) FILTER (alarm AND truth) / count(*) FILTER (truth), 4) AS point_recall, round(count(*) FILTER (alarm AND truth) / count(*) FILTER (alarm), 4) AS point_precision FROM x")
def point_scores(spark, d):
    g = hourly(spark, d)
    cells = g.join(baseline.profile(g, HOURLY), ["entity_id", "day_type", "tod_slot"]).select((F.col("value") > F.col("upper")).alias("alarm"), (F.col("value") > 20).alias("truth"))
    return evaluate.point_scores(cells, "alarm", "truth").select(r4("point_recall"), r4("point_precision"))


@query("WITH " + SQL_VIOLATIONS + ", " + sql_merge("v") + ", r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY round(peak, 9) DESC, start) AS k FROM ev) SELECT entity_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, round(peak, 4) AS peak FROM r WHERE k <= 6")
def budgeted_alarms(spark, d):
    g = hourly(spark, d)
    ev = detect.violation_events(g, baseline.profile(g, HOURLY), HOURLY).withColumn("peak", F.round("peak", 9))
    return evaluate.within_budget(ev, 30, 0.2).select("entity_id", text("start"), r4("peak"))


@query(
    "WITH " + SQL_CUSUM + ", a AS (SELECT * FROM c WHERE cusum > 4), " + sql_merge("a", score="cusum")
    + ", n AS (SELECT *, row_number() OVER (ORDER BY start, entity_id) AS k FROM ev) SELECT 'A-20240201-' || lpad(k::VARCHAR, CAST(greatest(4, length(k::VARCHAR)) AS INT), '0') AS event_id, 'B_efficiency' AS \"group\", entity_id, 'cop_degradation' AS type, 'info' AS severity, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, CAST(n_cells AS VARCHAR) AS n_cells FROM n"
)
def event_documents(spark, d):
    z = detect.standardized(hourly(spark, d), ("entity_id",), "value")
    ev = detect.cusum_events(z, ("entity_id",), "slot", "residual", 4.0, HOURLY)
    docs = detect.as_events(ev, "B_efficiency", "M2_chiller", "cop_degradation", "baseline_regression+cusum", F.to_timestamp(F.lit("2024-02-01")), "check condenser", {"n_cells": F.col("n_cells")})
    return docs.select("event_id", "group", "entity_id", "type", "severity", text("start"), F.col("evidence")["n_cells"].cast("string").alias("n_cells"))


@query(None)
def day_pca_score(spark, d):
    return detect.pca_scores(hourly(spark, d)).select("entity_id", "date", r4("error"))


@query(None)
def pooled_day_shapes(spark, d):
    """Shapes of the days of every event type, shrunk towards those of all types as one model."""
    g = hourly(spark, d)
    device = g.select("entity_id").distinct().withColumn("device_model", F.lit("any"))
    return detect.pooled_shapes(g, device).select("entity_id", "date", "day_type", "n_days", r4("error"), r4("score"))


@query(None)
def gbm_quantile_band(spark, d):
    g = hourly(spark, d).withColumn("weekday", F.weekday("slot"))
    return detect.boosted_band(g, ["tod_slot", "weekday", "n_samples"]).select("entity_id", "slot", r4("value"), r4("lower"), r4("expected"), r4("upper"))


@query(
    "WITH " + SQL_ODD + ", bad AS (SELECT DISTINCT entity_id, date FROM od), a AS (SELECT DISTINCT f.entity_id, f.date, f.day_type, f.total FROM f ANTI JOIN bad ON f.entity_id = bad.entity_id AND f.date = bad.date) "
    "SELECT x.entity_id, x.date::VARCHAR AS date, count(y.date) AS n_clean, round(avg(y.total), 4) AS usual FROM f x LEFT JOIN a y ON x.entity_id = y.entity_id AND x.day_type = y.day_type AND y.date < x.date AND y.date >= x.date - 14 GROUP BY 1, 2"
)
def clean_day_set(spark, d):
    x = days(spark, d)
    bad = detect.odd_features(x, "total").select("entity_id", "date")
    clean = x.join(bad, ["entity_id", "date"], "left_anti").select("entity_id", "day_type", F.col("date").alias("_d"), F.col("total").alias("_t"))
    before = (F.col("_d") < F.col("date")) & (F.col("_d") >= F.date_sub("date", 14))
    joined = x.alias("x").join(clean.alias("c"), (F.col("x.entity_id") == F.col("c.entity_id")) & (F.col("x.day_type") == F.col("c.day_type")) & before, "left")
    return joined.groupBy("x.entity_id", F.col("date").cast("string").alias("date")).agg(F.count("_d").alias("n_clean"), r4(F.avg("_t"), "usual"))


@query("WITH " + SQL_HOURLY + ", w AS (SELECT *, lead(slot) OVER (PARTITION BY entity_id ORDER BY slot) AS nxt FROM g) SELECT entity_id, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, CAST(date_diff('minute', slot, nxt) AS BIGINT) AS minutes FROM w WHERE nxt - slot > INTERVAL 1 HOUR")
def long_gaps(spark, d):
    nxt = F.lead("slot").over(Window.partitionBy("entity_id").orderBy("slot"))
    gap = ((F.unix_timestamp(nxt) - F.unix_timestamp("slot")) / 60).cast("long")
    return hourly(spark, d).withColumn("minutes", gap).where("minutes > 60").select("entity_id", text("slot"), "minutes")


@query(
    "WITH "
    + SQL_PROFILE
    + " SELECT entity_id, strftime(slot, '%Y-%m-%d %H:%M:%S') AS ts, 'power_active_kw' AS key, 'history' AS layer, 'fixed' AS window_type, round(lower, 4) AS lower, round(expected, 4) AS expected, round(upper, 4) AS upper, day_type, tod_slot FROM g JOIN prof USING (entity_id, day_type, tod_slot)"
)
def baseline_documents(spark, d):
    g = hourly(spark, d)
    scored = g.join(baseline.profile(g, HOURLY), ["entity_id", "day_type", "tod_slot"])
    docs = baseline.documents(scored, "power_active_kw", "history", "fixed", HOURLY)
    return docs.select("entity_id", text("ts"), "key", F.col("baseline_layer").alias("layer"), F.col("window.type").alias("window_type"), r4("lower"), r4("expected"), r4("upper"), "context.day_type", "context.tod_slot")


@query(
    "WITH " + SQL_VIOLATIONS + ", j AS (SELECT g.*, value - expected AS u FROM g JOIN prof USING (entity_id, day_type, tod_slot)), k AS (SELECT *, lag(u) OVER (PARTITION BY entity_id ORDER BY slot) AS l1 FROM j), "
    "f AS (SELECT entity_id, regr_intercept(u, l1) AS a, regr_slope(u, l1) AS b FROM k WHERE l1 IS NOT NULL GROUP BY 1), r AS (SELECT k.*, u - coalesce(a + b * l1, 0) AS rest FROM k JOIN f USING (entity_id)), "
    "sp AS (SELECT entity_id, quantile_cont(rest, 0.005) AS lo, quantile_cont(rest, 0.995) AS hi FROM r GROUP BY 1), short AS (SELECT entity_id, slot FROM v UNION SELECT entity_id, slot FROM r JOIN sp USING (entity_id) WHERE rest < lo OR rest > hi), "
    "z AS (SELECT *, (u - avg(u) OVER (PARTITION BY entity_id)) / stddev_samp(u) OVER (PARTITION BY entity_id) - 0.5 AS s FROM j), cs AS (SELECT *, sum(s) OVER (PARTITION BY entity_id ORDER BY slot) AS p FROM z), "
    "slow AS (SELECT entity_id, slot FROM (SELECT *, p - least(0, min(p) OVER (PARTITION BY entity_id ORDER BY slot)) AS c FROM cs) WHERE c > 5) "
    "SELECT entity_id, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, layer FROM (SELECT *, 'short' AS layer FROM short UNION ALL SELECT *, 'slow' FROM slow)"
)
def two_layers(spark, d):
    """Cells flagged by the layer for short faults and by the one for slow drift."""
    g = hourly(spark, d)
    return detect.two_layers(g, baseline.profile(g, HOURLY), HOURLY).select("entity_id", text("slot"), "layer")


# Identity, hierarchies of any depth, charts that begin again, exact thresholds.


def platform_devices(spark, d):
    """Customers and suppliers as the devices of two platforms; nation and balance make their serial numbers, segment and balance their vendors' ids."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")

    def told(df, source, name, nation, kind, balance):
        return df.select(
            F.lit(source).alias("source"), F.col(name).alias("entity_id"), F.concat_ws("-", F.col(nation).cast("string"), F.floor(F.col(balance) / 4).cast("string")).alias("serial_number"),
            F.concat(kind, F.lit(" "), F.floor(F.col(balance)).cast("string")).alias("vendor_device_id"),
        )

    return told(c, "platform", "c_name", "c_nationkey", F.col("c_mktsegment"), "c_acctbal").unionByName(told(s, "plant", "s_name", "s_nationkey", F.lit("PLANT"), "s_acctbal"))


@query(
    "WITH RECURSIVE v AS (SELECT 'platform' AS source, c_name AS e, c_nationkey || '-' || CAST(floor(c_acctbal / 4) AS BIGINT) AS sn, upper(c_mktsegment) || ' ' || CAST(floor(c_acctbal) AS BIGINT) AS vn FROM customer "
    "UNION ALL SELECT 'plant', s_name, s_nationkey || '-' || CAST(floor(s_acctbal / 4) AS BIGINT), 'PLANT ' || CAST(floor(s_acctbal) AS BIGINT) FROM supplier), n AS (SELECT *, source || '/' || e AS name FROM v), "
    "l AS (SELECT a.name AS a, b.name AS b FROM n a JOIN n b ON a.sn = b.sn UNION SELECT a.name, b.name FROM n a JOIN n b ON a.vn = b.vn), c AS (SELECT name AS a, name AS b FROM n UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a), "
    "u AS (SELECT a AS name, min(b) AS unit FROM c GROUP BY 1), g AS (SELECT unit, count(DISTINCT source) AS n_sources, count(DISTINCT n.name) AS k, count(DISTINCT sn) AS s FROM n JOIN u ON n.name = u.name GROUP BY 1) "
    "SELECT source, e AS entity_id, u.unit, n_sources, nullif(concat_ws('; ', CASE WHEN k > n_sources THEN k || ' devices in ' || n_sources || ' sources' END, CASE WHEN s > 1 THEN s || ' values of serial_number' END), '') AS conflict FROM n JOIN u ON n.name = u.name JOIN g ON g.unit = u.unit"
)
def device_identity(spark, d):
    """Devices of two platforms that share a number, or are joined by a chain of them, as one unit, and what speaks against it."""
    return graphs.identify(platform_devices(spark, d))


@query(
    "WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS child, q AS parent FROM part, (VALUES (3), (5)) f(k), LATERAL (SELECT p_partkey // k AS q) WHERE q >= 1), "
    "t AS (SELECT child, parent, 1 AS depth FROM e UNION SELECT t.child, e.parent, depth + 1 FROM t JOIN e ON t.parent = e.child) SELECT child, parent, min(depth)::BIGINT AS depth FROM t GROUP BY 1, 2"
)
def topology_any_depth(spark, d):
    """Parts below the third and the fifth of their number, to any depth, by the shortest way."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("child"))
    edges = p.withColumn("k", F.explode(F.array(F.lit(3), F.lit(5)))).select("child", F.expr("child div k").alias("parent")).where("parent >= 1").distinct()
    return graphs.closure(edges)


def hour_cents(spark, d):
    """entity_id, slot, v: the mean value of an hour in whole hundredths, the same in any engine."""
    s = samples(spark, d)
    cents = F.round(F.col("value") * 100).cast("long")
    return s.groupBy("entity_id", F.date_trunc("hour", "ts").alias("slot")).agg(F.sum(cents).alias("s"), F.count(F.lit(1)).alias("n")).select("entity_id", "slot", F.expr("s div n").alias("v"))


SQL_CENTS = "h AS (SELECT event_type AS entity_id, date_trunc('hour', ts) AS slot, sum(CAST(round(value * 100) AS BIGINT))::BIGINT // count(*) AS v FROM events GROUP BY 1, 2)"


@query(
    "WITH RECURSIVE " + SQL_CENTS + ", m AS (SELECT entity_id, (sum(v) // count(*))::BIGINT AS m FROM h GROUP BY 1), r AS (SELECT entity_id, slot, (v - m) / 1000.0::DOUBLE AS r, row_number() OVER (PARTITION BY entity_id ORDER BY slot) AS i FROM h JOIN m USING (entity_id)), "
    "t AS (SELECT entity_id, i, slot, greatest(0.0::DOUBLE, 0.0::DOUBLE + (r - 0.25::DOUBLE)) AS s FROM r WHERE i = 1 UNION ALL SELECT r.entity_id, r.i, r.slot, greatest(0.0::DOUBLE, (CASE WHEN t.s > 3 THEN 0.0::DOUBLE ELSE t.s END) + (r.r - 0.25::DOUBLE)) FROM t JOIN r ON r.entity_id = t.entity_id AND r.i = t.i + 1) "
    "SELECT entity_id, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, round(s, 4) AS cusum, s > 3 AS alarm FROM t"
)
def cusum_restarting(spark, d):
    """The control chart of hourly values that begins again after each alarm."""
    h = hour_cents(spark, d)
    m = h.groupBy("entity_id").agg(F.expr("sum(v) div count(1)").alias("m"))
    out = windows.restarting_cusum(h.join(m, "entity_id"), ("entity_id",), "slot", (F.col("v") - F.col("m")) / 1000.0, 0.25, 3.0)
    return out.select("entity_id", text("slot"), r4("cusum"), "alarm")


@query(
    "WITH " + SQL_CENTS + ", m AS (SELECT entity_id, (sum(v) // count(*))::BIGINT AS m FROM h GROUP BY 1), f AS (SELECT h.* FROM h JOIN m USING (entity_id) WHERE v > m), k AS (SELECT entity_id, NULL::BIGINT AS t FROM f UNION SELECT entity_id, v FROM f), "
    "c AS (SELECT k.entity_id, t, slot, lag(slot) OVER (PARTITION BY k.entity_id, t ORDER BY slot) AS before FROM k JOIN f ON f.entity_id = k.entity_id AND v > coalesce(t, -1)), "
    "n AS (SELECT entity_id, t, count(*) FILTER (before IS NULL OR slot - before > INTERVAL 2 HOUR) AS n FROM c GROUP BY 1, 2), y AS (SELECT entity_id, count(DISTINCT CAST(slot AS DATE)) AS days FROM h GROUP BY 1), "
    "a AS (SELECT k.entity_id, k.t, coalesce(n, 0) AS n, days FROM k JOIN y USING (entity_id) LEFT JOIN n ON n.entity_id = k.entity_id AND n.t IS NOT DISTINCT FROM k.t) "
    "SELECT entity_id, round(first(t ORDER BY t NULLS FIRST) / 100.0, 4) AS threshold, round(first(n ORDER BY t NULLS FIRST) / any_value(days), 4) AS alarms_per_day FROM a WHERE n <= days * 0.3 GROUP BY 1"
)
def alarm_budget_exact(spark, d):
    """Hours above a device's mean are flagged; the least of their values above which its merged alarms are within the budget."""
    h = hour_cents(spark, d).withColumn("score", F.col("v") / 100.0)
    m = h.groupBy("entity_id").agg(F.expr("sum(v) div count(1)").alias("m"))
    days = h.groupBy("entity_id").agg(F.countDistinct(F.to_date("slot")).alias("n_days"))
    out = evaluate.calibrate_exactly(h.join(m, "entity_id").where("v > m"), days, Config(alarm_budget=0.3, merge_gap=120))
    return out.select("entity_id", r4("threshold"), r4("alarms_per_day"))


# The same scans in blocks of time: no task holds a whole series.


@query("WITH " + SQL_ASOF + " SELECT event_id, strftime(mts, '%Y-%m-%d %H:%M:%S') AS maintained_at FROM a")
def asof_in_blocks(spark, d):
    s = samples(spark, d).where("entity_id != 'error'").withColumn("entity_id", F.col("user_id").cast("string"))
    return blocks.asof_in_blocks(s, maintenance(spark, d), "entity_id", "ts", "maintained_at").select("event_id", text("maintained_at"))


@query("WITH " + SQL_CUSUM + " SELECT entity_id, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, round(cusum, 4) AS cusum FROM c")
def cusum_in_blocks(spark, d):
    z = detect.standardized(hourly(spark, d), ("entity_id",), "value")
    return blocks.cusum_in_blocks(z, ("entity_id",), "slot", F.col("residual"), 0.5).select("entity_id", text("slot"), r4("cusum"))


@query("WITH s AS (SELECT event_type AS entity_id, CASE WHEN value > 10 THEN 1 ELSE 0 END AS v, ts FROM events), b AS (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY entity_id ORDER BY ts) = v THEN 0 ELSE 1 END AS edge FROM s), r AS (SELECT *, sum(edge) OVER (PARTITION BY entity_id ORDER BY ts) AS run FROM b) SELECT entity_id, CAST(v AS INT) AS v, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n FROM r GROUP BY entity_id, run, v")
def state_runs_in_blocks(spark, d):
    s = samples(spark, d).withColumn("v", (F.col("value") > 10).cast("int"))
    return blocks.state_runs_in_blocks(s, ("entity_id",), "ts", "v").select("entity_id", "v", text("start"), text("last"), "n")
