"""Queries of rules, forecasts, proposals, reports, and a stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from joulewright.operators import baseline, detect, evaluate, forecast, recommend, report, rules, windows
from joulewright.plans import flows
from joulewright.plans.testdata import SQL_DAY_TYPE, SQL_HOURLY, hourly, r4, samples, sql4, table, text, with_calendar
from joulewright.streaming import windows as streams

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql4(sql)
        return f

    return add


def states(spark, d):
    """Pump and valve states made of an event's numbers."""
    s, u, v = samples(spark, d), F.col("user_id"), F.col("value")
    return s.select(
        "entity_id", "ts", "event_id", "value", "user_id",
        (u % 4 != 0).cast("int").alias("pump_state"), (u % 3 != 0).cast("int").alias("pump_state_cmd"), (v < 4).alias("tank_low"), (v > 15).alias("tank_high"), v.alias("water_flow_lpm"),
        (u % 2).cast("int").alias("supply_valve_state_cmd"), (u % 5 > 1).cast("int").alias("supply_valve_open_limit"), (u % 7 > 3).cast("int").alias("supply_valve_close_limit"),
        (0.8 + (u % 10) * 0.02).alias("power_factor"), (u % 50 + 50.0).alias("pump_speed_pct"), F.lit(75.0).alias("pump_speed_pct_sp"),
        (20 + v).alias("water_supply_temp_c"), (20 + v * 1.5).alias("water_return_temp_c"),
    )


def sql_held(condition: str, seconds: int, rule: str, level: str) -> str:
    """Stretches of events in which a condition holds for longer than so many seconds, as SQL."""
    return (
        f"WITH s AS (SELECT event_type AS entity_id, ts, user_id AS u, value AS v, coalesce({condition}, false) AS on_, lead(ts) OVER w AS nxt FROM (SELECT *, user_id AS u, value AS v FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY ts)), "
        "b AS (SELECT *, CASE WHEN lag(on_) OVER (PARTITION BY entity_id ORDER BY ts) = on_ THEN 0 ELSE 1 END AS edge FROM s), r AS (SELECT *, sum(edge) OVER (PARTITION BY entity_id ORDER BY ts) AS run FROM b), "
        "h AS (SELECT entity_id, min(ts) AS start, max(coalesce(nxt, ts)) AS e FROM r WHERE on_ GROUP BY entity_id, run) "
        "SELECT * FROM (SELECT entity_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, strftime(e, '%Y-%m-%d %H:%M:%S') AS \"end\", CAST(floor(epoch(e)) - floor(epoch(start)) AS BIGINT) AS seconds, "
        f"'{rule}' AS rule, '{level}' AS severity FROM h) WHERE seconds > {seconds}"
    )


def shown(events):
    return events.select("entity_id", text("start"), text("end"), "seconds", "rule", "severity")


@query(sql_held("u % 4 <> 0 AND (v < 4 OR v < 0.1)", 1200, "dry_run", "critical"))
def dry_run_rule(spark, d):
    return shown(rules.dry_run(states(spark, d), 1200))


@query(sql_held("v > 15 AND u % 4 <> 0", -1, "overflow", "critical"))
def overflow_rule(spark, d):
    return shown(rules.overflow(states(spark, d)))


@query(
    "WITH d AS (" + sql_held("u % 4 <> 0 AND (v < 4 OR v < 0.1)", 1200, "dry_run", "critical") + "), o AS (" + sql_held("v > 15 AND u % 4 <> 0", -1, "overflow", "critical") + "), "
    "e AS (SELECT *, 'Stop the pump and check the supply' AS act FROM d UNION ALL SELECT *, 'Stop the fill pump and check the level contact' FROM o) "
    "SELECT 'A-20240201-' || lpad(k::VARCHAR, CAST(greatest(4, length(k::VARCHAR)) AS INT), '0') AS event_id, 'S_state' AS \"group\", entity_id, rule AS type, severity, start, \"end\", '{\"seconds\":' || seconds || '}' AS evidence, act AS suggested_action "
    "FROM (SELECT *, row_number() OVER (ORDER BY start, entity_id, rule) AS k FROM e)"
)
def rule_event_documents(spark, d):
    """Events of two critical rules as one table of documents; no baseline is needed for them."""
    s, at = states(spark, d), F.to_timestamp(F.lit("2024-02-01"))
    # ids count in order of the second that an event begins in; of those that begin in one second, in order of time
    found = [e.withColumns({c: F.date_trunc("second", c) for c in ("start", "end")}) for e in (rules.dry_run(s, 1200), rules.overflow(s))]
    docs = detect.combined([detect.rule_documents(e, "M3_water", at) for e in found], at)
    return docs.select("event_id", "group", "entity_id", "type", "severity", text("start"), text("end"), "evidence", "suggested_action")


@query(sql_held("u % 2 = 1 AND u % 5 <= 1", 1800, "stuck_valve", "warning"))
def stuck_valve_rule(spark, d):
    return shown(rules.stuck_valve(states(spark, d), 1800))


@query(sql_held("(u % 4 <> 0) <> (u % 3 <> 0)", 1200, "command_ignored", "warning"))
def command_mismatch(spark, d):
    return shown(rules.command_ignored(states(spark, d), 1200))


@query(sql_held("u % 5 > 1 AND u % 7 > 3", -1, "both_limits", "warning"))
def both_limits_rule(spark, d):
    return shown(rules.both_limits(states(spark, d)))


@query(sql_held("0.8 + (u % 10) * 0.02 < 0.9 - 0.005", 2400, "low_power_factor", "warning"))
def low_power_factor(spark, d):
    return shown(rules.low_power_factor(states(spark, d), 0.9 - 0.005, 2400))


@query(sql_held("v > 12", 1800, "voltage_unbalance", "warning"))
def unbalance_rule(spark, d):
    return shown(rules.unbalanced(states(spark, d), F.col("value"), 12.0, 1800, "voltage_unbalance"))


@query(sql_held("abs(u % 50 + 50.0 - 75) > 10", 2400, "drive_off_setpoint", "warning"))
def drive_off_setpoint(spark, d):
    return shown(rules.drive_off_setpoint(states(spark, d), 10.0, 2400))


@query(sql_held("u % 4 <> 0 AND (20 + v > 40 OR v * 0.5 > 6)", 600, "overheating", "critical"))
def overheating_rule(spark, d):
    return shown(rules.overheating(states(spark, d), 40.0, 6.0, 600))


@query(
    "WITH s AS (SELECT event_type AS entity_id, ts, CASE WHEN user_id % 4 <> 0 THEN 1 ELSE 0 END AS st FROM events), e AS (SELECT * FROM (SELECT *, lag(st) OVER (PARTITION BY entity_id ORDER BY ts) AS p FROM s) WHERE st <> p), "
    "w AS (SELECT entity_id, time_bucket(INTERVAL 5 MINUTES, ts) - k * INTERVAL 5 MINUTES AS start FROM e, range(0, 12) u(k)), c AS (SELECT entity_id, start, count(*) AS switches FROM w GROUP BY 1, 2 HAVING count(*) > 2) "
    "SELECT entity_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, switches FROM c"
)
def rapid_cycling(spark, d):
    return rules.rapid_cycling(states(spark, d), 2).select("entity_id", text("start"), "switches")


# Forecasts.

SQL_WATER = "w0 AS (SELECT event_type AS entity_id, date_trunc('hour', ts) AS slot, sum(value) AS value FROM events GROUP BY 1, 2), w AS (SELECT *, " + SQL_DAY_TYPE.format("slot") + " AS day_type, CAST(hour(slot) AS INT) AS tod_slot FROM w0)"


@query(
    "WITH " + SQL_WATER + " SELECT entity_id, strftime(TIMESTAMP '2024-01-31' + tod_slot * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS ts, round(quantile_cont(value, 0.1), 4) AS p10, round(median(value), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90 FROM w WHERE day_type = 'workday' GROUP BY entity_id, tod_slot"
)
def water_demand_forecast(spark, d):
    """The water that each tank's users draw by the hour of the day after the table, from days of the same type."""
    amounts = with_calendar(samples(spark, d).groupBy("entity_id", F.date_trunc("hour", "ts").alias("slot")).agg(F.sum("value").alias("value")))
    tanks = amounts.select("entity_id").distinct().withColumns({c: F.lit(v) for c, v in (("pump_m3", 8.0), ("tank_m3", 60.0), ("low_m3", 10.0), ("start_m3", 35.0))})
    docs, _ = flows.water_plan(amounts, tanks, F.lit(1.0), F.to_timestamp(F.lit("2024-01-31 00:00:00")))
    return docs.select("entity_id", F.inline("points")).select("entity_id", text("ts"), r4("p10"), r4("p50"), r4("p90"))

SQL_SEASON = SQL_HOURLY + ", q AS (SELECT entity_id, day_type, tod_slot, quantile_cont(value, 0.1) AS p10, median(value) AS p50, quantile_cont(value, 0.9) AS p90 FROM g WHERE slot < TIMESTAMP '2024-01-22' GROUP BY 1, 2, 3)"
CUT = "slot < TIMESTAMP '2024-01-22 00:00:00'"


@query("WITH " + SQL_SEASON + " SELECT entity_id, day_type, tod_slot, round(p10, 4) AS p10, round(p50, 4) AS p50, round(p90, 4) AS p90 FROM q")
def seasonal_forecast_quantiles(spark, d):
    return forecast.seasonal_quantiles(hourly(spark, d).where(CUT)).select("entity_id", "day_type", "tod_slot", r4("p10"), r4("p50"), r4("p90"))


@query(
    "WITH " + SQL_SEASON + ", j AS (SELECT g.*, p50 FROM g JOIN q USING (entity_id, day_type, tod_slot) WHERE slot >= TIMESTAMP '2024-01-22' AND g.day_type = 'workday' AND hour(slot) >= 8 AND hour(slot) < 18) "
    "SELECT entity_id, count(*) FILTER (abs(value) > 0.01) AS n, count(*) FILTER (abs(value) <= 0.01) AS n_dropped, round(avg(abs(value - p50) / abs(value)) FILTER (abs(value) > 0.01) * 100, 4) AS mape_pct FROM j GROUP BY 1"
)
def forecast_mape(spark, d):
    g = hourly(spark, d)
    told = g.where("NOT " + CUT).join(forecast.seasonal_quantiles(g.where(CUT)), ["entity_id", "day_type", "tod_slot"])
    return evaluate.mape(told, "value", "p50", F.col("is_op"), 0.01).withColumn("mape_pct", r4("mape_pct"))


@query(
    "WITH " + SQL_HOURLY + ", p AS (SELECT entity_id, tod_slot, median(value) AS usual FROM g WHERE slot < TIMESTAMP '2024-01-22' GROUP BY 1, 2), r AS (SELECT g.*, usual, value - usual AS rest FROM g JOIN p USING (entity_id, tod_slot) WHERE slot < TIMESTAMP '2024-01-22'), "
    "f AS (SELECT entity_id, regr_intercept(rest, n_samples) AS a, regr_slope(rest, n_samples) AS b FROM r GROUP BY 1), e AS (SELECT entity_id, quantile_cont(rest - coalesce(a + b * n_samples, 0), 0.1) AS lo, quantile_cont(rest - coalesce(a + b * n_samples, 0), 0.9) AS hi FROM r LEFT JOIN f USING (entity_id) GROUP BY 1) "
    "SELECT g.entity_id, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, round(usual + coalesce(a + b * n_samples, 0) + lo, 4) AS p10, round(usual + coalesce(a + b * n_samples, 0), 4) AS p50, round(usual + coalesce(a + b * n_samples, 0) + hi, 4) AS p90 "
    "FROM g LEFT JOIN p USING (entity_id, tod_slot) LEFT JOIN f USING (entity_id) LEFT JOIN e USING (entity_id) WHERE slot >= TIMESTAMP '2024-01-22'"
)
def regression_forecast(spark, d):
    g = hourly(spark, d)
    out = forecast.regress(g.where(CUT), g.where("NOT " + CUT), ["n_samples"], ("entity_id", "tod_slot"))
    return out.select("entity_id", text("slot"), r4("p10"), r4("p50"), r4("p90"))


def next_day(spark, d):
    """The day after the history's end, hour by hour, with the quantiles of its cells."""
    names = spark.createDataFrame([(x,) for x in ("click", "error", "purchase", "signup", "view")], "entity_id string")
    future = with_calendar(forecast.horizon(names, F.to_timestamp(F.lit("2024-01-23 00:00:00")), 24, 60), "ts")
    return future.join(forecast.seasonal_quantiles(hourly(spark, d).where(CUT)), ["entity_id", "day_type", "tod_slot"])


@query(
    "WITH " + SQL_SEASON + " SELECT entity_id, 'cooling_kw' AS key, '24h' AS horizon, '60min' AS step, '2024-01-23 00:00:00' AS issued_at, count(*) AS n_points, round(sum(p50), 4) AS total_p50, strftime(min(TIMESTAMP '2024-01-23' + tod_slot * INTERVAL 1 HOUR), '%Y-%m-%d %H:%M:%S') AS first_ts FROM q WHERE day_type = 'workday' GROUP BY 1"
)
def forecast_documents(spark, d):
    docs = forecast.documents(next_day(spark, d), "cooling_kw", 24, 60)
    total = F.aggregate("points", F.lit(0.0), lambda a, p: a + p["p50"])
    return docs.select("entity_id", "key", "horizon", "step", text("issued_at"), F.size("points").cast("long").alias("n_points"), r4(total, "total_p50"), F.date_format(F.col("points")[0]["ts"], "yyyy-MM-dd HH:mm:ss").alias("first_ts"))


@query("WITH " + SQL_SEASON + " SELECT entity_id, CASE WHEN tod_slot BETWEEN 9 AND 10 OR tod_slot BETWEEN 17 AND 19 THEN 'peak' WHEN tod_slot >= 22 OR tod_slot < 4 THEN 'off' ELSE 'normal' END AS band, round(sum(p50), 4) AS kwh FROM q WHERE day_type = 'workday' GROUP BY 1, 2")
def tariff_forecast_split(spark, d):
    from joulewright.functions.expressions import minute_of_day
    from joulewright.operators.joins import with_band
    from joulewright.sources.tables import split_midnight

    bands = split_midnight(spark.createDataFrame([("workday", 540, 660, "peak"), ("workday", 1020, 1200, "peak"), ("workday", 1320, 240, "off")], "day_type string, from_min int, to_min int, band string"))
    banded = with_band(next_day(spark, d), bands, minute_of_day(F.col("ts")))
    return banded.groupBy("entity_id", F.coalesce("band", F.lit("normal")).alias("band")).agg(r4(F.sum("p50"), "kwh"))


@query(
    "WITH " + SQL_HOURLY + ", o AS (SELECT entity_id, DATE '2024-01-15' + CAST(k * 7 AS INT) AS o FROM (SELECT DISTINCT entity_id FROM g), range(0, 3) u(k)), q AS (SELECT g.entity_id, o, day_type, tod_slot, median(value) AS p50 FROM g JOIN o ON g.entity_id = o.entity_id AND slot < o AND slot >= o - INTERVAL 14 DAYS GROUP BY ALL), "
    "a AS (SELECT g.*, o.o FROM g JOIN o ON g.entity_id = o.entity_id AND slot >= o AND slot < o + INTERVAL 1 DAY) SELECT a.o::VARCHAR AS issued_on, count(*) AS n, round(avg(abs(value - p50)), 4) AS mae FROM a LEFT JOIN q ON a.entity_id = q.entity_id AND a.o = q.o AND a.day_type = q.day_type AND a.tod_slot = q.tod_slot GROUP BY 1"
)
def forecast_backtest(spark, d):
    g = hourly(spark, d)
    out = forecast.backtest(g, "2024-01-15", 7, 3, 14)
    return out.groupBy(F.to_date("issued_at").cast("string").alias("issued_on")).agg(F.count(F.lit(1)).alias("n"), r4(F.avg(F.abs(F.col("value") - F.col("p50"))), "mae"))


# Proposals.


def machines(spark, d):
    """All suppliers as chillers, four to a plant."""
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    return s.select(F.floor(k / 4).alias("plant"), F.col("s_name").alias("entity_id"), (500.0 + (k % 4) * 150).alias("capacity"), (0.15 + (F.col("s_nationkey") % 7) * 0.013).alias("kw_per_kw"))


def plant_loads(spark, d, curves, load):
    """Every plant in every hour: plant, slot, load_kw. load: a column of plant and v, the hour's mean value in whole hundredths."""
    cents = F.round(F.col("value") * 100).cast("long")
    hours = samples(spark, d).groupBy(F.date_trunc("hour", "ts").alias("slot")).agg(F.sum(cents).alias("s"), F.count(F.lit(1)).alias("n")).withColumn("v", F.expr("s div n"))
    # the plants of an hour, from the one number that says how many there are
    plants = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))
    return hours.join(F.broadcast(curves.agg(F.max("plant").alias("last")))).withColumn("plant", plants).select("plant", "slot", load.cast("double").alias("load_kw"))


SQL_HOURS = "h AS (SELECT date_trunc('hour', ts) AS slot, sum(CAST(round(value * 100) AS BIGINT))::BIGINT // count(*) AS v FROM events GROUP BY 1)"
SQL_COMBO = (
    "mc AS (SELECT s_suppkey // 4 AS plant, s_name AS e, 500.0 + (s_suppkey % 4) * 150 AS cap, 0.15 + (s_nationkey % 7) * 0.013 AS r, row_number() OVER (PARTITION BY s_suppkey // 4 ORDER BY s_name) - 1 AS i FROM supplier), "
    "sub AS (SELECT plant, k, list(e ORDER BY e) AS ms, sum(cap) AS cap, CAST(round(sum(cap * r) / sum(cap) * 1e9) AS BIGINT) AS rate FROM mc, range(1, 16) u(k) WHERE (k >> i) & 1 = 1 GROUP BY plant, k), "
    + SQL_HOURS + ", dm AS (SELECT plant, slot, CAST(v * (60 + plant % 20 * 5) / 250 AS DOUBLE) AS load FROM h, (SELECT DISTINCT plant FROM mc)), "
    "t AS (SELECT dm.plant, slot, load, ms, round(load * rate / 1e9, 6) AS kw, row_number() OVER (PARTITION BY dm.plant, slot ORDER BY rate, len(ms), ms) AS k FROM dm JOIN sub ON dm.plant = sub.plant AND cap >= load)"
)


@query("WITH " + SQL_COMBO + " SELECT dm.plant, strftime(dm.slot, '%Y-%m-%d %H:%M:%S') AS slot, array_to_string(ms, '+') AS machines, round(kw, 4) AS est_kw, CAST(len(ms) AS INT) AS n_machines FROM dm LEFT JOIN t ON dm.plant = t.plant AND dm.slot = t.slot AND t.k = 1")
def chiller_combo_argmin(spark, d):
    """Every plant in every hour, at a load that follows the hour's mean value; some are over what a plant has."""
    curves = machines(spark, d)
    out = recommend.best_combination(plant_loads(spark, d, curves, F.col("v") * (60 + F.col("plant") % 20 * 5) / 250), curves)
    return out.select("plant", text("slot"), F.array_join("machines", "+").alias("machines"), r4("est_kw"), "n_machines")


def load_points(spark, d):
    """Part-load curves of all suppliers as chillers: the median price of a line by bins of ten of its quantity, as watts a kW."""
    s, li = table(spark, d, "supplier"), table(spark, d, "lineitem")
    each = F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("long")
    bins = baseline.efficiency_curve(li.select(F.col("l_suppkey").alias("entity_id"), F.col("l_quantity").alias("load"), each.alias("ratio")), "load", "ratio", 10.0)
    load = F.least((F.col("load_bin") + 1) * 10, F.lit(50))
    points = bins.groupBy("entity_id", load.alias("load_kw")).agg(F.max("p50").alias("w"))
    named = points.join(s.select(F.col("s_suppkey").alias("entity_id"), "s_name"), "entity_id")
    # watts a kW of load, least at thirty kW of load
    watts = F.floor((F.floor("w") + F.pow(F.col("load_kw") - 30, F.lit(2)) * 100) / 1000).cast("long") * F.col("load_kw")
    return named.select(F.floor(F.col("entity_id") / 4).alias("plant"), F.col("s_name").alias("entity_id"), "load_kw", (watts / 1000).alias("power_kw"))


@query(
    "WITH RECURSIVE li AS (SELECT l_suppkey AS k, CAST(floor(l_quantity / 10) AS INT) AS b, CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT) AS ratio FROM lineitem), "
    "pt AS (SELECT k, least((b + 1) * 10, 50) AS x, max(w) AS w FROM (SELECT k, b, quantile_cont(ratio, 0.5) AS w FROM li GROUP BY 1, 2) GROUP BY 1, 2), "
    "pw AS (SELECT k // 4 AS plant, s_name AS e, x, CAST(floor((floor(w) + (x - 30) * (x - 30) * 100) / 1000) AS BIGINT) * x AS y FROM pt JOIN supplier ON s_suppkey = k), "
    "en AS (SELECT plant, e, min(x) AS x0, max(x) AS x1, arg_min(y, x) AS y0, dense_rank() OVER (PARTITION BY plant ORDER BY e) AS i FROM pw GROUP BY plant, e), "
    "sg AS (SELECT plant, e, x AS xa, y AS ya, lead(x) OVER w AS xb, lead(y) OVER w AS yb FROM pw WINDOW w AS (PARTITION BY plant, e ORDER BY x)), "
    "c AS (SELECT en.plant, i, en.e, u.x, CAST(floor(CASE WHEN u.x <= x0 THEN y0::DOUBLE ELSE ya + (u.x - xa) * (yb - ya) / (xb - xa) END + 0.500001) AS BIGINT) AS watts "
    "FROM en JOIN range(1, 51) u(x) ON u.x <= x1 LEFT JOIN sg ON sg.plant = en.plant AND sg.e = en.e AND u.x > x0 AND u.x > xa AND u.x <= xb), "
    + "b0 AS (SELECT DISTINCT plant, 0 AS l, struct_pack(w := 0::BIGINT, n := 0, m := []::VARCHAR[]) AS best FROM en), "
    + "".join(
        f"b{k} AS (SELECT plant, l, min(best) AS best FROM (SELECT plant, l, best FROM b{k - 1} UNION ALL SELECT c.plant, l + c.x, struct_pack(w := best.w + watts, n := best.n + 1, m := list_append(best.m, c.e)) FROM b{k - 1} AS b JOIN c ON c.plant = b.plant AND c.i = {k}) GROUP BY plant, l), "
        for k in (1, 2, 3, 4)
    )
    + SQL_HOURS + ", dm AS (SELECT plant, slot, CAST((v * (20 + plant % 20)) // 1000 AS DOUBLE) AS load_kw FROM h, (SELECT DISTINCT s_suppkey // 4 AS plant FROM supplier)) "
    "SELECT dm.plant, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, array_to_string(best.m, '+') AS machines, round(best.w / 1000.0, 4) AS est_kw, CAST(best.n AS INT) AS n_machines FROM dm LEFT JOIN b4 ON dm.plant = b4.plant AND dm.load_kw = b4.l"
)
def chiller_dispatch(spark, d):
    """Machines and their shares of the load on part-load curves, for every plant in every hour."""
    from joulewright.operators.dispatch import dispatch

    points = load_points(spark, d)
    load = F.expr("(v * (20 + plant % 20)) div 1000")
    out = dispatch(plant_loads(spark, d, machines(spark, d), load), points)
    return out.select("plant", text("slot"), F.array_join("machines", "+").alias("machines"), r4("est_kw"), "n_machines")


@query(
    "WITH d AS (SELECT CAST(ts AS DATE) AS date, avg(value) * 20 AS heat FROM events GROUP BY 1), o AS (SELECT date, heat, CAST(s AS INT) AS s, greatest(0, heat / 100 - (8 - s) * 3) AS short, (8 - s) * 50 + heat * 0.01 AS cost FROM d, range(4, 9) u(s)) "
    "SELECT date::VARCHAR AS date, arg_min(s, round(cost, 6)) AS choice, round(min(cost), 4) AS cost FROM o WHERE short <= 4 GROUP BY 1"
)
def morning_start(spark, d):
    heat = samples(spark, d).groupBy(F.to_date("ts").cast("string").alias("date")).agg((F.avg("value") * 20).alias("heat"))
    options = heat.withColumn("s", F.explode(F.sequence(F.lit(4), F.lit(8))))
    short = F.greatest(F.lit(0.0), F.col("heat") / 100 - (8 - F.col("s")) * 3)
    cost = F.round((8 - F.col("s")) * 50 + F.col("heat") * 0.01, 6)
    return recommend.cheapest_option(options, ("date",), F.lit(True), short <= 4, cost, "s").select("date", "choice", r4("cost"))


@query(
    "WITH d AS (SELECT date_trunc('hour', ts) AS slot, avg(value) AS load FROM events GROUP BY 1), o AS (SELECT slot, load, CAST(6.0 + k * 0.5 AS DOUBLE) AS sp FROM d, range(0, 7) u(k)) "
    "SELECT strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, arg_min(sp, round(load * (1 - 0.02 * (sp - 6)), 6)) AS choice, round(min(load * (1 - 0.02 * (sp - 6))), 4) AS cost FROM o WHERE sp <= 7.5 AND sp <= 9 - load / 20 GROUP BY 1"
)
def supply_setpoint(spark, d):
    load = samples(spark, d).groupBy(F.date_trunc("hour", "ts").alias("slot")).agg(F.avg("value").alias("load"))
    options = load.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn("sp", 6.0 + F.col("k") * 0.5)
    cost = F.round(F.col("load") * (1 - 0.02 * (F.col("sp") - 6)), 6)
    return recommend.cheapest_option(options, ("slot",), F.col("sp") <= 7.5, F.col("sp") <= 9 - F.col("load") / 20, cost, "sp").select(text("slot"), "choice", r4("cost"))


@query(
    "WITH a AS (SELECT date_trunc('hour', ts) AS slot, sum(value) AS kw, sum(value) FILTER (user_id % 10 <> 0) AS told FROM events GROUP BY 1) "
    "SELECT round(sum(kw - told), 4) AS kwh, CAST(round(sum((kw - told) * CASE WHEN hour(slot) BETWEEN 9 AND 18 THEN 3000.0 ELSE 2000.0 END)) AS BIGINT) AS vnd, count(*) AS n_slots, 'one in ten loads shed' AS assumptions FROM a WHERE told IS NOT NULL"
)
def savings_backtest(spark, d):
    s = samples(spark, d).withColumn("slot", F.date_trunc("hour", "ts"))
    actual = s.groupBy("slot").agg(F.sum("value").alias("kw")).withColumn("price", F.when(F.hour("slot").between(9, 18), 3000.0).otherwise(2000.0))
    told = s.where("user_id % 10 != 0").groupBy("slot").agg(F.sum("value").alias("kw"))
    return recommend.savings(actual, told, F.col("price"), ["slot"], 1.0, "one in ten loads shed").withColumn("kwh", r4("kwh"))


@query(None)
def machine_plan(spark, d):
    """Combinations of three machines for all hourly loads, as one horizon: two hours on at least, at the turn of a week too."""
    sums = hourly(spark, d).groupBy("slot").agg(F.sum("value").alias("v"))
    # the machines are sized for the largest load: it is 2000 of their 2100 kW
    load = sums.join(F.broadcast(sums.agg(F.max("v").alias("most")))).select("slot", (F.col("v") / F.col("most") * 2000).alias("load_kw"), F.lit("P").alias("plant"))
    return recommend.plan_machines(load, [("A", 500.0, 0.2), ("B", 700.0, 0.15), ("C", 900.0, 0.18)])


@query("SELECT n_regionkey AS plant, array_to_string(list(s_name ORDER BY s_acctbal, s_name), ',') AS run_order FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def balanced_order(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    hours = s.select(F.col("n_regionkey").alias("plant"), F.col("s_acctbal").alias("run_hours"), F.col("s_name").alias("entity_id"))
    return recommend.balanced_order(hours).select("plant", F.array_join("order", ",").alias("run_order"))


@query(None)
def pump_schedule_dp(spark, d):
    """Each type's values as the water demand of a tank, planned day by day: 6 m3 in an hour of the day's mean value."""
    day = hourly(spark, d).withColumn("day", F.to_date("slot"))
    day = day.withColumn("mean", F.avg("value").over(Window.partitionBy("entity_id", "day")))
    price = F.when(F.hour("slot").isin(9, 10, 17, 18, 19), 3.0).when((F.hour("slot") >= 22) | (F.hour("slot") < 4), 1.0).otherwise(2.0)
    demand = day.select("entity_id", "day", "slot", (F.col("value") / F.col("mean") * 6).alias("use_m3"), price.alias("price"), F.lit(8.0).alias("pump_m3"), F.lit(60.0).alias("tank_m3"), F.lit(10.0).alias("low_m3"), F.lit(35.0).alias("start_m3"))
    return recommend.schedule_pump(demand, by=("entity_id", "day"))


@query(
    "WITH o AS (SELECT o_orderkey AS k, o_orderdate AS f, o_totalprice / 1000 AS kwh, date_trunc('quarter', o_orderdate) AS q FROM orders) "
    "SELECT 'R-' || strftime(q, '%Y%m%d') || '-' || lpad(n::VARCHAR, CAST(greatest(3, length(n::VARCHAR)) AS INT), '0') AS rec_id, action, CAST(round(kwh * 2500) AS BIGINT) AS est_saving_vnd, 'pending_operator' AS status FROM (SELECT *, 'run ' || k AS action, row_number() OVER (PARTITION BY q ORDER BY f, 'run ' || k) AS n FROM o)"
)
def recommendation_documents(spark, d):
    """Every order as a proposal, issued at the beginning of its quarter: some thousand an issue date at sf0.1."""
    p = table(spark, d, "orders").select(
        F.col("o_orderdate").alias("valid_from"), F.col("o_orderdate").alias("valid_to"), F.concat(F.lit("run "), F.col("o_orderkey").cast("string")).alias("action"), F.lit("cheaper").alias("reason"),
        F.array(F.lit("comfort")).alias("constraints_checked"), (F.col("o_totalprice") / 1000).alias("est_saving_kwh"),
    )
    docs = recommend.documents(p, "M2_chiller", F.date_trunc("quarter", "valid_from"), F.lit(2500.0))
    return docs.select("rec_id", "action", "est_saving_vnd", "status")


# Reports.


@query(
    "SELECT strftime(p, '%Y-%m-%d') AS period_start, region, nation, round(sum(q), 4) AS total FROM (SELECT date_trunc('month', l_shipdate) AS p, r_name AS region, n_name AS nation, l_quantity AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY GROUPING SETS ((p, region, nation), (p, region), (p))"
)
def report_grouping_sets(spark, d):
    li, s, n, r = (table(spark, d, t) for t in ("lineitem", "supplier", "nation", "region"))
    joined = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    facts = joined.select(F.col("l_shipdate").alias("slot"), F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("l_quantity").alias("value"))
    return report.totals(facts, "month", ["region", "nation"]).withColumns({"period_start": F.col("period_start").cast("string"), "total": r4("total")})


@query("WITH " + SQL_HOURLY + ", e AS (SELECT entity_id, tod_slot, median(value) AS expected FROM g GROUP BY 1, 2) SELECT strftime(date_trunc('week', slot), '%Y-%m-%d') AS period_start, entity_id, round(sum(value), 4) AS total, round(sum(expected), 4) AS expected FROM g JOIN e USING (entity_id, tod_slot) GROUP BY GROUPING SETS ((1, 2), (1))")
def actual_vs_baseline(spark, d):
    g = hourly(spark, d)
    usual = g.groupBy("entity_id", "tod_slot").agg(F.percentile("value", F.lit(0.5)).alias("expected"))
    return report.totals(g.join(usual, ["entity_id", "tod_slot"]), "week", ["entity_id"], expected="expected").withColumns({"period_start": F.col("period_start").cast("string"), "total": r4("total"), "expected": r4("expected")})


@query("SELECT l_suppkey AS entity_id, round(sum(l_extendedprice) - 30000 * count(*), 4) AS waste FROM lineitem GROUP BY 1 ORDER BY waste DESC, l_suppkey LIMIT 10")
def top_wasters(spark, d):
    w = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("entity_id")).agg(r4(F.sum("l_extendedprice") - 30000 * F.count(F.lit(1)), "waste"))
    return report.top(w, "entity_id", F.desc("waste"), 10)


@query("SELECT o_orderpriority AS module, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_accepted, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS saved_kwh, CAST(sum(round(o_totalprice) :: BIGINT) FILTER (o_orderstatus = 'F') AS BIGINT) AS saved_vnd FROM orders GROUP BY 1")
def recommendation_report(spark, d):
    o = table(spark, d, "orders")
    p = o.select(F.col("o_orderpriority").alias("module"), F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("open").alias("status"), F.col("o_totalprice").alias("est_saving_kwh"), F.round("o_totalprice").cast("long").alias("est_saving_vnd"))
    return report.acceptance(p).withColumn("saved_kwh", F.round("saved_kwh", 2))


@query("WITH s AS (SELECT event_type AS entity_id, CASE WHEN value > 10 THEN 1 ELSE 0 END AS v, ts FROM events), b AS (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY entity_id ORDER BY ts) = v THEN 0 ELSE 1 END AS edge FROM s), r AS (SELECT *, sum(edge) OVER (PARTITION BY entity_id ORDER BY ts) AS run FROM b) SELECT entity_id, CAST(v AS INT) AS v, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n FROM r GROUP BY entity_id, run, v")
def state_runs(spark, d):
    s = samples(spark, d).withColumn("v", (F.col("value") > 10).cast("int"))
    return windows.state_runs(s, ("entity_id",), "ts", "v").select("entity_id", "v", text("start"), text("last"), "n")


@query("SELECT event_type AS entity_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS switches FROM (SELECT *, lag(user_id % 4 <> 0) OVER (PARTITION BY event_type ORDER BY ts) AS p FROM events) WHERE (user_id % 4 <> 0) <> p GROUP BY 1, 2")
def switches_per_hour(spark, d):
    e = windows.edges(states(spark, d), ("entity_id",), "ts", "pump_state").where("edge = 1")
    return e.groupBy("entity_id", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("hour")).agg(F.count(F.lit(1)).alias("switches"))


# A stream, run to its end.


@query("WITH " + SQL_HOURLY + " SELECT entity_id, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, round(value, 4) AS value, n_samples FROM g")
def streaming_hourly_cells(spark, d):
    """The hourly grid of events read as a stream of files; each batch writes the cells it changed, the last one counts."""
    import uuid

    from joulewright.sources.tables import shared_dir

    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    shaped = stream.select(F.col("event_type").alias("entity_id"), F.lit("power_active_kw").alias("key"), "ts", "value")
    out = streams.cells(streams.timed(shaped), "1 hour").select("entity_id", text("slot"), r4("value"), "n_samples")
    path = f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}"

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/table/part={number}")

    out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    cells = spark.read.parquet(f"{path}/table")
    return cells.groupBy("entity_id", "slot").agg(F.max_by("value", "batch").alias("value"), F.max_by("n_samples", "batch").alias("n_samples"))


def last_batch(spark, stream, name: str):
    """The whole result of a stream of files that has been run to its end, as its last batch gives it."""
    import uuid

    from joulewright.sources.tables import shared_dir

    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/table")

    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/table")


def event_stream(spark, d):
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return stream.select(F.col("event_type").alias("entity_id"), F.col("ts").cast("timestamp").alias("ts"))


@query(
    "SELECT event_type AS entity_id, strftime(time_bucket(INTERVAL 5 MINUTE, ts) - k * INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS switches FROM events, range(0, 12) u(k) GROUP BY 1, 2"
)
def streaming_sliding_hours(spark, d):
    """Events of a stream as state changes: how many there are in each hour that begins at a multiple of five minutes."""
    out = streams.switch_counts(event_stream(spark, d))
    return last_batch(spark, out, "sliding").select("entity_id", text("start"), "switches")


@query(
    "WITH s AS (SELECT event_type AS entity_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), n AS (SELECT *, sum(b) OVER (PARTITION BY entity_id ORDER BY ts) AS k FROM s) "
    "SELECT entity_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 10 MINUTE, '%Y-%m-%d %H:%M:%S') AS end, count(*) AS n FROM n GROUP BY entity_id, k"
)
def streaming_sessions(spark, d):
    """Stretches of a stream without a gap of ten minutes."""
    out = streams.sessions(event_stream(spark, d), "10 minutes")
    return last_batch(spark, out, "sessions").select("entity_id", text("start"), text("end"), "n")
