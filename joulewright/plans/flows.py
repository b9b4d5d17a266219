"""The flows from end to end, on tables of the data model: telemetry to baselines and events, chillers to
efficiency events, history to forecasts and proposals, and the periodic report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joulewright.config import DEFAULT, Config
from joulewright.functions import expressions as X
from joulewright.operators import baseline, detect, dispatch, evaluate, forecast, normalize, quality, recommend, report, windows
from joulewright.sources.tables import saved


@dataclass(frozen=True)
class Consumption:
    """What the flow of amounts gives: the grid with flags, baseline documents, and events."""

    grid: DataFrame
    baselines: DataFrame
    events: DataFrame
    quality: DataFrame


def on_grid(telemetry: DataFrame, registry: DataFrame, calendar: DataFrame, config: Config) -> DataFrame:
    """Telemetry of one name per quantity on a complete grid: amounts of counters, flags, and the calendar's columns."""
    known = registry.select("key", "kind")
    named = normalize.map_keys(telemetry, registry).join(known, "key", "left")
    kind = F.when(F.col("kind").isin("counter", "state"), F.col("kind")).otherwise("gauge")
    cells = normalize.complete(normalize.resample(named, config.step, kind), config.step)
    amounts = normalize.counter_amounts(cells, config.step).select("entity_id", "key", "slot", "amount", "reset", "gap_span")
    both = cells.join(amounts, ["entity_id", "key", "slot"], "left").join(registry.select("key", "kind", "lo", "hi"), "key", "left")
    counter = F.col("kind") == "counter"
    flagged = both.withColumn(
        "flags",
        normalize.flags(missing=F.col("n_samples") == 0, backwards=F.col("reset"), after_gap=counter & F.col("gap_span"), out_of_range=(F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))),
    )
    bad = F.array_contains("flags", "out_of_range")
    judged = flagged.withColumn("value", F.when(counter, F.col("amount")).when(~F.coalesce(bad, F.lit(False)), F.col("value"))).drop("amount", "reset", "gap_span", "lo", "hi")
    days = calendar.select(F.col("date").alias("_date"), "day_type", "op_start_min", "op_end_min")
    dated = judged.join(days, F.to_date("slot") == F.col("_date"), "left").drop("_date")
    minute = X.minute_of_day(F.col("slot"))
    inside = (minute >= F.col("op_start_min")) & (minute < F.col("op_end_min"))
    return dated.withColumn("day_type", F.coalesce("day_type", F.lit("workday"))).withColumn("tod_slot", X.tod_slot(F.col("slot"), config.step)).withColumn("is_op", F.coalesce(inside, F.lit(False)))


def consumption(telemetry: DataFrame, registry: DataFrame, calendar: DataFrame, issued: Column, module: str = "M1_electricity", config: Config = DEFAULT, conditions: DataFrame | None = None, x: list[str] | None = None, device: DataFrame | None = None) -> Consumption:
    """Group A: every cell is judged by the profile of the last refit before it, which rolls.

    x: columns of grid conditions (weather, people; entity_id, slot and those columns in
    `conditions`) that explain a part of what the profile leaves; each refit fits them anew
    on the rows before it, so what comes later changes nothing. device: entity_id,
    device_model; with it, cells above their model's peers count too.

    Slow losses (leaks, a base load that creeps) stay within the band, so a control chart of
    the deviations, in half widths of the band, runs beside it: it begins again after each
    alarm, and alarms up to config.drift_gap apart are one event (slow_drift) from the first
    sample after the chart was last at zero. The strongest of them are told, within the
    budget; what is left of it is for the fast layers: a series' threshold is the least score
    that keeps their merged events within it, so that the budget holds whatever the scores.
    """
    grid = saved(on_grid(telemetry, registry, calendar, config), "grid")
    cell = ("entity_id", "key", "day_type", "tod_slot")
    prof = baseline.rolling_profile(grid, config, cell)
    judged = grid.withColumn("refit_on", baseline.in_force(F.col("slot"), config))
    scored = saved(judged.join(prof, [*cell, "refit_on"]), "scored")
    half = F.greatest(F.col("upper") - F.col("lower"), F.lit(1e-9)) / 2
    if conditions is not None and x:
        # what weather and people explain moves the expectation; the band is what they leave of it
        fits = ("entity_id", "key", "refit_on")
        told = sum((F.col(f"b_{i}") * F.col(c) for i, c in enumerate(x, 1)), F.col("b_0"))
        past = baseline.to_refits(grid.where("value IS NOT NULL"), config).join(prof, [*cell, "refit_on"]).join(conditions, ["entity_id", "slot"], "left")
        past = saved(past.select(*fits, *x, (F.col("value") - F.col("expected")).alias("_rest")), "past")
        fit = saved(baseline.fit_linear(past, fits, "_rest", x).drop("n"), "fit")
        low, _, high = config.quantiles
        left = past.join(fit, list(fits)).withColumn("_left", F.col("_rest") - told)
        spread = left.groupBy(*fits).agg(F.percentile("_left", F.lit(low)).alias("_low"), F.percentile("_left", F.lit(high)).alias("_high"))
        moved = scored.join(conditions, ["entity_id", "slot"], "left").join(fit, list(fits), "left").withColumn("_told", F.coalesce(told, F.lit(0.0)))
        middle = F.col("expected") + F.col("_told")
        known = (F.col("_told") != 0) & F.col("_low").isNotNull()
        band = {"lower": F.when(known, middle + F.col("_low")).otherwise(F.col("lower")), "upper": F.when(known, middle + F.col("_high")).otherwise(F.col("upper")), "expected": F.when(known, middle).otherwise(F.col("expected"))}
        scored = saved(moved.join(spread, list(fits), "left").withColumns(band).drop("_told", "_low", "_high", *x, *[f"b_{i}" for i in range(len(x) + 1)]), "scored")
        half = F.greatest(F.col("upper") - F.col("lower"), F.lit(1e-9)) / 2
    score = F.try_divide(F.abs(F.col("value") - F.col("expected")), half)
    out = scored.where((F.col("value") > F.col("upper")) | (F.col("value") < F.col("lower"))).withColumn("score", score).withColumn("model", F.lit("profile_band"))
    if device is not None:
        typed = scored.join(device.select("entity_id", "device_model"), "entity_id")
        peers = baseline.peer_band(typed.withColumn("cell", F.struct("key", "slot")), "device_model", "cell", config).select("device_model", "cell", F.col("upper").alias("_up"), F.col("expected").alias("_mid"))
        above = typed.withColumn("cell", F.struct("key", "slot")).join(peers, ["device_model", "cell"]).where(F.col("value") > F.col("_up"))
        apart = F.try_divide(F.col("value") - F.col("_mid"), F.greatest(F.col("_up") - F.col("_mid"), F.lit(1e-9)))
        out = out.unionByName(above.withColumn("score", apart).withColumn("model", F.lit("peers")).select(*out.columns))
    series = F.struct("entity_id", "key")
    flagged = out.groupBy(series.alias("entity_id"), "slot").agg(F.max("score").alias("score"), F.sort_array(F.collect_set("model")).alias("models"), F.max(F.greatest(F.col("value") - F.col("expected"), F.lit(0.0))).alias("_above"))
    flagged = saved(flagged, "flagged")
    days = saved(grid.groupBy(series.alias("entity_id")).agg(F.countDistinct(F.to_date("slot")).alias("n_days")), "days")
    # a cell of few samples has a narrow band by chance, so the chart's unit is the mean half width of the refit
    usual = F.avg(half).over(Window.partitionBy("entity_id", "key", "refit_on"))
    apart = scored.withColumn("_dev", (F.col("value") - F.col("expected")) / usual).withColumn("entity_id", series)
    drifts = saved(slow_drifts(apart, F.col("_dev"), days, config), "drifts")
    used = drifts.groupBy("entity_id").agg(F.count(F.lit(1)).alias("_used"))
    left = days.join(used, "entity_id", "left").select("entity_id", "n_days", (F.floor(F.col("n_days") * config.alarm_budget + 1e-9) - F.coalesce("_used", F.lit(0))).alias("allowed"))
    limits = evaluate.calibrate_exactly(flagged, left, config).select("entity_id", F.coalesce("threshold", F.lit(0.0)).alias("threshold"))
    told = flagged.join(limits, "entity_id").where(F.col("score") > F.col("threshold"))
    more = {"excess": F.sum("_above") * config.step / 60, "models": F.array_sort(F.array_distinct(F.flatten(F.collect_set("models")))), "threshold": F.first("threshold")}
    events = windows.merge_cells(told, ("entity_id",), "slot", config.step, config.merge_gap, config.min_duration, "score", more)
    events = events.withColumn("kind", F.lit("out_of_band")).unionByName(drifts.withColumn("kind", F.lit("slow_drift")))
    events = events.withColumn("key", F.col("entity_id.key")).withColumn("entity_id", F.col("entity_id.entity_id"))
    # if it comes back each day (a longer event: goes on) as it was
    length = F.greatest((F.unix_timestamp("end") - F.unix_timestamp("start")) / 86400, F.lit(1.0))
    proof = {"key": F.col("key"), "peak_score": F.round("peak", 3), "n_cells": F.col("n_cells"), "threshold": F.col("threshold"), "layers": F.col("models")}
    action = F.when(F.col("kind") == "slow_drift", "Look for a leak or a base load that creeps").otherwise("Check schedule and load")
    docs = detect.as_events(events, "A_consumption", module, F.col("kind"), F.array_join("models", "+"), issued, action, proof, waste=F.col("excess") / length * 30)
    # a series is an entity and a key
    told = baseline.documents(scored.withColumn("entity_id", F.struct("entity_id", "key")), "", "history", "rolling", config)
    told = told.withColumn("key", F.col("entity_id.key")).withColumn("entity_id", F.col("entity_id.entity_id"))
    return Consumption(grid, told, docs, quality.valid_ratio(grid))


def slow_drifts(scored: DataFrame, deviation: Column, days: DataFrame, config: Config) -> DataFrame:
    """entity_id, start, end, n_cells, peak, excess, models, threshold: events of the control charts of series, within the budget.

    scored: entity_id, slot, value, expected; deviation in half widths of the band, upwards.
    days: entity_id, n_days. An event lasts from the row after its chart was last at zero to
    the last alarm; peak is the mean deviation in it, and excess what it used too much.
    """
    rows = scored.select("entity_id", "slot", "value", "expected", deviation.alias("_dev")).where("_dev IS NOT NULL")
    chart = saved(windows.restarting_cusum(rows, ("entity_id",), "slot", F.col("_dev"), config.cusum_slack, config.cusum_limit), "charts")
    order = Window.partitionBy("entity_id").orderBy("slot")
    # since when the chart has been rising: the row after it was zero, or the first of the series
    first = F.first("slot").over(order)
    after = F.lead("slot").over(order)
    risen = chart.withColumn("_after", after).withColumn("_since", F.coalesce(F.last(F.when(F.col("cusum") == 0, F.col("_after")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), first))
    alarms = risen.where("alarm").select("entity_id", "slot", "_since")
    merged = windows.merge_cells(alarms, ("entity_id",), "slot", config.step, config.drift_gap, 0, None, {"_since": F.min("_since")})
    spans = merged.select("entity_id", F.least("_since", "start").alias("start"), "end")
    # what the rows of an event used, by its place among the events of its series
    inside = risen.join(spans.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans")), "entity_id")
    inside = inside.withColumn("_e", F.get(F.filter("_spans", lambda e: (e["start"] <= F.col("slot")) & (F.col("slot") < e["end"])), F.lit(0))).where("_e IS NOT NULL")
    over = F.col("value") - F.col("expected")
    events = inside.groupBy("entity_id", F.col("_e.start").alias("start"), F.col("_e.end").alias("end")).agg(F.count(F.lit(1)).alias("n_cells"), F.avg("_dev").alias("peak"), (F.sum(over) * config.step / 60).alias("excess"))
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("excess"), "start"))
    kept = events.join(days, "entity_id").withColumn("_rank", rank).where(F.col("_rank") <= F.floor(F.col("n_days") * config.alarm_budget + 1e-9))
    return kept.select("entity_id", "start", "end", "n_cells", "peak", "excess", F.array(F.lit("control_chart")).alias("models"), F.lit(config.cusum_limit).alias("threshold"))


def chiller_efficiency(grid: DataFrame, rating: DataFrame, maintenance: DataFrame, issued: Column, config: Config = DEFAULT, least_pct: float = 10.0) -> DataFrame:
    """Group B events: efficiency of the rows after the fixed window that follows the last maintenance.

    grid: long, on the grid, with power_active_kw, cooling_kw, chiller_load_pct, chiller_state
    per machine. Machines without a maintenance row give no event.
    """
    keys = ["power_active_kw", "cooling_kw", "chiller_load_pct", "chiller_state"]
    wide = normalize.to_wide(grid.where(F.col("key").isin(keys)), keys)
    steady = normalize.settled(wide, "chiller_state", config.settled_minutes)
    loaded = normalize.above_load_floor(steady, rating, "cooling_kw", "rated_cooling_kw", config.load_floor)
    ratio = loaded.withColumn("kw_per_kw_cooling", X.kw_per_kw(F.col("power_active_kw"), F.col("cooling_kw")))
    parts = saved(baseline.split_by_maintenance(ratio, maintenance, config, "slot"), "ratios")
    by = ("entity_id", "maintained_at")
    judged = detect.degradation_events(parts, "kw_per_kw_cooling", ["chiller_load_pct"], least_pct=least_pct, by=by, weight="cooling_kw")
    # of each machine, the window it is compared with and the loads since
    spans = parts.groupBy(*by).agg(
        F.array(F.round(F.min(F.when(F.col("part") == "current", F.col("chiller_load_pct"))), 0), F.round(F.max(F.when(F.col("part") == "current", F.col("chiller_load_pct"))), 0)).alias("loads"),
        F.min(F.when(F.col("part") == "reference", F.to_date("slot"))).alias("ref_from"),
        F.max(F.when(F.col("part") == "reference", F.to_date("slot"))).alias("ref_to"),
    )
    events = judged.join(spans, list(by)).withColumn("start", F.col("start").cast("timestamp")).withColumn("end", F.lit(None).cast("timestamp"))
    evidence = {
        "kw_per_kw_cooling": F.round("observed", 3),
        "reference": F.round("expected", 3),
        "deviation_pct": F.col("deviation_pct"),
        "reference_window": F.concat_ws("..", F.col("ref_from").cast("string"), F.col("ref_to").cast("string")),
        "load_pct_range": F.col("loads"),
        "detected_on": F.col("detected_on"),
    }
    waste = F.col("excess") * config.step / 60 / F.col("n_days") * 30
    return detect.as_events(events, "B_efficiency", "M2_chiller", "cop_degradation", "baseline_regression+cusum", issued, "Check condenser and refrigerant", evidence, waste=waste)


def pump_degradation(grid: DataFrame, maintenance: DataFrame, issued: Column, config: Config = DEFAULT, least_pct: float = 10.0) -> DataFrame:
    """Group B events of pumps: head at full speed falls, or kWh per m3 rises, against the window after maintenance.

    grid: long, on the grid, with pump_state, pump_speed_pct, pressure_supply_bar,
    pressure_return_bar, water_flow_lpm and power_active_kw per pump.
    """
    keys = ["pump_state", "pump_speed_pct", "pressure_supply_bar", "pressure_return_bar", "water_flow_lpm", "power_active_kw"]
    on = normalize.to_wide(grid.where(F.col("key").isin(keys)), keys).where("pump_state = 1")
    head = X.pump_head(F.col("pressure_supply_bar"), F.col("pressure_return_bar"), F.col("pump_speed_pct"))
    rate = X.kwh_per_m3(F.col("power_active_kw"), F.col("water_flow_lpm") * 60 / 1000)
    on = on.withColumn("m3", F.col("water_flow_lpm") * 60 / 1000)  # in an hour
    parts = saved(baseline.split_by_maintenance(on.withColumn("head", head).withColumn("kwh_per_m3", rate), maintenance, config, "slot"), "pumps")
    documents = []
    for ratio, x, sign, kind, action in (("head", ["water_flow_lpm"], -1, "pump_head_loss", "Check impeller and seals"), ("kwh_per_m3", ["pump_speed_pct"], 1, "kwh_per_m3_rise", "Check pump efficiency and valves")):
        found = detect.degradation_events(parts, ratio, x, least_pct=least_pct, sign=sign, by=("entity_id", "maintained_at"), weight="m3")
        found = found.withColumn("start", F.col("start").cast("timestamp")).withColumn("end", F.lit(None).cast("timestamp"))
        evidence = {ratio: F.round("observed", 3), "reference": F.round("expected", 3), "deviation_pct": F.col("deviation_pct"), "detected_on": F.col("detected_on")}
        # what a m3 takes too much, times the m3; a loss of head says nothing of the power
        waste = F.col("excess") * config.step / 60 / F.col("n_days") * 30 if ratio == "kwh_per_m3" else None
        documents.append(detect.as_events(found, "B_efficiency", "M3_water", kind, "baseline_regression+cusum", issued, action, evidence, waste=waste))
    return detect.combined(documents, issued)


def odd_shapes(grid: DataFrame, peak_hours: list[int], on_above: float, issued: Column, module: str = "M1_electricity", config: Config = DEFAULT) -> DataFrame:
    """Group C events: odd totals, peaks moved into the tariff's peak hours, and days like those of another type; at most
    config.odd_days_per_month of a device.

    grid: entity_id, slot, value, day_type, tod_slot.
    """
    types = grid.select("entity_id", F.to_date("slot").alias("date"), "day_type").distinct()
    days = saved(detect.day_features(grid, F.col("value") > on_above).join(types, ["entity_id", "date"]), "days")
    kinds = {
        "odd_total": detect.odd_features(days, "total").select("entity_id", "date"),
        "peak_moved": detect.moved_peaks(days, peak_hours).select("entity_id", "date"),
        "wrong_day_type": detect.nearest_day_type(grid).where("wrong").select("entity_id", "date"),
    }
    told = None
    for kind, found in kinds.items():
        part = found.withColumn("kind", F.lit(kind))
        told = part if told is None else told.unionByName(part)
    odd = told.groupBy("entity_id", "date").agg(F.sort_array(F.collect_set("kind")).alias("kinds")).withColumn("_n", F.size("kinds"))
    capped = saved(report.capped_days(odd, "_n", config.odd_days_per_month), "odd")
    events = capped.withColumn("start", F.col("date").cast("timestamp")).withColumn("end", F.date_add("date", 1).cast("timestamp"))
    return detect.as_events(events, "C_shape", module, F.get("kinds", F.lit(0)), "day_shape", issued, "Check the schedule of the day", {"kinds": F.col("kinds"), "date": F.col("date")})


def water_plan(history: DataFrame, tanks: DataFrame, price: Column, issued: Column) -> tuple[DataFrame, DataFrame]:
    """The next day's water demand by the hour as forecast documents, and a pump plan of each tank that covers its P90.

    history: entity_id (a tank), slot, value (m3 an hour), day_type, tod_slot. tanks:
    entity_id, pump_m3, tank_m3, low_m3, start_m3. price: a column of ts, slot and tod_slot.
    """
    ahead = forecast.horizon(tanks, issued, 24, 60).withColumn("tod_slot", X.tod_slot(F.col("ts"), 60)).withColumn("day_type", X.day_type(F.to_date("ts"), F.lit(False)))
    told = ahead.join(forecast.seasonal_quantiles(history), ["entity_id", "day_type", "tod_slot"])
    documents = forecast.documents(told, "water_volume_m3_total", 24, 60)
    demand = told.withColumn("slot", F.col("ts")).withColumn("price", price).withColumn("use_m3", F.col("p90"))
    return documents, recommend.schedule_pump(demand.select("entity_id", "slot", "use_m3", "price", "pump_m3", "tank_m3", "low_m3", "start_m3"))


def cooling_proposals(history: DataFrame, weather: DataFrame | None, curves: DataFrame, tariff: DataFrame, issued: Column, running_kw_per_kw: float, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """The next day's load as forecast documents, and proposals of machines for each band of the tariff.

    history: entity_id (a plant), slot, value, day_type, tod_slot, temperature. weather: ts,
    temperature of the horizon; without it each hour takes the history's mean of that hour.
    curves: plant, entity_id, and capacity, kw_per_kw of each machine, or load_kw, power_kw of
    the points of its part-load curve: machines then share a load as their curves say. A
    slot in which the proposal needs more than running_kw_per_kw counts against it.
    """
    plants = history.select("entity_id").distinct()
    ahead = forecast.horizon(plants, issued, 24, config.step).withColumn("tod_slot", X.tod_slot(F.col("ts"), config.step)).withColumn("day_type", X.day_type(F.to_date("ts"), F.lit(False)))
    if weather is None:
        usual = history.groupBy("entity_id", "tod_slot").agg(F.avg("temperature").alias("temperature"))
        ahead = ahead.join(usual, ["entity_id", "tod_slot"], "left")
    else:
        ahead = ahead.join(weather.select("ts", "temperature"), "ts", "left")
    told = forecast.regress(history, ahead, ["temperature"])
    documents = forecast.documents(told, "cooling_kw", 24, config.step)
    asked = told.where("p90 IS NOT NULL").select(F.col("entity_id").alias("plant"), "ts", F.col("p90").alias("load_kw"), "day_type", F.col("p50").alias("likely_kw"))
    best = dispatch.dispatch(asked, curves) if "power_kw" in curves.columns else recommend.best_combination(asked, curves)
    from joulewright.operators.joins import with_band

    banded = with_band(best.where("machines IS NOT NULL"), tariff, X.minute_of_day(F.col("ts"))).withColumn("band", F.coalesce("band", F.lit("normal")))
    hours = config.step / 60
    names = F.array_join("machines", " + ")
    runs = windows.number_islands(banded.withColumn("_who", names), ("plant",), "ts", F.lag("_who").over(_order("plant")) != F.col("_who"), "run")
    saved = F.col("likely_kw") * (running_kw_per_kw - F.try_divide("est_kw", "load_kw")) * hours
    blocks = runs.groupBy("plant", "run", "_who").agg(
        F.min("ts").alias("valid_from"),
        F.timestamp_seconds(F.max(F.unix_timestamp("ts")) + config.step * 60).alias("valid_to"),
        F.sum(saved).alias("est_saving_kwh"),
        F.sum(saved * F.coalesce("vnd_per_kwh", F.lit(0.0))).alias("_vnd"),
        F.first("constraints_checked").alias("constraints_checked"),
    )
    shaped = blocks.withColumn("action", X.sentence("Run %s", F.col("_who"))).withColumn("reason", X.sentence("Least power of all safe combinations at P90 load of %s", F.col("plant")))
    docs = recommend.documents(shaped, "M2_chiller", issued, F.coalesce(F.try_divide("_vnd", "est_saving_kwh"), F.lit(0.0)))
    return documents, docs


def _order(by: str):
    from pyspark.sql import Window

    return Window.partitionBy(by).orderBy("ts")


def periodic_report(flow: Consumption, area: DataFrame, proposals: DataFrame, period: str = "week", k: int = 10) -> dict[str, DataFrame]:
    """The sections of a report: totals against baseline by area, top wasters, events, proposals, valid samples."""
    told = flow.baselines.select("entity_id", "key", F.col("ts").alias("slot"), "expected")
    facts = flow.grid.join(told, ["entity_id", "key", "slot"], "left").join(area.select("entity_id", "area_id"), "entity_id", "left")
    waste = facts.groupBy("entity_id").agg(F.sum(F.greatest(F.col("value") - F.col("expected"), F.lit(0.0))).alias("waste"))
    return {
        "totals": report.totals(facts, period, ["area_id", "key"], expected="expected"),
        "top_wasters": report.top(waste.where("waste > 0"), "entity_id", F.desc("waste"), k),
        "events": flow.events,
        "proposals": report.acceptance(proposals),
        "valid_samples": flow.quality,
    }
