"""Safety and state rules on raw samples, without any baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joulewright.operators.windows import edges, number_islands


def held(df: DataFrame, condition: Column, least_seconds: float, by: tuple[str, ...] = ("entity_id",), order: str = "ts") -> DataFrame:
    """by, start, end, seconds: stretches in which the condition holds for longer than `least_seconds`.

    A stretch runs from its first sample to the first sample after it, or to the last one
    known; a null condition does not hold.
    """
    w = Window.partitionBy(*by).orderBy(order)
    marked = df.withColumn("_on", F.coalesce(condition, F.lit(False))).withColumn("_next", F.lead(order).over(w))
    runs = number_islands(marked, by, order, F.lag("_on").over(w) != F.col("_on"), "_run").where("_on")
    found = runs.groupBy(*by, "_run").agg(F.min(order).alias("start"), F.max(F.coalesce("_next", order)).alias("end"))
    return found.withColumn("seconds", F.unix_timestamp("end") - F.unix_timestamp("start")).where(F.col("seconds") > least_seconds).drop("_run")


def tagged(events: DataFrame, rule: str, level: str) -> DataFrame:
    return events.withColumn("rule", F.lit(rule)).withColumn("severity", F.lit(level))


def contact(c: Column, polarity: Column) -> Column:
    """Whether a tank contact reports its level; null (no rule fires) until the contact's kind is confirmed."""
    return F.when(polarity == "NO", c == 1).when(polarity == "NC", c == 0)


def dry_run(df: DataFrame, seconds: float, flow_zero: float = 0.1) -> DataFrame:
    empty = F.coalesce(F.col("tank_low"), F.lit(False)) | F.coalesce(F.col("water_flow_lpm") < flow_zero, F.lit(False))
    return tagged(held(df, (F.col("pump_state") == 1) & empty, seconds), "dry_run", "critical")


def overflow(df: DataFrame) -> DataFrame:
    return tagged(held(df, F.col("tank_high") & (F.col("pump_state") == 1), -1), "overflow", "critical")


def stuck_valve(df: DataFrame, seconds: float, command: str = "supply_valve_state_cmd", limit: str = "supply_valve_open_limit") -> DataFrame:
    return tagged(held(df, (F.col(command) == 1) & (F.col(limit) == 0), seconds), "stuck_valve", "warning")


def command_ignored(df: DataFrame, seconds: float, command: str = "pump_state_cmd", state: str = "pump_state", rule: str = "command_ignored") -> DataFrame:
    """Command and feedback differ for too long: pumps, and with other columns chillers."""
    return tagged(held(df, F.col(command) != F.col(state), seconds), rule, "warning")


def both_limits(df: DataFrame, opened: str = "supply_valve_open_limit", closed: str = "supply_valve_close_limit") -> DataFrame:
    return tagged(held(df, (F.col(opened) == 1) & (F.col(closed) == 1), -1), "both_limits", "warning")


def rapid_cycling(df: DataFrame, per_hour: int, state: str = "pump_state", by: tuple[str, ...] = ("entity_id",), order: str = "ts", slide: str = "5 minutes") -> DataFrame:
    """by, start, end, switches: hours (sliding) in which the state changes more often than allowed."""
    switched = edges(df, by, order, state).where("edge = 1")
    hours = switched.groupBy(*by, F.window(order, "1 hour", slide).alias("w")).agg(F.count(F.lit(1)).alias("switches")).where(F.col("switches") > per_hour)
    return tagged(hours.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "switches"), "rapid_cycling", "warning")


def low_power_factor(df: DataFrame, floor: float, seconds: float) -> DataFrame:
    return tagged(held(df, F.col("power_factor") < floor, seconds), "low_power_factor", "warning")


def unbalanced(df: DataFrame, pct: Column, limit: float, seconds: float, rule: str) -> DataFrame:
    return tagged(held(df, pct > limit, seconds), rule, "warning")


def drive_off_setpoint(df: DataFrame, points: float, seconds: float) -> DataFrame:
    return tagged(held(df, F.abs(F.col("pump_speed_pct") - F.col("pump_speed_pct_sp")) > points, seconds), "drive_off_setpoint", "warning")


def overheating(df: DataFrame, limit_c: float, rise_c: float, seconds: float) -> DataFrame:
    """A running pump whose water is hot, or warmer on return by too much: dry, or in a closed loop."""
    hot = (F.col("water_supply_temp_c") > limit_c) | (F.col("water_return_temp_c") - F.col("water_supply_temp_c") > rise_c)
    return tagged(held(df, (F.col("pump_state") == 1) & hot, seconds), "overheating", "critical")


def wide_states(telemetry: DataFrame, keys: list[str], by: str = "entity_id", order: str = "ts") -> DataFrame:
    """A row per entity and instant with the latest known state of every key."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    at = telemetry.groupBy(by, order).pivot("key", keys).agg(F.last("value"))
    return at.select(by, order, *[F.last(k, ignorenulls=True).over(w).alias(k) for k in keys])
