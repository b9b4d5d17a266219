"""Step 4: the next day, as P10, P50 and P90 on the grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joulewright.operators.baseline import fit_linear

CELL = ("entity_id", "day_type", "tod_slot")


def seasonal_quantiles(history: DataFrame, by: tuple[str, ...] = CELL, value: str = "value") -> DataFrame:
    """by, p10, p50, p90 of the history's cells."""
    return history.where(F.col(value).isNotNull()).groupBy(*by).agg(*[F.percentile(value, F.lit(q / 100)).alias(f"p{q}") for q in (10, 50, 90)])


def horizon(entities: DataFrame, issued: Column, hours: int, step_minutes: int) -> DataFrame:
    """entities with a row for each step of the horizon: ts from the time of issue on."""
    end = F.timestamp_seconds(F.unix_timestamp(issued) + hours * 3600 - step_minutes * 60)
    return entities.withColumn("issued_at", issued).withColumn("ts", F.explode(F.sequence(issued, end, F.expr(f"INTERVAL {int(step_minutes)} MINUTES"))))


def regress(history: DataFrame, future: DataFrame, x: list[str], by: tuple[str, ...] = CELL, value: str = "value") -> DataFrame:
    """future with p10, p50, p90: the cell's median, corrected by weather and people, with the quantiles of what is left.

    history and future have the columns of `by` and x. A future row whose cell has no
    history, or whose predictors are missing, falls back to the cell or is null.
    """
    usual = seasonal_quantiles(history, by, value).select(*by, F.col("p50").alias("_usual"))
    rest = history.join(usual, list(by)).withColumn("_rest", F.col(value) - F.col("_usual"))
    fit = fit_linear(rest, ("entity_id",), "_rest", x)
    told = F.col("b_0")
    for i, c in enumerate(x, 1):
        told = told + F.col(f"b_{i}") * F.col(c)
    told = F.coalesce(told, F.lit(0.0))
    left = rest.join(fit, "entity_id", "left").withColumn("_left", F.col("_rest") - told)
    spread = left.groupBy("entity_id").agg(F.percentile("_left", F.lit(0.1)).alias("_lo"), F.percentile("_left", F.lit(0.9)).alias("_hi"))
    out = future.join(usual, list(by), "left").join(fit, "entity_id", "left").join(spread, "entity_id", "left")
    mid = F.col("_usual") + told
    names = ["_usual", "_lo", "_hi", "n", *[f"b_{i}" for i in range(len(x) + 1)]]
    return out.withColumn("p50", mid).withColumn("p10", mid + F.col("_lo")).withColumn("p90", mid + F.col("_hi")).drop(*names)


def documents(points: DataFrame, key: str, hours: int, step_minutes: int) -> DataFrame:
    """entity_id, key, issued_at, horizon, step, points: one forecast document per entity and issue."""
    each = F.array_sort(F.collect_list(F.struct("ts", "p50", "p10", "p90")))
    return points.groupBy("entity_id", "issued_at").agg(each.alias("points")).select(
        "entity_id", F.lit(key).alias("key"), "issued_at", F.lit(f"{hours}h").alias("horizon"), F.lit(f"{step_minutes}min").alias("step"), "points"
    )


def backtest(grid: DataFrame, first: str, every: int, count: int, days: int, by: tuple[str, ...] = CELL, ts: str = "slot") -> DataFrame:
    """Forecasts of the day after each origin from the `days` before it, with the actual values and issued_at.

    Origins are midnights: `first`, and `count` of them `every` so many days. A row of the
    grid is copied, by arithmetic on its day, to the days / every origins whose window it is
    in; no row is joined by range, and an origin's history ends before it.
    """
    away = F.datediff(F.to_date(ts), F.to_date(F.lit(first)))
    low, high = F.floor(away / every) + 1, F.floor((away + days) / every)
    inside = F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit(count - 1)))
    past = grid.where((low <= high) & (low < count) & (high >= 0)).withColumn("_origin", F.explode(inside))
    told = seasonal_quantiles(past, ("_origin", *by))
    own = F.floor(away / every)
    ahead = grid.withColumn("_origin", own).where((away % every == 0) & own.between(0, count - 1))
    issued = F.date_add(F.to_date(F.lit(first)), (F.col("_origin") * every).cast("int")).cast("timestamp")
    return ahead.join(told, ["_origin", *by], "left").withColumn("issued_at", issued).drop("_origin")
