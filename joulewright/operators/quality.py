"""The data-quality layer: what is wrong with the numbers themselves, for the system's operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joulewright.operators.windows import number_islands

SERIES = ("entity_id", "key")


def valid_ratio(grid: DataFrame, by: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """by, n_cells, n_missing, valid_ratio; the denominator is all cells of a completed grid."""
    missing = F.sum((F.col("n_samples") == 0).cast("long"))
    return grid.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cells"), missing.alias("n_missing"), (1 - missing / F.count(F.lit(1))).alias("valid_ratio"))


def stuck(df: DataFrame, least: int, by: tuple[str, ...] = SERIES, order: str = "slot", value: str = "value", only: Column | None = None) -> DataFrame:
    """by, start, last, n, value: runs of at least `least` equal values in a row.

    A null value breaks a run, and so does a row that `only` does not hold for, a condition
    such as a power above 0 beside a counter.
    """
    known = F.when(F.lit(True) if only is None else F.coalesce(only, F.lit(False)), F.col(value))
    rows = df.withColumn("_known", known)
    before = F.lag("_known").over(Window.partitionBy(*by).orderBy(order))
    runs = number_islands(rows, by, order, ~before.eqNullSafe(F.col("_known"))).where("_known IS NOT NULL").groupBy(*by, "island")
    found = runs.agg(F.min(order).alias("start"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"), F.first(value).alias(value))
    return found.where(F.col("n") >= least).drop("island")


def backwards(df: DataFrame, by: tuple[str, ...] = SERIES, order: str = "ts", value: str = "value") -> DataFrame:
    """Rows of a counter that are less than the row before, with how far it fell."""
    fall = F.lag(value).over(Window.partitionBy(*by).orderBy(order)) - F.col(value)
    return df.withColumn("fall", fall).where("fall > 0")


def out_of_range(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows outside the physical limits that the registry gives their key."""
    limits = registry.select("key", "lo", "hi")
    return df.join(limits, "key").where("value < lo OR value > hi")


def clock_drift(df: DataFrame, by: tuple[str, ...] = ("entity_id",), limit_seconds: int = 300) -> DataFrame:
    """by, median_seconds, drifts: how late samples arrive by their own clock, and whether that is too far off."""
    late = F.unix_timestamp("ingest_ts") - F.unix_timestamp("ts")
    mid = F.percentile(late, F.lit(0.5))
    return df.groupBy(*by).agg(mid.alias("median_seconds"), (F.abs(mid) > limit_seconds).alias("drifts"))


def firmware_steps(df: DataFrame, device: DataFrame, hours: int = 24) -> DataFrame:
    """entity_id, key, changed_at, before, after, step: means of the hours on both sides of a firmware change."""
    w = Window.partitionBy("entity_id").orderBy("valid_from")
    changes = device.withColumn("_old", F.lag("firmware_version").over(w)).where("_old != firmware_version").select("entity_id", F.col("valid_from").alias("changed_at"))
    away = F.unix_timestamp("ts") - F.unix_timestamp("changed_at")
    near = df.join(changes, "entity_id").where(F.abs(away) <= hours * 3600)
    means = near.groupBy("entity_id", "key", "changed_at").agg(F.avg(F.when(away < 0, F.col("value"))).alias("before"), F.avg(F.when(away >= 0, F.col("value"))).alias("after"))
    return means.withColumn("step", F.col("after") - F.col("before"))
