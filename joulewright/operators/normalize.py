"""Step 1: one name and unit per quantity, a regular grid with explicit gaps, amounts from counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("entity_id", "key")


def map_keys(telemetry: DataFrame, key_map: DataFrame) -> DataFrame:
    """Canonical names and units; keys that the map does not have keep theirs.

    key_map: key, canonical_key, factor, of catalogue size; Catalyst broadcasts it if it is small.
    """
    m = key_map.select("key", "canonical_key", "factor")
    joined = telemetry.join(m, "key", "left")
    return joined.withColumn("value", F.col("value") * F.coalesce("factor", F.lit(1.0))).withColumn("key", F.coalesce("canonical_key", "key")).drop("canonical_key", "factor")


def in_scope(telemetry: DataFrame, keys: DataFrame) -> DataFrame:
    return telemetry.join(keys.select("key").distinct(), "key", "left_semi")


def route(df: DataFrame, device: DataFrame, modules: dict[str, str]) -> DataFrame:
    """df with the module of its device's type; unknown types have none."""
    choice = F.lit(None).cast("string")
    for kind, module in modules.items():
        choice = F.when(F.col("device_type") == kind, module).otherwise(choice)
    return df.join(device.select("entity_id", "device_type"), "entity_id", "left").withColumn("module", choice)


def slot(ts: Column | str, step_minutes: int) -> Column:
    """The start of the grid cell that holds ts."""
    seconds = step_minutes * 60
    return F.timestamp_seconds(F.floor(F.unix_timestamp(F.col(ts) if isinstance(ts, str) else ts) / seconds) * seconds)


def resample(telemetry: DataFrame, step_minutes: int, kind: Column | None = None) -> DataFrame:
    """entity_id, key, slot, value, n_samples: gauges by mean, counters and states by their last sample.

    kind: a column that is 'gauge', 'counter' or 'state' (default: all gauges). Aggregated
    before the shuffle. A cell without samples is absent here; see complete().
    """
    last = F.max_by("value", "ts")
    value = F.avg("value") if kind is None else F.when(F.first("_kind") == "gauge", F.avg("value")).otherwise(last)
    df = telemetry if kind is None else telemetry.withColumn("_kind", kind)
    return df.groupBy(*SERIES, slot("ts", step_minutes).alias("slot")).agg(value.alias("value"), F.count("value").alias("n_samples"))


def complete(grid: DataFrame, step_minutes: int, by: tuple[str, ...] = SERIES, between: tuple | None = None) -> DataFrame:
    """Every cell of every series from its first to its last (or `between`); a missing one is null with 0 samples."""
    ends = grid.groupBy(*by).agg(F.min("slot").alias("_a"), F.max("slot").alias("_b"))
    if between:
        ends = ends.withColumn("_a", F.lit(between[0]).cast("timestamp")).withColumn("_b", F.lit(between[1]).cast("timestamp"))
    cells = ends.select(*by, F.explode(F.sequence("_a", "_b", F.expr(f"INTERVAL {int(step_minutes)} MINUTES"))).alias("slot"))
    return cells.join(grid, [*by, "slot"], "left").withColumn("n_samples", F.coalesce("n_samples", F.lit(0)))


def counter_amounts(grid: DataFrame, step_minutes: int, by: tuple[str, ...] = SERIES) -> DataFrame:
    """amount: the counter's rise since the cell before; null where it falls, or a cell between is missing (gap_span)."""
    known = grid.where("value IS NOT NULL")
    w = Window.partitionBy(*by).orderBy("slot")
    d = F.col("value") - F.lag("value").over(w)
    away = F.unix_timestamp("slot") - F.lag(F.unix_timestamp("slot")).over(w)
    whole = away == step_minutes * 60
    return known.withColumn("gap_span", F.coalesce(~whole, F.lit(False))).withColumn("amount", F.when(whole & (d >= 0), d)).withColumn("reset", F.coalesce(d < 0, F.lit(False)))


def flags(**conditions: Column) -> Column:
    """The names of the conditions that hold, as an array."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))


def to_wide(grid: DataFrame, keys: list[str]) -> DataFrame:
    """A row per entity and cell, a column per key; the key list is given, so there is no extra pass."""
    return grid.groupBy("entity_id", "slot").pivot("key", keys).agg(F.first("value"))


def without_generator(wide: DataFrame, band: tuple[float, float]) -> DataFrame:
    """Without cells whose frequency is out of band; an unknown frequency stays."""
    return wide.where(F.coalesce(F.col("frequency_hz").between(*band), F.lit(True)))


def running(wide: DataFrame, state: str, modes: tuple = (), mode: str | None = None) -> DataFrame:
    """Only cells in which the machine runs, and not those in test or service modes."""
    out = wide.where(F.col(state) == 1)
    return out.where(F.coalesce(~F.col(mode).isin(*modes), F.lit(True))) if mode and modes else out


def above_load_floor(df: DataFrame, rating: DataFrame, load: str, rated: str, share: float) -> DataFrame:
    return df.join(rating.select("entity_id", rated), "entity_id").where(F.col(load) > F.col(rated) * share)


def settled(wide: DataFrame, state: str, minutes: int, by: tuple[str, ...] = ("entity_id",), order: str = "slot") -> DataFrame:
    """Cells in which the machine has run for at least so many minutes without a stop."""
    from joulewright.operators.windows import number_islands

    before = F.lag(state).over(Window.partitionBy(*by).orderBy(order))
    runs = number_islands(wide, by, order, before != F.col(state), "_run")
    since = F.min(F.unix_timestamp(order)).over(Window.partitionBy(*by, "_run"))
    return runs.withColumn("_for", F.unix_timestamp(order) - since).where((F.col(state) == 1) & (F.col("_for") >= minutes * 60)).drop("_run", "_for")


def usable(wide: DataFrame) -> DataFrame:
    """Cells of devices that are reachable, without a fault and not set to manual; unknown counts as good."""
    good = lambda c, v: F.coalesce(F.col(c) == v, F.lit(True))
    return wide.where(good("reachable", 1.0) & good("fault", 0.0) & good("mode", 0.0))


def attribute_history(snapshots: DataFrame, attributes: list[str], by: str = "entity_id", seen: str = "seen_at") -> DataFrame:
    """by, attributes, valid_from, valid_to (null: still so), last_seen of the snapshots of devices' attributes (by, seen, attributes).

    A row is a stretch of snapshots in which nothing changed; null is a value. It is made of
    all snapshots, in order of when they were taken, so one that arrives late, or twice,
    gives what it would have given in time, and a run that is repeated changes nothing. Of
    several at one time the greatest counts. Snapshots of no device or no time are left out.
    """
    order = Window.partitionBy(by).orderBy(seen)
    value = F.struct(*attributes)
    once = snapshots.where(F.col(by).isNotNull() & F.col(seen).isNotNull()).groupBy(by, seen).agg(F.max(value).alias("_v"))
    begins = ~F.col("_v").eqNullSafe(F.lag("_v").over(order))
    marked = once.withColumn("_n", F.sum(F.coalesce(begins, F.lit(True)).cast("int")).over(order))
    stretches = marked.groupBy(by, "_n").agg(F.first("_v").alias("_v"), F.min(seen).alias("valid_from"), F.max(seen).alias("last_seen"))
    closed = stretches.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy(by).orderBy("valid_from")))
    return closed.select(by, *[F.col("_v")[a].alias(a) for a in attributes], "valid_from", "valid_to", "last_seen")


def outside_firmware_steps(df: DataFrame, device: DataFrame, hours: int, ts: str = "ts") -> DataFrame:
    """Without rows within so many hours after the device's firmware changed (device has a row per version)."""
    w = Window.partitionBy("entity_id").orderBy("valid_from")
    changed = device.withColumn("_old", F.lag("firmware_version").over(w)).where("_old != firmware_version")
    spans = changed.select("entity_id", F.col("valid_from").alias("_from"))
    hit = (df["entity_id"] == spans["entity_id"]) & (F.col(ts) >= F.col("_from")) & (F.unix_timestamp(ts) < F.unix_timestamp("_from") + hours * 3600)
    return df.join(spans, hit, "left_anti")
