"""Which machines run, and at what load each, on curves of power over load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Watts in a kW: costs are whole watts, so equal costs are equal in any engine.
WATTS = 1000
#: Added before cutting to whole watts: halves go up, however the last digit of a double fell.
HALF = 0.500001


def curve_points(curve: DataFrame, rating: DataFrame, width_pct: float, capacity: str = "rated_cooling_kw", ratio: str = "p50") -> DataFrame:
    """entity_id, load_kw, power_kw: the points of an efficiency curve by load bins (entity_id, load_bin, ratio) at the bins' upper edges.

    load_bin counts bins of width_pct per cent of the capacity in rating.
    """
    load = (F.col("load_bin") + 1) * width_pct / 100 * F.col(capacity)
    return curve.join(rating.select("entity_id", capacity), "entity_id").select("entity_id", load.alias("load_kw"), (load * F.col(ratio)).alias("power_kw"))


def dispatch_table(points: DataFrame, by: str = "plant", unit_kw: float = 1.0) -> DataFrame:
    """by, units, est_kw, machines, loads_kw: for each whole number of units of load that a plant can carry, the cheapest way.

    points: by, entity_id, load_kw, power_kw. A machine that runs takes between one unit and
    its last point; its power is interpolated between points, and that of its first point
    below it. Shares are whole units, costs whole watts. Of equal costs fewer machines win,
    then the first names. Exact for curves of any shape, convex or not: machines are added
    one at a time, and the best cost of each load with the machines so far (which subset of
    them that is does not matter to those to come) is all that is kept. So a plant of n
    machines takes n passes over its loads, not 2 ** n subsets. A group is one plant's points.
    """
    import numpy as np
    import pandas as pd

    def best(g: pd.DataFrame) -> pd.DataFrame:
        names = sorted(g["entity_id"].unique())
        costs = []
        for name in names:
            p = g[g["entity_id"] == name].groupby("load_kw")["power_kw"].min().sort_index()
            units = np.arange(1, int(p.index[-1] / unit_kw + 1e-9) + 1)
            costs.append(np.floor(np.interp(units * unit_kw, p.index, p.to_numpy()) * WATTS + HALF).astype(np.int64))
        total, many = sum(map(len, costs)), len(names) + 1
        # cost of each load times `many`, plus the number of machines; and a bit for each machine, the first name's the highest
        key = np.full(total + 1, 1 << 61, np.int64)
        key[0] = 0
        bits = np.zeros(total + 1, np.int64 if len(names) < 63 else object)
        share = np.zeros((len(names), total + 1), np.int32)
        known = 1
        for k, cost in enumerate(costs):
            new, new_bits, bit = key.copy(), bits.copy(), 1 << (len(names) - 1 - k)
            for x, watts in enumerate(cost, 1):
                to = slice(x, x + known)
                cand, cand_bits = key[:known] + watts * many + 1, bits[:known] | bit
                better = (cand < new[to]) | ((cand == new[to]) & (cand_bits > new_bits[to]))
                new[to][better], new_bits[to][better], share[k, to][better] = cand[better], cand_bits[better], x
            key, bits, known = new, new_bits, known + len(cost)
        units = np.arange(1, total + 1)
        left, loads = units.copy(), np.zeros((len(names), total), np.int64)
        for k in reversed(range(len(names))):
            loads[k] = share[k, left]
            left -= loads[k]
        on = [np.flatnonzero(c) for c in loads.T]
        return pd.DataFrame({
            by: g[by].iloc[0],
            "units": units,
            "est_kw": key[1:] // many / WATTS,
            "machines": [[names[k] for k in c] for c in on],
            "loads_kw": [(loads[c, i] * unit_kw).tolist() for i, c in enumerate(on)],
        })

    kind = points.schema[by].dataType.simpleString()
    return points.select(by, F.col("entity_id").cast("string").alias("entity_id"), F.col("load_kw").cast("double").alias("load_kw"), F.col("power_kw").cast("double").alias("power_kw")).where("load_kw > 0 AND power_kw IS NOT NULL").groupBy(by).applyInPandas(
        best, f"{by} {kind}, units long, est_kw double, machines array<string>, loads_kw array<double>"
    )


def dispatch(demand: DataFrame, points: DataFrame, by: str = "plant", unit_kw: float = 1.0, spare: float = 0.0) -> DataFrame:
    """demand (by, load_kw, ...) with machines, loads_kw, est_kw, n_machines, constraints_checked, note.

    Safety first: a load is rounded up to units, and only covered if the plant could carry it
    with `spare`; then cost. A load of nothing needs no machine. The table is made once a
    plant, and a row of demand looks its load up, so the search does not grow with the demand.
    """
    table = dispatch_table(points, by, unit_kw)
    units = F.ceil(F.col("load_kw") / unit_kw - 1e-9).cast("long")
    most = points.groupBy(by, "entity_id").agg(F.max("load_kw").alias("_c")).groupBy(by).agg(F.sum(F.floor(F.col("_c") / unit_kw + 1e-9)).cast("long").alias("_most"))
    asked = demand.withColumn("_units", units).join(most, by, "left")
    fits = F.ceil(F.col("load_kw") * (1 + spare) / unit_kw - 1e-9) <= F.col("_most")
    asked = asked.withColumn("_units", F.when(fits, F.col("_units")))
    found = table.withColumnRenamed("units", "_units")
    told = asked.join(found, [by, "_units"], "left")
    none = fits & (F.col("load_kw") <= 0)
    note: Column = F.when(F.col("_most").isNull(), "no curves of this plant").when(F.col("load_kw").isNull(), "no load").when(~fits, "no combination covers the load")
    machines = F.when(none, F.expr("cast(array() AS array<string>)")).otherwise(F.col("machines"))
    return told.select(
        *demand.columns,
        machines.alias("machines"),
        F.when(none, F.expr("cast(array() AS array<double>)")).otherwise(F.col("loads_kw")).alias("loads_kw"),
        F.when(none, F.lit(0.0)).otherwise(F.col("est_kw")).alias("est_kw"),
        F.when(machines.isNotNull(), F.size(machines)).alias("n_machines"),
        F.array(F.lit("capacity"), F.lit("part_load_efficiency")).alias("constraints_checked"),
        note.alias("note"),
    )
