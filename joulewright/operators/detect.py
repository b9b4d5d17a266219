"""Step 3: anomalies of amount (A), efficiency (B) and daily shape (C)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joulewright.config import DEFAULT, Config
from joulewright.operators.baseline import fit_linear
from joulewright.operators.windows import cusum, merge_cells, numbered

CELL = ("entity_id", "day_type", "tod_slot")


def violations(grid: DataFrame, prof: DataFrame, by: tuple[str, ...] = CELL, above_only: bool = False) -> DataFrame:
    """Grid cells outside their band, with score (how many half-widths beyond the middle)."""
    out = (F.col("value") > F.col("upper")) if above_only else (F.col("value") > F.col("upper")) | (F.col("value") < F.col("lower"))
    score = F.try_divide(F.abs(F.col("value") - F.col("expected")), F.greatest(F.col("upper") - F.col("lower"), F.lit(1e-9)) / 2)
    return grid.join(prof, list(by)).where(out).withColumn("score", score)


def violation_events(grid: DataFrame, prof: DataFrame, config: Config = DEFAULT, by: tuple[str, ...] = CELL) -> DataFrame:
    """entity_id, start, end, n_cells, peak of merged violations."""
    return merge_cells(violations(grid, prof, by), ("entity_id",), "slot", config.step, config.merge_gap, config.min_duration, "score")


def standardized(df: DataFrame, by: tuple[str, ...], value: str, fitted: Column | None = None) -> DataFrame:
    """residual: distance from the mean of the fitted rows, in their standard deviations (null where that is 0)."""
    at = F.col(value) if fitted is None else F.when(fitted, F.col(value))
    stats = df.groupBy(*by).agg(F.avg(at).alias("_mean"), F.stddev_samp(at).alias("_sd"))
    return df.join(stats, list(by)).withColumn("residual", F.try_divide(F.col(value) - F.col("_mean"), F.when(F.col("_sd") > 0, F.col("_sd")))).drop("_mean", "_sd")


def cusum_events(df: DataFrame, by: tuple[str, ...], order: str, residual: str, limit: float, config: Config = DEFAULT) -> DataFrame:
    """by, start, end, n_cells, peak: where the control chart of the residual stands above its limit."""
    chart = cusum(df, by, order, F.col(residual), config.cusum_slack)
    return merge_cells(chart.where(F.col("cusum") > limit), by, order, config.step, config.merge_gap, config.min_duration, "cusum")


def night_minimum(df: DataFrame, value: str = "value", ts: str = "slot", hours: tuple[int, int] = (1, 4)) -> DataFrame:
    """entity_id, date, night_min: the least value between the hours."""
    return df.where((F.hour(ts) >= hours[0]) & (F.hour(ts) < hours[1])).groupBy("entity_id", F.to_date(ts).alias("date")).agg(F.min(value).alias("night_min"))


def ratio_degradation(df: DataFrame, ratio: str, x: list[str], part: str = "part", least_pct: float = 10.0) -> DataFrame:
    """entity_id, expected, observed, deviation_pct, degraded: current rows against a fit on the reference rows.

    The fit has operating points only, never the ratio's own past; entities without a
    reference window give no row.
    """
    fit = fit_linear(df.where(F.col(part) == "reference"), ("entity_id",), ratio, x)
    told = reduce(lambda acc, i: acc + F.col(f"b_{i}") * F.col(x[i - 1]), range(1, len(x) + 1), F.col("b_0"))
    now = df.where(F.col(part) == "current").join(fit, "entity_id").withColumn("_told", told)
    each = now.groupBy("entity_id").agg(F.avg("_told").alias("expected"), F.avg(ratio).alias("observed"), F.count(F.lit(1)).alias("n"))
    return each.withColumn("deviation_pct", F.round(F.try_divide(F.col("observed") - F.col("expected"), F.col("expected")) * 100, 1)).withColumn("degraded", F.col("deviation_pct") >= least_pct)


def lagged(df: DataFrame, by: tuple[str, ...], order: str, value: str, lags: tuple[int, ...]) -> DataFrame:
    """df with value_lag_n columns; only for short faults of amount, never for efficiency."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumns({f"{value}_lag_{n}": F.lag(value, n).over(w) for n in lags})


def static_low(df: DataFrame, value: str, limit: float, config: Config = DEFAULT, by: tuple[str, ...] = ("entity_id",), order: str = "slot") -> DataFrame:
    """Merged events of cells under a fixed limit (low difference of temperature, low load)."""
    return merge_cells(df.where(F.col(value) < limit), by, order, config.step, config.merge_gap, config.min_duration)


def day_features(grid: DataFrame, on_above: Column, ts: str = "slot", value: str = "value") -> DataFrame:
    """entity_id, date, total, peak_hour, first_on, last_on, hours_on, switches of a day."""
    on = F.coalesce(on_above, F.lit(False))
    w = Window.partitionBy("entity_id", F.to_date(ts)).orderBy(ts)
    marked = grid.withColumn("_on", on.cast("int")).withColumn("_switch", F.coalesce((F.lag("_on").over(w) != F.col("_on")).cast("int"), F.lit(0)))
    return marked.groupBy("entity_id", F.to_date(ts).alias("date")).agg(
        F.sum(value).alias("total"),
        F.max_by(F.hour(ts), F.struct(F.col(value), -F.hour(ts))).alias("peak_hour"),
        F.min(F.when(F.col("_on") == 1, F.hour(ts))).alias("first_on"),
        F.max(F.when(F.col("_on") == 1, F.hour(ts))).alias("last_on"),
        F.sum("_on").alias("hours_on"),
        F.sum("_switch").alias("switches"),
    )


def odd_features(days: DataFrame, feature: str, quantiles: tuple[float, float] = (0.05, 0.95), by: tuple[str, ...] = ("entity_id", "day_type")) -> DataFrame:
    """Days whose feature lies outside what days of the same type have (schedule shifts, moved peaks)."""
    lo, hi = quantiles
    usual = days.groupBy(*by).agg(F.percentile(feature, F.lit(lo)).alias("_lo"), F.percentile(feature, F.lit(hi)).alias("_hi"))
    return days.join(usual, list(by)).where(~F.col(feature).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def nearest_day_type(grid: DataFrame) -> DataFrame:
    """entity_id, date, day_type, nearest, wrong: the type of day whose mean profile is nearest to the day's."""
    cells = grid.withColumn("date", F.to_date("slot"))
    means = cells.groupBy("entity_id", F.col("day_type").alias("nearest"), "tod_slot").agg(F.avg("value").alias("_mean"))
    apart = cells.join(means, ["entity_id", "tod_slot"]).groupBy("entity_id", "date", "day_type", "nearest").agg(F.avg((F.col("value") - F.col("_mean")) ** 2).alias("_d"))
    best = apart.groupBy("entity_id", "date", "day_type").agg(F.min(F.struct("_d", "nearest")).alias("_best"))
    return best.select("entity_id", "date", "day_type", F.col("_best.nearest").alias("nearest"), (F.col("_best.nearest") != F.col("day_type")).alias("wrong"))


def day_vectors(grid: DataFrame) -> DataFrame:
    """entity_id, date, day_type, profile: the day's values in order of the cell."""
    cells = F.array_sort(F.collect_list(F.struct("tod_slot", "value")))
    return grid.groupBy("entity_id", F.to_date("slot").alias("date"), "day_type").agg(F.transform(cells, lambda x: x["value"]).alias("profile"))


def pca_scores(grid: DataFrame, components: int = 3, cells: int = 24) -> DataFrame:
    """entity_id, date, error: how badly a day is rebuilt from the main shapes of its entity's days.

    One group is an entity's days (some hundred vectors), decomposed by numpy; a missing
    cell counts as the mean of that cell.
    """
    import numpy as np
    import pandas as pd

    def score(g: pd.DataFrame) -> pd.DataFrame:
        wide = g.pivot_table(index="date", columns="tod_slot", values="value", aggfunc="mean").reindex(columns=range(cells))
        x = wide.to_numpy(float)
        mean = np.nan_to_num(np.nanmean(x, axis=0)) if len(x) else np.zeros(cells)
        x = np.where(np.isnan(x), mean, x)
        # odd days must not shape what they are judged by: the tenth farthest from the median is left out of the fit
        far = np.sqrt(((x - np.median(x, axis=0)) ** 2).mean(axis=1))
        usual = x[far <= np.quantile(far, 0.9)]
        mean = usual.mean(axis=0)
        x, usual = x - mean, usual - mean
        _, _, v = np.linalg.svd(usual, full_matrices=False)
        k = min(components, max(0, len(usual) - 1))
        rest = x - x @ v[:k].T @ v[:k]
        return pd.DataFrame({"entity_id": g["entity_id"].iloc[0], "date": wide.index, "error": np.sqrt((rest**2).mean(axis=1))})

    plain = grid.select("entity_id", F.to_date("slot").alias("date"), "tod_slot", F.col("value").cast("double").alias("value"))
    return plain.groupBy("entity_id").applyInPandas(score, "entity_id string, date date, error double")


def summed_arrays(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, and each column of arrays summed place by place: aggregated before the shuffle, whatever the number of rows."""
    zipped = F.arrays_zip(*columns)
    each = df.select(*by, F.posexplode(zipped).alias("_i", "_x")).groupBy(*by, "_i").agg(*[F.sum(f"_x.{c}").alias(c) for c in columns])
    packed = each.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_i", *columns))).alias("_a"))
    return packed.select(*by, *[F.col("_a")[c].alias(c) for c in columns])


def pooled_shapes(grid: DataFrame, device: DataFrame, components: int = 3, cells: int = 24, shrink: float = 20.0) -> DataFrame:
    """entity_id, date, day_type, n_days, error, score: how odd the shape of a day is for its device, with few days too.

    A day's shape is its values over their mean; a missing cell has the mean shape of its
    model. Means and second moments are sums, so they are merged from parts, by device and by
    model (device: entity_id, device_model). A day is judged by the moments of its device and
    type of day without itself, shrunk towards its model's as if these were `shrink` days
    more: eight Saturdays alone give no usable shapes in 24 dimensions. error is what the
    main shapes leave of the day, score the same in units of what they usually leave (null
    where so few days are known that they leave nothing). Days without a positive mean have no shape and no row; a device without a model is one of its own.
    """
    import numpy as np
    import pandas as pd

    model = device.select("entity_id", F.col("device_model").cast("string").alias("model")).dropDuplicates(["entity_id"])
    typed = grid.where("value IS NOT NULL AND tod_slot IS NOT NULL").join(model, "entity_id", "left").withColumn("model", F.coalesce("model", F.concat(F.lit("="), "entity_id")))
    hour = typed.groupBy("entity_id", "model", "day_type", F.to_date("slot").alias("date"), "tod_slot").agg(F.avg(F.col("value").cast("double")).alias("v"))
    days = hour.groupBy("entity_id", "model", "day_type", "date").agg(F.avg("v").alias("mean"), F.map_from_entries(F.collect_list(F.struct("tod_slot", "v"))).alias("at")).where("mean > 0")
    usual = days.select("model", "day_type", F.explode(F.transform_values("at", lambda _, v: v / F.col("mean"))).alias("tod_slot", "v")).groupBy("model", "day_type", "tod_slot").agg(F.avg("v").alias("v"))
    usual = usual.groupBy("model", "day_type").agg(F.map_from_entries(F.collect_list(F.struct("tod_slot", "v"))).alias("usual"))
    cell = lambda i: F.coalesce(F.try_element_at("at", i) / F.col("mean"), F.try_element_at("usual", i), F.lit(1.0))
    shapes = days.join(usual, ["model", "day_type"]).select("entity_id", "model", "day_type", "date", F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), cell).alias("x"))
    # n, sums and sums of products in one array: 1, x, and x times each of x
    row = F.concat(F.array(F.lit(1.0)), F.col("x"), F.flatten(F.transform("x", lambda a: F.transform("x", lambda b: a * b))))
    own = summed_arrays(shapes.withColumn("m", row), ["entity_id", "model", "day_type"], ["m"])
    whole = summed_arrays(own, ["model", "day_type"], ["m"]).withColumnRenamed("m", "pool")
    moments = own.join(whole, ["model", "day_type"]).select(F.col("entity_id").alias("_entity"), F.col("day_type").alias("_type"), "m", "pool")

    def cut(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        return m[0], m[1 : cells + 1], m[cells + 1 :].reshape(cells, cells)

    def score(g: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        n, s, p = cut(np.array(known["m"].iloc[0], float))
        pn, ps, pp = cut(np.array(known["pool"].iloc[0], float))
        out = []
        for date, x in zip(g["date"], g["x"]):
            x = np.asarray(x, float)
            xx = np.outer(x, x)
            # both without the day itself
            left, pool = n - 1, pn - 1
            if pool < 1:
                continue
            weight = shrink / pool
            total = left + shrink
            mean = (s - x + weight * (ps - x)) / total
            cov = (p - xx + weight * (pp - xx)) / total - np.outer(mean, mean)
            values, vectors = np.linalg.eigh(cov)
            main = vectors[:, cells - components :]
            d = x - mean
            rest = d - main @ (main.T @ d)
            error = float(np.sqrt((rest**2).mean()))
            usually = float(np.sqrt(max(values[: cells - components].sum(), 0.0) / cells))
            out.append((g["entity_id"].iloc[0], date, g["day_type"].iloc[0], int(n), error, error / usually if usually > 1e-6 else None))
        return pd.DataFrame(out, columns=["entity_id", "date", "day_type", "n_days", "error", "score"]).astype({"score": "float64"})

    pairs = shapes.select("entity_id", "day_type", "date", "x").groupBy("entity_id", "day_type").cogroup(moments.groupBy("_entity", "_type"))
    return pairs.applyInPandas(score, "entity_id string, date date, day_type string, n_days long, error double, score double")


def boosted_band(df: DataFrame, x: list[str], y: str = "value", quantiles: tuple[float, ...] = (0.05, 0.5, 0.95), rounds: int = 60, rate: float = 0.15, bins: int = 16) -> DataFrame:
    """entity_id, slot, value, lower, expected, upper: quantile bands from boosted stumps on the pinball loss.

    One group is an entity's history on the grid. Features are cut at their quantiles; the
    leaves of a stump are the quantiles of the residuals in them. No feature is a lag.
    """
    import numpy as np
    import pandas as pd

    def boost(a: np.ndarray, target: np.ndarray, q: float) -> np.ndarray:
        told = np.full(len(target), np.quantile(target, q))
        cuts = [np.unique(np.quantile(a[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(a.shape[1])]
        sides = [(j, c, a[:, j] <= c) for j in range(a.shape[1]) for c in cuts[j]]
        sides = [(j, c, s) for j, c, s in sides if 0 < s.sum() < len(s)]
        for _ in range(rounds if sides else 0):
            pull = np.where(target > told, q, q - 1)  # the negative gradient
            _, _, s = max(sides, key=lambda k: pull[k[2]].sum() ** 2 / k[2].sum() + pull[~k[2]].sum() ** 2 / (~k[2]).sum())
            rest = target - told
            told = told + rate * np.where(s, np.quantile(rest[s], q), np.quantile(rest[~s], q))
        return told

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.dropna().sort_values("slot")
        a, target = g[x].to_numpy(float), g[y].to_numpy(float)
        out = g[["entity_id", "slot", y]].rename(columns={y: "value"})
        told = np.sort(np.stack([boost(a, target, q) for q in quantiles]), axis=0) if len(g) else np.zeros((3, 0))
        return out.assign(lower=told[0], expected=told[1], upper=told[2])

    return df.select("entity_id", "slot", y, *x).groupBy("entity_id").applyInPandas(fit, "entity_id string, slot timestamp, value double, lower double, expected double, upper double")


def peer_outliers(grid: DataFrame, peers: DataFrame, model: str, slot: str) -> DataFrame:
    """Rows above what the other devices of their model do in the same slot."""
    return grid.join(peers, [model, slot]).where(F.col("value") > F.col("upper"))


def fuse(detectors: dict[str, DataFrame], mode: str = "or", cell: tuple[str, ...] = ("entity_id", "slot")) -> DataFrame:
    """The cells that any ('or') or every ('and') detector flags, with how many did."""
    tagged = [d.select(*cell).distinct().withColumn("_by", F.lit(n)) for n, d in detectors.items()]
    votes = reduce(DataFrame.unionByName, tagged).groupBy(*cell).agg(F.count(F.lit(1)).alias("n_detectors"))
    return votes if mode == "or" else votes.where(F.col("n_detectors") == len(detectors))


def severity(group: Column, safety: Column) -> Column:
    """critical: safety; info: slow loss of efficiency; warning: anything else."""
    return F.when(safety, "critical").when(group == "B_efficiency", "info").otherwise("warning")


def as_events(
    events: DataFrame, group: str, module: str, kind: Column | str, model: Column | str, issued: Column, action: Column | str,
    evidence: dict[str, Column] | None = None, safety: Column | None = None, waste: Column | None = None,
) -> DataFrame:
    """Event documents; an id counts the events of an issue date in order of time, then of entity, type, key and end.

    evidence: names and columns of its own types; safety: whether an event is critical;
    waste: kWh a month, where it is known.
    """
    from joulewright.functions.expressions import document_id

    name = lambda c: F.lit(c) if isinstance(c, str) else c
    proof = F.struct(*[c.alias(k) for k, c in evidence.items()]) if evidence else F.lit(None).cast("string")
    order = ("start", "entity_id", "_kind", *(["key"] if "key" in events.columns else []), F.asc_nulls_last("end"))
    counted = numbered(events.withColumns({"_issued": issued, "_kind": name(kind)}), F.to_date("_issued"), F.to_date("start"), order, "_number")
    return counted.select(
        document_id("A", F.col("_issued"), F.col("_number"), 4).alias("event_id"),
        F.lit(group).alias("group"),
        F.lit(module).alias("module"),
        "entity_id",
        name(kind).alias("type"),
        severity(F.lit(group), F.lit(False) if safety is None else safety).alias("severity"),
        name(model).alias("rule_or_model"),
        "start",
        "end",
        proof.alias("evidence"),
        (F.lit(None) if waste is None else F.round(waste, 1)).cast("double").alias("estimated_waste_kwh_per_month"),
        name(action).alias("suggested_action"),
    )


#: What to tell the operator of a rule's event.
ADVICE = {
    "dry_run": "Stop the pump and check the supply",
    "overflow": "Stop the fill pump and check the level contact",
    "stuck_valve": "Check the valve and its limit switch",
    "command_ignored": "Check local mode and the starter",
    "both_limits": "Check the limit switches",
    "rapid_cycling": "Check the control band",
    "overheating": "Check for a dry or closed loop",
}


def rule_documents(events: DataFrame, module: str, issued: Column) -> DataFrame:
    """Documents of the events of rules (entity_id, start, end, rule, severity); critical ones need no baseline."""
    advice = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    lasted = {"seconds": F.unix_timestamp("end") - F.unix_timestamp("start")}
    action = F.coalesce(F.try_element_at(advice, F.col("rule")), F.lit("Check the device"))
    return as_events(events, "S_state", module, F.col("rule"), F.col("rule"), issued, action, lasted, F.col("severity") == "critical")


def combined(documents: list[DataFrame], issued: Column) -> DataFrame:
    """Documents of several kinds as one table: evidence as JSON, ids counted anew over all kinds of an issue date.

    Events of one type that begin at one time are counted in order of their ends (open ones
    last), then of evidence, so an id does not depend on how rows are dealt out.
    """
    from joulewright.functions.expressions import document_id

    told = [d.withColumn("evidence", F.to_json("evidence", {"ignoreNullFields": "false"}) if "struct" in d.schema["evidence"].dataType.simpleString() else F.col("evidence")) for d in documents]
    both = reduce(DataFrame.unionByName, told).withColumn("_issued", issued)
    counted = numbered(both, F.to_date("_issued"), F.to_date("start"), ("start", "entity_id", "type", F.asc_nulls_last("end"), "evidence"), "_number")
    return counted.withColumn("event_id", document_id("A", F.col("_issued"), F.col("_number"), 4)).drop("_issued", "_number")


def degradation_events(
    df: DataFrame, ratio: str, x: list[str], part: str = "part", least_pct: float = 10.0, sign: int = 1, by: tuple[str, ...] = ("entity_id",), ts: str = "slot", weight: str | None = None
) -> DataFrame:
    """by, start, detected_on, expected, observed, deviation_pct, n_days, excess of a loss after the reference window.

    The fit on the reference rows has operating points only, never the ratio's own past. A
    control chart of the daily deviation (slack three quarters of least_pct, limit least_pct)
    finds a loss of least_pct within five days, whenever it begins; start is the day after the
    chart was last at zero, and the means are of the days from there on. sign: 1 if a higher
    ratio is a loss (kW per kW, kWh per m3), -1 if a lower one is (pump head). excess: the sum
    of (observed - expected) * weight. Entities without a reference window give no row.
    """
    fit = fit_linear(df.where(F.col(part) == "reference"), by, ratio, x).drop("n")
    told = reduce(lambda acc, i: acc + F.col(f"b_{i}") * F.col(x[i - 1]), range(1, len(x) + 1), F.col("b_0"))
    now = df.where((F.col(part) == "current") & F.col(ratio).isNotNull()).join(fit, list(by)).withColumn("_told", told)
    over = (F.col(ratio) - F.col("_told")) * (F.col(weight) if weight else F.lit(1.0))
    daily = now.groupBy(*by, F.to_date(ts).alias("_date")).agg(F.sum(ratio).alias("_seen"), F.sum("_told").alias("_due"), F.count(F.lit(1)).alias("_n"), F.sum(over).alias("_over"))
    pct = sign * (F.try_divide("_seen", "_due") - 1) * 100
    chart = cusum(daily, by, "_date", pct, 0.75 * least_pct, "_chart")
    w = Window.partitionBy(*by)
    alarm = chart.withColumn("detected_on", F.min(F.when(F.col("_chart") > least_pct, F.col("_date"))).over(w)).where("detected_on IS NOT NULL")
    zero = alarm.withColumn("_zero", F.max(F.when((F.col("_chart") <= 0) & (F.col("_date") < F.col("detected_on")), F.col("_date"))).over(w))
    since = zero.where("_zero IS NULL OR _date > _zero").groupBy(*by, "detected_on").agg(
        F.min("_date").alias("start"), (F.sum("_due") / F.sum("_n")).alias("expected"), (F.sum("_seen") / F.sum("_n")).alias("observed"), F.count(F.lit(1)).alias("n_days"), F.sum("_over").alias("excess")
    )
    return since.withColumn("deviation_pct", F.round(F.try_divide(F.col("observed") - F.col("expected"), F.col("expected")) * 100, 1))


def moved_peaks(days: DataFrame, peak_hours: list[int], by: tuple[str, ...] = ("entity_id", "day_type")) -> DataFrame:
    """Days whose highest hour lies in the tariff's peak hours, where that of most days of their type does not."""
    inside = F.col("peak_hour").isin(peak_hours)
    usual = days.groupBy(*by).agg(F.avg(inside.cast("double")).alias("_share"))
    return days.join(usual, list(by)).where(inside & (F.col("_share") < 0.5)).drop("_share")


def two_layers(grid: DataFrame, prof: DataFrame, config: Config = DEFAULT, limit: float = 5.0, by: tuple[str, ...] = CELL) -> DataFrame:
    """entity_id, slot, layer of the two layers that run side by side: 'short' (band, and regression on the
    last value) and 'slow' (control chart of the residual).
    """
    joined = grid.join(prof, list(by)).withColumn("_usual", F.col("value") - F.col("expected"))
    lag = lagged(joined, ("entity_id",), "slot", "_usual", (1,))
    fit = fit_linear(lag, ("entity_id",), "_usual", ["_usual_lag_1"]).select("entity_id", "b_0", "b_1")
    rest = lag.join(fit, "entity_id").withColumn("_rest", F.col("_usual") - F.coalesce(F.col("b_0") + F.col("b_1") * F.col("_usual_lag_1"), F.lit(0.0)))
    spread = rest.groupBy("entity_id").agg(F.percentile("_rest", F.lit(0.005)).alias("_lo"), F.percentile("_rest", F.lit(0.995)).alias("_hi"))
    lagging = rest.join(spread, "entity_id").where(~F.col("_rest").between(F.col("_lo"), F.col("_hi")))
    chart = cusum(standardized(joined, ("entity_id",), "_usual"), ("entity_id",), "slot", F.col("residual"), config.cusum_slack).where(F.col("cusum") > limit)
    short = violations(grid, prof, by).select("entity_id", "slot").unionByName(lagging.select("entity_id", "slot")).distinct()
    return short.withColumn("layer", F.lit("short")).unionByName(chart.select("entity_id", "slot").distinct().withColumn("layer", F.lit("slow")))
