"""Step 2: what a value should be, from physics, from the device's own history, and from its peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joulewright.config import DEFAULT, Config
from joulewright.operators.joins import asof


def band(quantiles: tuple[float, float, float], value: str = "value") -> list[Column]:
    lo, mid, hi = quantiles
    return [F.percentile(value, F.lit(q)).alias(n) for q, n in ((lo, "lower"), (mid, "expected"), (hi, "upper"))]


def profile(grid: DataFrame, config: Config = DEFAULT, by: tuple[str, ...] = ("entity_id", "day_type", "tod_slot")) -> DataFrame:
    """by, lower, expected, upper, n: the usual range of a cell of the day and type of day."""
    known = grid.where("value IS NOT NULL")
    return known.groupBy(*by).agg(*band(config.quantiles), F.count(F.lit(1)).alias("n")).where(F.col("n") >= config.min_samples)


def refits(first: Column, last: Column, weeks: int) -> Column:
    """The refit dates of a series: every so many weeks from the Monday of its first row on."""
    return F.sequence(F.to_date(F.date_trunc("week", first)), F.to_date(last), F.expr(f"INTERVAL {7 * int(weeks)} DAYS"))


def to_refits(grid: DataFrame, config: Config = DEFAULT, ts: str = "slot") -> DataFrame:
    """The rows of grid, each with the refit_on of every refit whose window of `fit_weeks` holds it.

    Rows are copied (fit_weeks / refit_weeks times) instead of being joined by range: no row
    at or after a refit can be in its fit.
    """
    day = F.to_date(ts)
    period, start = 7 * config.refit_weeks, F.to_date(F.lit("1970-01-05"))  # a Monday
    # the first refit after the day, and the last one whose window still holds it
    first = F.floor(F.datediff(day, start) / period) + 1
    last = F.floor((F.datediff(day, start) + 7 * config.fit_weeks) / period)
    spread = grid.where(first <= last).withColumn("refit_no", F.explode(F.sequence(first, last)))
    return spread.withColumn("refit_on", F.date_add(start, (F.col("refit_no") * period).cast("int"))).drop("refit_no")


def rolling_profile(grid: DataFrame, config: Config = DEFAULT, by: tuple[str, ...] = ("entity_id", "day_type", "tod_slot"), ts: str = "slot") -> DataFrame:
    """A profile for each refit date, from the `fit_weeks` before it only."""
    spread = to_refits(grid.where("value IS NOT NULL"), config, ts)
    return spread.groupBy(*by, "refit_on").agg(*band(config.quantiles), F.count(F.lit(1)).alias("n")).where(F.col("n") >= config.min_samples)


def in_force(ts: Column, config: Config = DEFAULT) -> Column:
    """The refit date that a row is judged by: the last one at or before its day."""
    period, start = 7 * config.refit_weeks, F.to_date(F.lit("1970-01-05"))
    return F.date_add(start, (F.floor(F.datediff(F.to_date(ts), start) / period) * period).cast("int"))


def split_by_maintenance(df: DataFrame, maintenance: DataFrame, config: Config = DEFAULT, ts: str = "ts") -> DataFrame:
    """df with maintained_at and part: 'reference' (the fixed window after maintenance), 'current' (after it), or 'settling'.

    Rows before a device's first maintenance have neither, and no part.
    """
    log = maintenance.select("entity_id", F.col("ts").alias(ts)).distinct()
    since = asof(df, log, "entity_id", ts, "maintained_at")
    days = (F.unix_timestamp(ts) - F.unix_timestamp("maintained_at")) / 86400
    end = config.settle_days + 7 * config.reference_weeks
    part = F.when(days < config.settle_days, "settling").when(days < end, "reference").when(days >= end, "current")
    return since.withColumn("part", part)


def peer_band(grid: DataFrame, model: str, slot: str, config: Config = DEFAULT) -> DataFrame:
    """model, slot, lower, expected, upper, n_peers: what devices of one model do; at least two of them."""
    return grid.groupBy(model, slot).agg(*band(config.quantiles), F.countDistinct("entity_id").alias("n_peers")).where("n_peers >= 2")


def normal_equations(df: DataFrame, by: tuple[str, ...], y: str, x: list[str]) -> DataFrame:
    """by, n, and the sums of products that a least-squares fit needs: one pass, aggregated before the shuffle."""
    cols = ["_one", *x]
    ready = df.withColumn("_one", F.lit(1.0)).dropna(subset=[y, *x])
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"s_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    right = [F.sum(F.col(a) * F.col(y)).alias(f"t_{i}") for i, a in enumerate(cols)]
    return ready.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums, *right)


def fit_linear(df: DataFrame, by: tuple[str, ...], y: str, x: list[str]) -> DataFrame:
    """by, n, b_0 (intercept), b_1, ...: least squares by elimination on the sums, without leaving the plan.

    Null coefficients where the predictors are dependent or rows too few.
    """
    k = len(x) + 1
    eq = normal_equations(df, by, y, x)
    m = [[F.col(f"s_{min(i, j)}_{max(i, j)}") for j in range(k)] + [F.col(f"t_{i}")] for i in range(k)]
    # eliminate column by column; each step is a projection, so expressions stay short
    for i in range(k):
        for j in range(k + 1):
            eq = eq.withColumn(f"_{i}_{j}", m[i][j])
    for p in range(k):
        pivot = F.when(F.abs(F.col(f"_{p}_{p}")) > 1e-9, F.col(f"_{p}_{p}"))
        eq = eq.select("*", *[(F.col(f"_{p}_{j}") / pivot).alias(f"_n_{p}_{j}") for j in range(k + 1)])
        new = {}
        for i in range(k):
            for j in range(k + 1):
                new[f"_{i}_{j}"] = F.col(f"_n_{p}_{j}") if i == p else F.col(f"_{i}_{j}") - F.col(f"_{i}_{p}") * F.col(f"_n_{p}_{j}")
        eq = eq.withColumns(new).drop(*[f"_n_{p}_{j}" for j in range(k + 1)])
    return eq.select(*by, "n", *[F.col(f"_{i}_{k}").alias(f"b_{i}") for i in range(k)])


def conditional_baseline(grid: DataFrame, prof: DataFrame, x: list[str], by: tuple[str, ...] = ("entity_id", "day_type", "tod_slot")) -> DataFrame:
    """The profile's expectation plus what weather and people explain of the rest, as column expected."""
    scored = grid.join(prof.select(*by, F.col("expected").alias("_usual")), list(by))
    rest = scored.withColumn("_rest", F.col("value") - F.col("_usual"))
    fit = fit_linear(rest, ("entity_id",), "_rest", x)
    told = F.col("b_0")
    for i, c in enumerate(x, 1):
        told = told + F.col(f"b_{i}") * F.col(c)
    return scored.join(fit, "entity_id", "left").withColumn("expected", F.col("_usual") + F.coalesce(told, F.lit(0.0))).drop("_usual", "n", *[f"b_{i}" for i in range(len(x) + 1)])


def efficiency_curve(df: DataFrame, load: str, ratio: str, width: float, temp: str | None = None, temp_width: float = 5.0) -> DataFrame:
    """entity_id, load_bin (and temp_bin), p25, p50, p75, n of the ratio."""
    keys = [F.floor(F.col(load) / width).cast("int").alias("load_bin")] + ([F.floor(F.col(temp) / temp_width).cast("int").alias("temp_bin")] if temp else [])
    return df.where(F.col(ratio).isNotNull()).groupBy("entity_id", *keys).agg(*[F.percentile(ratio, F.lit(q / 100)).alias(f"p{q}") for q in (25, 50, 75)], F.count(F.lit(1)).alias("n"))


def documents(scored: DataFrame, key: str, layer: str, window: str, config: Config = DEFAULT, ts: str = "slot", temperature: str | None = None, occupancy: str | None = None) -> DataFrame:
    """Baseline documents of rows with lower, expected, upper, day_type, tod_slot (and refit_on, if the window rolls).

    layer: rule, history or peers; window: rolling or fixed.
    """
    refit = F.col("refit_on").cast("string") if "refit_on" in scored.columns else F.lit(None).cast("string")
    weeks = config.fit_weeks if window == "rolling" else config.reference_weeks
    number = lambda c: (F.col(c) if c else F.lit(None)).cast("double")
    return scored.select(
        "entity_id",
        F.lit(key).alias("key"),
        F.col(ts).alias("ts"),
        "expected",
        "lower",
        "upper",
        F.lit(layer).alias("baseline_layer"),
        F.struct(F.lit(window).alias("type"), F.lit(weeks).alias("fit_weeks"), refit.alias("refit_on")).alias("window"),
        F.struct("day_type", "tod_slot", number(temperature).alias("outdoor_temp_c"), number(occupancy).alias("occupancy_delta")).alias("context"),
    )
