"""Thresholds by alarm budget, and how good detections and forecasts are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joulewright.config import DEFAULT, Config
from joulewright.operators.joins import bucket, buckets, overlaps
from joulewright.operators.windows import merge_cells


def calibrate(scored: DataFrame, thresholds: list[float], days: DataFrame, config: Config = DEFAULT, order: str = "slot") -> DataFrame:
    """entity_id, threshold, alarms_per_day: the least threshold whose merged events stay within the budget.

    scored: entity_id, slot, score. days: entity_id, n_days. Merging depends on the
    threshold, so every candidate is tried; a cell is copied to those below its score only.
    """
    options = F.filter(F.array(*[F.lit(float(t)) for t in sorted(thresholds)]), lambda t: t < F.col("score"))
    tried = scored.withColumn("threshold", F.explode(options))
    events = merge_cells(tried, ("entity_id", "threshold"), order, config.step, config.merge_gap, config.min_duration)
    counts = events.groupBy("entity_id", "threshold").agg(F.count(F.lit(1)).alias("_n"))
    grid = days.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in sorted(thresholds)])))
    rate = grid.join(counts, ["entity_id", "threshold"], "left").withColumn("alarms_per_day", F.coalesce("_n", F.lit(0)) / F.col("n_days"))
    # more than one threshold may fit: the least one above every threshold that does not
    worst = F.max(F.when(F.col("alarms_per_day") > config.alarm_budget, F.col("threshold"))).over(Window.partitionBy("entity_id"))
    fit = rate.withColumn("_worst", worst).where("_worst IS NULL OR threshold > _worst")
    return fit.groupBy("entity_id").agg(F.min("threshold").alias("threshold"), F.min_by("alarms_per_day", "threshold").alias("alarms_per_day"))


def events_by_threshold(scored: DataFrame, merge_gap: int, order: str = "slot") -> DataFrame:
    """entity_id, threshold, n: how many merged events the cells with score > threshold make, at every score where that changes.

    A cell begins an event while the threshold is under its own score, but not under the
    highest score of the cells up to merge_gap minutes before it (these would be part of the
    same event). So each cell adds one event between two scores, and the sum of these steps,
    in order of the score, is the number at every threshold: one window and no candidates.
    A threshold holds up to the next one; before the first, n is that of the first (null) row.
    """
    at = scored.where("score IS NOT NULL").withColumn("_at", F.unix_timestamp(order))
    near = Window.partitionBy("entity_id").orderBy("_at").rangeBetween(-merge_gap * 60, -1)
    # cells of one time are one cell
    cells = at.groupBy("entity_id", "_at").agg(F.max("score").alias("score")).withColumn("_before", F.max("score").over(near))
    begins = cells.where("_before IS NULL OR _before < score")
    steps = begins.select("entity_id", F.explode(F.array(F.struct(F.col("_before").alias("threshold"), F.lit(1).alias("d")), F.struct(F.col("score").alias("threshold"), F.lit(-1).alias("d")))).alias("x"))
    summed = steps.groupBy("entity_id", "x.threshold").agg(F.sum("x.d").alias("d"))
    return summed.select("entity_id", "threshold", F.sum("d").over(Window.partitionBy("entity_id").orderBy(F.asc_nulls_first("threshold"))).alias("n"))


def calibrate_exactly(scored: DataFrame, days: DataFrame, config: Config = DEFAULT, order: str = "slot") -> DataFrame:
    """entity_id, threshold, alarms_per_day: the least of all scores above which merged events are within the budget.

    scored: entity_id, slot, score. days: entity_id, n_days, and where the budget is another
    one than config's, allowed (events). Merging makes fewer events of a lower threshold now and then, so the number is looked at for every score. A threshold of
    null means that all cells may alarm. There is always one: above the highest score there
    is no event. Events are counted before config.min_duration drops short ones, so with one
    longer than a cell they are at most as many.
    """
    counts = events_by_threshold(scored, config.merge_gap, order).join(days, "entity_id").withColumn("alarms_per_day", F.col("n") / F.col("n_days"))
    fit = counts.where(F.col("n") <= (F.col("allowed") if "allowed" in days.columns else F.col("n_days") * config.alarm_budget + 1e-9))
    best = F.min(F.struct(F.col("threshold").isNotNull().alias("_a"), F.col("threshold"), F.col("alarms_per_day"))).alias("_b")
    return fit.groupBy("entity_id").agg(best).select("entity_id", "_b.threshold", "_b.alarms_per_day")


def within_budget(events: DataFrame, days: int, budget: float, score: str = "peak") -> DataFrame:
    """The strongest events of each entity, as many as the budget allows over the days."""
    w = Window.partitionBy("entity_id").orderBy(F.desc(score), "start")
    return events.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= int(days * budget)).drop("_rank")


def event_scores(predicted: DataFrame, labelled: DataFrame, by: str = "entity_id") -> DataFrame:
    """n_predicted, n_labelled, n_true, n_found, precision, recall, by event and not by sample."""
    hits = overlaps(predicted, labelled, by)
    found = hits.agg(F.countDistinct("a_id").alias("n_true"), F.countDistinct("b_id").alias("n_found"))
    n = predicted.agg(F.count(F.lit(1)).alias("n_predicted")).join(labelled.agg(F.count(F.lit(1)).alias("n_labelled"))).join(found)
    return n.withColumn("precision", F.try_divide("n_true", "n_predicted")).withColumn("recall", F.try_divide("n_found", "n_labelled"))


def point_scores(cells: DataFrame, alarm: str, truth: str) -> DataFrame:
    """point_recall and point_precision of flagged cells."""
    both = F.sum((F.col(alarm) & F.col(truth)).cast("long"))
    return cells.agg(
        F.try_divide(both, F.sum(F.col(truth).cast("long"))).alias("point_recall"), F.try_divide(both, F.sum(F.col(alarm).cast("long"))).alias("point_precision")
    )


def delays(alarms: DataFrame, labelled: DataFrame, by: str = "entity_id", ts: str = "slot") -> DataFrame:
    """by, id, delay_min: from a fault's start to the first alarm in it; null if there is none.

    A fault is copied to each time bucket it reaches, up to the last alarm.
    """
    a = alarms.select(F.col(by).alias("_e"), F.col(ts).alias("_at"), bucket(F.col(ts)).alias("_b"))
    last = F.broadcast(alarms.agg(F.max(ts).alias("_last")))
    faults = labelled.join(last).withColumn("_bucket", F.explode_outer(buckets(F.col("start"), F.col("end"), F.col("_last"))))
    hit = (faults[by] == a["_e"]) & (F.col("_bucket") == F.col("_b")) & (F.col("_at") >= F.col("start")) & (F.col("_at") < F.col("end"))
    first = faults.join(a, hit, "left").groupBy(by, "id", "start").agg(F.min("_at").alias("_first"))
    return first.select(by, "id", ((F.unix_timestamp("_first") - F.unix_timestamp("start")) / 60).alias("delay_min"))


def mape(df: DataFrame, actual: str, forecast: str, operating: Column, least: float = 1e-9, by: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """by, n, n_dropped, mape_pct over operating hours; actuals of about 0 are dropped and counted."""
    counts = operating & F.col(actual).isNotNull() & F.col(forecast).isNotNull()
    big = F.abs(F.col(actual)) > least
    error = F.try_divide(F.abs(F.col(actual) - F.col(forecast)), F.abs(F.col(actual)))
    return df.where(counts).groupBy(*by).agg(
        F.sum(big.cast("long")).alias("n"), F.sum((~big).cast("long")).alias("n_dropped"), (F.avg(F.when(big, error)) * 100).alias("mape_pct")
    )
