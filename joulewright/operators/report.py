"""Periodic reports: totals against baseline, top lists, odd days, accepted proposals, valid samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals(df: DataFrame, period: str, dims: list[str], value: str = "value", expected: str | None = None, ts: str = "slot") -> DataFrame:
    """period_start, dims (null: all of them), total and expected by day, week or month, with subtotals."""
    aggs = [F.sum(value).alias("total")] + ([F.sum(expected).alias("expected")] if expected else [])
    return df.withColumn("period_start", F.to_date(F.date_trunc(period, ts))).groupBy("period_start", *dims).agg(*aggs) if not dims else _rolled(df, period, dims, aggs, ts)


def _rolled(df: DataFrame, period: str, dims: list[str], aggs: list[Column], ts: str) -> DataFrame:
    dated = df.withColumn("period_start", F.to_date(F.date_trunc(period, ts)))
    sets = [["period_start", *dims[:k]] for k in range(len(dims), -1, -1)]
    return dated.groupingSets([[F.col(c) for c in s] for s in sets], *["period_start", *dims]).agg(*aggs)


def top(df: DataFrame, by: str, order: Column, k: int) -> DataFrame:
    """The k first rows in that order, ties by name: a top list, the one place where rows are capped."""
    return df.orderBy(order, by).limit(k)


def capped_days(days: DataFrame, score: str, per_month: int) -> DataFrame:
    """At most so many odd days a device and month, the oddest first."""
    w = Window.partitionBy("entity_id", F.date_trunc("month", F.col("date"))).orderBy(F.desc(score), "date")
    return days.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_month)


def acceptance(proposals: DataFrame) -> DataFrame:
    """module, n, n_accepted, saved_kwh, saved_vnd of proposals."""
    taken = F.col("status") == "accepted"
    return proposals.groupBy("module").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(taken).alias("n_accepted"),
        F.sum(F.when(taken, F.col("est_saving_kwh"))).alias("saved_kwh"),
        F.sum(F.when(taken, F.col("est_saving_vnd"))).alias("saved_vnd"),
    )
