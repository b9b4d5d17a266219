"""Patterns over ordered rows: islands, durations, control charts, reversals."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number_islands(df: DataFrame, by: tuple[str, ...], order: str, begins: Column, name: str = "island") -> DataFrame:
    """A number for each run of rows; a run begins where `begins` holds (or is null, as at the first row)."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("_begins", F.coalesce(begins, F.lit(True)).cast("int")).withColumn(name, F.sum("_begins").over(w)).drop("_begins")


def state_runs(df: DataFrame, by: tuple[str, ...], order: str, value: str) -> DataFrame:
    """by, value, start, last, n: maximal runs of one value (null is a value of its own)."""
    before = F.lag(F.struct(value)).over(Window.partitionBy(*by).orderBy(order))
    runs = number_islands(df, by, order, ~before.eqNullSafe(F.struct(value)))
    return runs.groupBy(*by, "island").agg(F.first(value).alias(value), F.min(order).alias("start"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("island")


def merge_cells(cells: DataFrame, by: tuple[str, ...], order: str, step_minutes: int, gap_minutes: int, least_minutes: int, score: str | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """by, start, end, n_cells, peak: flagged cells as events; cells up to the gap apart are one event.

    more: names and aggregates of further columns of an event.

    An event ends with its last cell (start of it plus the step) and is kept if it lasts long enough.
    """
    seconds = F.unix_timestamp(order)
    gap = seconds - F.lag(seconds).over(Window.partitionBy(*by).orderBy(order)) - step_minutes * 60
    runs = number_islands(cells, by, order, gap > gap_minutes * 60 - step_minutes * 60)
    peak = F.max(score) if score else F.lit(None).cast("double")
    events = runs.groupBy(*by, "island").agg(
        F.min(order).alias("start"), F.timestamp_seconds(F.max(seconds) + step_minutes * 60).alias("end"), F.count(F.lit(1)).alias("n_cells"), peak.alias("peak"), *[c.alias(n) for n, c in (more or {}).items()]
    )
    return events.where(F.unix_timestamp("end") - F.unix_timestamp("start") >= least_minutes * 60).drop("island")


def cusum(df: DataFrame, by: tuple[str, ...], order: str, residual: Column, slack: Column | float, name: str = "cusum") -> DataFrame:
    """max(0, S + residual - slack) along each series, in closed form: the running sum less its running minimum.

    A null residual adds nothing. The other side is the same of the negated residual.
    """
    w = Window.partitionBy(*by).orderBy(order)
    step = F.coalesce(residual - slack, F.lit(0.0))
    summed = df.withColumn("_sum", F.sum(step).over(w))
    return summed.withColumn(name, F.col("_sum") - F.least(F.lit(0.0), F.min("_sum").over(w))).drop("_sum")


def restarting_cusum(df: DataFrame, by: tuple[str, ...], order: str, residual: Column, slack: float, limit: float, name: str = "cusum", alarm: str = "alarm") -> DataFrame:
    """max(0, S + residual - slack) along each series, begun again from 0 after each row at which it exceeds the limit (alarm).

    Where a chart begins again depends on all alarms before, so the closed form of cusum()
    does not hold. The rows of a series pass through one task in order (Spark sorts them, and
    spills), which keeps one number of the series, not its rows; so a series of any length
    takes constant memory. A null residual adds nothing. The last row of a series is the
    state that online_cusum() goes on from, if it is no alarm (0 then).
    """
    told = df.withColumn("_step", F.coalesce(residual.cast("double") - slack, F.lit(0.0)))
    columns = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType()), T.StructField(alarm, T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, s = None, 0.0
        for b in batches:
            keys = list(zip(*[b.column(b.schema.names.index(c)).to_pylist() for c in by]))
            sums, alarms = [], []
            for key, step in zip(keys, b.column(b.schema.names.index("_step")).to_pylist()):
                if key != now:
                    now, s = key, 0.0
                s = max(0.0, s + step)
                sums.append(s)
                alarms.append(s > limit)
                if s > limit:
                    s = 0.0
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.names.index(c)) for c in columns], pa.array(sums, pa.float64()), pa.array(alarms, pa.bool_())], names=[*columns, name, alarm])

    return told.repartition(*by).sortWithinPartitions(*by, order).mapInArrow(run, schema)


def edges(df: DataFrame, by: tuple[str, ...], order: str, value: str, name: str = "edge") -> DataFrame:
    """1 where the value differs from the row before, else 0; the first row is no edge."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn(name, F.coalesce((before != F.col(value)).cast("int"), F.lit(0)))


def numbered(df: DataFrame, by: Column, block: Column, order: tuple[str | Column, ...], name: str = "number") -> DataFrame:
    """A number from 1 for each row of `by`, in order of block, then of `order`; block must rise with `order`.

    Rows are numbered within their block and moved by the count of the blocks before it, so
    no task sorts all rows of `by`, however many it has; the counts are one row a block.
    """
    keyed = df.withColumn("_by", by).withColumn("_block", block)
    counts = keyed.groupBy("_by", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_by").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    moves = counts.select(F.col("_by").alias("_b1"), F.col("_block").alias("_b2"), F.coalesce(before, F.lit(0)).alias("_before"))
    placed = keyed.join(moves, F.col("_by").eqNullSafe(F.col("_b1")) & F.col("_block").eqNullSafe(F.col("_b2")))
    own = F.row_number().over(Window.partitionBy("_by", "_block").orderBy(*order))
    return placed.withColumn(name, F.col("_before") + own).drop("_by", "_block", "_b1", "_b2", "_before")


def fill_time(states: DataFrame, by: tuple[str, ...], order: str, low: str, high: str) -> DataFrame:
    """by, filled_at, seconds: from the last low contact to the high contact that follows it."""
    w = Window.partitionBy(*by).orderBy(order)
    rise = lambda c: (F.col(c) == 1) & (F.coalesce(F.lag(c).over(w), F.lit(0.0)) != 1)
    marked = states.withColumn("_high", rise(high)).withColumn("_low_at", F.last(F.when(F.col(low) == 1, F.col(order)), ignorenulls=True).over(w))
    return marked.where("_high AND _low_at IS NOT NULL").select(*by, F.col(order).alias("filled_at"), (F.unix_timestamp(order) - F.unix_timestamp("_low_at")).alias("seconds"))
