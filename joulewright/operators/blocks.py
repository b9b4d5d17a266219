"""Scans of very long raw series in blocks of time, so that no task holds a whole series.

A window partitioned by entity sorts all of an entity's samples in one task. Here a window is
partitioned by entity and block of time, and what it has to know of the blocks before comes
from one row a block: their sums, extremes and last values, scanned in turn (which is short).
So each running value costs an aggregation and a join on (entity, block) more, and a series
of any length is as many tasks as it has blocks. The results are those of the plain windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of running values: of the rows of a block, and of what the blocks before say and the block itself.
SUM, MIN, MAX, LAST = "sum", "min", "max", "last"
DAY = 86400


def in_blocks(df: DataFrame, order: str, seconds: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.unix_timestamp(F.col(order).cast("timestamp")) / seconds))


def carried(df: DataFrame, by: tuple[str, ...], values: dict[str, Column], fold) -> DataFrame:
    """by, _block, and each of values (aggregates of a block) folded over the blocks before it: one row a block."""
    blocks = df.groupBy(*by, "_block").agg(*[c.alias(n) for n, c in values.items()])
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    told = blocks.select(*[F.col(c).alias(f"_k_{c}") for c in (*by, "_block")], *[fold(n, before).alias(f"_c_{n}") for n in values])
    on = [df[c].eqNullSafe(told[f"_k_{c}"]) for c in (*by, "_block")]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return df.join(told, condition).drop(*[f"_k_{c}" for c in (*by, "_block")])


def running(df: DataFrame, by: tuple[str, ...], order: str, values: dict[str, tuple[str, Column]], seconds: int = DAY) -> DataFrame:
    """df with the running value of each of values (name: (kind, column)) up to a row and its peers; nulls are passed over."""
    d = in_blocks(df, order, seconds).withColumns({f"_v_{n}": c for n, (_, c) in values.items()})
    w = Window.partitionBy(*by, "_block").orderBy(order)
    own = {SUM: F.sum, MIN: F.min, MAX: F.max, LAST: lambda c: F.last(c, ignorenulls=True)}
    inside = d.withColumns({f"_w_{n}": own[kind](f"_v_{n}").over(w) for n, (kind, _) in values.items()})

    def total(n: str, kind: str) -> Column:
        v = F.col(f"_v_{n}")
        return F.max(F.when(v.isNotNull(), F.struct(F.col(order).alias("at"), v.alias("v"))))["v"] if kind == LAST else own[kind](v)

    def fold(n: str, before) -> Column:
        return own[values[n][0]](n).over(before)

    both = carried(inside, by, {n: total(n, kind) for n, (kind, _) in values.items()}, fold)
    merge = {
        SUM: lambda a, b: F.when(a.isNotNull() & b.isNotNull(), a + b).otherwise(F.coalesce(a, b)),
        MIN: F.least,
        MAX: F.greatest,
        LAST: F.coalesce,
    }
    out = both.withColumns({n: merge[kind](F.col(f"_w_{n}"), F.col(f"_c_{n}")) for n, (kind, _) in values.items()})
    return out.drop("_block", *[f"_{k}_{n}" for k in "vwc" for n in values])


def previous(df: DataFrame, by: tuple[str, ...], order: str, columns: list[str], name: str, seconds: int = DAY) -> DataFrame:
    """df with the columns of the row before (a struct; null at the first row), from the block before where it is there."""
    d = in_blocks(df, order, seconds).withColumn("_s", F.struct(*columns))
    w = Window.partitionBy(*by, "_block").orderBy(order)
    both = carried(d.withColumn("_own", F.lag("_s").over(w)), by, {"last": F.max(F.struct(F.col(order).alias("at"), F.col("_s").alias("s")))}, lambda n, before: F.last(n).over(before))
    return both.withColumn(name, F.coalesce("_own", F.col("_c_last")["s"])).drop("_block", "_s", "_own", "_c_last")


def asof_in_blocks(df: DataFrame, marks: DataFrame, by: str, ts: str, name: str, seconds: int = DAY) -> DataFrame:
    """df with the time (name) of the last of marks (by, ts) at or before each row, as asof() gives it."""
    m = marks.select(F.col(by), F.col(ts), F.col(ts).alias("_mark")).distinct()
    rows = df.withColumn("_row", F.lit(True)).unionByName(m, allowMissingColumns=True)
    told = running(rows, (by,), ts, {name: (LAST, F.col("_mark"))}, seconds)
    return told.where("_row").drop("_row", "_mark")


def state_runs_in_blocks(df: DataFrame, by: tuple[str, ...], order: str, value: str, seconds: int = DAY) -> DataFrame:
    """by, value, start, last, n: maximal runs of one value (null is a value of its own), as state_runs() gives them."""
    told = previous(df, by, order, [value], "_before", seconds)
    begins = F.coalesce(~F.col("_before").eqNullSafe(F.struct(value)), F.lit(True))
    runs = running(told.withColumn("_begins", begins.cast("int")), by, order, {"island": (SUM, F.col("_begins"))}, seconds)
    return runs.groupBy(*by, "island").agg(F.first(value).alias(value), F.min(order).alias("start"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("island")


def cusum_in_blocks(df: DataFrame, by: tuple[str, ...], order: str, residual: Column, slack: Column | float, name: str = "cusum", seconds: int = DAY) -> DataFrame:
    """max(0, S + residual - slack) along each series, as cusum() gives it."""
    summed = running(df, by, order, {"_sum": (SUM, F.coalesce(residual - slack, F.lit(0.0)))}, seconds)
    least = running(summed, by, order, {"_least": (MIN, F.col("_sum"))}, seconds)
    return least.withColumn(name, F.col("_sum") - F.least(F.lit(0.0), "_least")).drop("_sum", "_least")
