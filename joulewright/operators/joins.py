"""Joins by time, each with an equality key, so that none is a nested loop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: str, ts: str = "ts", value: str = "right_ts") -> DataFrame:
    """left with the latest right.ts of the same key at or before its own; null where there is none.

    One exchange and one sort of the union by the key, and a running last value: linear in
    both sides, where a join with a range would pair all earlier rows.
    """
    marks = right.select(by, ts).withColumn("_left", F.lit(0))
    rows = left.withColumn("_left", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(ts, "_left").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn(value, F.last(F.when(F.col("_left") == 0, F.col(ts)), ignorenulls=True).over(w))
    return found.where("_left = 1").drop("_left")


def validity(log: DataFrame, by: str, ts: str = "ts") -> DataFrame:
    """The log with until: the time of the key's next row, null for its last."""
    return log.withColumn("until", F.lead(ts).over(Window.partitionBy(by).orderBy(ts)))


def with_band(df: DataFrame, bands: DataFrame, minute: Column, day_type: str = "day_type") -> DataFrame:
    """df with the columns of the band that holds its minute of the day; bands are split at midnight.

    The day type is the equality key. Without a band the row stays, with nulls.
    """
    b = bands.withColumnRenamed(day_type, "_type")
    inside = (F.col(day_type) == F.col("_type")) & (F.col("_minute") >= F.col("from_min")) & (F.col("_minute") < F.col("to_min"))
    return df.withColumn("_minute", minute).join(b, inside, "left").drop("_minute", "_type", "from_min", "to_min")


#: Seconds of a time bucket, the second equality key of joins of intervals.
BUCKET = 6 * 3600


def bucket(ts: Column) -> Column:
    return F.floor(F.unix_timestamp(ts) / BUCKET)


def buckets(start: Column, end: Column, last: Column) -> Column:
    """The buckets of an interval, as far as `last`, after which nothing is looked for."""
    return F.sequence(bucket(start), bucket(F.greatest(start, F.least(end, F.coalesce(last, start)))))


def overlaps(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """by, a_id, b_id of intervals (start, end, end exclusive; null end: open) that overlap.

    An interval is copied to each time bucket it reaches, up to the latest start of all;
    a pair is found in the bucket of its later start only, so once.
    """
    far = F.lit("9999-01-01").cast("timestamp")
    x = a.select(by, F.col("id").alias("a_id"), F.col("start").alias("s1"), F.coalesce("end", far).alias("e1"))
    y = b.select(by, F.col("id").alias("b_id"), F.col("start").alias("s2"), F.coalesce("end", far).alias("e2"))
    last = F.broadcast(x.select("s1").union(y.select("s2")).agg(F.max("s1").alias("_last")))
    x = x.join(last).withColumn("_bucket", F.explode(buckets(F.col("s1"), F.col("e1"), F.col("_last")))).drop("_last")
    y = y.join(last).withColumn("_bucket", F.explode(buckets(F.col("s2"), F.col("e2"), F.col("_last")))).drop("_last")
    later = bucket(F.greatest("s1", "s2")) == F.col("_bucket")
    return x.join(y, [by, "_bucket"]).where("s1 < e2 AND s2 < e1").where(later).select(by, "a_id", "b_id")


def roll_up(df: DataFrame, topology: DataFrame, entity: str, hops: int) -> DataFrame:
    """df with level_1 ... level_n: the parents of its entity, hop by hop."""
    at = entity
    for k in range(1, hops + 1):
        edge = topology.select(F.col("child").alias(f"_c{k}"), F.col("parent").alias(f"level_{k}"))
        df = df.join(edge, df[at] == edge[f"_c{k}"], "left").drop(f"_c{k}")
        at = f"level_{k}"
    return df


def unite(feeds: dict[str, DataFrame], key: tuple[str, ...] = ("entity_id", "key", "ts"), value: str = "value") -> DataFrame:
    """key, value, source: all feeds as one; where several have a sample, the first feed's that is not null.

    One pass and one shuffle with partial aggregation, however many feeds there are.
    """
    tagged = [d.select(*key, F.struct(F.col(value).isNull().alias("lacks"), F.lit(i).alias("rank"), (-F.col(value)).alias("low"), F.lit(n).alias("source")).alias("_x")) for i, (n, d) in enumerate(feeds.items())]
    return reduce(DataFrame.unionByName, tagged).groupBy(*key).agg(F.min("_x").alias("_x")).select(*key, (-F.col("_x.low")).alias(value), "_x.source")


def prefer(first: DataFrame, second: DataFrame, on: list[str], value: str = "value") -> DataFrame:
    """The rows of both, by key; where both have one, the first source's value unless it is null."""
    b = second.select(*on, F.col(value).alias("_second"), F.lit(1).alias("_b"))
    both = first.select(*on, F.col(value).alias("_first")).join(b, on, "full")
    origin = F.when(F.col("_first").isNotNull(), "first").when(F.col("_second").isNotNull(), "second")
    return both.select(*on, F.coalesce("_first", "_second").alias(value), origin.alias("origin"))
