"""The driver's tables in the roles of the data model: events as telemetry, parts as device models, and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joulewright.functions.expressions import day_type, tod_slot
from joulewright.operators.normalize import slot

HOLIDAY = "2024-01-01"
OP_START, OP_END = 8, 18


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """events as telemetry: an event type is a device, its values the samples."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_type").alias("entity_id"), F.lit("platform").alias("source"), F.lit("power_active_kw").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_id", "user_id", "props"
    )


def with_calendar(df: DataFrame, ts: str = "slot", step: int = 60) -> DataFrame:
    t = F.col(ts)
    kind = day_type(F.to_date(t), F.to_date(t) == F.to_date(F.lit(HOLIDAY)))
    hours = (F.hour(t) >= OP_START) & (F.hour(t) < OP_END)
    return df.withColumn("day_type", kind).withColumn("tod_slot", tod_slot(t, step)).withColumn("is_op", (F.col("day_type") == "workday") & hours)


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """entity_id, slot, value (mean), n_samples, day_type, tod_slot, is_op of the hours that have samples."""
    s = samples(spark, d)
    return with_calendar(s.groupBy("entity_id", slot("ts", 60).alias("slot")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_samples")))


def text(c: str):
    """A time as text, the same in any engine."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


#: Halves are rounded differently by different engines; this moves exact halves off the edge before rounding.
OFF_EDGE = 0.00003173


def r4(c, name: str | None = None):
    return F.round((F.col(c) if isinstance(c, str) else c) + OFF_EDGE, 4).alias(name or c)


def sql4(sql: str) -> str:
    """The SQL with the same rounding as r4."""
    return sql.replace(", 4)", f" + {OFF_EDGE:.8f}, 4)")


def daily_lines(spark: SparkSession, d: str) -> DataFrame:
    """lineitem by return flag and day: entity_id, day (date), qty, price, value (price per quantity)."""
    li = table(spark, d, "lineitem")
    g = li.groupBy(F.col("l_returnflag").alias("entity_id"), F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price"))
    return g.withColumn("value", F.try_divide("price", "qty"))


# The same in SQL, for the oracles.
SQL_DAY_TYPE = "CASE WHEN CAST({0} AS DATE) = DATE '2024-01-01' THEN 'holiday' WHEN dayofweek({0}) = 6 THEN 'saturday' WHEN dayofweek({0}) = 0 THEN 'off' ELSE 'workday' END"
SQL_HOURLY = (
    "g0 AS (SELECT event_type AS entity_id, date_trunc('hour', ts) AS slot, avg(value) AS value, count(*) AS n_samples FROM events GROUP BY 1, 2), "
    "g AS (SELECT *, " + SQL_DAY_TYPE.format("slot") + " AS day_type, CAST(hour(slot) AS INT) AS tod_slot FROM g0)"
)
SQL_LINES = (
    "l AS (SELECT l_returnflag AS entity_id, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS qty, sum(l_extendedprice) AS price, "
    "sum(l_extendedprice) / sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
)
