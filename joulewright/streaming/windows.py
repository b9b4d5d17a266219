"""Streams of telemetry: cells, sliding counts, sessions, duplicates, and what is joined to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(stream: DataFrame, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """The stream with a watermark; a time without zone is read in the session's zone."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Each sample once, as long as the watermark has not passed it; later copies are left to the batch run."""
    return stream.dropDuplicatesWithinWatermark(keys)


def cells(stream: DataFrame, step: str = "15 minutes") -> DataFrame:
    """entity_id, key, slot, value, n_samples of tumbling cells."""
    agg = stream.groupBy("entity_id", "key", F.window("ts", step).alias("w")).agg(F.avg("value").alias("value"), F.count("value").alias("n_samples"))
    return agg.select("entity_id", "key", F.col("w.start").alias("slot"), "value", "n_samples")


def switch_counts(edges: DataFrame, slide: str = "5 minutes") -> DataFrame:
    """entity_id, start, switches in sliding hours, of a stream of state changes."""
    return edges.groupBy("entity_id", F.window("ts", "1 hour", slide).alias("w")).agg(F.count(F.lit(1)).alias("switches")).select("entity_id", F.col("w.start").alias("start"), "switches")


def sessions(stream: DataFrame, gap: str) -> DataFrame:
    """entity_id, start, end, n: stretches of samples without a longer gap."""
    agg = stream.groupBy("entity_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return agg.select("entity_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def with_dimensions(stream: DataFrame, device: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """The stream with the static columns of its device and day; the tables are read again in each micro-batch."""
    out = stream.join(device, "entity_id", "left")
    return out.withColumn("date", F.to_date("ts")).join(calendar, "date", "left") if calendar is not None else out


def upsert_events(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps one row per event, the newest, so that an open event is closed in place.

    The table is partitioned by the day of an event's start and by batch: a batch writes the
    days that it touches anew, under its number, and deletes what these days had before the
    batch before; other days stay as they are. A batch that runs again gives the same table.
    Readers take latest_events().
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # of one event, an end beats no end, then the later end
        fresh = batch.select("entity_id", "rule", "start", "end", F.to_date("start").cast("string").alias("day"))
        days = [r.day for r in fresh.select("day").distinct().collect()]
        held = latest_events(spark, path, before=number, days=days)
        both = fresh if held is None else fresh.unionByName(held.withColumn("day", F.to_date("start").cast("string")))
        newest = both.groupBy("entity_id", "rule", "start", "day").agg(F.max("end").alias("end")).withColumn("batch", F.lit(number))
        newest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        for day, batches in batches_of(spark, path).items():
            if day in days:
                for old in sorted(n for n in batches if n < number)[:-1]:
                    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day={day}/batch={old}"), True)

    return merge


def batches_of(spark, path: str) -> dict[str, list[int]]:
    """The batches that the table holds of each day."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return {}
    inside = lambda p, what: [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith(what)]
    return {p.getName().split("=", 1)[1]: [int(b.getName().split("=")[1]) for b in inside(p, "batch=")] for p in inside(hadoop, "day=")}


def latest_events(spark, path: str, before: int | None = None, days: list[str] | None = None) -> DataFrame | None:
    """The events after the last batch (or the last one before a batch), of all days or of some; None if there are none."""
    held = {d: [n for n in b if before is None or n < before] for d, b in batches_of(spark, path).items() if days is None or d in days}
    parts = [f"{path}/day={d}/batch={max(b)}" for d, b in held.items() if b]
    return spark.read.schema("entity_id string, rule string, start timestamp, end timestamp").parquet(*parts) if parts else None
