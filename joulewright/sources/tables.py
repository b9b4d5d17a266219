"""Sources and sinks: telemetry, attributes, outside tables, wide meter files, result documents."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joulewright.sources.registry import may_write

SCHEMAS = {
    "telemetry": "entity_id string, source string, key string, ts timestamp, value double, ingest_ts timestamp",
    "device": "entity_id string, device_type string, device_model string, device_label string, vendor_device_id string, serial_number string, firmware_version string, valid_from timestamp, valid_to timestamp",
    "weather": "site string, ts timestamp, temperature double, humidity double",
    "access_counter": "site string, ts timestamp, record_count double, record_capacity double",
    "calendar": "site string, date date, day_type string, op_start_min int, op_end_min int",
    "maintenance": "entity_id string, ts timestamp, kind string",
    "tariff": "day_type string, from_min int, to_min int, band string, vnd_per_kwh double",
    "topology": "child string, parent string, relation string",
    "rating": "entity_id string, rated_cooling_kw double, rated_pump_kw double, pump_curve array<struct<flow:double,head:double>>, tank_m3 double, tank_contact_polarity string",
    "area": "area_id string, floor_m2 double, design_people int",
    "fault_label": "entity_id string, type string, start timestamp, end timestamp",
}


def read_table(spark: SparkSession, name: str, path: str, form: str = "parquet", **options) -> DataFrame:
    """A table of the data model with its declared types, from parquet, csv, json or orc."""
    if form == "csv":
        options = {"header": "true"} | options
    return spark.read.schema(SCHEMAS[name]).options(**options).format(form).load(path)


def read_stream(spark: SparkSession, path: str, form: str = "parquet", name: str = "telemetry") -> DataFrame:
    """The same as a stream of files; a message queue differs only in format and options."""
    return spark.readStream.schema(SCHEMAS[name]).format(form).load(path)


def read_wide_meters(spark: SparkSession, path: str, time_col: str = "timestamp", key: str = "energy_active_kwh", source: str = "meters") -> DataFrame:
    """Hourly meter files with a column per meter, as telemetry; empty cells are missing, not 0."""
    wide = spark.read.options(header="true").csv(path)
    meters = [c for c in wide.columns if c != time_col]
    quoted = [F.col(f"`{c}`") for c in meters]
    typed = wide.select(F.to_timestamp(time_col).alias("ts"), *[c.cast("double").alias(n) for c, n in zip(quoted, meters)])
    long = typed.unpivot("ts", quoted, "entity_id", "value").where("value IS NOT NULL")
    return long.select("entity_id", F.lit(source).alias("source"), F.lit(key).alias("key"), "ts", "value", F.col("ts").alias("ingest_ts"))


def split_midnight(tariff: DataFrame) -> DataFrame:
    """Bands over midnight as two bands, so that a band is one range of minutes."""
    wraps = F.col("from_min") >= F.col("to_min")
    parts = F.when(
        wraps,
        F.array(F.struct(F.col("from_min").alias("a"), F.lit(1440).alias("b")), F.struct(F.lit(0).alias("a"), F.col("to_min").alias("b"))),
    ).otherwise(F.array(F.struct(F.col("from_min").alias("a"), F.col("to_min").alias("b"))))
    cut = tariff.withColumn("part", F.explode(parts)).withColumn("from_min", F.col("part.a")).withColumn("to_min", F.col("part.b")).drop("part")
    return cut.where("from_min < to_min")


def inventory(telemetry: DataFrame, last_days: int = 30) -> DataFrame:
    """key, n_days with samples, samples_per_day, missing_days among the last days of the table."""
    day = F.to_date("ts")
    daily = telemetry.groupBy("key", day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    last = telemetry.agg(F.max(day).alias("last_day"))
    recent = daily.join(F.broadcast(last)).withColumn("recent", F.col("day") > F.date_sub("last_day", last_days))
    return recent.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.avg("n").alias("samples_per_day"),
        (F.lit(last_days) - F.sum(F.col("recent").cast("long"))).alias("missing_days"),
    )


def as_document(c: Column | str) -> Column:
    """A result document as JSON, with its nulls (an open event has "end": null)."""
    return F.to_json(c, {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"})


def write_documents(df: DataFrame, path: str, by: tuple[str, ...] = ("module", "date"), form: str = "parquet", mode: str = "append") -> None:
    """Append result documents, partitioned so that a report reads only its days."""
    if "key" in df.columns and df.where(F.col("key").rlike("(_cmd|_sp)$")).take(1):
        raise ValueError("commands and set points are never written")
    writer = df.write.mode(mode).partitionBy(*[c for c in by if c in df.columns])
    (writer.option("ignoreNullFields", "false") if form == "json" else writer).format(form).save(path)


def write_run(df: DataFrame, path: str, run: str, by: tuple[str, ...] = ("module", "date")) -> None:
    """Result documents of one run (a batch number, or an issue date), all of them or none, once however often it is repeated.

    A run has a folder of its own, which a repeated run replaces; readers (read_runs) take
    runs that have been committed, which is the last thing done. So a run that is killed
    halfway leaves nothing that is read, and its repetition leaves one copy.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run):
        raise ValueError(f"{run!r} is no name of a folder")
    spark = df.sparkSession
    paths = spark._jvm.org.apache.hadoop.fs.Path
    mark, fs = paths(f"{path}/_commits/{run}"), paths(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(mark, False)
    write_documents(df, f"{path}/run={run}", by, mode="overwrite")
    fs.create(mark, True).close()


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The documents of all committed runs, with the columns of schema (those that partition them too) and run."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    log = paths(f"{path}/_commits")
    fs = log.getFileSystem(spark._jsc.hadoopConfiguration())
    runs = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
    folders = [f"{path}/run={r}" for r in runs]
    if not folders:
        return spark.createDataFrame([], schema).withColumn("run", F.lit(None).cast("string"))
    return spark.read.schema(f"{schema}, run string").option("basePath", path).parquet(*folders)


def write_report(sections: dict[str, DataFrame], path: str, period_start: str, form: str = "parquet") -> None:
    """One table per section under path, in a partition of the period; a period that is written again replaces itself."""
    for name, df in sections.items():
        df.write.mode("overwrite").format(form).save(f"{path}/{name}/period={period_start}")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    A session without that setting gets a temporary folder, and only in local mode, where
    driver and executors are one process.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"file://{tempfile.mkdtemp(prefix='joulewright-')}"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


#: The lists that saved() enters its tables in, of this thread (or context); see saving().
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("saving", default=())


@contextmanager
def saving() -> Iterator[list[str]]:
    """The paths of the tables that this thread saves meanwhile, to be deleted with discard() once their results are written."""
    paths: list[str] = []
    before = _OPEN.set((*_OPEN.get(), paths))
    try:
        yield paths
    finally:
        _OPEN.reset(before)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete saved tables; what still reads them cannot be computed any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back: what follows neither plans nor computes it again.

    A lost executor costs a reread. The table stays until it is deleted, see saving().
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _OPEN.get():
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def guard_write(key: str) -> None:
    """Raise for any attempt to write a command or a set point back to a device."""
    if not may_write(key):
        raise PermissionError(f"{key} is read-only")
