"""What the corpus operators share: reading, writing intermediate tables, SQL pieces."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word and equality rules: space, and tab to carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    A session without that setting gets a temporary folder, and only in local mode,
    where driver and executors are one process.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"file://{tempfile.mkdtemp(prefix='joulewright-')}"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


#: The lists that materialize() enters its tables in, of this thread (or context) only; see collected().
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of the tables that this thread materializes meanwhile, for drop_tables()."""
    paths: list[str] = []
    before = _OPEN.set((*_OPEN.get(), paths))
    try:
        yield paths
    finally:
        _OPEN.reset(before)


def drop_tables(spark: SparkSession, paths: list[str], but: DataFrame | None = None) -> list[str]:
    """Delete materialized tables that `but` does not read; returns those that it does."""
    read_ = {f for f in but.inputFiles()} if but is not None else set()
    kept = []
    for path in paths:
        if any(f"/{path.rsplit('/', 1)[1]}/" in f for f in read_):
            kept.append(path)
        else:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return kept


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    This cuts the lineage (a lost executor costs a reread, not a recomputation) and keeps
    a result that several later steps use from being computed again for each of them.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for paths in _OPEN.get():
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_parts(parts: Iterator[DataFrame], label: str) -> DataFrame | None:
    """Several frames of one schema, written one after the other to one table; None of none.

    Reading it back is one scan, however many parts there were.
    """
    path = schema = spark = None
    for number, part in enumerate(parts):
        if path is None:
            spark, schema = part.sparkSession, part.schema
            path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
            for paths in _OPEN.get():
                paths.append(path)
        part.write.option("compression", "zstd").parquet(f"{path}/{number}")
    return path and spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose intermediate tables are deleted when it returns, but for those that its result reads.

    Those stay until someone drops them: inside collected(), they are in its list.
    """

    @wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        with collected() as tables:
            out = operator(*args, **kwargs)
        drop_tables(out.sparkSession, tables, but=out)
        return out

    return run


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps, whose plans nothing holds now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as long) and the text (null: empty), so that no other column can clash."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


#: A key with more than one in HOT_SHARE of all rows is hot, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000


def hot_keys(facts: DataFrame, on: list[str], size: Column, total: int) -> DataFrame:
    """The keys that hold more than one in HOT_SHARE of `total` rows; size: how many of them a key has."""
    return facts.where(size > total // HOT_SHARE).select(*on).distinct()


def join_facts(rows: DataFrame, facts: DataFrame, on: list[str], hot: DataFrame) -> DataFrame:
    """rows joined with facts about their keys, where one key may have any share of the rows.

    hot: from hot_keys(), so fewer than HOT_SHARE. The facts of these are broadcast, and their
    rows stay where they are; only the others are shuffled by key.
    """
    few = F.broadcast(facts.join(F.broadcast(hot), on, "left_semi"))
    return rows.join(F.broadcast(hot), on, "left_anti").join(facts, on).unionByName(rows.join(few, on))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def rows_in_blocks(df: DataFrame, key: str, rows: int, text: str, chars: int) -> Iterator[list]:
    """The rows of a table that may be large, in order of key, as lists that a driver can hold.

    A list has at most `rows` rows and, unless it is one row, `chars` characters of text.
    """
    block, size = [], 0
    for row in df.orderBy(key).toLocalIterator(prefetchPartitions=True):
        n = len(row[text] or "")
        if block and (len(block) == rows or size + n > chars):
            yield block
            block, size = [], 0
        block.append(row)
        size += n
    if block:
        yield block
