"""From documents to packed training sequences, in five stages.

Every stage but the last returns rows of documents with all their columns. A stage that
decides by row numbers its input once, in a table written to the shared folder, so that
rows with equal or missing ids are still told apart. The tables that a stage's result reads
are deleted when the same thread begins the next stage, so a result is to be written before
that; pipelines that run side by side have a thread each and do not see each other's tables.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joulewright.llm import decontamination, exact_dedup, near_dedup, packing, toxicity
from joulewright.llm.common import collected, drop_tables, materialize, read, release, text_of


#: Tables of the stage before in this thread, which its result may still read until it is written.
LEFT: ContextVar[tuple[str, ...]] = ContextVar("left", default=())


def stage(step: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = drop_tables(spark, list(LEFT.get()), but=docs)
        release(spark)
        with collected() as tables:
            out = step(spark, docs, sf_dir)
        LEFT.set((*left, *drop_tables(spark, tables, but=out)))
        return out

    return run_step


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number, written once, and the name of its column."""
    row = "row_number"
    while row in docs.columns:
        row += "_"
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def only(rows: DataFrame, row: str, kept: DataFrame) -> DataFrame:
    """The rows whose numbers kept has in its one column."""
    return rows.join(kept.toDF(row), row, "left_semi").select(*[c for c in rows.columns if c != row])


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or of sentence scores is under 0.7; null and empty texts stay.

    The model is fitted on the labels that are not held out; without one of either kind all stay.
    """
    model = toxicity.fit(text_of(docs), read(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without ASCII white space, the one with the most code points, then the smallest id (null last).

    Null and empty texts are one group; of rows alike in all, one stays.
    """
    rows, row = numbered(docs)
    return only(rows, row, exact_dedup.dedup(rows, row_col=row).where("kept").select("row"))


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of fingerprints within 4 bits, the row with the smallest id (null last).

    Null and empty texts have one fingerprint, so one of them stays.
    """
    rows, row = numbered(docs)
    groups = near_dedup.near_duplicates(rows, id_col=row).select(F.col("doc_id").alias("row"), "component_id")
    ids = rows.select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "row"))
    return only(rows, row, groups.join(ids, "row").groupBy("component_id").agg(first.alias("first")).select("first.row"))


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any word inside an occurrence of a benchmark window; null and empty texts stay."""
    rows, row = numbered(docs)
    found = decontamination.decontaminate(rows, read(spark, sf_dir, "benchmark"), id_col=row)
    return only(rows, row, found.where("NOT contaminated").select("doc_id"))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; null and empty texts are the end id alone."""
    path = public_tokenizers.path
    return packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A trained model and a tokenizer are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents of sf_dir that all stages keep."""
    docs, written = read(spark, sf_dir, "documents"), []
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            with collected() as results:
                docs = materialize(docs, name)
            drop_tables(spark, written)
            written = results
    return docs
