"""Pieces that several operators share."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import tune
from ledgerloom.sources.shared import stage, with_local_folder

#: Fixed value: what separates words, as a class for Java and Python patterns alike.
BLANKS = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, or the named columns of it."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return table.select(*columns) if columns else table


def ready(spark: SparkSession) -> SparkSession:
    """The session with the settings of this package and, where none is named, a folder for stages."""
    return with_local_folder(tune(spark))


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Run a query in a session with the settings of this package."""

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(ready(spark), sf_dir)

    return run


def words_of(text: Column) -> Column:
    """The words of a text as an array, in order. No text, no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def count_rows_up_to(df: DataFrame, limit: int) -> int:
    """The number of rows, counted no further than one past the limit."""
    return df.limit(limit + 1).count()


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def global_rank(df: DataFrame, order: Column, name: str = "rank") -> DataFrame:
    """The rows with their place from 0 in a total order, without a single task that sees them all.

    Rows are dealt out by ranges of the order; their places within a range and the sizes of the ranges before add up.
    """
    ranges = stage(
        df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    # One row for each range.
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_range").orderBy(order)
    return (
        ranges.withColumn("_at", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), F.col("_range") == F.col("_r"))
        .withColumn(name, (F.col("_before") + F.col("_at")).cast("bigint"))
        .drop("_range", "_r", "_before", "_at")
    )
