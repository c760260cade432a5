"""Category vocabulary: bank categories to standard ones, and standard ones to a direction."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.lookup import lookup
from ledgerloom.schema import DIRECTIONS


def map_category(column: Column, mapping: Mapping[str, str]) -> Column:
    """The standard category of a bank's own category; unmapped ones stay as they are."""
    if not mapping:
        return column
    pairs = F.create_map(*[F.lit(text) for pair in mapping.items() for text in pair])
    return F.coalesce(F.try_element_at(pairs, column), column)


def map_categories(df: DataFrame, mapping: Mapping[str, str] | DataFrame, column: str = "category") -> DataFrame:
    """Rename categories by a dict, or by a table with columns `raw` and `standard`."""
    if isinstance(mapping, DataFrame):
        named = mapping.select("raw", F.col("standard").alias("_standard"))
        joined = lookup(df, named, column, "raw", "left")
        return joined.withColumn(column, F.coalesce("_standard", column)).drop("_standard")
    return df.withColumn(column, map_category(F.col(column), mapping))


def taxonomy(spark: SparkSession) -> DataFrame:
    """The standard categories with their direction."""
    rows = [(name, direction) for direction, names in DIRECTIONS.items() for name in names]
    return spark.createDataFrame(rows, "taxon string, direction string")


def with_direction(df: DataFrame, column: str = "category") -> DataFrame:
    """Add `direction` (outgoing, incoming, internal); null for categories outside the taxonomy."""
    known = F.broadcast(taxonomy(df.sparkSession))  # a fixed table of a few rows
    return df.join(known, F.lower(F.col(column)) == F.col("taxon"), "left").drop("taxon")
