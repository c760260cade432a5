"""Joining facts with a table that has one row per key, whatever the sizes and skew.

A small lookup table (checked by counting up to a limit) is broadcast. Beyond the limit the join shuffles on
the key, and keys that hold more rows than one task should take are spread over several salts, with the
lookup row copied to each salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A lookup table up to this many rows is broadcast.
BROADCAST_ROWS = 200_000
# A key with more rows than this is split. There are at most (all rows / HOT_ROWS) such keys.
HOT_ROWS = 1_000_000


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether the table has at most `rows` rows; stops counting just above."""
    return df.limit(rows + 1).count() <= rows


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than `hot_rows` rows and how many pieces each should be split into.

    Counts are combined map-side, and the result is bounded by (all rows / hot_rows).
    """
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("_rows"))
        .where(F.col("_rows") > hot_rows)
        .select(*keys, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_pieces"))
    )


def lookup(
    facts: DataFrame,
    table: DataFrame,
    fact_key: str,
    table_key: str,
    how: str = "left",
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join each fact with its row of `table`, which is unique on `table_key`.

    `how` is inner, left, left_semi or left_anti. The key column of `table` is dropped.
    """
    renamed = table.withColumnRenamed(table_key, "_key")
    if fits(renamed, broadcast_rows):
        joined = facts.join(F.broadcast(renamed), F.col(fact_key) == F.col("_key"), how)
        return joined.drop("_key")

    hot = hot_keys(facts.select(fact_key), [fact_key], hot_rows).withColumnRenamed(fact_key, "_hot")
    # Equal rows from different input partitions get different salts, so copies spread as well.
    piece = F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in facts.columns]), F.col("_pieces"))
    salted = (
        facts.join(F.broadcast(hot), F.col(fact_key) == F.col("_hot"), "left")
        .withColumn("_salt", F.coalesce(piece, F.lit(0)).cast("int"))
        .drop("_hot", "_pieces")
    )
    copied = (
        renamed.join(F.broadcast(hot), F.col("_key") == F.col("_hot"), "left")
        .withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)) - 1)))
        .drop("_hot", "_pieces")
    )
    joined = salted.join(
        copied, (F.col(fact_key) == F.col("_key")) & (F.col("_salt") == F.col("_piece")), how
    )
    return joined.drop("_key", "_salt", "_piece")
