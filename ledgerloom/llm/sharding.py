"""Shards by jump consistent hashing, numbered without gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the multiplier of the 64-bit linear congruential generator behind jump consistent hashing.
MULTIPLIER = 2862933555777941757
#: Parts into which each shard is cut for numbering: no task sorts a whole shard.
PARTS = 1024

_LOW = 0xFFFFFFFF


def _next_key(high: Column, low: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2**64, on 32-bit halves: no product exceeds 63 bits, so nothing overflows."""
    a_high, a_low = MULTIPLIER >> 32, MULTIPLIER & _LOW
    a_top, a_bottom = a_low >> 16, a_low & 0xFFFF
    middle = low * F.lit(a_top)
    first = low * F.lit(a_bottom) + F.shiftleft(middle.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    new_low = first.bitwiseAND(F.lit(_LOW))
    carried = F.shiftright(first, 32) + F.shiftright(middle, 16)
    cross = high * F.lit(a_bottom) + F.shiftleft((high * F.lit(a_top)).bitwiseAND(F.lit(0xFFFF)), 16)
    new_high = (
        carried + (low * F.lit(a_high)).bitwiseAND(F.lit(_LOW)) + cross.bitwiseAND(F.lit(_LOW))
    ).bitwiseAND(F.lit(_LOW))
    return new_high, new_low


def jump(key: Column, shards: int) -> Column:
    """A struct: `shard`, the shard of a 64-bit key among 0 to shards - 1, and `next`, where the key would jump next.

    Consistent: with one more shard, a key either keeps its shard or takes the new one, and it takes the new one
    exactly if `next` equals `shards`. A null key counts as 0.
    """
    bits = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))
    start = F.struct(
        F.shiftright(bits, 32).bitwiseAND(F.lit(_LOW)).alias("high"),
        bits.bitwiseAND(F.lit(_LOW)).alias("low"),
        F.lit(-1).cast("bigint").alias("shard"),
        F.lit(0).cast("bigint").alias("next"),
    )

    def step(state: Column, _: Column) -> Column:
        high, low = _next_key(state["high"], state["low"])
        # 2**31 over the upper 31 bits of the new key plus one, times the shard number it leaves plus one.
        leap = (F.lit(2147483648.0) / (F.shiftright(high, 1) + F.lit(1)).cast("double")) * (
            state["next"] + F.lit(1)
        ).cast("double")
        moved = F.struct(
            high.alias("high"), low.alias("low"), state["next"].alias("shard"),
            F.floor(leap).cast("bigint").alias("next"),
        )
        return F.when(state["next"] < F.lit(shards), moved).otherwise(state)

    # Each jump goes up by one shard at least.
    rounds = F.sequence(F.lit(1), F.lit(shards))
    return F.aggregate(rounds, start, step, lambda state: F.struct(state["shard"], state["next"]))


def shard(
    df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", overhead: int = 16
) -> DataFrame:
    """One row for each input row: id, stored size, checksum, shard, place in the shard, shard after growth by one.

    The shard depends on the key and the number of shards alone. A shard's slots run from 0 without gaps, in the
    order of (part, key, checksum, size), the part being a hash of those three; rows that agree in them are
    interchangeable. Rows are numbered within parts, and parts get their offsets from a count of at most
    shards * 1024 rows, so neither a task nor the driver sees a whole shard. A null key shards as 0, a null text has
    no bytes; repeated rows are sharded alike and each gets a slot of its own; an empty input gives no rows. Other
    columns of the input are not read, whatever their names.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = (
        df.select(F.col(key).alias("doc_id"), body.alias("_body"))
        .select(
            "doc_id",
            (F.octet_length("_body") + F.lit(overhead)).cast("bigint").alias("size"),
            F.crc32(F.col("_body").cast("binary")).alias("text_crc32"),
        )
        .withColumn("_jump", jump(F.col("doc_id"), shards))
        .select(
            "*",
            F.col("_jump.shard").cast("int").alias("shard"),
            F.when(F.col("_jump.next") == shards, F.lit(shards))
            .otherwise(F.col("_jump.shard")).cast("int").alias("grown_shard"),
            (F.crc32(F.concat_ws(":", "doc_id", "text_crc32", "size").cast("binary")) % PARTS).alias("_part"),
        )
        .drop("_jump")
    )
    parts = rows.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        F.col("shard").alias("_shard"), F.col("_part").alias("_p"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    within = Window.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("_at", F.row_number().over(within) - 1)
        # At most shards * PARTS rows of three numbers.
        .join(F.broadcast(offsets), (F.col("shard") == F.col("_shard")) & (F.col("_part") == F.col("_p")))
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("_before") + F.col("_at")).cast("bigint").alias("slot"), "grown_shard",
        )
    )
