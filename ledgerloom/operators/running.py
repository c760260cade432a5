"""Running totals that do not need one task per key.

Keys of ordinary size run in one window each: one shuffle, nothing else. A key with more rows than a task
should sort is cut by day; a day that is still too large by second, and a second by instant and blocks of row
numbers. Each piece runs its own window, opened with the total of the pieces before it. Those totals come
from pre-aggregated tables, and the join with them shares its shuffle with the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.lookup import HOT_ROWS, hot_keys
from ledgerloom.sources.shared import stage

# Rows without a time sort first, and pieces that are not cut further carry this as their time.
_NEVER = "0001-01-01 00:00:00"


def running_total(
    df: DataFrame,
    keys: list[str],
    when: str,
    row: str,
    value: str,
    out: str,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Add `out`: the sum of the decimal `value` up to each row, per key, in order of (`when`, `row`).

    `row` is a whole number, unique per key and instant, and the keys are not null. A null value gives a null
    total at its own row and counts as nothing afterwards. Counts the rows per key when called, unless
    `hot_rows` is None because the keys are known to be small.
    """
    sum_type = f"decimal(36,{df.schema[value].dataType.scale})"
    zero = F.lit(0).cast(sum_type)
    never = F.lit(_NEVER).cast("timestamp_ntz")
    instant = F.coalesce(F.col(when).cast("timestamp_ntz"), never)
    whole_blocks = F.floor(F.col(row) / (hot_rows or 1))
    cuts = {
        "_day": (F.to_date(instant), never.cast("date")),
        "_second": (F.date_trunc("second", instant).cast("timestamp_ntz"), never),
        "_moment": (_moment(instant, whole_blocks), _moment(never, F.lit(0).cast("bigint"))),
    }

    pieces, made = df, []
    for name, (cut, uncut) in cuts.items() if hot_rows else ():
        # At most (all rows / hot_rows) groups are too large, so they are safe to broadcast.
        hot = hot_keys(pieces.select(*keys, *made), [*keys, *made], hot_rows).drop("_pieces")
        if hot.isEmpty():
            break
        pieces = (
            pieces.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), [*keys, *made], "left")
            .withColumn(name, F.when(F.col("_hot"), cut).otherwise(uncut))
            .withColumn("_cut", F.coalesce(F.col("_hot") if not made else F.col("_cut"), F.lit(False)))
            .drop("_hot")
        )
        made.append(name)

    group = [*keys, *made]
    upto = Window.partitionBy(*group).orderBy(instant, row).rowsBetween(Window.unboundedPreceding, 0)
    total = F.coalesce(F.sum(value).over(upto).cast(sum_type), zero)
    if not made:
        return df.withColumn(out, F.when(F.col(value).isNotNull(), total))

    totals = pieces.where("_cut").groupBy(*group).agg(F.sum(value).cast(sum_type).alias("_total"))
    openings = _openings(stage(totals, "running-totals"), keys, made, sum_type)
    opened = pieces.join(openings, group, "left")
    return opened.withColumn(
        out, F.when(F.col(value).isNotNull(), total + F.coalesce(F.col("_opening"), zero))
    ).drop(*made, "_cut", "_opening")


def _moment(instant: Column, block: Column) -> Column:
    return F.struct(instant.alias("instant"), block.alias("block"))


def _openings(totals: DataFrame, keys: list[str], cuts: list[str], sum_type: str) -> DataFrame:
    """For each piece, the total of all pieces of its key that come before it.

    One window per level, over the children of one parent: days of a key, seconds of a day, instants and
    blocks of a second.
    """
    opened = totals
    for depth, cut in enumerate(cuts):
        parent = [*keys, *cuts[:depth]]
        earlier = Window.partitionBy(*parent).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
        before = (
            totals.groupBy(*parent, cut)
            .agg(F.sum("_total").cast(sum_type).alias("_total"))
            .select(*parent, cut, F.sum("_total").over(earlier).cast(sum_type).alias(f"_before_{depth}"))
        )
        opened = opened.join(before, [*parent, cut])
    befores = [F.coalesce(F.col(f"_before_{depth}"), F.lit(0)) for depth in range(len(cuts))]
    return opened.select(*keys, *cuts, sum(befores, F.lit(0)).cast(sum_type).alias("_opening"))
