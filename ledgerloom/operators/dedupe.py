"""Insert-or-ignore: the first row of a key wins, against the batch and against the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.schema import UNIQUE_KEY


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes first in `order`.

    An aggregate rather than a ranking window: copies collapse before the shuffle, so a key that holds a
    large share of the rows costs one row per input partition.
    """
    rest = [name for name in df.columns if name not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_first")).select(
        *[F.col(name) if name in keys else F.col(f"_first.`{name}`").alias(name) for name in df.columns]
    )


def not_stored(
    df: DataFrame, ledger: DataFrame, keys: list[str] = list(UNIQUE_KEY), small: bool = False
) -> DataFrame:
    """Rows whose key the ledger does not hold. Both sides are unique on the key, so neither is skewed.

    `small` says that `df` has been counted and may be broadcast: the ledger is then cut to the keys of the batch
    where it is read, and only those move.
    """
    held = ledger.select(*keys)
    if small:
        held = held.join(F.broadcast(df.select(*keys)), keys, "left_semi")
    return df.join(held, keys, "left_anti")


def merge(ledger: DataFrame, staged: DataFrame, order: list[str], keys: list[str] = list(UNIQUE_KEY)) -> DataFrame:
    """The ledger with the new rows of `staged` added; first wins."""
    new = not_stored(first_wins(staged, keys, order), ledger, keys)
    return ledger.unionByName(new.select(*ledger.columns))
