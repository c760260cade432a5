"""Filtering DataFrames with the filter language."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.names import resolve_name
from ledgerloom.functions.predicates import FRAME, LEDGER, predicate, read_setting

class NoRows(ValueError):
    """A filter that had to find rows found none."""


def where_all(df: DataFrame, settings: Mapping[str, Any], dialect: str = FRAME) -> DataFrame:
    """Rows that satisfy every setting. Column names may be abbreviated or misspelt."""
    tests = []
    for name, setting in settings.items():
        column = resolve_name(name, df.columns)
        # Lists of any length become one predicate; Catalyst turns long ones into a hash set.
        tests.append(predicate(df[column], df.schema[column].dataType, read_setting(setting, dialect), dialect))
    return df.where(reduce(and_, tests)) if tests else df


def all_of(df: DataFrame, settings: Mapping[str, Any], dialect: str = FRAME) -> Column:
    """The settings as one predicate, to be used in a projection instead of a filter."""
    tests = []
    for name, setting in settings.items():
        column = resolve_name(name, df.columns)
        tests.append(predicate(F.col(column), df.schema[column].dataType, read_setting(setting, dialect), dialect))
    return reduce(and_, tests, F.lit(True))


def filter_frame(df: DataFrame, /, **settings: Any) -> DataFrame:
    """Filter any DataFrame; see `functions.predicates` for the settings."""
    return where_all(df, settings, FRAME)


def filter_ledger(df: DataFrame, /, require_nonempty: bool = False, **settings: Any) -> DataFrame:
    """Filter a ledger table with SQL comparison rules. Lazy unless rows are required."""
    kept = where_all(df, settings, LEDGER)
    if require_nonempty and kept.isEmpty():
        wanted = ", ".join(f"{name} = {setting}" for name, setting in settings.items())
        raise NoRows(f"No entries satisfy: {wanted}")
    return kept


def by_id(df: DataFrame, id: str) -> DataFrame:
    return df.where(F.col("id") == id)


def by_name(df: DataFrame, name: str, column: str = "name") -> DataFrame:
    return df.where(F.lower(F.col(column)) == name.lower())
