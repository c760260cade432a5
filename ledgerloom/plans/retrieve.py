"""Reading transactions: filters, date ranges and what to show."""

from __future__ import annotations

from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import as_timestamp
from ledgerloom.functions.names import resolve_name
from ledgerloom.functions.predicates import LEDGER, read_setting
from ledgerloom.operators.filtering import filter_ledger
from ledgerloom.schema import CANONICAL_COLUMNS


def retrieve_transactions(
    transactions: DataFrame, /, show_metadata: bool = False, require_nonempty: bool = False, **filters: Any
) -> DataFrame:
    """Transactions that satisfy all filters: the canonical columns and the account, or every column."""
    found = filter_ledger(in_months(transactions, filters), require_nonempty, **filters)
    if show_metadata:
        return found.drop("month") if "month" in found.columns else found
    return found.select(*CANONICAL_COLUMNS, "account_name")


def transactions_in_date_range(
    transactions: DataFrame,
    from_date: str | date | datetime,
    to_date: str | date | datetime,
    show_metadata: bool = False,
) -> DataFrame:
    """Transactions between two moments, both included. Dates are day first."""
    ends = (as_timestamp(from_date), as_timestamp(to_date))
    return retrieve_transactions(transactions, show_metadata, date=ends)


def in_months(transactions: DataFrame, filters: dict[str, Any]) -> DataFrame:
    """Restrict the scan to the storage months that a filter on the date leaves: a range, a date or a list of dates."""
    if "month" not in transactions.columns:
        return transactions
    for name, setting in filters.items():
        if resolve_name(name, transactions.columns) == "date":
            for bound in _month_bounds(setting):
                transactions = transactions.where(bound)
    return transactions


def _month_bounds(setting: Any) -> list[Column]:
    test = read_setting(setting, LEDGER)
    low, high = None, None
    if test.op == "in":
        months = {as_timestamp(day).date().replace(day=1) for day in test.value if day is not None}
        return [F.col("month").isin(sorted(months))]
    if test.op in ("eq", "same"):
        low = high = test.value
    elif test.op == "between":
        low, high = test.value
    elif test.op in ("gt", "gte"):
        low = test.value
    elif test.op in ("lt", "lte"):
        high = test.value
    first_of_month = [(end and as_timestamp(end).date().replace(day=1)) for end in (low, high)]
    bounds = []
    if first_of_month[0]:
        bounds.append(F.col("month") >= F.lit(first_of_month[0]))
    if first_of_month[1]:
        bounds.append(F.col("month") <= F.lit(first_of_month[1]))
    return bounds
