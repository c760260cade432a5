"""Totals and breakdowns of transactions. All are one pass with map-side combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.lookup import lookup
from ledgerloom.schema import MONEY_TOTAL


def _sum(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast(MONEY_TOTAL)


def outgoings() -> Column:
    return _sum(F.when(F.col("amount") <= 0, F.col("amount")))


def incomings() -> Column:
    return _sum(F.when(F.col("amount") > 0, F.col("amount")))


def spent() -> Column:
    return _sum(F.when(F.col("amount") < 0, -F.col("amount")))


def month_of(when: str = "date") -> Column:
    """First instant of the month, without a zone."""
    return F.date_trunc("month", F.col(when)).cast("timestamp_ntz")


def account_summary(transactions: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """Per account: outgoings, incomings, net (their sum), turnover (incomings minus outgoings), rows.

    With `accounts`, exactly those are listed; one without transactions has zeros.
    """
    sums = transactions.groupBy("account_name").agg(
        outgoings().alias("outgoings"), incomings().alias("incomings"), F.count("*").alias("n_tx")
    )
    if accounts is not None:
        names = accounts.select(F.col("name").alias("account_name"))
        sums = names.join(sums, "account_name", "left").withColumns(
            {column: F.coalesce(column, F.lit(0).cast(sums.schema[column].dataType)) for column in sums.columns[1:]}
        )
    return sums.select(
        "account_name",
        "outgoings",
        "incomings",
        (F.col("incomings") + F.col("outgoings")).cast(MONEY_TOTAL).alias("net"),
        (F.col("incomings") - F.col("outgoings")).cast(MONEY_TOTAL).alias("turnover"),
        "n_tx",
    )


def table_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))


def elements_of(df: DataFrame, field: str) -> DataFrame:
    """All values of a field, repeats included."""
    return df.select(field)


def monthly_spend(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy(month_of().alias("month")).agg(
        spent().alias("spent"), F.count("*").alias("n_tx")
    )


def category_breakdown(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("category").agg(
        outgoings().alias("outgoings"), incomings().alias("incomings"), F.count("*").alias("n_tx")
    )


def monthly_category_spend(transactions: DataFrame, categories: list[str]) -> DataFrame:
    """Month by category; the categories are given, so no extra pass looks for them."""
    monthly = transactions.withColumn("month", month_of()).groupBy("month").pivot("category", categories)
    return monthly.agg(spent()).fillna(0)


def bank_breakdown(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Per bank. Accounts are summed before they are joined, so a busy account joins one row."""
    per_account = transactions.groupBy("account_name").agg(
        outgoings().alias("outgoings"), incomings().alias("incomings"), F.count("*").alias("n_tx")
    )
    named = lookup(per_account, accounts.select("name", "bank"), "account_name", "name", "left")
    return named.groupBy("bank").agg(
        _sum(F.col("outgoings")).alias("outgoings"),
        _sum(F.col("incomings")).alias("incomings"),
        F.sum("n_tx").alias("n_tx"),
    )


def dashboard(
    transactions: DataFrame, accounts: DataFrame, categories: list[str] | None = None
) -> DataFrame:
    """Totals by month, by month and category, by bank, and over all, in one result.

    `level` is the grouping id over (month, category, bank): 3, 1, 6 and 7. The grouping sets expand rows
    that are already summed per month, category and account.
    """
    chosen = transactions if categories is None else transactions.where(F.col("category").isin(categories))
    base = (
        chosen.groupBy(month_of().alias("month"), "category", "account_name")
        .agg(F.sum("amount").alias("amount"), spent().alias("spent"), F.count("*").alias("n_tx"))
    )
    named = lookup(base, accounts.select("name", "bank"), "account_name", "name", "left")
    cells = named.groupBy("month", "category", "bank").agg(
        F.sum("amount").alias("amount"), F.sum("spent").alias("spent"), F.sum("n_tx").alias("n_tx")
    )
    month, category, bank = F.col("month"), F.col("category"), F.col("bank")
    return cells.groupingSets([[month], [month, category], [bank], []], month, category, bank).agg(
        F.grouping_id().cast("int").alias("level"),
        _sum(F.col("amount")).alias("net"),
        _sum(F.col("spent")).alias("spent"),
        F.sum("n_tx").alias("n_tx"),
    )


def import_history(transactions: DataFrame, statements: DataFrame) -> DataFrame:
    """Per imported statement: rows, first and last date, sum. Statements without rows are kept."""
    sums = (
        transactions.where(F.col("imported_from").isNotNull())
        .groupBy("imported_from")
        .agg(
            F.count("*").alias("n_tx"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
            _sum(F.col("amount")).alias("amount"),
        )
    )
    return statements.join(sums, statements.id == sums.imported_from, "left").select(
        F.col("id").alias("imported_from"),
        "source_file",
        F.coalesce("n_tx", F.lit(0)).alias("n_tx"),
        "first_date",
        "last_date",
        F.coalesce("amount", F.lit(0)).cast(MONEY_TOTAL).alias("amount"),
    )
