"""Relations between accounts, statements and transactions: joins and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.dedupe import first_wins
from ledgerloom.operators.lookup import lookup


def from_account(transactions: DataFrame, account: str) -> DataFrame:
    return transactions.where(F.col("account_name") == account)


def from_accounts(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Transactions of all listed accounts (column `name`)."""
    return lookup(transactions, accounts.select("name").distinct(), "account_name", "name", "left_semi")


def from_bank(transactions: DataFrame, accounts: DataFrame, bank: str) -> DataFrame:
    """Transactions of the accounts held at a bank."""
    return lookup(transactions, accounts_with_bank(accounts, bank), "account_name", "name", "left_semi")


def accounts_with_bank(accounts: DataFrame, bank: str) -> DataFrame:
    """Names of the accounts held at a bank."""
    return accounts.where(F.lower("bank") == bank.lower()).select("name")


def account_transactions(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """Each account with its transactions (their name as `tx_name`); accounts without any appear once.

    Written as transactions looking up their account, so that a busy account is split like any hot key,
    plus the accounts that no transaction names.
    """
    owners = accounts.select("name", *[c for c in accounts.columns if c != "name" and c not in transactions.columns])
    renamed = transactions.withColumnRenamed("name", "tx_name")
    held = lookup(renamed, owners, "account_name", "name", "inner").withColumn("name", F.col("account_name"))
    used = transactions.select(F.col("account_name").alias("name")).distinct()
    unused = owners.join(used, "name", "left_anti")
    return held.unionByName(unused, allowMissingColumns=True)


def statement_lineage(transactions: DataFrame, statements: DataFrame) -> DataFrame:
    """Each transaction with the file it was imported from, if any."""
    files = statements.select(F.col("id").alias("statement_id"), "source_file", "import_timestamp")
    return lookup(transactions, files, "imported_from", "statement_id", "left")


def orphans(child: DataFrame, foreign_key: str, parent: DataFrame, key: str) -> DataFrame:
    """Foreign keys without a parent row, with the number of rows that hold them.

    Children are counted per key before the join, so a key costs one row whatever its weight.
    """
    counted = (
        child.where(F.col(foreign_key).isNotNull())
        .groupBy(F.col(foreign_key).cast("string").alias("missing_key"))
        .agg(F.count("*").alias("n_rows"))
    )
    keys = parent.select(F.col(key).cast("string").alias("missing_key"))
    return counted.join(keys, "missing_key", "left_anti").select(
        F.lit(foreign_key).alias("foreign_key"), "missing_key", "n_rows"
    )


def integrity_report(transactions: DataFrame, accounts: DataFrame, statements: DataFrame) -> DataFrame:
    """All broken references of the ledger; empty when it is sound."""
    return (
        orphans(transactions, "account_name", accounts, "name")
        .unionByName(orphans(transactions, "imported_from", statements, "id"))
        .unionByName(orphans(statements, "account", accounts, "name"))
    )


def delete_accounts(transactions: DataFrame, deleted: DataFrame) -> DataFrame:
    """Transactions that remain when the accounts in `deleted` (column `name`) go."""
    return lookup(transactions, deleted.select("name").distinct(), "account_name", "name", "left_anti")


def new_accounts(
    accounts: DataFrame, proposed: DataFrame, banks: list[str], order: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Split proposed accounts (`name`, `bank`, ...) into accepted ones and refusals with a `reason`.

    A name may be used once; of several proposals for it, the first in `order` counts.
    """
    known = F.coalesce(F.col("bank").isin(banks), F.lit(False))
    unknown_bank = proposed.where(~known).withColumn("reason", F.lit("unknown bank"))
    valid = proposed.where(known)
    first = first_wins(valid, ["name"], order)
    kept = first.select(F.col("name").alias("_kept"), F.struct(*order).alias("_place"))
    repeats = (
        lookup(valid, kept, "name", "_kept", "inner")
        .where(~F.struct(*order).eqNullSafe(F.col("_place")))
        .select(*proposed.columns)
    )
    taken = first.join(accounts.select("name"), "name", "left_semi").select(*proposed.columns)
    accepted = first.join(accounts.select("name"), "name", "left_anti").select(*proposed.columns)
    duplicate = repeats.unionByName(taken).withColumn("reason", F.lit("duplicate name"))
    return accepted, unknown_bank.unionByName(duplicate)
