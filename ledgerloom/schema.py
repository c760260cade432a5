"""Fixed schemas, defaults and value domains of the ledger."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
# Money while it is still being computed: exact text value, before rounding to pence.
WIDE_MONEY = T.DecimalType(24, 10)
MONEY_TOTAL = T.DecimalType(38, 2)

# Canonical statement columns, in their preferred order.
CANONICAL_COLUMNS = ("date", "name", "category", "amount", "balance", "currency", "notes")

# What a column holds when a bank layout does not supply it.
DEFAULTS = {
    "name": "None",
    "category": "None",
    "amount": "0",
    "balance": "0",
    "currency": "GBP",
    "notes": "",
}

# Stored in place of a missing name or category.
MISSING_NAME = "Unknown"
MISSING_CATEGORY = "UNCATEGORISED"

# Layout positions that are not canonical columns.
IGNORE = "ignore"
TIMELIKE = "timelike"

# Account types.
ACCOUNT_TYPES = ("current", "savings", "investment", "credit")

# Category taxonomy.
OUTGOING = (
    "rent",
    "bill",
    "subscription",
    "cash_withdrawal",
    "transfer_out_external",
    "investment",
    "fee",
    "loan_payment",
    "credit_card",
    "leisure",
    "uncategorised",
    "groceries",
)
INCOMING = ("salary", "interest", "refund", "transfer_in_external", "cash_deposit", "income")
INTERNAL = ("transfer", "savings", "roundup")

DIRECTIONS = {"outgoing": OUTGOING, "incoming": INCOMING, "internal": INTERNAL}

# Cell texts that a statement CSV uses for "no value".
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# A transaction is stored once per value of these columns.
UNIQUE_KEY = ("account_name", "date", "name", "balance")

CANONICAL = T.StructType(
    [
        T.StructField("date", T.TimestampNTZType()),
        T.StructField("name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("amount", MONEY),
        T.StructField("balance", MONEY),
        T.StructField("currency", T.StringType()),
        T.StructField("notes", T.StringType()),
    ]
)

ACCOUNTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("name", T.StringType()),
        T.StructField("bank", T.StringType()),
        T.StructField("account_type", T.StringType()),
        T.StructField("is_active", T.BooleanType()),
    ]
)

IMPORTED_STATEMENTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("account", T.StringType()),
        T.StructField("import_timestamp", T.TimestampType()),
        T.StructField("source_file", T.StringType()),
    ]
)

# `month` (first day of the month of `date`) is the storage partition.
TRANSACTIONS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        *CANONICAL.fields,
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("account_name", T.StringType()),
        T.StructField("imported_from", T.StringType()),
        T.StructField("month", T.DateType()),
    ]
)

# One typed slot per kind of value; exactly one is filled.
RULE_VALUE = T.StructType(
    [
        T.StructField("str", T.StringType()),
        T.StructField("num", T.DecimalType(38, 10)),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("strs", T.ArrayType(T.StringType())),
        T.StructField("nums", T.ArrayType(T.DecimalType(38, 10))),
        T.StructField("tss", T.ArrayType(T.TimestampNTZType())),
    ]
)
RULE_PART = T.StructType(
    [
        T.StructField("apply_to", T.StringType()),
        T.StructField("operation", T.StringType()),
        T.StructField("value", RULE_VALUE),
    ]
)
RULES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("name", T.StringType()),
        T.StructField("conditions", T.ArrayType(RULE_PART)),
        T.StructField("actions", T.ArrayType(RULE_PART)),
        T.StructField("priority", T.IntegerType()),
    ]
)
