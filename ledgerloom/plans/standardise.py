"""From raw statement rows to canonical transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.cleaning import (
    clean_money,
    decode_html,
    known_category,
    known_name,
    quantise,
)
from ledgerloom.functions.dates import parse_dates
from ledgerloom.operators.categories import map_category
from ledgerloom.operators.lookup import HOT_ROWS
from ledgerloom.operators.running import running_total
from ledgerloom.schema import CANONICAL_COLUMNS, DEFAULTS, IGNORE, TIMELIKE
from ledgerloom.sources.layouts import Layout, run_steps
from ledgerloom.sources.statements import RAW_LINE, RawStatements

REASON = "reason"
_TEXT = ("name", "category", "currency", "notes")


def to_canonical(raw: DataFrame, layout: Layout) -> DataFrame:
    """Canonical columns with exact money, plus `_src_file`, `_row`, `_raw_line` and `reason`.

    `reason` says why a row cannot be stored; it is null for good rows. Columns of `raw` that the layout does
    not know (other than those) are dropped.
    """
    shaped = run_steps(raw, layout.before)
    when = F.col(layout.raw("date")).cast("string")
    if TIMELIKE in layout.columns:
        when = F.concat(when, F.lit(" "), F.col(layout.raw(TIMELIKE)).cast("string"))
    named: dict[str, Column] = {
        column: F.col(layout.raw(column))
        for column in layout.columns
        if column not in (IGNORE, TIMELIKE)
    }
    named["date"] = parse_dates(when)
    missing = {column: F.lit(DEFAULTS[column]) for column in CANONICAL_COLUMNS if column not in named}
    located = shaped.select(
        *[column.alias(name) for name, column in (named | missing).items()], "_src_file", "_row", RAW_LINE
    )
    stepped = run_steps(located, layout.after)
    cleaned = stepped.select(
        "date",
        decode_html(F.col("name")).alias("name"),
        decode_html(map_category(F.col("category"), layout.category_map)).alias("category"),
        clean_money(F.col("amount")).alias("amount"),
        clean_money(F.col("balance")).alias("balance"),
        decode_html(F.col("currency")).alias("currency"),
        decode_html(F.col("notes")).alias("notes"),
        "_src_file",
        "_row",
        RAW_LINE,
    )
    return cleaned.withColumn(REASON, _reason())


def _reason() -> Column:
    return F.coalesce(
        F.when(F.col(RAW_LINE).isNotNull(), "columns"),
        F.when(F.col("date").isNull(), "date"),
        *[F.when(quantise(F.col(money)).isNull(), money) for money in ("amount", "balance")],
        F.when(F.col("currency").isNull(), "currency"),
    )


def running_balance(
    df: DataFrame, keys: list[str] | None = None, row: str = "_row", hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Replace `balance` by the sum of the amounts so far, per statement unless other keys are given."""
    totals = running_total(df, keys or ["_src_file"], "date", row, "amount", "_balance", hot_rows)
    return totals.withColumn("balance", F.col("_balance")).drop("_balance").select(*df.columns)


def with_balance(good: DataFrame, layout: Layout, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Accepted rows with the running balance, where the statement does not supply one."""
    return good if layout.has_balance else running_balance(good, hot_rows=hot_rows)


def to_ledger_values(df: DataFrame) -> DataFrame:
    """Money rounded to pence, and the stored texts for a missing name or category."""
    return df.withColumns(
        {
            "name": known_name(F.col("name")),
            "category": known_category(F.col("category")),
            "amount": quantise(F.col("amount")),
            "balance": quantise(F.col("balance")),
        }
    )


def standardise(raw: RawStatements, layout: Layout) -> DataFrame:
    """The canonical statement: accepted rows in the seven canonical columns, oldest first.

    Rows keep `_src_file` and `_row`; ties in time are in file order.
    """
    return standardise_rows(raw.rows, layout, raw.hot_rows)


def standardise_rows(raw: DataFrame, layout: Layout, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """`standardise` for rows that did not come from files: raw cells, `_src_file`, `_row`, `_raw_line`."""
    canonical = to_canonical(raw, layout)
    good = canonical.where(F.col(REASON).isNull()).drop(REASON, RAW_LINE)
    rounded = with_balance(good, layout, hot_rows).withColumns(
        {"amount": quantise(F.col("amount")), "balance": quantise(F.col("balance"))}
    )
    return rounded.orderBy("date", "_src_file", "_row")


def rejected(raw: RawStatements, layout: Layout) -> DataFrame:
    """Rows that cannot be stored, with the reason."""
    return to_canonical(raw.rows, layout).where(F.col(REASON).isNotNull())
