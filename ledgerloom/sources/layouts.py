"""Bank statement layouts: what each CSV column means, and the quirks of each bank.

A layout is a value. Add a bank with `register(Layout(...))`; attach quirks with `before`/`after` steps,
functions from DataFrame to DataFrame. Steps run in ascending `order`, then in the order they were given.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.cleaning import clean_money
from ledgerloom.functions.names import resolve_name
from ledgerloom.functions.predicates import Test, predicate
from ledgerloom.schema import CANONICAL_COLUMNS, IGNORE, TIMELIKE

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Layout:
    """Positional meaning of the columns of a statement.

    `columns` names a canonical column, TIMELIKE (a time to append to the date) or IGNORE per position.
    `title_rows` lines stand above the header line. `category_map` renames the bank's own categories.
    """

    name: str
    columns: tuple[str, ...]
    title_rows: int = 0
    before: tuple[tuple[int, Step], ...] = ()
    after: tuple[tuple[int, Step], ...] = ()
    category_map: Mapping[str, str] = field(default_factory=dict, hash=False)

    def __post_init__(self) -> None:
        unknown = set(self.columns) - {*CANONICAL_COLUMNS, IGNORE, TIMELIKE}
        if unknown:
            raise ValueError(f"{self.name}: unknown columns {sorted(unknown)}")
        if "date" not in self.columns:
            raise ValueError(f"{self.name}: a statement needs a date column")

    @property
    def raw_columns(self) -> tuple[str, ...]:
        return tuple(f"_c{position}" for position in range(len(self.columns)))

    @property
    def has_balance(self) -> bool:
        return "balance" in self.columns

    def raw(self, column: str) -> str:
        """Name of the raw column at the position of `column`."""
        return f"_c{self.columns.index(column)}"

    def with_before(self, step: Step, order: int = 0) -> Layout:
        """Add a step that sees the raw columns `_c0`, `_c1`, ..."""
        return replace(self, before=(*self.before, (order, step)))

    def with_after(self, step: Step, order: int = 0) -> Layout:
        """Add a step that sees the canonical columns, before money and text are cleaned."""
        return replace(self, after=(*self.after, (order, step)))


def run_steps(df: DataFrame, steps: tuple[tuple[int, Step], ...]) -> DataFrame:
    for _, step in sorted(steps, key=lambda entry: entry[0]):
        df = df.transform(step)
    return df


def _mentions(df: DataFrame, column: str, words: str):
    return predicate(df[column], df.schema[column].dataType, Test("contains", words))


def chase_round_ups(df: DataFrame) -> DataFrame:
    """Round-ups are told by name only; give them a category of their own."""
    return df.withColumn(
        "category", F.when(_mentions(df, "name", "round up"), "roundup").otherwise(F.col("category"))
    )


def chase_withdrawals(df: DataFrame) -> DataFrame:
    """Cash withdrawals carry the currency in the category; keep that text in the notes."""
    cash = _mentions(df, "category", "withdrawal")
    return df.withColumns(
        {
            "notes": F.when(cash, F.col("category")).otherwise(F.col("notes")),
            "category": F.when(cash, "cash_withdrawal").otherwise(F.col("category")),
        }
    )


# Fixed value: a card payment in a foreign currency, with the rate after the bar.
FOREIGN_PURCHASE = r"Purchase \| (.+)"


def chase_foreign_purchases(df: DataFrame) -> DataFrame:
    """Foreign purchases carry the rate in the category; move it to the notes."""
    foreign = F.coalesce(F.col("category").rlike(FOREIGN_PURCHASE), F.lit(False))
    return df.withColumns(
        {
            "notes": F.when(foreign, F.regexp_extract("category", FOREIGN_PURCHASE, 1)).otherwise(F.col("notes")),
            "category": F.when(foreign, "Purchase").otherwise(F.col("category")),
        }
    )


def lloyds_negate_amount(df: DataFrame) -> DataFrame:
    """Card statements show spending as positive."""
    amount = LLOYDS_CC.raw("amount")
    return df.withColumn(amount, -clean_money(F.col(amount)))


def monzo_flex(df: DataFrame) -> DataFrame:
    """Instalment payments come without a name."""
    return df.withColumn(
        "name", F.when(_mentions(df, "notes", "flex"), "Flex payment").otherwise(F.col("name"))
    )


def monzo_overdraft(df: DataFrame) -> DataFrame:
    """Overdraft fees come without a name and under a general category."""
    fee = _mentions(df, "notes", "overdraft")
    return df.withColumns(
        {
            "name": F.when(fee, "Overdraft fees").otherwise(F.col("name")),
            "category": F.when(fee, "fee").otherwise(F.col("category")),
        }
    )


def monzo_round_ups(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "category", F.when(_mentions(df, "name", "round ups"), "roundup").otherwise(F.col("category"))
    )


# The column order of each bank's export.
CHASE = Layout(
    "Chase",
    ("date", TIMELIKE, "category", "name", "amount", "currency", "balance"),
    title_rows=1,
    after=((0, chase_round_ups), (0, chase_withdrawals), (0, chase_foreign_purchases)),
)
LLOYDS_CC = Layout(
    "LloydsCC",
    ("date", IGNORE, "notes", "name", "amount"),
    before=((0, lloyds_negate_amount),),
)
MONZO = Layout(
    "Monzo",
    (
        IGNORE,
        "date",
        TIMELIKE,
        IGNORE,
        "name",
        IGNORE,
        "category",
        "amount",
        "currency",
        IGNORE,
        IGNORE,
        "notes",
        *[IGNORE] * 6,
    ),
    after=((0, monzo_flex), (0, monzo_overdraft), (0, monzo_round_ups)),
)

LAYOUTS: dict[str, Layout] = {layout.name: layout for layout in (CHASE, LLOYDS_CC, MONZO)}


def register(layout: Layout) -> Layout:
    LAYOUTS[layout.name] = layout
    return layout


def find_layout(bank: str) -> Layout:
    """The layout of a bank, by a possibly misspelt name."""
    return LAYOUTS[resolve_name(bank, LAYOUTS)]
