"""The filter language: a setting for a column becomes one Catalyst predicate.

    (lo, hi)        between, both ends included
    [a, b]          membership
    10, 2.5, "x"    equality (see the dialects)
    "^x"            contains, any case
    "!x"            does not contain, any case
    ">=10", "!=3"   comparison with a Python literal
    "10(2)"         from 8 to 12
    lambda c: ...   any predicate on the column
    Text("10(2)")   the text itself, without the shorthand above
    Matches("^a+")  regular expression
    PerValue(f)     opaque Python test of one value, run on Arrow batches

Dialects: "frame" compares text exactly, floats within a tolerance, and keeps nulls in exclusions. "ledger"
follows SQL: text equality in any case, exact numbers, `%`/`_` live in contains, and nulls never qualify.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.dates import as_timestamp

FRAME = "frame"
LEDGER = "ledger"

# Shorthand signs and the tolerances of approximate equality.
CONTAINS_SIGN = "^"
EXCLUDES_SIGN = "!"
COMPARISONS = {">=": "gte", "<=": "lte", "==": "same", "!=": "differs", ">": "gt", "<": "lt"}
ABSOLUTE_TOLERANCE = 1e-8
RELATIVE_TOLERANCE = 1e-5


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Matches:
    pattern: str


@dataclass(frozen=True)
class PerValue:
    test: Callable[[Any], bool]


@dataclass(frozen=True)
class Test:
    """One comparison of a column with a value."""

    op: str
    value: Any


def read_setting(setting: Any, dialect: str = FRAME) -> Test:
    """What a filter setting asks for."""
    if isinstance(setting, Test):
        return setting
    if isinstance(setting, Text):
        return Test("eq", setting.value)
    if isinstance(setting, Matches):
        return Test("regex", setting.pattern)
    if isinstance(setting, PerValue):
        return Test("per_value", setting.test)
    if isinstance(setting, str):
        return read_shorthand(setting) or _read_text(setting)
    if isinstance(setting, tuple) and len(setting) == 2:
        return Test("between", setting)
    if isinstance(setting, list):
        return Test("in", setting)
    if isinstance(setting, (float, Decimal)):
        return Test("approx_eq" if dialect == FRAME else "eq", setting)
    if isinstance(setting, int):
        return Test("eq", setting)
    if callable(setting):
        return Test("call", setting)
    raise ValueError(f"No filter is written as {setting!r}")


def read_shorthand(text: str) -> Test | None:
    """Comparison and tolerance shorthand; None when the text is neither."""
    bare = text.strip()
    ends = _tolerance(bare)
    if ends is not None:
        return Test("between", ends)
    for sign, op in COMPARISONS.items():
        operand = bare.removeprefix(sign).strip()
        if bare.startswith(sign) and operand:
            try:
                return Test(op, ast.literal_eval(operand))
            except (ValueError, SyntaxError) as error:
                raise ValueError(f"Not a literal value in {text!r}: {operand}") from error
    return None


def _tolerance(bare: str) -> tuple[Decimal, Decimal] | None:
    """The ends of `middle(reach)`, both plain decimal numbers and the reach without a sign."""
    middle, bracket, rest = bare.partition("(")
    if not bracket or not rest.endswith(")"):
        return None
    reach = rest[:-1]
    unsigned = middle[1:] if middle[:1] in ("+", "-") else middle
    for digits, may_lack_units in ((unsigned, False), (reach, True)):
        units, point, decimals = digits.partition(".")
        if not (units + decimals).isdecimal() or (point and not decimals) or not (units or may_lack_units):
            return None
    return Decimal(middle) - Decimal(reach), Decimal(middle) + Decimal(reach)


def _read_text(text: str) -> Test:
    if text.startswith(CONTAINS_SIGN):
        return Test("contains", text[1:])
    if text.startswith(EXCLUDES_SIGN):
        return Test("not_contains", text[1:])
    return Test("eq", text)


def predicate(
    column: Column, dtype: T.DataType, test: Test, dialect: str = FRAME, folded: Column | None = None
) -> Column:
    """The predicate of `test` on a column of type `dtype`.

    `folded` is the upper-cased column, when the caller has computed it already.
    """
    build = _BUILDERS.get(test.op)
    if build is None:
        raise ValueError(f"Unknown comparison {test.op!r}")
    return build(_Operand(column, dtype, dialect, folded), test.value)


def comparable(dtype: T.DataType, value: Any) -> bool:
    """Whether the value can be compared with a column of the type without changing its type."""
    if isinstance(dtype, T.StringType):
        return isinstance(value, str)
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return isinstance(value, (str, date, datetime))
    if isinstance(dtype, T.BooleanType):
        return isinstance(value, bool) or value in (0, 1)
    return isinstance(dtype, T.NumericType) and isinstance(value, (int, float, Decimal))


def approximate_reach(dtype: T.DataType, value: Any) -> float:
    """How far from the value a number may lie and still be approximately equal."""
    if not isinstance(dtype, T.NumericType):
        raise ValueError(f"Approximate equality needs a number column, not {dtype.simpleString()}")
    return ABSOLUTE_TOLERANCE + RELATIVE_TOLERANCE * abs(float(value))


@dataclass(frozen=True)
class _Operand:
    column: Column
    dtype: T.DataType
    dialect: str
    folded: Column | None

    @property
    def is_text(self) -> bool:
        return isinstance(self.dtype, T.StringType)

    @property
    def is_time(self) -> bool:
        return isinstance(self.dtype, (T.TimestampNTZType, T.TimestampType, T.DateType))

    @property
    def is_flag(self) -> bool:
        return isinstance(self.dtype, T.BooleanType)

    @property
    def text(self) -> Column:
        return self.column if self.is_text else self.column.cast("string")

    def accepts(self, value: Any) -> bool:
        return comparable(self.dtype, value)

    def literal(self, value: Any) -> Column:
        if not self.accepts(value):
            raise ValueError(f"Cannot compare a {self.dtype.simpleString()} column with {value!r}")
        if self.is_time:
            return F.lit(as_timestamp(value).isoformat(sep=" ")).cast(self.dtype)
        if self.is_flag:
            return F.lit(bool(value))
        if isinstance(value, bool):
            return F.lit(int(value))
        if isinstance(self.dtype, T.FractionalType) and not isinstance(self.dtype, T.DecimalType):
            return F.lit(float(value))
        if isinstance(value, float) and isinstance(self.dtype, T.DecimalType):
            return F.lit(Decimal(str(value)))
        return F.lit(value)


def _equals(operand: _Operand, value: Any) -> Column:
    if operand.dialect == LEDGER and isinstance(value, str) and not operand.is_time:
        return F.lower(operand.text) == F.lit(value.lower())
    if operand.dialect == LEDGER and operand.is_text:
        return operand.column == F.lit(str(value))
    return _same(operand, value)


def _same(operand: _Operand, value: Any) -> Column:
    if not operand.accepts(value):
        return F.lit(False)
    return operand.column == operand.literal(value)


def _differs(operand: _Operand, value: Any) -> Column:
    if operand.dialect == LEDGER:
        return operand.column != operand.literal(value)
    if not operand.accepts(value):
        return F.lit(True)
    return ~operand.column.eqNullSafe(operand.literal(value))


def _approx(operand: _Operand, value: Any) -> Column:
    anchor, reach = float(value), approximate_reach(operand.dtype, value)
    # The wider range is only there for the scan: unlike abs(), Parquet can skip row groups by it.
    return operand.column.between(F.lit(anchor - 2 * reach), F.lit(anchor + 2 * reach)) & (
        F.abs(operand.column.cast("double") - F.lit(anchor)) <= F.lit(reach)
    )


def _contains(operand: _Operand, value: str) -> Column:
    if operand.dialect == LEDGER:
        return operand.text.ilike("%" + value.replace("\\", "\\\\") + "%")
    folded = F.upper(operand.text) if operand.folded is None else operand.folded
    return F.coalesce(folded.contains(value.upper()), F.lit(False))


def _excludes(operand: _Operand, value: str) -> Column:
    return ~_contains(operand, value)


def _is_in(operand: _Operand, values: list) -> Column:
    known = [value for value in values if value is not None]
    if operand.dialect == LEDGER and operand.is_text:
        known = [str(value) for value in known]
    comparable = [operand.literal(value) for value in known if operand.accepts(value)]
    hit = operand.column.isin(*comparable) if comparable else F.lit(False)
    if operand.dialect == FRAME and len(known) < len(values):
        return operand.column.isNull() | hit
    return hit


def _between(operand: _Operand, ends: tuple) -> Column:
    lowest, highest = ends
    return operand.column.between(operand.literal(lowest), operand.literal(highest))


def _call(operand: _Operand, test: Callable) -> Column:
    try:
        made = test(operand.column)
    except Exception as error:
        raise ValueError(
            f"{test!r} is not a predicate on a column. Wrap a test of single values in PerValue."
        ) from error
    if isinstance(made, bool):
        return F.lit(made)
    if not isinstance(made, Column):
        raise ValueError(f"{test!r} returned {type(made).__name__}, not a column")
    return made


def _per_value(operand: _Operand, test: Callable) -> Column:
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda value: False if pd.isna(value) else bool(test(value))).astype(bool)

    return F.coalesce(F.pandas_udf(run, T.BooleanType())(operand.column), F.lit(False))


_BUILDERS: dict[str, Callable[[_Operand, Any], Column]] = {
    "eq": _equals,
    "same": _same,
    "differs": _differs,
    "approx_eq": _approx,
    "in": _is_in,
    "between": _between,
    "contains": _contains,
    "not_contains": _excludes,
    "gt": lambda operand, value: operand.column > operand.literal(value),
    "gte": lambda operand, value: operand.column >= operand.literal(value),
    "lt": lambda operand, value: operand.column < operand.literal(value),
    "lte": lambda operand, value: operand.column <= operand.literal(value),
    "regex": lambda operand, value: F.coalesce(operand.text.rlike(value), F.lit(False)),
    "call": _call,
    "per_value": _per_value,
}
