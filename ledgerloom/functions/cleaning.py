"""Column cleaners: money, text and missing values."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.schema import MISSING_CATEGORY, MISSING_NAME, MONEY, NA_TOKENS, WIDE_MONEY


# Entities that are decoded without Python; the ampersand has to be the last.
_USUAL_ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "#39": "'", "#x27": "'", "amp": "&"}


def null_if_na(col: Column) -> Column:
    """Null for the cell texts that stand for "no value"."""
    return F.when(~col.isin(*NA_TOKENS), col)


def clean_money(col: Column) -> Column:
    """Exact number from money text; null where the text is not a number.

    Goes through decimal, not double: text such as `12d`, `nan` or `inf` is not money.
    """
    bare = F.translate(col.cast("string"), "£$,", "")
    return bare.try_cast(WIDE_MONEY)


def quantise(col: Column) -> Column:
    """Round an exact decimal half-even to pence; null when it does not fit."""
    return F.bround(col, 2).try_cast(MONEY)


def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def decode_html(col: Column) -> Column:
    """Decode HTML entities.

    The usual ones are replaced by built-in functions, the ampersand last, as what it leaves is not decoded again.
    Only texts with other entities reach the Python function; it gets nulls for the rest.
    """
    unescape = F.pandas_udf(_unescape, T.StringType())
    usual = col
    for entity, sign in _USUAL_ENTITIES.items():
        usual = F.replace(usual, F.lit(f"&{entity};"), F.lit(sign))
    others = col.rlike("&(?!(?:" + "|".join(_USUAL_ENTITIES) + ");)[#A-Za-z]")
    return F.when(others, unescape(F.when(others, col))).otherwise(usual)


def fold_name(col: Column) -> Column:
    """Lower case without spaces and commas, the form names are compared in."""
    return F.translate(F.lower(col), " ,", "")


def known_name(col: Column) -> Column:
    return F.coalesce(col, F.lit(MISSING_NAME))


def known_category(col: Column) -> Column:
    return F.coalesce(col, F.lit(MISSING_CATEGORY))
