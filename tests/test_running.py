"""Running totals in pieces equal one window per key."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators.running import running_total


@pytest.fixture(scope="module")
def rows(spark):
    start = datetime(2025, 1, 1)
    made = []
    for n in range(1200):
        key = "hot" if n % 3 else f"k{n % 10}"
        when = start + timedelta(hours=n // 20)
        if n % 4 == 0:
            when = start + timedelta(days=3)
        if n % 7 == 0:
            when = start + timedelta(days=3, microseconds=n % 5)
        if n % 31 == 0:
            when = None
        amount = None if n % 11 == 0 else Decimal(n * 37 % 501 - 250) / 100
        made.append((key, when, n * 13 % 1201, amount))
    return spark.createDataFrame(made, "k string, date timestamp_ntz, place long, amount decimal(12,2)")


@pytest.mark.parametrize("hot_rows", [10_000_000, 500, 60, 7, 1])
def test_pieces_equal_one_window(rows, hot_rows):
    upto = Window.partitionBy("k").orderBy("date", "place").rowsBetween(Window.unboundedPreceding, 0)
    expected = {
        r.place: r.total
        for r in rows.withColumn(
            "total", F.when(F.col("amount").isNotNull(), F.sum("amount").over(upto))
        ).collect()
    }
    found = running_total(rows, ["k"], "date", "place", "amount", "total", hot_rows)
    assert found.columns == [*rows.columns, "total"]
    assert {r.place: r.total for r in found.collect()} == expected


def test_one_shuffle_for_ordinary_keys(rows):
    plan = running_total(rows, ["k"], "date", "place", "amount", "total")._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange") == 1
