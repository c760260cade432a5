"""Filter language and retrieval."""

from __future__ import annotations

from datetime import date, timedelta
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.predicates import Matches, PerValue, Text
from ledgerloom.operators import relations, totals
from ledgerloom.operators.filtering import by_name, filter_frame, filter_ledger
from ledgerloom.plans.retrieve import retrieve_transactions, transactions_in_date_range
from registry.catalogue import catalogue
from registry.views import ACCOUNTS, TX_ORDERS, accounts, table, tx_orders, with_views

query, QUERIES, ORACLES = catalogue()


def _named_parts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.nullif(F.col("p_name"), F.lit("hot ring")).alias("p_name"))


_NAMED_PARTS = "named as (select p_partkey, nullif(p_name, 'hot ring') p_name from part)"


@query("select p_partkey, p_type from part where p_type = 'ECONOMY'")
def filter_equals_frame(spark, sf):
    return filter_frame(table(spark, sf, "part").select("p_partkey", "p_type"), p_type="ECONOMY")


@query("select p_partkey, p_type from part where lower(p_type) = lower('Economy')")
def filter_equals_ledger(spark, sf):
    return filter_ledger(table(spark, sf, "part").select("p_partkey", "p_type"), p_type="Economy")


@query("select event_id, value from events where abs(value - 12.31) <= 1e-8 + 1e-5 * abs(12.31)")
def filter_approx(spark, sf):
    return filter_frame(table(spark, sf, "events").select("event_id", "value"), value=12.31)


@query(with_views(_NAMED_PARTS, query="select * from named where contains(lower(p_name), 'red')"))
def filter_contains(spark, sf):
    return filter_frame(_named_parts(spark, sf), p_name="^RED")


@query(with_views(_NAMED_PARTS, query="select * from named where not coalesce(contains(lower(p_name), 'red'), false)"))
def filter_excludes_frame(spark, sf):
    return filter_frame(_named_parts(spark, sf), p_name="!red")


@query(with_views(_NAMED_PARTS, query="select * from named where p_name ilike '%R_D%e%'"))
def filter_ilike_ledger(spark, sf):
    return filter_ledger(_named_parts(spark, sf), p_name="^R_D%e")


@query(with_views(_NAMED_PARTS, query="select * from named where p_name not ilike '%red%'"))
def filter_excludes_ledger(spark, sf):
    return filter_ledger(_named_parts(spark, sf), p_name="!red")


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus in ('F', 'P')")
def filter_in(spark, sf):
    return filter_frame(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), o_orderstatus=["F", "P"])


@query(
    "select l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice from lineitem where l_shipdate between "
    "timestamp '1997-02-01' and timestamp '1998-03-31' and l_extendedprice between 1000 and 20000.5"
)
def filter_between(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"
    )
    return filter_frame(rows, l_shipdate=("01/02/1997", "31 March 1998"), l_extendedprice=(1000, 20000.5))


@query("select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem where l_quantity > 10 and l_quantity < 20")
def filter_predicate(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return filter_frame(rows, l_quantity=lambda column: (column > 10) & (column < 20))


@query(with_views(_NAMED_PARTS, query="select * from named where p_name like '%a%' and p_name not like '%e%'"))
def filter_per_value(spark, sf):
    return filter_frame(_named_parts(spark, sf), p_name=PerValue(lambda name: "a" in name and "e" not in name))


@query("select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem where l_quantity >= 10")
def filter_comparator(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return filter_frame(rows, l_quantity=">=10")


@query(with_views(_NAMED_PARTS, query="select * from named where p_name is distinct from 'red plate'"))
def filter_not_equal(spark, sf):
    return filter_frame(_named_parts(spark, sf), p_name="!='red plate'")


@query("select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem where l_quantity between 22 and 28")
def filter_tolerance(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return filter_frame(rows, l_quantity="25(3)")


@query(
    "select l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag, l_shipdate from lineitem "
    "where l_quantity < 24 and l_returnflag = 'A' and l_shipdate >= timestamp '1997-01-01'"
)
def filter_conjunction(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate"
    )
    return filter_frame(rows, l_quantity="<24", l_returnflag="A", l_shipdate=">='1 January 1997'")


@query("select p_partkey, p_name from part where regexp_matches(p_name, '^(red|blue) .*(ring|bolt)$')")
def filter_regex(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_name")
    return filter_frame(rows, p_name=Matches("^(red|blue) .*(ring|bolt)$"))


@query("select l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem where l_extendedprice > 50000")
def filter_fuzzy_column(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return filter_frame(rows, l_extendedprise=">50000")


_DIALECT_SETTINGS = {
    "text": ("p_type", "economy"),
    "contains": ("p_name", "^RED"),
    "excludes": ("p_name", "!red"),
    "number": ("p_retailprice", 900.1),
    "compare": ("p_size", ">=20"),
    "differs": ("p_name", "!='red plate'"),
}

_DIALECT_TESTS = {
    ("frame", "text"): "p_type = 'economy'",
    ("frame", "contains"): "contains(upper(p_name), 'RED')",
    ("frame", "excludes"): "not coalesce(contains(upper(p_name), 'RED'), false)",
    ("frame", "number"): "abs(p_retailprice - 900.1) <= 1e-8 + 1e-5 * 900.1",
    ("frame", "compare"): "p_size >= 20",
    ("frame", "differs"): "p_name is distinct from 'red plate'",
    ("ledger", "text"): "lower(p_type) = 'economy'",
    ("ledger", "contains"): "p_name ilike '%RED%'",
    ("ledger", "excludes"): "p_name not ilike '%red%'",
    ("ledger", "number"): "p_retailprice = 900.1::double",
    ("ledger", "compare"): "p_size >= 20",
    ("ledger", "differs"): "p_name <> 'red plate'",
}


@query(
    "with named as (select * replace (nullif(p_name, 'hot ring') as p_name) from part) "
    + " union all ".join(
        f"select '{dialect}' dialect, '{kind}' kind, count(*) n_rows from named where {test}"
        for (dialect, kind), test in _DIALECT_TESTS.items()
    )
)
def filter_dialects(spark, sf):
    named = table(spark, sf, "part").withColumn("p_name", F.nullif(F.col("p_name"), F.lit("hot ring")))
    counts = [
        keep(named, **dict([_DIALECT_SETTINGS[kind]]))
        .agg(F.count("*").alias("n_rows"))
        .select(F.lit(dialect).alias("dialect"), F.lit(kind).alias("kind"), "n_rows")
        for dialect, keep in (("frame", filter_frame), ("ledger", filter_ledger))
        for kind in _DIALECT_SETTINGS
    ]
    return reduce(DataFrame.unionByName, counts)


@query(
    "select 'shorthand' as reading, count(*) n_rows from part where p_size between 8 and 12 union all "
    "select 'text', count(*) from part where p_brand = '10(2)' union all "
    "select 'sign', count(*) from part where contains(lower(p_brand), '#1')"
)
def filter_sugar_text(spark, sf):
    parts = table(spark, sf, "part")
    readings = {
        "shorthand": filter_frame(parts, p_size="10(2)"),
        "text": filter_frame(parts, p_brand=Text("10(2)")),
        "sign": filter_frame(parts, p_brand="^#1"),
    }
    return reduce(
        DataFrame.unionByName,
        [
            rows.agg(F.count("*").alias("n_rows")).withColumn("reading", F.lit(name))
            for name, rows in readings.items()
        ],
    )


_CANONICAL = "date, name, category, amount, balance, currency, notes, account_name"


@query(
    with_views(
        TX_ORDERS,
        query=f"select {_CANONICAL} from tx_orders where name ilike '%high%' and amount < 0 and "
        "date between timestamp '1997-01-01' and timestamp '1998-12-31'",
    )
)
def retrieve_transactions_filtered(spark, sf):
    return retrieve_transactions(
        tx_orders(spark, sf), name="^high", amount="<0", date=("1 Jan 1997", "31/12/1998")
    )


@query(
    with_views(
        TX_ORDERS,
        query=f"select {_CANONICAL} from tx_orders where date between timestamp '1997-03-05' and timestamp '1997-09-01'",
    )
)
def date_range(spark, sf):
    return transactions_in_date_range(tx_orders(spark, sf), "05/03/1997", "1st September 1997")


@query(
    with_views(
        TX_ORDERS,
        query=f"select {_CANONICAL}, o_orderkey from tx_orders where lower(category) = 'f' and amount between -5000 and 0",
    )
)
def retrieve_metadata(spark, sf):
    return retrieve_transactions(tx_orders(spark, sf), show_metadata=True, category="f", amount=(-5000, 0))


@query(with_views(ACCOUNTS, query="select * from accounts where lower(name) = '77'"))
def lookup_account(spark, sf):
    return by_name(accounts(spark, sf), "77")


@query(with_views(TX_ORDERS, query=f"select {_CANONICAL}, o_orderkey from tx_orders where account_name = '77'"))
def from_account(spark, sf):
    return relations.from_account(tx_orders(spark, sf), "77")


@query(with_views(ACCOUNTS, query="select name from accounts where lower(bank) = 'building'"))
def accounts_with_bank(spark, sf):
    return relations.accounts_with_bank(accounts(spark, sf), "Building")


@query("select count(*) n_rows from lineitem")
def table_count(spark, sf):
    return totals.table_count(table(spark, sf, "lineitem"))


@query("select o_orderpriority from orders")
def field_elements(spark, sf):
    return totals.elements_of(table(spark, sf, "orders"), "o_orderpriority")


_DAYS = [date(1993, 1, 1) + timedelta(days=n) for n in range(1200)]


@query(
    with_views(
        TX_ORDERS,
        query="""select 'date' as kind, count(*) n_rows from tx_orders
            where date >= timestamp '1993-01-01' and date < timestamp '1993-01-01' + interval 1200 day
              and date = date_trunc('day', date)
        union all select 'amount', count(*) from tx_orders where abs(amount) between 10000 and 10014.99 and amount > 0
        union all select 'text', count(*) from tx_orders where cast(account_name as int) between 1 and 1500""",
    )
)
def filter_in_long(spark, sf):
    """Membership lists above a thousand values: day-first texts, exact numbers and texts."""
    orders = tx_orders(spark, sf)
    lists = {
        "date": [f"{day:%d/%m/%Y}" for day in _DAYS],
        "amount": [Decimal(cents) / 100 for cents in range(1_000_000, 1_001_500)],
        "text": [str(number) for number in range(1, 1501)],
    }
    columns = {"date": "date", "amount": "amount", "text": "account_name"}
    counts = [
        filter_ledger(orders, **{columns[kind]: values})
        .agg(F.count("*").alias("n_rows"))
        .select(F.lit(kind).alias("kind"), "n_rows")
        for kind, values in lists.items()
    ]
    return reduce(DataFrame.unionByName, counts)
