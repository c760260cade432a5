"""Ledger maintenance, relations, totals and running balances."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions.predicates import LEDGER
from ledgerloom.operators import relations, totals
from ledgerloom.operators.dedupe import first_wins, merge
from ledgerloom.operators.filtering import all_of, by_id, filter_ledger
from ledgerloom.operators.rules import Action, Condition, Rule, apply_rules
from ledgerloom.operators.rules import reclassify as set_category
from ledgerloom.operators.running import running_total
from ledgerloom.plans.imports import to_transactions
from ledgerloom.plans.ledger import Ledger
from ledgerloom.plans.retrieve import transactions_in_date_range
from ledgerloom.sources.shared import shared_folder
from ledgerloom.sources.store import Store
from registry.catalogue import catalogue
from registry.views import (
    ACCOUNTS,
    STATEMENTS,
    TX_EVENTS,
    TX_IMPORTED,
    TX_ORDERS,
    accounts,
    money,
    statements,
    table,
    tx_events,
    tx_imported,
    tx_orders,
    with_views,
)

query, QUERIES, ORACLES = catalogue()


_SUMMARY = """account_name,
    cast(coalesce(sum(case when amount <= 0 then amount end), 0) as decimal(38,2)) outgoings,
    cast(coalesce(sum(case when amount > 0 then amount end), 0) as decimal(38,2)) incomings,
    cast(sum(amount) as decimal(38,2)) net, cast(sum(abs(amount)) as decimal(38,2)) turnover, count(*) n_tx"""


@query(
    with_views(
        TX_ORDERS,
        ACCOUNTS,
        query=f"""select {_SUMMARY} from tx_orders
        where date between timestamp '1997-01-01' and timestamp '1997-12-31' and contains(lower(name), 'high')
          and account_name in (select name from accounts where lower(bank) = 'building')
        group by account_name""",
    )
)
def bank_account_summary(spark, sf):
    """The flagship: totals of the accounts of one bank, over filtered transactions of one year."""
    held = relations.from_bank(tx_orders(spark, sf), accounts(spark, sf), "building")
    year = transactions_in_date_range(held, "1 January 1997", "31 December 1997")
    return totals.account_summary(filter_ledger(year, name="^high"))


@query(with_views(TX_ORDERS, query=f"select {_SUMMARY} from tx_orders group by account_name"))
def account_summary(spark, sf):
    return totals.account_summary(tx_orders(spark, sf))


@query(with_views(TX_EVENTS, query=f"select {_SUMMARY} from tx_events group by account_name"))
def account_summary_events(spark, sf):
    return totals.account_summary(tx_events(spark, sf))


@query(
    with_views(
        TX_ORDERS,
        ACCOUNTS,
        query="""select t.* from tx_orders t
        where exists (select 1 from accounts a where a.name = t.account_name and lower(a.bank) = 'machinery')""",
    )
)
def from_bank(spark, sf):
    return relations.from_bank(tx_orders(spark, sf), accounts(spark, sf), "Machinery")


@query(
    with_views(
        TX_ORDERS,
        ACCOUNTS,
        query="""select a.name, a.bank, t.account_name, t.date, t.name as tx_name, t.amount, t.o_orderkey
        from accounts a left join tx_orders t on t.account_name = a.name""",
    )
)
def account_transactions(spark, sf):
    transactions = tx_orders(spark, sf).select("account_name", "date", "name", "amount", "o_orderkey")
    return relations.account_transactions(accounts(spark, sf), transactions)


@query(
    with_views(
        TX_IMPORTED,
        STATEMENTS,
        query="""select t.o_orderkey, t.imported_from, t.amount, s.source_file, s.import_timestamp
        from tx_imported t left join statements s on s.id = t.imported_from""",
    )
)
def statement_lineage(spark, sf):
    transactions = tx_imported(spark, sf).select("o_orderkey", "imported_from", "amount")
    return relations.statement_lineage(transactions, statements(spark, sf))


@query(
    with_views(
        TX_ORDERS,
        query="""select cast(date_trunc('month', date) as timestamp) as month,
               cast(coalesce(sum(case when amount < 0 then -amount end), 0) as decimal(38,2)) spent, count(*) n_tx
        from tx_orders group by 1""",
    )
)
def monthly_spend(spark, sf):
    return totals.monthly_spend(tx_orders(spark, sf))


@query(
    with_views(
        TX_ORDERS,
        query="""select cast(date_trunc('month', date) as timestamp) as month, """
        + ", ".join(
            f"cast(coalesce(sum(case when amount < 0 and category = '{c}' then -amount end), 0) as decimal(38,2)) \"{c}\""
            for c in "FOP"
        )
        + " from tx_orders group by 1",
    )
)
def monthly_category_spend(spark, sf):
    return totals.monthly_category_spend(tx_orders(spark, sf), ["F", "O", "P"])


_IN_OUT = """cast(coalesce(sum(case when amount <= 0 then amount end), 0) as decimal(38,2)) outgoings,
    cast(coalesce(sum(case when amount > 0 then amount end), 0) as decimal(38,2)) incomings, count(*) n_tx"""


@query(with_views(TX_EVENTS, query=f"select category, {_IN_OUT} from tx_events group by category"))
def category_breakdown(spark, sf):
    return totals.category_breakdown(tx_events(spark, sf))


@query(
    with_views(
        TX_ORDERS,
        ACCOUNTS,
        query=f"""select a.bank, {_IN_OUT} from tx_orders t left join accounts a on a.name = t.account_name
        group by a.bank""",
    )
)
def bank_breakdown(spark, sf):
    return totals.bank_breakdown(tx_orders(spark, sf), accounts(spark, sf))


@query(
    with_views(
        TX_ORDERS,
        ACCOUNTS,
        """rows as (select cast(date_trunc('month', t.date) as timestamp) as month, t.category, a.bank, t.amount
        from tx_orders t left join accounts a on a.name = t.account_name)""",
        query="""select month, category, bank, cast(grouping_id(month, category, bank) as integer) as level,
               cast(sum(amount) as decimal(38,2)) net,
               cast(coalesce(sum(case when amount < 0 then -amount end), 0) as decimal(38,2)) spent, count(*) n_tx
        from rows group by grouping sets ((month), (month, category), (bank), ())""",
    )
)
def dashboard_cube(spark, sf):
    return totals.dashboard(tx_orders(spark, sf), accounts(spark, sf))


@query(
    with_views(
        TX_IMPORTED,
        STATEMENTS,
        query="""select s.id as imported_from, s.source_file, count(t.o_orderkey) n_tx, min(t.date) first_date,
               max(t.date) last_date, cast(coalesce(sum(t.amount), 0) as decimal(38,2)) amount
        from statements s left join tx_imported t on t.imported_from = s.id group by s.id, s.source_file""",
    )
)
def import_history(spark, sf):
    return totals.import_history(tx_imported(spark, sf), statements(spark, sf))


@query(
    with_views(
        TX_EVENTS,
        "gaps as (select account_name, date, event_id, nullif(amount, 10.00) as amount from tx_events)",
        query="""select account_name, date, event_id, amount,
               case when amount is not null then cast(sum(coalesce(amount, 0)) over (
                   partition by account_name order by date, event_id
                   rows between unbounded preceding and current row) as decimal(38,2)) end as balance
        from gaps""",
    )
)
def running_balance(spark, sf):
    gaps = tx_events(spark, sf).select(
        "account_name",
        "date",
        "event_id",
        F.nullif(F.col("amount"), F.lit("10.00").cast("decimal(12,2)")).alias("amount"),
    )
    totalled = running_total(gaps, ["account_name"], "date", "event_id", "amount", "balance")
    return totalled.withColumn("balance", F.col("balance").cast("decimal(38,2)"))


@query(
    with_views(
        TX_ORDERS,
        query="""select category, date, o_orderkey, amount, cast(sum(amount) over (
                   partition by category order by date, o_orderkey
                   rows between unbounded preceding and current row) as decimal(38,2)) as balance
        from tx_orders""",
    )
)
def running_balance_few_keys(spark, sf):
    """Three keys hold all rows, so almost all of the work is inside the days."""
    rows = tx_orders(spark, sf).select("category", "date", "o_orderkey", "amount")
    totalled = running_total(rows, ["category"], "date", "o_orderkey", "amount", "balance")
    return totalled.withColumn("balance", F.col("balance").cast("decimal(38,2)"))


_LINE_KEY = ["l_orderkey", "l_linenumber"]
_LINE_ORDER = ["l_partkey", "l_shipdate"]


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        *_LINE_KEY, *_LINE_ORDER, "l_linestatus", money("l_extendedprice").alias("amount")
    )


@query(
    """select l_orderkey, l_linenumber, l_partkey, l_shipdate, l_linestatus,
              cast(l_extendedprice as decimal(12,2)) amount
       from lineitem
       qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_shipdate) = 1"""
)
def dedupe_first_wins(spark, sf):
    return first_wins(_lines(spark, sf), _LINE_KEY, _LINE_ORDER)


@query(
    """with firsts as (
           select l_orderkey, l_linenumber, l_partkey, l_shipdate, l_linestatus,
                  cast(l_extendedprice as decimal(12,2)) amount
           from lineitem
           qualify row_number() over (
               partition by l_linestatus, l_orderkey, l_linenumber order by l_partkey, l_shipdate) = 1)
       select * from firsts where l_linestatus = 'F'
       union all
       select * from firsts n where l_linestatus <> 'F' and not exists (
           select 1 from firsts o where o.l_linestatus = 'F'
           and o.l_orderkey = n.l_orderkey and o.l_linenumber = n.l_linenumber)"""
)
def ledger_append(spark, sf):
    """Finished lines are the ledger, open ones the new batch."""
    lines = _lines(spark, sf)
    stored = first_wins(lines.where("l_linestatus = 'F'"), _LINE_KEY, _LINE_ORDER)
    return merge(stored, lines.where("l_linestatus <> 'F'"), _LINE_ORDER, _LINE_KEY)


@query(
    with_views(
        TX_ORDERS,
        ACCOUNTS,
        query="""select 'account_name' as foreign_key, account_name as missing_key, count(*) n_rows from tx_orders
        where account_name not in (select name from accounts where bank <> 'BUILDING') group by account_name""",
    )
)
def fk_audit(spark, sf):
    known = accounts(spark, sf).where("bank <> 'BUILDING'")
    return relations.orphans(tx_orders(spark, sf), "account_name", known, "name")


@query(
    with_views(
        TX_ORDERS,
        ACCOUNTS,
        query="""select * from tx_orders
        where account_name not in (select name from accounts where bank = 'BUILDING')""",
    )
)
def cascade_delete(spark, sf):
    deleted = relations.accounts_with_bank(accounts(spark, sf), "building")
    return relations.delete_accounts(tx_orders(spark, sf), deleted)


@query(
    with_views(
        ACCOUNTS,
        "stored as (select name from accounts where bank = 'BUILDING')",
        """proposed as (select cast(o_custkey as varchar) as name, o_orderstatus as bank, o_orderkey from orders)""",
        """ranked as (select *, row_number() over (partition by name order by o_orderkey) as place
        from proposed where bank in ('F', 'O'))""",
        query="""select name, bank, o_orderkey, 'unknown bank' as reason from proposed where bank not in ('F', 'O')
        union all select name, bank, o_orderkey,
            case when place > 1 or name in (select name from stored) then 'duplicate name' else 'accepted' end
        from ranked""",
    )
)
def register_accounts(spark, sf):
    stored = accounts(spark, sf).where("bank = 'BUILDING'")
    proposed = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("name"), F.col("o_orderstatus").alias("bank"), "o_orderkey"
    )
    accepted, refused = relations.new_accounts(stored, proposed, ["F", "O"], ["o_orderkey"])
    return accepted.withColumn("reason", F.lit("accepted")).unionByName(refused)


@query("select o_orderkey as id, o_orderdate, o_totalprice from orders order by id")
def table_ordered_by_id(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate", "o_totalprice")
    return rows.orderBy("id")


@query("select cast(o_orderkey as varchar) as id, 'a' || o_custkey as account, o_orderstatus as source_file from orders")
def statements_ordered_by_id(spark, sf):
    """A stored table as a full scan in order of its ids."""
    store = Store(spark, shared_folder(spark, "ledger"))
    stamp = F.lit(datetime(2025, 1, 1))
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        stamp.alias("created_at"),
        F.concat(F.lit("a"), F.col("o_custkey").cast("string")).alias("account"),
        stamp.alias("import_timestamp"),
        F.col("o_orderstatus").alias("source_file"),
    )
    store.append("imported_statements", rows)
    return store.read_ordered("imported_statements").select("id", "account", "source_file")


@query(
    with_views(
        TX_ORDERS,
        ACCOUNTS,
        query="""select o_orderkey, account_name, amount from tx_orders
        where account_name in (select name from accounts where lower(bank) in ('building', 'machinery'))""",
    )
)
def from_accounts(spark, sf):
    """Transactions of a list of accounts, some of them listed twice."""
    held = accounts(spark, sf)
    listed = relations.accounts_with_bank(held, "building").unionByName(relations.accounts_with_bank(held, "machinery"))
    return relations.from_accounts(tx_orders(spark, sf), listed.unionByName(listed)).select(
        "o_orderkey", "account_name", "amount"
    )


@query(
    with_views(
        TX_ORDERS,
        query="""select o_orderkey, case when hit then 'bill' else category end as category, hit as changed
        from (select *, amount between -200000 and 0 and name ilike '%urgent%' as hit from tx_orders)""",
    )
)
def reclassify(spark, sf):
    rows = tx_orders(spark, sf)
    condition = all_of(rows, {"amount": (-200000, 0), "name": "^urgent"}, LEDGER)
    return set_category(rows, condition, "bill", changed="changed").select("o_orderkey", "category", "changed")


@query(
    with_views(
        TX_ORDERS,
        query="""select cast(o_orderkey as varchar) as imported_from, account_name, date, amount,
               case when name ilike '%urgent%' and amount between -200000 and 0 then 'bill'
                    when name ilike '%high%' then 'groceries' else category end as category,
               (name ilike '%urgent%' and amount between -200000 and 0) or name ilike '%high%' as touched
        from tx_orders""",
    )
)
def rules_retroactive(spark, sf):
    """All orders stored as a ledger, then rules added to it and applied to what is stored."""
    ledger = Ledger(spark, shared_folder(spark, "ledger"))
    rows = tx_orders(spark, sf).withColumn("imported_from", F.col("o_orderkey").cast("string"))
    ledger.store.append("transactions", to_transactions(rows, datetime(2025, 1, 1)))
    ledger.add_rule({"name": "^high"}, "groceries", priority=1)
    ledger.add_rule({"name": "^urgent", "amount": (-200000, 0)}, "bill", priority=2)
    ledger.apply_rules()
    touched = F.col("updated_at") > F.col("created_at")
    return ledger.transactions.select(
        "imported_from", "account_name", "date", "amount", "category", touched.alias("touched")
    )


def _stored_orders(spark, sf) -> Ledger:
    """All orders stored as a ledger; every customer is an account."""
    ledger = Ledger(spark, shared_folder(spark, "ledger"))
    rows = tx_orders(spark, sf).withColumn("imported_from", F.col("o_orderkey").cast("string"))
    ledger.store.append("transactions", to_transactions(rows, datetime(2025, 1, 1)))
    names = rows.select(F.col("account_name").alias("name")).distinct()
    now = F.lit(datetime(2025, 1, 1))
    ledger.store.append(
        "accounts",
        names.select(
            F.col("name").alias("id"), now.alias("created_at"), "name", F.lit("Chase").alias("bank"),
            F.lit("current").alias("account_type"), F.lit(True).alias("is_active"),
        ),
    )
    return ledger


@query(
    with_views(
        TX_ORDERS,
        query="""select cast(o_orderkey as varchar) as imported_from,
               case when hit then 'bill' else category end as category, hit as touched
        from (select *, coalesce(amount between -200000 and 0 and name ilike '%urgent%', false) as hit from tx_orders)""",
    )
)
def ledger_reclassify(spark, sf):
    """Stored transactions put into another category, and stamped, where they satisfy the filters."""
    ledger = _stored_orders(spark, sf)
    ledger.reclassify("bill", amount=(-200000, 0), name="^urgent")
    return ledger.transactions.select("imported_from", "category", (F.col("updated_at") > F.col("created_at")).alias("touched"))


@query(
    with_views(
        TX_ORDERS,
        query="""select account_name, count(*) as n_tx, sum(amount) as net from tx_orders
        where account_name <> (select min(account_name) from tx_orders) group by account_name""",
    )
)
def ledger_delete_account(spark, sf):
    """What is stored of the other accounts once one is deleted with all that belongs to it."""
    ledger = _stored_orders(spark, sf)
    ledger.delete_account(ledger.accounts.agg(F.min("name")).first()[0])
    left = ledger.transactions.groupBy("account_name").agg(F.count("*").alias("n_tx"), F.sum("amount").alias("net"))
    known = ledger.accounts.select(F.col("name").alias("account_name"))
    return left.join(known, "account_name")


@query(
    with_views(
        TX_ORDERS,
        ACCOUNTS,
        query="""select a.name as account_name, coalesce(sum(amount) filter (amount <= 0), 0) as outgoings,
               coalesce(sum(amount) filter (amount > 0), 0) as incomings, coalesce(sum(amount), 0) as net,
               coalesce(sum(abs(amount)), 0) as turnover, count(amount) as n_tx
        from accounts a left join tx_orders t on t.account_name = a.name group by a.name""",
    )
)
def account_summary_all(spark, sf):
    """Totals of every account; accounts without transactions have zeros."""
    return totals.account_summary(tx_orders(spark, sf), accounts(spark, sf))


@query(
    with_views(
        TX_EVENTS,
        query="""select event_id, case when name = 'purchase' then amount + 1.50 else amount end as amount
        from tx_events""",
    )
)
def rules_many(spark, sf):
    """Three hundred rules that add half a penny each, as data: rounded once, after the last."""
    rules = [
        Rule((Condition("name", "eq", "purchase"),), (Action("amount", "increment", Decimal("0.005")),), n, id=f"{n:04d}")
        for n in range(300)
    ]
    return apply_rules(tx_events(spark, sf), rules, per_pass=100).select("event_id", "amount")


@query(with_views(STATEMENTS, query="select id, source_file from statements where id = 's7'"))
def lookup_by_id(spark, sf):
    return by_id(statements(spark, sf), "s7").select("id", "source_file")
