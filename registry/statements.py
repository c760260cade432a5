"""Statement files: events written in the shape of each bank's export, read back and imported."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from datetime import datetime
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.relations import statement_lineage
from ledgerloom.operators.rules import category_rule
from ledgerloom.plans.imports import import_folder, natural_id, register_statements as register
from ledgerloom.plans.imports import import_statements as import_manifest_files
from ledgerloom.plans.retrieve import retrieve_transactions
from ledgerloom.plans.standardise import standardise, standardise_rows
from ledgerloom.schema import ACCOUNTS as ACCOUNT_SCHEMA
from ledgerloom.sources.layouts import CHASE, LLOYDS_CC, MONZO, Layout
from ledgerloom.sources.shared import shared_folder
from ledgerloom.sources.statements import read_statements
from ledgerloom.sources.store import Store
from ledgerloom.streaming.ingest import stream_statements
from registry.catalogue import catalogue
from registry.views import STATEMENTS, statements, table, with_views

query, QUERIES, ORACLES = catalogue()


_CHASE_HEAD = ['"Account overview"', '"Day","Clock","Kind","Who","Sum","Money","Left"']
_LLOYDS_HEAD = ["Booked,Cleared,Kind,Who,Sum"]
_MONZO_HEAD = [
    "Key,Day,Clock,Kind,Who,Sign,Group,Sum,Money,Foreign sum,Foreign money,"
    "Remarks,Place,Slip,Text,Split,Spent,Got"
]


def _line(*cells: Column) -> Column:
    """One CSV line with every cell quoted; a null cell stays empty."""
    quoted = [
        F.concat(F.lit('"'), F.replace(F.coalesce(cell, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
        for cell in cells
    ]
    return F.concat_ws(",", *quoted)


def _chase_line() -> Column:
    kind = F.col("event_type")
    negative = kind.isin("purchase", "error")
    return _line(
        F.date_format("ts", "dd MMM yyyy"),
        F.date_format("ts", "HH:mm:ss"),
        F.when(kind == "purchase", "Purchase | EUR 2.00 | FX rate").when(kind == "error", "Cash Withdrawal").otherwise(kind),
        F.when(kind == "view", "Round up").otherwise(F.concat(kind, F.lit(" &amp; co"))),
        F.concat(F.when(negative, "-£").otherwise("£"), F.format_number("value", 2)),
        F.lit("GBP"),
        F.format_number(F.col("value") * 100, 2),
    )


_CHASE_SQL = """chase as (
    select user_id, event_id, date_trunc('second', ts) as date,
           case when event_type = 'view' then 'Round up' else event_type || ' & co' end as name,
           case event_type when 'purchase' then 'Purchase' when 'error' then 'cash_withdrawal'
                when 'view' then 'roundup' else event_type end as category,
           cast(case when event_type in ('purchase', 'error') then -value else value end as decimal(12,2)) as amount,
           cast(cast(value as decimal(12,2)) * 100 as decimal(12,2)) as balance, 'GBP' as currency,
           case event_type when 'purchase' then 'EUR 2.00 | FX rate' when 'error' then 'Cash Withdrawal' else '' end
           as notes
    from events)"""


def _lloyds_line() -> Column:
    return _line(
        F.date_format("ts", "dd/MM/yyyy"),
        F.date_format("ts", "dd/MM/yyyy"),
        F.col("event_type"),
        F.concat(F.lit('Shop "'), F.col("event_type"), F.lit('", &lt;main&gt;')),
        F.concat(F.lit("£"), F.format_number("value", 2)),
    )


_LLOYDS_SQL = """lloyds as (
    select user_id, event_id, date_trunc('day', ts)::timestamp as date, 'Shop "' || event_type || '", <main>' as name,
           'None' as category, -cast(value as decimal(12,2)) as amount,
           cast(sum(-cast(value as decimal(12,2))) over (
               partition by user_id order by date_trunc('day', ts), event_id
               rows between unbounded preceding and current row) as decimal(12,2)) as balance,
           'GBP' as currency, event_type as notes
    from events)"""


def _monzo_line() -> Column:
    kind = F.col("event_type")
    blank = F.lit(None).cast("string")
    return _line(
        F.col("event_id").cast("string"),
        F.date_format("ts", "dd/MM/yyyy"),
        F.date_format("ts", "HH:mm:ss"),
        F.lit("Card payment"),
        F.when(kind == "view", "Round Ups Pot").when(kind == "click", blank).otherwise(kind),
        blank,
        F.lit("General"),
        F.col("value").cast("string"),
        F.when(kind == "signup", "EUR").otherwise("GBP"),
        blank,
        blank,
        F.when(kind == "error", "OVERDRAFT charge").when(kind == "click", "Paid with Flex").otherwise(F.col("props")),
        *[blank] * 6,
    )


_MONZO_SQL = """monzo as (
    select user_id, event_id, date_trunc('second', ts) as date,
           case event_type when 'view' then 'Round Ups Pot' when 'click' then 'Flex payment'
                when 'error' then 'Overdraft fees' else event_type end as name,
           case event_type when 'view' then 'roundup' when 'error' then 'fee' else 'General' end as category,
           cast(value as decimal(12,2)) as amount,
           cast(sum(cast(value as decimal(12,2))) over (
               partition by user_id order by date_trunc('second', ts), event_id
               rows between unbounded preceding and current row) as decimal(12,2)) as balance,
           case when event_type = 'signup' then 'EUR' else 'GBP' end as currency,
           case event_type when 'error' then 'OVERDRAFT charge' when 'click' then 'Paid with Flex' else props end
           as notes
    from events)"""

_LINES = {"Chase": (_CHASE_HEAD, _chase_line), "LloydsCC": (_LLOYDS_HEAD, _lloyds_line), "Monzo": (_MONZO_HEAD, _monzo_line)}


# Statement files in one folder.
FOLDER_FILES = 30_000


def write_statements(events: DataFrame, layout: Layout, folder: str) -> str:
    """One statement file per user, with its head, in folders below `folder`; returns the pattern that reads them."""
    head, line = _LINES[layout.name]
    body = events.select(
        F.concat(F.lit(f"{layout.name}-"), F.col("user_id").cast("string")).alias("account"),
        F.col("event_id").alias("place"),
        line().alias("line"),
    )
    accounts = body.select("account").distinct()
    heads = accounts.select("account", F.posexplode(F.array(*[F.lit(text) for text in head])).alias("place", "line"))
    above = heads.withColumn("place", (F.col("place") - len(head)).cast("bigint"))
    # Folders take ranges of accounts, so that the files of all folders are in the order of their accounts.
    folders = max(1, -(-accounts.count() // FOLDER_FILES))
    parts = accounts.repartitionByRange(folders, "account").select(
        F.col("account").alias("_account"), F.lpad(F.spark_partition_id().cast("string"), 6, "0").alias("part")
    )
    files = (
        above.unionByName(body)
        .join(parts, F.col("account").eqNullSafe(F.col("_account")))
        .repartition("account")
        .sortWithinPartitions("part", "account", "place")
        .select("part", "account", "line")
    )
    if re.match("(file:)?/", folder):
        # Spark's own writer starts processes for each file that it makes on a local disk.
        files.mapInArrow(_write_files(re.sub("^file:/+", "/", folder)), "files long").agg(F.sum("files")).collect()
    else:
        files.write.partitionBy("part", "account").text(folder)
    return f"{folder}/part=*/account=*"


def _write_files(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out, files = None, None, 0
        for batch in batches:
            rows = zip(*(column.to_pylist() for column in batch.columns))
            for at, lines in groupby(rows, key=lambda row: row[:2]):
                if at != key:
                    if out:
                        out.close()
                    own = f"{folder}/part={at[0]}/account={'__HIVE_DEFAULT_PARTITION__' if at[1] is None else at[1]}"
                    os.makedirs(own, exist_ok=True)
                    key, out, files = at, open(f"{own}/part-0.csv", "w", encoding="utf-8", newline=""), files + 1
                out.writelines(f"{line}\n" for _, _, line in lines)
        if out:
            out.close()
        yield pa.RecordBatch.from_pydict({"files": [files]})

    return write


def account_of(path: Column) -> Column:
    return F.regexp_extract(path, "/account=([^/]+)/", 1)


def _standardised(spark, sf: str, layout: Layout) -> DataFrame:
    pattern = write_statements(table(spark, sf, "events"), layout, shared_folder(spark, "statements"))
    raw = read_statements(spark, [pattern], layout)
    return standardise(raw, layout).select(
        account_of(F.col("_src_file")).alias("account_name"),
        "date",
        "name",
        "category",
        "amount",
        "balance",
        "currency",
        "notes",
    )


_COLUMNS = "date, name, category, amount, balance, currency, notes"


@query(with_views(_CHASE_SQL, query=f"select 'Chase-' || user_id as account_name, {_COLUMNS} from chase"))
def statement_csv_chase(spark, sf):
    return _standardised(spark, sf, CHASE)


@query(with_views(_LLOYDS_SQL, query=f"select 'LloydsCC-' || user_id as account_name, {_COLUMNS} from lloyds"))
def statement_csv_lloyds(spark, sf):
    return _standardised(spark, sf, LLOYDS_CC)


@query(with_views(_MONZO_SQL, query=f"select 'Monzo-' || user_id as account_name, {_COLUMNS} from monzo"))
def statement_csv_monzo(spark, sf):
    return _standardised(spark, sf, MONZO)


# Large files of rows over several lines, with quotes inside plain cells. Two of twenty files are of another kind.
_LONG = Layout("Long", ("date", "name", "notes", "amount"))
_OTHER_FILES = (3, 7)
_LONG_SQL = """select user_id % 20 as file, cast(date_trunc('day', ts) as timestamp) as date, '5" ' || event_type as name,
    event_type || ', then' || chr(10) || chr(10) || '"' || event_id || '"' as notes, cast(value as decimal(12,2)) as amount
    from events"""


def _long_statements(spark, sf: str):
    """The files read in blocks of 64 KB, each row over three lines."""
    cells = [
        F.date_format("ts", "yyyy-MM-dd"), F.concat(F.lit('5" '), F.col("event_type")),
        F.concat(F.lit('"'), F.col("event_type"), F.lit(', then\n\n""'), F.col("event_id").cast("string"), F.lit('"""')),
        F.col("value").cast("string"),
    ]
    file = F.col("user_id") % 20
    body = table(spark, sf, "events").select(file.alias("account"), F.col("event_id").alias("place"), F.concat_ws(",", *cells).alias("line"))
    head = F.when(F.col("account").isin(*_OTHER_FILES), F.lit("Day,Who")).otherwise(F.lit("Day,Who,Text,Sum"))
    heads = body.select("account").distinct().select("account", F.lit(-1).cast("bigint").alias("place"), head.alias("line"))
    folder = shared_folder(spark, "statements")
    files = heads.unionByName(body).repartition("account").sortWithinPartitions("account", "place")
    files.select("account", "line").write.partitionBy("account").text(folder)
    block, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(block, str(64 * 1024))
    try:
        return read_statements(spark, [f"{folder}/account=*"], _LONG, large_file=1)
    finally:
        spark.conf.set(block, before)


@query(f"select * from ({_LONG_SQL}) where file not in {_OTHER_FILES}")
def statement_csv_in_blocks(spark, sf):
    raw = _long_statements(spark, sf)
    return standardise(raw, _LONG).select(
        account_of(F.col("_src_file")).cast("bigint").alias("file"), "date", "name", "notes", "amount"
    )


@query(
    f"""select file, 4 as expected_columns, 'Day,Who' as header_line from ({_LONG_SQL})
        where file in {_OTHER_FILES} group by file"""
)
def statement_misfits(spark, sf):
    """Files whose header does not fit the layout, with what stands there instead."""
    return _long_statements(spark, sf).rejected_files.select(
        account_of(F.col("source_file")).cast("bigint").alias("file"), "expected_columns", "header_line"
    )


# A layout without notes, currency, category and balance: everything else is a default.
_SPARSE = Layout("Sparse", ("date", "name", "amount"))


@query(
    """select cast(date_trunc('day', ts) as timestamp) as date, nullif(event_type, 'view') as name, 'None' as category,
              cast(value as decimal(12,2)) as amount,
              cast(sum(cast(value as decimal(12,2))) over (
                  partition by user_id order by date_trunc('day', ts), event_id
                  rows between unbounded preceding and current row) as decimal(12,2)) as balance,
              'GBP' as currency, '' as notes, event_id as _row
       from events"""
)
def standardise_defaults(spark, sf):
    """Rows that never were a file: any frame with raw cells, a source and a place can be standardised."""
    raw = table(spark, sf, "events").select(
        F.date_format("ts", "d MMM yyyy").alias("_c0"),
        F.nullif(F.col("event_type"), F.lit("view")).alias("_c1"),
        F.concat(F.lit("$"), F.format_number("value", 2)).alias("_c2"),
        F.col("user_id").cast("string").alias("_src_file"),
        F.col("event_id").alias("_row"),
        F.lit(None).cast("string").alias("_raw_line"),
    )
    return standardise_rows(raw, _SPARSE).drop("_src_file")


def _new_ledger(spark, sf: str, layouts: list[Layout]) -> Store:
    """An empty ledger with one account per user and bank."""
    store = Store(spark, shared_folder(spark, "ledger"))
    users = table(spark, sf, "events").select("user_id").distinct()
    for layout in layouts:
        named = users.select(
            F.concat(F.lit(f"{layout.name}-"), F.col("user_id").cast("string")).alias("name"),
            F.lit(layout.name).alias("bank"),
            F.lit("current").alias("account_type"),
            F.lit(True).alias("is_active"),
            F.lit(datetime(2025, 1, 1)).alias("created_at"),
        ).withColumn("id", natural_id("name"))
        store.append("accounts", named.select(*ACCOUNT_SCHEMA.names))
    return store


_FIRST = "qualify row_number() over (partition by user_id, date, name, balance order by event_id) = 1"


@query(
    with_views(
        _CHASE_SQL,
        _LLOYDS_SQL,
        _MONZO_SQL,
        query=" union all ".join(
            f"(select '{bank}-' || user_id as account_name, {_COLUMNS} from {view} {_FIRST})"
            for bank, view in (("Chase", "chase"), ("LloydsCC", "lloyds"), ("Monzo", "monzo"))
        ),
    )
)
def import_statements(spark, sf):
    """Three banks' files into one stored ledger; the Chase files are imported twice and count once."""
    layouts = [CHASE, LLOYDS_CC, MONZO]
    store = _new_ledger(spark, sf, layouts)
    events = table(spark, sf, "events")
    for layout in layouts:
        pattern = write_statements(events, layout, shared_folder(spark, "statements"))
        import_folder(store, pattern, layout, account_of)
        if layout is CHASE:
            import_folder(store, pattern, layout, account_of)
    return retrieve_transactions(store.read("transactions"))


@query(
    with_views(
        _LLOYDS_SQL,
        query=f"""select account_name, sha256(concat_ws(chr(1), account_name, cast(date as varchar), name,
               cast(balance as varchar))) as id, account_name as file_account, account_name as listed_account
        from (select *, 'LloydsCC-' || user_id as account_name from lloyds {_FIRST})""",
    )
)
def import_lineage(spark, sf):
    """Ids of stored transactions, each with the account of the file and of the history row it was imported from."""
    store = _new_ledger(spark, sf, [LLOYDS_CC])
    pattern = write_statements(table(spark, sf, "events"), LLOYDS_CC, shared_folder(spark, "statements"))
    for _ in range(2):
        import_folder(store, pattern, LLOYDS_CC, account_of)
    history = store.read("imported_statements")
    transactions = statement_lineage(store.read("transactions"), history)
    listed = history.select(F.col("id").alias("imported_from"), F.col("account").alias("listed_account"))
    return transactions.join(listed, "imported_from").select(
        "account_name", "id", account_of(F.col("source_file")).alias("file_account"), "listed_account"
    )


@query(
    with_views(
        _LLOYDS_SQL,
        query=f"""select 'LloydsCC-' || user_id as account_name, date, name,
               case when notes = 'purchase' then 'groceries' else category end as category,
               amount, balance, currency, notes from (select * from lloyds {_FIRST})""",
    )
)
def stream_import(spark, sf):
    """The same files arriving in a watched folder, with a rule applied on import."""
    store = _new_ledger(spark, sf, [LLOYDS_CC])
    pattern = write_statements(table(spark, sf, "events"), LLOYDS_CC, shared_folder(spark, "statements"))
    rules = [category_rule({"notes": "purchase"}, "groceries")]
    for _ in range(2):
        stream_statements(
            store, pattern, LLOYDS_CC, account_of, f"{store.root}/stream-checkpoint", rules, multi_line=False, by_folder=True
        ).awaitTermination()
    return retrieve_transactions(store.read("transactions"))


@query(with_views(STATEMENTS, query="select id as statement, 'a' || id as account, source_file from statements"))
def register_statements(spark, sf):
    """Statements registered twice under one import appear once in the stored history."""
    store = Store(spark, shared_folder(spark, "ledger"))
    stamp = F.lit(datetime(2025, 1, 1))
    rows = statements(spark, sf).select(
        natural_id("id").alias("id"),
        stamp.alias("created_at"),
        F.concat(F.lit("a"), "id").alias("account"),
        stamp.alias("import_timestamp"),
        "source_file",
    )
    for _ in range(2):
        register(store, rows)
    return store.read("imported_statements").select(
        F.replace("source_file", F.lit(".csv"), F.lit("")).alias("statement"), "account", "source_file"
    )


@query(
    with_views(
        _LLOYDS_SQL,
        """owners as (select unnest(['mine', 'ours']) as account_name)""",
        query=f"""select account_name, {_COLUMNS} from lloyds, owners
        qualify row_number() over (partition by account_name, date, name, balance
                                   order by cast(user_id as varchar), event_id) = 1""",
    )
)
def import_manifest(spark, sf):
    """All files listed twice for one account, and once for another: each file counts once in each account."""
    store = Store(spark, shared_folder(spark, "ledger"))
    owners = spark.createDataFrame([("mine",), ("ours",)], "name string")
    named = owners.select(
        natural_id("name").alias("id"), "name", F.lit(LLOYDS_CC.name).alias("bank"),
        F.lit("credit").alias("account_type"), F.lit(True).alias("is_active"),
        F.lit(datetime(2025, 1, 1)).alias("created_at"),
    )
    store.append("accounts", named.select(*ACCOUNT_SCHEMA.names))
    pattern = write_statements(table(spark, sf, "events"), LLOYDS_CC, shared_folder(spark, "statements"))
    import_manifest_files(store, [("mine", pattern), ("mine", f"{pattern}"), ("ours", pattern)])
    return retrieve_transactions(store.read("transactions"))
