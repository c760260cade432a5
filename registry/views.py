"""The given tables seen as ledger tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def money(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(12,2)")


def tx_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    price = money("o_totalprice")
    return orders.select(
        F.col("o_custkey").cast("string").alias("account_name"),
        F.col("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("name"),
        F.col("o_orderstatus").alias("category"),
        F.when(F.col("o_orderstatus") == "F", -price).otherwise(price).cast("decimal(12,2)").alias("amount"),
        price.alias("balance"),
        F.lit("GBP").alias("currency"),
        F.lit(None).cast("string").alias("notes"),
        "o_orderkey",
    )


TX_ORDERS = """tx_orders as (
    select cast(o_custkey as varchar) account_name, o_orderdate as date, o_orderpriority as name,
           o_orderstatus as category,
           cast(case when o_orderstatus = 'F' then -o_totalprice else o_totalprice end as decimal(12,2)) amount,
           cast(o_totalprice as decimal(12,2)) balance, 'GBP' currency, cast(null as varchar) notes, o_orderkey
    from orders)"""


def tx_events(spark: SparkSession, sf: str) -> DataFrame:
    value = money("value")
    spent = F.col("event_type").isin("purchase", "error")
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("account_name"),
        F.col("ts").alias("date"),
        F.col("event_type").alias("name"),
        F.col("event_type").alias("category"),
        F.when(spent, -value).otherwise(value).cast("decimal(12,2)").alias("amount"),
        F.lit("GBP").alias("currency"),
        F.col("props").alias("notes"),
        "event_id",
    )


TX_EVENTS = """tx_events as (
    select cast(user_id as varchar) account_name, ts as date, event_type as name, event_type as category,
           cast(case when event_type in ('purchase', 'error') then -value else value end as decimal(12,2)) amount,
           'GBP' currency, props as notes, event_id
    from events)"""


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("name"), F.col("c_mktsegment").alias("bank")
    )


ACCOUNTS = "accounts as (select cast(c_custkey as varchar) as name, c_mktsegment as bank from customer)"


def tx_imported(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as rows imported from twenty statements."""
    return tx_orders(spark, sf).withColumn("imported_from", _statement())


def _statement() -> Column:
    return F.concat(F.lit("s"), (F.col("o_orderkey") % 20).cast("string"))


TX_IMPORTED = TX_ORDERS + """, tx_imported as (
    select *, 's' || cast(o_orderkey % 20 as varchar) as imported_from from tx_orders)"""


def statements(spark: SparkSession, sf: str) -> DataFrame:
    """The statements of `tx_imported`, read off the same table."""
    return (
        table(spark, sf, "orders")
        .select(_statement().alias("id"))
        .distinct()
        .withColumn("source_file", F.concat("id", F.lit(".csv")))
        .withColumn("import_timestamp", F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))
    )


STATEMENTS = """statements as (
    select distinct 's' || cast(o_orderkey % 20 as varchar) as id,
           's' || cast(o_orderkey % 20 as varchar) || '.csv' as source_file,
           timestamp '2025-01-01 00:00:00' as import_timestamp
    from orders)"""


def with_views(*views: str, query: str) -> str:
    return "with " + ", ".join(views) + "\n" + query
