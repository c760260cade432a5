"""The ledger at rest: four Parquet tables, transactions partitioned by month.

There is one writer at a time. Rewrites replace only the months they touch; what has to happen together goes
through the journal.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.schema import ACCOUNTS, IMPORTED_STATEMENTS, RULES, TRANSACTIONS

SCHEMAS = {
    "accounts": ACCOUNTS,
    "imported_statements": IMPORTED_STATEMENTS,
    "transactions": TRANSACTIONS,
    "rules": RULES,
}


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def read(self, table: str) -> DataFrame:
        """The table as it is now; empty before the first write."""
        schema: T.StructType = SCHEMAS[table]
        try:
            return self.spark.read.schema(schema).parquet(self.path(table)).select(*schema.names)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def read_ordered(self, table: str) -> DataFrame:
        return self.read(table).orderBy("id")

    def append(self, table: str, rows: DataFrame) -> None:
        schema: T.StructType = SCHEMAS[table]
        shaped = rows.select(*[F.col(field.name).cast(field.dataType) for field in schema])
        if table == "transactions":
            _by_month(shaped).write.mode("append").partitionBy("month").parquet(self.path(table))
        else:
            _by_id(shaped).write.mode("append").parquet(self.path(table))

    def replace_months(self, rows: DataFrame, months: Iterable[date]) -> None:
        """Replace the transactions of these months by `rows`, which hold no other month.

        Months that are left without rows are removed.
        """
        months = list(months)
        if not months:
            return
        path = self.path("transactions")
        shaped = rows.select(*TRANSACTIONS.names)
        kept = {row.month for row in shaped.select("month").distinct().collect()}
        _by_month(shaped).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "month"
        ).parquet(path)
        for month in set(months) - kept:
            self.remove(f"{path}/month={month.isoformat()}")

    def overwrite(self, table: str, rows: DataFrame) -> None:
        """Replace a small table by rows that do not come from the table itself."""
        _by_id(rows.select(*SCHEMAS[table].names)).write.mode("overwrite").parquet(self.path(table))

    def months_of(self, rows: DataFrame) -> list[date]:
        """The calendar months that occur: one short value per month of history."""
        return sorted(row.month for row in rows.select("month").distinct().collect())

    def remove(self, folder: str) -> None:
        files, path = self._files(folder)
        files.delete(path, True)

    def names_in(self, folder: str) -> list[str]:
        """Names of what a folder holds, none if it is not there."""
        files, path = self._files(folder)
        return sorted(found.getPath().getName() for found in files.listStatus(path)) if files.exists(path) else []

    def _files(self, folder: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path


def _by_month(rows: DataFrame) -> DataFrame:
    """Few files per month: small months share a task, large ones are split over several."""
    return rows.hint("rebalance", "month").sortWithinPartitions("month", "account_name", "date")


def _by_id(rows: DataFrame) -> DataFrame:
    """Files that hold ranges of ids, in order, so that a lookup by id skips most of them by their statistics."""
    return rows.repartitionByRange("id").sortWithinPartitions("id")
