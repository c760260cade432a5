"""Changes of several stored tables that happen together or not at all.

A change is first written aside in full, below `_journal` in the ledger's folder, and then announced by one small
file. From then on it is finished, also after a crash, by whoever opens the ledger next; without that file it is
dropped. Each step gives the same tables when it runs twice, so a change that was half made is simply made again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.shared import stage
from ledgerloom.sources.store import SCHEMAS, Store

_INTENT = "place int, table string, kind string, months array<date>"


@dataclass(frozen=True)
class Change:
    """Rows for one table: `append` adds them, `replace` makes them the table, `months` makes them those months.

    Rows to append have ids that the table does not hold.
    """

    table: str
    kind: str
    rows: DataFrame
    months: Sequence[date] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        if self.kind not in ("append", "replace", "months"):
            raise ValueError(f"Unknown kind of change {self.kind!r}")


def commit(store: Store, changes: Sequence[Change]) -> None:
    """Make all changes or, if this fails before they are announced, none of them."""
    recover(store)
    entry = f"{_folder(store)}/{uuid.uuid4().hex}"
    for place, change in enumerate(changes):
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[change.table]]
        stage(change.rows.select(*columns), change.table, f"{entry}/{place}")
    intent = [(place, c.table, c.kind, list(c.months)) for place, c in enumerate(changes)]
    store.spark.createDataFrame(intent, _INTENT).coalesce(1).write.parquet(f"{entry}/intent")
    _finish(store, entry, again=False)


def recover(store: Store) -> None:
    """Finish the announced changes that a crash has left, and drop those that were not announced."""
    for entry in _entries(store):
        _finish(store, entry, again=True)


def _finish(store: Store, entry: str, again: bool) -> None:
    for place, table, kind, months in _announced(store, entry):
        rows = store.spark.read.schema(SCHEMAS[table]).parquet(f"{entry}/{place}")
        if kind == "replace":
            store.overwrite(table, rows)
        elif kind == "months":
            store.replace_months(rows, months)
        else:
            # After a crash some of the rows may be there already.
            store.append(table, _not_there(store, table, rows) if again else rows)
    store.remove(entry)


def _not_there(store: Store, table: str, rows: DataFrame) -> DataFrame:
    there = store.read(table)
    if table == "transactions":
        there = there.where(F.col("month").isin(store.months_of(rows)))
    # Written aside: Spark does not append to a table what it reads from it.
    return stage(rows.join(there.select("id"), "id", "left_anti"), f"{table}-again")


def _announced(store: Store, entry: str) -> list[tuple]:
    """The steps of an announced change, one short row for each table; none if it was not announced."""
    try:
        steps = store.spark.read.schema(_INTENT).parquet(f"{entry}/intent").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(map(tuple, steps), key=lambda step: step[0])


def _folder(store: Store) -> str:
    return store.path("_journal")


def _entries(store: Store) -> list[str]:
    """What earlier changes have left: nothing as a rule, one entry after a crash."""
    return [f"{_folder(store)}/{name}" for name in store.names_in(_folder(store))]
