"""Importing statements into the ledger: many files, accounts and layouts at once."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from itertools import islice
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.dedupe import first_wins, not_stored
from ledgerloom.operators.lookup import fits
from ledgerloom.operators.rules import Rule, apply_rules
from ledgerloom.plans.standardise import REASON, to_canonical, to_ledger_values, with_balance
from ledgerloom.schema import TRANSACTIONS, UNIQUE_KEY
from ledgerloom.sources.journal import Change, commit
from ledgerloom.sources.layouts import Layout, find_layout
from ledgerloom.sources import shared
from ledgerloom.sources.shared import in_parts, literal, shared_folder, stage
from ledgerloom.sources.statements import (
    RAW_LINE,
    RawStatements,
    read_parts,
    read_statements,
    require_all_files,
)
from ledgerloom.sources.store import Store

_ORDER = ["_src_file", "_row"]


class RejectedRows(ValueError):
    """Rows that cannot be stored, found by a strict import."""


@dataclass(frozen=True)
class ImportResult:
    """What an import left out: files that do not fit their layout, and rows with the reason."""

    rejected_files: DataFrame
    rejected_rows: DataFrame


def natural_id(*parts: Column | str) -> Column:
    """An id that a repeated run computes again."""
    return F.sha2(F.concat_ws("\u0001", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]), 256)


def import_statements(
    store: Store,
    manifest: Iterable[tuple[str, str]],
    imported_at: datetime | None = None,
    rules: Iterable[Rule] = (),
    strict: bool = False,
    multi_line: bool | None = None,
) -> ImportResult:
    """Import `(account, path)` pairs; a path may be a file, a folder or a pattern.

    A file that an account lists several times counts once; one that several accounts list goes to each of them.
    Files are listed and read in parts, so the driver holds one part's names and never their rows.
    """
    spark = store.spark
    stamp = imported_at or datetime.now()
    asked = list(dict.fromkeys(manifest))
    names = spark.createDataFrame([(account,) for account in {account for account, _ in asked}], "name string")
    banks = {row.name: row.bank for row in store.read("accounts").join(names, "name", "left_semi").collect()}
    unknown = sorted({account for account, _ in asked} - set(banks))
    if unknown:
        raise ValueError(f"No such account: {', '.join(unknown)}")
    by_path: dict[str, list[str]] = defaultdict(list)
    for account, path in asked:
        by_path[path].append(account)
    listed, sizes = _listed(store, by_path, banks)
    parts = []
    for bank in sorted(set(banks.values())):
        layout, own = find_layout(bank), listed.where(F.col("bank") == bank).select("path", "account_name")
        paths = [path for path, owners in by_path.items() if bank in (banks[owner] for owner in owners)]
        files = own.select("path").distinct()
        if files.count() == sum(sizes[path] for path in paths):
            raw = read_statements(spark, paths, layout, multi_line, staged=True)
        else:
            # Files that several paths list are read once.
            raw = read_parts(spark, _in_names(files), layout, multi_line)
        parts.append((layout, raw, own))
    return import_rows(store, parts, f"{stamp:%Y-%m-%dT%H:%M:%S.%f}", stamp, rules, strict)


def _listed(store: Store, by_path: dict[str, list[str]], banks: dict[str, str]) -> tuple[DataFrame, dict[str, int]]:
    """`path`, `account_name` and `bank` of all files once for each account, and the number of files of each path."""
    spark, rows, sizes = store.spark, [], dict.fromkeys(by_path, 0)
    folder = shared_folder(spark, "manifest")

    def put() -> None:
        frame = spark.createDataFrame(rows, "path string, account_name string, bank string")
        frame.write.mode("append").parquet(folder)
        rows.clear()

    for path, owners in by_path.items():
        for part in in_parts(spark, [path]):
            files = _files(store, part)
            sizes[path] += len(files)
            for owner in owners:
                rows += [(file, owner, banks[owner]) for file in files]
                if len(rows) >= shared.LISTED:
                    put()
    put()
    return stage(spark.read.parquet(folder).distinct(), "manifest-files"), sizes


def _in_names(files: DataFrame) -> Iterator[list[str]]:
    """The names, so many at a time."""
    names = (literal(row.path) for row in files.toLocalIterator())
    while part := list(islice(names, shared.LISTED)):
        yield part


def import_folder(
    store: Store,
    folder: str,
    layout: Layout,
    account_of: Callable[[Column], Column],
    imported_at: datetime | None = None,
    rules: Iterable[Rule] = (),
    strict: bool = False,
    multi_line: bool | None = None,
) -> ImportResult:
    """Import all statements of one layout below a folder or pattern.

    The account comes from the path of each file, so there is no list of files to hand over.
    """
    stamp = imported_at or datetime.now()
    raw = read_statements(store.spark, [folder], layout, multi_line, staged=True)
    files = raw.files.withColumn("account_name", account_of(F.col("path")))
    require_accounts(store, files)
    return import_rows(store, [(layout, raw, files)], f"{stamp:%Y-%m-%dT%H:%M:%S.%f}", stamp, rules, strict)


def require_accounts(store: Store, files: DataFrame) -> None:
    """Raise when a file belongs to no account: its rows would have nowhere to go."""
    names = store.read("accounts").select("name")
    unknown = files.join(names, F.col("account_name") == F.col("name"), "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"No such account: {unknown[0].account_name} ({unknown[0].path})")


def _files(store: Store, paths: list[str]) -> list[str]:
    listed = store.spark.read.text(paths).inputFiles()
    return sorted(re.sub("^file:/+", "/", unquote(file)) for file in listed)


def import_rows(
    store: Store,
    parts: list[tuple[Layout, RawStatements, DataFrame]],
    import_key: str,
    imported_at: datetime,
    rules: Iterable[Rule] = (),
    strict: bool = False,
) -> ImportResult:
    """Standardise, register and append rows that have been read.

    Each part has its layout, its rows, and a table of `path` and `account_name`: a file may have several accounts.
    """
    canonical = [(layout, raw, files, to_canonical(raw.rows, layout)) for layout, raw, files in parts]
    rejected_files = _all(raw.rejected_files for _, raw, _ in parts)
    rejected_rows = _all(rows.where(F.col(REASON).isNotNull()) for *_, rows in canonical)
    if strict:
        for layout, raw, _ in parts:
            require_all_files(raw, layout)
        bad = rejected_rows.select("_src_file", "_row", REASON).limit(1).collect()
        if bad:
            raise RejectedRows(f"{bad[0]._src_file}, row {bad[0]._row}: bad {bad[0][REASON]}")

    fitting = _all(
        files.join(raw.rejected_files, F.col("path") == F.col("source_file"), "left_anti") for _, raw, files in parts
    )
    statements = fitting.select(
        natural_id("account_name", "path", F.lit(import_key)).alias("id"),
        F.lit(imported_at).alias("created_at"),
        F.col("account_name").alias("account"),
        F.lit(imported_at).alias("import_timestamp"),
        F.col("path").alias("source_file"),
    )
    named = _all(
        # Balances run over a file before its rows are given to its accounts.
        to_ledger_values(with_balance(rows.where(F.col(REASON).isNull()).drop(REASON, RAW_LINE), layout, raw.hot_rows))
        .join(files.withColumnRenamed("path", "_path"), F.col("_src_file") == F.col("_path"))
        .drop("_path")
        for layout, raw, files, rows in canonical
    )
    rows = named.withColumn("imported_from", natural_id("account_name", "_src_file", F.lit(import_key)))
    staged = stage(first_wins(apply_rules(rows, rules), list(UNIQUE_KEY), _ORDER), "import")
    commit(store, [new_statements(store, statements), new_transactions(store, staged, imported_at)])
    return ImportResult(rejected_files, rejected_rows)


def _all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def new_statements(store: Store, statements: DataFrame) -> Change:
    """One history row per imported file; a repeated run of the same import adds nothing."""
    known = store.read("imported_statements").select("id")
    return Change("imported_statements", "append", not_stored(statements, known, ["id"], small=fits(statements)))


def register_statements(store: Store, statements: DataFrame) -> None:
    commit(store, [new_statements(store, statements)])


def to_transactions(rows: DataFrame, stamp: datetime) -> DataFrame:
    """Complete canonical rows with `account_name` and `imported_from` to ledger transactions."""
    return rows.withColumns(
        {
            "id": natural_id(*UNIQUE_KEY),
            "created_at": F.lit(stamp),
            "updated_at": F.lit(stamp),
            "month": F.trunc("date", "month"),
        }
    ).select(*TRANSACTIONS.names)


def new_transactions(store: Store, staged: DataFrame, stamp: datetime) -> Change:
    """Insert or ignore: the rows whose key the ledger does not hold yet.

    `staged` is unique on the key and stored, since it is read twice. The key contains the date, so only the
    months of the batch need to be looked at.
    """
    new = to_transactions(staged, stamp)
    months = store.months_of(new)
    ledger = store.read("transactions").where(F.col("month").isin(months))
    return Change("transactions", "append", not_stored(new, ledger, small=fits(new)))


def append_transactions(store: Store, staged: DataFrame, stamp: datetime) -> None:
    commit(store, [new_transactions(store, staged, stamp)])
