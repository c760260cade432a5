"""The ledger as one object: accounts, imports, queries, rules and totals over a stored ledger."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from datetime import date, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.cleaning import fold_name, known_category, known_name, quantise
from ledgerloom.functions.names import AmbiguousMatch, NoMatch, fold
from ledgerloom.functions.predicates import LEDGER
from ledgerloom.operators import relations, totals
from ledgerloom.operators.dedupe import first_wins
from ledgerloom.operators.filtering import all_of, by_id, by_name, filter_ledger
from ledgerloom.operators.resolve import resolve_names
from ledgerloom.operators.rules import (
    Rule,
    apply_rules,
    category_rule,
    load_rules,
    reclassify,
    rule_audit,
    rules_table,
)
from ledgerloom.plans import imports, retrieve
from ledgerloom.schema import ACCOUNT_TYPES, ACCOUNTS, CANONICAL_COLUMNS, TRANSACTIONS, UNIQUE_KEY
from ledgerloom.session import tune
from ledgerloom.sources.journal import Change, commit, recover
from ledgerloom.sources.layouts import find_layout
from ledgerloom.sources.shared import stage
from ledgerloom.sources.store import Store

_CHANGED = "_changed"


class Ledger:
    """A ledger stored under one folder. Results are lazy DataFrames.

    Opening it finishes or drops what a crash has left half done, so open it from one place at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = tune(spark)
        self.store = Store(spark, root)
        recover(self.store)

    # Tables

    @property
    def accounts(self) -> DataFrame:
        return self.store.read("accounts")

    @property
    def statements(self) -> DataFrame:
        return self.store.read("imported_statements")

    @property
    def transactions(self) -> DataFrame:
        return self.store.read("transactions")

    @property
    def rules(self) -> DataFrame:
        return self.store.read("rules")

    def account_names(self) -> DataFrame:
        return totals.elements_of(self.accounts, "name")

    # Accounts

    def add_account(self, name: str, bank: str, account_type: str = "current") -> None:
        """Add one account; the bank may be misspelt, the name must be new."""
        self.add_accounts([(name, bank, account_type)])

    def add_accounts(self, accounts: Iterable[tuple[str, str, str]]) -> None:
        """Add `(name, bank, account_type)` accounts, or none of them when one is refused."""
        rows = []
        now = datetime.now()
        for place, (name, bank, account_type) in enumerate(accounts):
            if account_type not in ACCOUNT_TYPES:
                raise ValueError(f"Unknown account type {account_type!r}; use one of {', '.join(ACCOUNT_TYPES)}")
            rows.append((None, now, name, find_layout(bank).name, account_type, True, place))
        schema = T.StructType([*ACCOUNTS.fields, T.StructField("place", T.IntegerType())])
        proposed = self.spark.createDataFrame(rows, schema)
        accepted, refused = relations.new_accounts(
            self.accounts, proposed, sorted({row[3] for row in rows}), ["place"]
        )
        taken = refused.limit(1).collect()
        if taken:
            raise ValueError(f"There is already an account named {taken[0].name!r}")
        self.store.append("accounts", accepted.withColumn("id", imports.natural_id("name")))

    def delete_account(self, name: str) -> None:
        """Remove an account and its transactions."""
        account = self.resolve_account(name)
        gone = self.spark.createDataFrame([(account,)], "name string")
        months = self.store.months_of(self.transactions.where(F.col("account_name") == account))
        touched = self.transactions.where(F.col("month").isin(months))
        commit(
            self.store,
            [
                Change("transactions", "months", relations.delete_accounts(touched, gone), months),
                Change("imported_statements", "replace", self.statements.where(F.col("account") != account)),
                Change("accounts", "replace", self.accounts.where(F.col("name") != account)),
            ],
        )

    def account(self, name: str) -> DataFrame:
        return by_name(self.accounts, self.resolve_account(name))

    def accounts_with_bank(self, bank: str) -> DataFrame:
        return relations.accounts_with_bank(self.accounts, find_layout(bank).name)

    def resolve_account(self, name: str) -> str:
        """The account meant by a possibly misspelt name."""
        exact = self.accounts.where(fold_name(F.col("name")) == fold(name)).select("name").limit(2).collect()
        if len(exact) == 1:
            return exact[0].name
        wanted = self.spark.createDataFrame([(name,)], "wanted string")
        found = resolve_names(wanted, "wanted", self.accounts, "name").collect()[0]
        if found.method == "none":
            raise NoMatch(f"No account resembles {name!r}")
        if found.match is None:
            raise AmbiguousMatch(f"{found.n_candidates} accounts resemble {name!r}")
        return found.match

    # Imports

    def import_statement(self, account: str, path: str, strict: bool = False) -> imports.ImportResult:
        """Import one statement file (or folder of them) of an account."""
        return self.import_statements([(self.resolve_account(account), path)], strict=strict)

    def import_statements(
        self, manifest: Iterable[tuple[str, str]], strict: bool = False, multi_line: bool | None = None
    ) -> imports.ImportResult:
        """Import `(account, path)` pairs; stored rules are applied on the way in."""
        return imports.import_statements(
            self.store, manifest, rules=load_rules(self.rules), strict=strict, multi_line=multi_line
        )

    def add_transactions(
        self, account: str, rows: DataFrame, order: list[str], imported_from: str | None = None
    ) -> None:
        """Insert or ignore canonical rows; of rows with one key, the first in `order` counts.

        `imported_from`, if given, must be the id of a registered statement.
        """
        name = self.resolve_account(account)
        if imported_from is not None and by_id(self.statements, imported_from).isEmpty():
            raise ValueError(f"No statement has the id {imported_from!r}")
        shaped = rows.select(
            *[F.col(c) for c in CANONICAL_COLUMNS if c not in ("name", "category", "amount", "balance")],
            known_name(F.col("name")).alias("name"),
            known_category(F.col("category")).alias("category"),
            quantise(F.col("amount").cast("decimal(24,10)")).alias("amount"),
            quantise(F.col("balance").cast("decimal(24,10)")).alias("balance"),
            *[F.col(c) for c in order if c not in CANONICAL_COLUMNS],
            F.lit(name).alias("account_name"),
            F.lit(imported_from).cast("string").alias("imported_from"),
        ).dropna(subset=["date", "amount", "balance", "currency"])
        staged = stage(first_wins(shaped, list(UNIQUE_KEY), order), "transactions")
        imports.append_transactions(self.store, staged, datetime.now())

    # Queries

    def filter(self, table: str = "transactions", /, require_nonempty: bool = False, **filters: Any) -> DataFrame:
        rows = self.store.read(table)
        return filter_ledger(retrieve.in_months(rows, filters), require_nonempty, **filters)

    def from_id(self, id: str, table: str = "transactions") -> DataFrame:
        return by_id(self.store.read(table), id)

    def table_ordered_by_id(self, table: str) -> DataFrame:
        return self.store.read_ordered(table)

    def count(self, table: str) -> int:
        return self.store.read(table).count()

    def retrieve_transactions(self, show_metadata: bool = False, **filters: Any) -> DataFrame:
        return retrieve.retrieve_transactions(self.transactions, show_metadata, **filters)

    def transactions_in_date_range(
        self, from_date: str | date | datetime, to_date: str | date | datetime, show_metadata: bool = False
    ) -> DataFrame:
        return retrieve.transactions_in_date_range(self.transactions, from_date, to_date, show_metadata)

    def from_account(self, name: str) -> DataFrame:
        return relations.from_account(self.transactions, self.resolve_account(name))

    def from_bank(self, bank: str) -> DataFrame:
        return relations.from_bank(self.transactions, self.accounts, find_layout(bank).name)

    # Totals

    def account_summary(self) -> DataFrame:
        return totals.account_summary(self.transactions, self.accounts)

    def summary_of(self, name: str) -> DataFrame:
        """Outgoings, incomings, net and turnover of one account."""
        account = self.resolve_account(name)
        return totals.account_summary(relations.from_account(self.transactions, account), by_name(self.accounts, account))

    def dashboard(self, categories: list[str] | None = None, **filters: Any) -> DataFrame:
        rows = retrieve.retrieve_transactions(self.transactions, **filters)
        return totals.dashboard(rows, self.accounts, categories)

    def import_history(self) -> DataFrame:
        return totals.import_history(self.transactions, self.statements)

    def integrity_report(self) -> DataFrame:
        return relations.integrity_report(self.transactions, self.accounts, self.statements)

    # Rules

    def add_rule(self, conditions: Mapping[str, Any], category: str, priority: int = 0, name: str | None = None) -> Rule:
        """Store a rule in the filter language; it applies to later imports."""
        rule = category_rule(conditions, category, priority, name=name)
        self.store.append("rules", rules_table(self.spark, [rule]))
        return rule

    def add_rules(self, rules: Iterable[Rule]) -> None:
        self.store.append("rules", rules_table(self.spark, rules))

    def rule_audit(self) -> DataFrame:
        return rule_audit(self.transactions, load_rules(self.rules))

    def apply_rules(self) -> None:
        """Apply the stored rules to the stored transactions."""
        rules = load_rules(self.rules)
        # The key of a stored row is what its id is made from, and no two rows may share one.
        moved = sorted({a.apply_to for rule in rules for a in rule.actions} & {*UNIQUE_KEY, "id", "month"})
        if moved:
            raise ValueError(f"Rules cannot change {', '.join(moved)} of stored transactions")
        self._rewrite(lambda rows: apply_rules(rows, rules, changed=_CHANGED))

    def reclassify(self, category: str, /, **filters: Any) -> None:
        """Set the category of all transactions that satisfy the filters."""

        def change(rows: DataFrame) -> DataFrame:
            condition = all_of(rows, filters, LEDGER)
            return reclassify(rows, condition, category, changed=_CHANGED)

        self._rewrite(change, retrieve.in_months(self.transactions, filters))

    def _rewrite(self, change: Callable[[DataFrame], DataFrame], within: DataFrame | None = None) -> None:
        """Replace changed rows in the months that hold them, before or after the change, and stamp those rows.

        All changed rows are among `within`. The change is computed once; ids, which it keeps, tell the rows that
        it replaces.
        """
        hits = change(self.transactions if within is None else within).where(F.col(_CHANGED))
        was = F.col("month").alias("_was")
        hits = stage(
            hits.select(*[c for c in TRANSACTIONS.names if c not in ("updated_at", "month")], was)
            .withColumns({"updated_at": F.current_timestamp(), "month": F.trunc("date", "month")}),
            "changed-rows",
        )
        months = self.store.months_of(hits.select("month").unionByName(hits.select(F.col("_was").alias("month"))))
        if not months:
            return
        others = self.transactions.where(F.col("month").isin(months)).join(
            hits.select("id", F.col("_was").alias("month")), ["id", "month"], "left_anti"
        )
        rows = others.select(*TRANSACTIONS.names).unionByName(hits.select(*TRANSACTIONS.names))
        commit(self.store, [Change("transactions", "months", rows, months)])
