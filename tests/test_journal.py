"""Changes of several tables: whatever step fails, the ledger opens in the old state or in the new one."""

import shutil
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom import Ledger
from ledgerloom.sources import journal
from ledgerloom.sources.store import Store

LINES = ["a,b,c,d,e", "25/02/2026,x,k,one,1", "26/03/2026,x,k,two,2", "27/03/2026,x,k,three,3"]
MORE = ["a,b,c,d,e", "27/03/2026,x,k,four,4", "28/04/2026,x,k,five,5"]


class Crash(RuntimeError):
    pass


@pytest.fixture(scope="module")
def before(spark, tmp_path_factory):
    """A folder with a ledger of two accounts, and a file that is not imported yet."""
    root = tmp_path_factory.mktemp("journal")
    (root / "one.csv").write_text("\n".join(LINES))
    (root / "two.csv").write_text("\n".join(MORE))
    ledger = Ledger(spark, str(root / "ledger"))
    ledger.add_accounts([("Mine", "lloyds", "credit"), ("Ours", "lloyds", "credit")])
    ledger.import_statements([("Mine", str(root / "one.csv")), ("Ours", str(root / "one.csv"))])
    ledger.add_rule({"name": "^t"}, "groceries")
    return root


def state(ledger):
    rows = ledger.transactions.select("account_name", "date", "name", "amount", "category", "month")
    return (
        sorted(map(tuple, rows.collect())),
        sorted(map(tuple, ledger.statements.select("account", "source_file").collect())),
        sorted(row.name for row in ledger.accounts.collect()),
    )


OPERATIONS = {
    "delete": lambda ledger, root: ledger.delete_account("Ours"),
    "import": lambda ledger, root: ledger.import_statement("Mine", str(root / "two.csv")),
    "reclassify": lambda ledger, root: ledger.reclassify("bill", amount="<=-2"),
    "rules": lambda ledger, root: ledger.apply_rules(),
}


@pytest.mark.parametrize("operation", OPERATIONS)
def test_crash_at_every_step(spark, before, tmp_path, monkeypatch, operation):
    run = OPERATIONS[operation]
    old = state(Ledger(spark, str(before / "ledger")))
    real = {name: getattr(Store, name) for name in ("append", "overwrite", "replace_months", "remove")}
    real_stage = journal.stage
    seen, outcomes, new = 0, set(), None
    for fail_at in range(1, 20):
        calls = 0

        def step(name, store, *args):
            nonlocal calls
            calls += 1
            if calls < fail_at:
                return real[name](store, *args)
            if calls == fail_at:
                if name == "append":
                    # The job has moved some of its files.
                    real[name](store, args[0], args[1].orderBy("id").limit(1))
                raise Crash(name)
            raise Crash("after the crash")

        def stage(*args):
            nonlocal calls
            calls += 1
            if calls >= fail_at:
                raise Crash("stage")
            return real_stage(*args)

        root = tmp_path / f"at-{fail_at}"
        shutil.copytree(before / "ledger", root)
        ledger = Ledger(spark, str(root))
        with monkeypatch.context() as broken:
            for name in real:
                broken.setattr(Store, name, lambda store, *args, name=name: step(name, store, *args))
            broken.setattr(journal, "stage", stage)
            try:
                run(ledger, before)
                crashed = False
            except Crash:
                crashed = True
        reopened = state(Ledger(spark, str(root)))
        assert not list((root / "_journal").glob("*"))
        if not crashed:
            new = reopened
            break
        seen += 1
        outcomes.add(str(reopened))
    assert new is not None and new != old and seen >= 2
    assert outcomes == {str(old), str(new)}


def test_rewrite_keeps_other_rows(spark, before, tmp_path):
    shutil.copytree(before / "ledger", tmp_path / "ledger")
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    stamps = {r.id: r.updated_at for r in ledger.transactions.collect()}
    ledger.reclassify("bill", name="two")
    rows = ledger.transactions.collect()
    assert {r.name for r in rows if r.category == "bill"} == {"two"} and len(rows) == len(stamps)
    assert {r.name for r in rows if r.updated_at != stamps[r.id]} == {"two"}
    assert sorted(r.amount for r in rows if r.account_name == "Mine") == [Decimal(-3), Decimal(-2), Decimal(-1)]
    ledger.reclassify("bill", name="nothing like it")
    assert ledger.transactions.count() == len(stamps)


def test_unannounced_change_is_dropped(spark, before, tmp_path):
    shutil.copytree(before / "ledger", tmp_path / "ledger")
    left = tmp_path / "ledger" / "_journal" / "x" / "0"
    left.mkdir(parents=True)
    (left / "part").write_text("half a file")
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    assert not left.parent.exists()
    assert ledger.transactions.where(F.col("date") > datetime(2026, 3, 1)).count() == 4
