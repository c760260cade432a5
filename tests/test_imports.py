"""Statement files through the whole import, into a stored ledger and back."""

import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ledgerloom import CHASE, LLOYDS_CC, MONZO, Ledger, Rule
from ledgerloom.operators.rules import Action, Condition
from ledgerloom.plans.imports import RejectedRows
from ledgerloom.plans.standardise import rejected, standardise
from ledgerloom.sources import shared, statements
from ledgerloom.sources.layouts import Layout
from ledgerloom.sources.shared import in_parts
from ledgerloom.sources.statements import LayoutMismatch, read_statements, require_all_files
from ledgerloom.streaming.ingest import stream_statements

CHASE_LINES = [
    '"My statement"',
    '"Day","Clock","Kind","Who","Sum","Money","Left"',
    '"17 May 2025","10:54","Purchase","Fish &amp; Chips","-8.45","GBP","116.29"',
    '"18 May 2025","11:00","Purchase | EUR 81.40 | FX rate","Airline","-£1,031.56","GBP","86.08"',
    '"16 May 2025","09:00","Cash withdrawal | EUR 20","Till","-20","GBP","124.74"',
    '"19 May 2025","12:00","Transfer","Round up","-0.10","GBP","85.98"',
    '"20 May 2025","12:00","Transfer","Bad money","lots","GBP","85.98"',
    '"32 May 2025","12:00","Transfer","Bad date","1","GBP","85.98"',
    '"21 May 2025","12:00","Transfer","Short"',
]
LLOYDS_LINES = [
    "Booked,Cleared,Kind,Who,Sum",
    "25/02/2026,26/02/2026,Card in shop,CORNER BAKERY 12,£4.20",
    "25/02/2026,26/02/2026,Card in shop,CORNER BAKERY 12,£4.20",
    "24/02/2026,26/02/2026,Card in shop,CORNER BAKERY 12,£4.20",
    "26/02/2026,26/02/2026,Paid in,NA,-5",
]
MONZO_HEADER = (
    "Key,Day,Clock,Kind,Who,Sign,Group,Sum,Money,Foreign sum,Foreign money,"
    "Remarks,Place,Slip,Text,Split,Spent,Got"
)
MONZO_LINES = [
    MONZO_HEADER,
    "tx_1,01/05/2025,02:01:58,Pot transfer,Round Ups Pot,,Transfers,0.05,GBP,0.05,GBP,,,,0.05,,,",
    'tx_2,02/05/2025,03:00:00,Card,,,General,-9.99,GBP,-9.99,GBP,"Flex, one\nof three",,,x,,,',
    "tx_3,03/05/2025,03:00:00,Fee,,,General,-2,GBP,-2,GBP,OVERDRAFT charge,,,x,,,",
]


def write(folder, name, lines):
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / name
    path.write_text("\n".join(lines))
    return str(path)


def test_chase(spark, tmp_path):
    path = write(tmp_path, "a b+c.csv", CHASE_LINES)
    raw = read_statements(spark, [path], CHASE)
    rows = standardise(raw, CHASE).collect()
    assert [(r.date, r.name, r.category, r.amount, r.balance, r.notes) for r in rows] == [
        (datetime(2025, 5, 16, 9), "Till", "cash_withdrawal", Decimal("-20.00"), Decimal("124.74"), "Cash withdrawal | EUR 20"),
        (datetime(2025, 5, 17, 10, 54), "Fish & Chips", "Purchase", Decimal("-8.45"), Decimal("116.29"), ""),
        (datetime(2025, 5, 18, 11), "Airline", "Purchase", Decimal("-1031.56"), Decimal("86.08"), "EUR 81.40 | FX rate"),
        (datetime(2025, 5, 19, 12), "Round up", "roundup", Decimal("-0.10"), Decimal("85.98"), ""),
    ]
    assert rows[0]._src_file == path
    reasons = {r.name: r.reason for r in rejected(raw, CHASE).collect()}
    assert reasons == {"Bad money": "amount", "Bad date": "date", "Short": "columns"}
    assert raw.rejected_files.count() == 0


def test_lloyds_running_balance(spark, tmp_path):
    raw = read_statements(spark, [write(tmp_path, "l.csv", LLOYDS_LINES)], LLOYDS_CC)
    rows = standardise(raw, LLOYDS_CC).collect()
    assert [(r.date.day, r.name, r.category, r.currency, r.amount, r.balance) for r in rows] == [
        (24, "CORNER BAKERY 12", "None", "GBP", Decimal("-4.20"), Decimal("-4.20")),
        (25, "CORNER BAKERY 12", "None", "GBP", Decimal("-4.20"), Decimal("-8.40")),
        (25, "CORNER BAKERY 12", "None", "GBP", Decimal("-4.20"), Decimal("-12.60")),
        (26, None, "None", "GBP", Decimal("5.00"), Decimal("-7.60")),
    ]
    assert rows[1]._row < rows[2]._row


@pytest.mark.parametrize("large_file", [10, 300, 100_000])
def test_monzo_cells_over_line_ends(spark, tmp_path, large_file):
    plain = write(tmp_path, "plain.csv", [MONZO_HEADER, MONZO_LINES[1]])
    spanning = write(tmp_path, "spanning.csv", MONZO_LINES)
    raw = read_statements(spark, [plain, spanning], MONZO, large_file=large_file)
    rows = standardise(raw, MONZO).where(F.col("_src_file") == spanning).collect()
    assert [(r.date, r.name, r.category, r.notes, r.balance) for r in rows] == [
        (datetime(2025, 5, 1, 2, 1, 58), "Round Ups Pot", "roundup", None, Decimal("0.05")),
        (datetime(2025, 5, 2, 3), "Flex payment", "General", "Flex, one\nof three", Decimal("-9.94")),
        (datetime(2025, 5, 3, 3), "Overdraft fees", "fee", "OVERDRAFT charge", Decimal("-11.94")),
    ]
    assert standardise(raw, MONZO).count() == 4


def test_large_files_are_split_and_keep_their_order(spark, tmp_path):
    lines = ["Date,Cleared,Type,Name,Amount"] + [f"01/01/2025,02/01/2025,x,row {i},-{i}" for i in range(1, 3001)]
    path = write(tmp_path, "large.csv", lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        raw = read_statements(spark, [path], LLOYDS_CC, large_file=1000)
        assert raw.hot_rows is not None
        rows = standardise(raw, LLOYDS_CC).orderBy("_row").select("name", "balance").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.name for r in rows] == [f"row {i}" for i in range(1, 3001)]
    assert [r.balance for r in rows] == [Decimal(i * (i + 1) // 2) for i in range(1, 3001)]


def cells_of(rng):
    """Cells as they occur: plain, quoted, with delimiters, quotes and line ends inside, and with stray quotes."""
    kind = rng.random()
    if kind < 0.55:
        return rng.choice(["x", "", "12.5", "a b", "é", '5" pipe', 'b"', " lead"])
    inner = "".join(rng.choice(["a", ",", '""', "\n", " ", "word", "\n\n"]) for _ in range(rng.randint(0, 6)))
    return f'"{inner}"'


@pytest.mark.parametrize("seed", range(3))
def test_rows_over_line_ends_in_blocks(spark, tmp_path, seed):
    """Blocks of a few bytes give the same rows as whole files, in the same order, whatever the quotes."""
    rng = random.Random(seed)
    layout = Layout("Any", ("date", "name", "notes", "ignore"))
    paths = []
    for n in range(3):
        lines = ["d,n,t,i"]
        for i in range(120):
            width = 4 if rng.random() < 0.9 else rng.randint(1, 6)
            lines.append(",".join([f"{n}-{i}", *(cells_of(rng) for _ in range(width - 1))]))
        paths.append(write(tmp_path, f"s{n}.csv", lines))
    whole = read_statements(spark, paths, layout, multi_line=True)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        raw = read_statements(spark, paths, layout, large_file=10)
        blocks = raw.rows.rdd.getNumPartitions()
        rows = raw.rows.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert blocks > 1

    def ordered(rows):
        rows = sorted(rows, key=lambda r: (r._src_file, r._row))
        assert len({(r._src_file, r._row) for r in rows}) == len(rows)
        return [(r._src_file, r._c0, r._c1, r._c2, r._c3, r._raw_line is None) for r in rows]

    assert ordered(rows) == ordered(whole.rows.collect())


def test_stray_opening_quote(spark, tmp_path):
    """A quote that opens a cell by mistake costs the rows up to the next quoted cell, not the rest of the file."""
    plain = lambda i: f"01/01/2025,x,k,row {i},-{i}"
    lines = ["a,b,c,d,e", *map(plain, range(200)), '01/01/2025,x,k,"open,1', *map(plain, range(200, 210))]
    lines += ['01/01/2025,x,k,"closed",1', *map(plain, range(210, 600))]
    path = write(tmp_path, "stray.csv", lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        raw = read_statements(spark, [path], LLOYDS_CC, large_file=10)
        rows = standardise(raw, LLOYDS_CC).orderBy("_row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    names = [r.name for r in rows]
    assert names.pop(200).startswith('"open,1\n')
    assert names == [f"row {i}" for i in range(600) if not 200 <= i < 210]


def test_cell_without_end(spark, tmp_path, monkeypatch):
    """A cell that never closes makes one misfit row, shown by its first lines; the rows before it stand."""
    monkeypatch.setattr(statements, "RECORD_LINES", 20)
    lines = ["a,b,c,d,e", "25/02/2026,x,k,one,1", '26/02/2026,x,k,"two,2', *["27/02/2026,x,k,lost,3"] * 500]
    path = write(tmp_path, "open.csv", lines)
    raw = read_statements(spark, [path], LLOYDS_CC, large_file=10)
    assert [r.name for r in standardise(raw, LLOYDS_CC).collect()] == ["one"]
    (misfit,) = raw.rows.where("_raw_line is not null").collect()
    assert misfit._raw_line.startswith('26/02/2026,x,k,"two') and misfit._raw_line.count("lost") == 19


@pytest.mark.parametrize("large_file", [10, 100_000])
def test_file_of_another_layout(spark, tmp_path, large_file):
    good = write(tmp_path, "good.csv", LLOYDS_LINES)
    bad = write(tmp_path, "bad.csv", ["a,b", "1,2", "25/02/2026,x,y,z,1"])
    raw = read_statements(spark, [good, bad], LLOYDS_CC, large_file=large_file)
    assert [(r.source_file, r.expected_columns) for r in raw.rejected_files.collect()] == [(bad, 5)]
    assert {r._src_file for r in raw.rows.collect()} == {good}
    with pytest.raises(LayoutMismatch, match="5 columns"):
        require_all_files(raw, LLOYDS_CC)


def test_steps_run_in_order(spark, tmp_path):
    seen = Layout("Seen", ("date", "name", "amount"), category_map={"raw": "leisure"})
    seen = seen.with_after(lambda df: df.withColumn("name", F.lit("second")), 1)
    seen = seen.with_after(lambda df: df.withColumn("name", F.lit("first")), 0)
    seen = seen.with_after(lambda df: df.withColumn("category", F.lit("raw")), 0)
    seen = seen.with_before(lambda df: df.withColumn(seen.raw("amount"), F.lit("10000")))
    raw = read_statements(spark, [write(tmp_path, "s.csv", ["d,n,a", "1/2/2025,x,1"])], seen)
    row = standardise(raw, seen).collect()[0]
    assert (row.name, row.category, row.amount) == ("second", "leisure", Decimal("10000.00"))


@pytest.fixture
def ledger(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    ledger.add_account("Main", "chse")
    ledger.add_account("Card", "loyds", "credit")
    ledger.add_account("Pot", "Monzo")
    return ledger


def manifest(tmp_path):
    return [
        ("Main", write(tmp_path / "main", "c.csv", CHASE_LINES)),
        ("Card", write(tmp_path / "card", "l.csv", LLOYDS_LINES)),
        ("Pot", write(tmp_path / "pot", "m.csv", MONZO_LINES)),
    ]


def test_import_twice_is_import_once(ledger, tmp_path):
    files = manifest(tmp_path)
    result = ledger.import_statements(files)
    assert result.rejected_rows.count() == 3
    assert ledger.count("transactions") == 11
    once = {tuple(r) for r in ledger.retrieve_transactions().collect()}
    ledger.import_statements(files)
    assert {tuple(r) for r in ledger.retrieve_transactions().collect()} == once
    assert ledger.count("transactions") == 11
    assert ledger.count("imported_statements") == 6
    assert ledger.integrity_report().count() == 0
    history = {(r.source_file, r.n_tx) for r in ledger.import_history().collect()}
    assert (files[0][1], 4) in history and (files[0][1], 0) in history


def test_accounts(ledger):
    assert {r.name for r in ledger.account_names().collect()} == {"Main", "Card", "Pot"}
    assert ledger.account("crd").collect()[0].bank == "LloydsCC"
    assert [r.name for r in ledger.accounts_with_bank("lloyds").collect()] == ["Card"]
    with pytest.raises(ValueError, match="already an account"):
        ledger.add_account("Main", "Chase")
    with pytest.raises(ValueError, match="account type"):
        ledger.add_account("Other", "Chase", "piggy bank")


def test_queries_on_a_stored_ledger(ledger, tmp_path):
    ledger.import_statement("main", manifest(tmp_path)[0][1])
    ledger.import_statement("card", manifest(tmp_path)[1][1])
    found = ledger.retrieve_transactions(name="^corner", amount="<0")
    assert found.columns == ["date", "name", "category", "amount", "balance", "currency", "notes", "account_name"]
    assert found.count() == 3
    ranged = ledger.transactions_in_date_range("17 May 2025", "18/05/2025 11:00", show_metadata=True)
    assert {r.name for r in ranged.collect()} == {"Fish & Chips", "Airline"}
    assert "PartitionFilters: [isnotnull(month" in ranged._jdf.queryExecution().toString()
    assert ledger.from_bank("Lloyds").count() == 4
    summary = ledger.summary_of("Card").collect()[0]
    assert (summary.outgoings, summary.incomings, summary.net, summary.turnover) == (
        Decimal("-12.60"),
        Decimal("5.00"),
        Decimal("-7.60"),
        Decimal("17.60"),
    )
    one = ledger.retrieve_transactions(show_metadata=True, name="Airline").collect()[0]
    assert ledger.from_id(one.id).collect()[0].name == "Airline"
    ids = [r.id for r in ledger.table_ordered_by_id("transactions").collect()]
    assert ids == sorted(ids)


def test_rules_on_import_and_afterwards(ledger, tmp_path):
    files = manifest(tmp_path)
    ledger.add_rule({"name": "^corner"}, "leisure")
    ledger.import_statements(files)
    assert ledger.filter(category="leisure").count() == 3
    ledger.add_rule({"name": "^corner", "amount": (-200, 0)}, "groceries", priority=1)
    ledger.add_rules([Rule((Condition("name", "eq", "Till"),), (Action("notes", "append", "!"),))])
    before = {r.id: r.updated_at for r in ledger.transactions.collect()}
    ledger.apply_rules()
    after = ledger.transactions.collect()
    assert sorted(r.name for r in after if r.updated_at > before[r.id]) == ["CORNER BAKERY 12"] * 3 + ["Till"]
    assert ledger.filter(category="groceries").count() == 3
    assert ledger.filter(name="Till").collect()[0].notes == "Cash withdrawal | EUR 20!"
    assert ledger.count("transactions") == 11
    ledger.reclassify("bill", category="groceries", date=("24/02/2026", "24/02/2026"))
    assert ledger.filter(category="bill").count() == 1
    assert ledger.filter(category="groceries").count() == 2


def test_delete_account_removes_emptied_months(ledger, tmp_path):
    ledger.import_statements(manifest(tmp_path))
    ledger.delete_account("Card")
    assert ledger.count("transactions") == 7
    assert {r.name for r in ledger.account_names().collect()} == {"Main", "Pot"}
    assert ledger.integrity_report().count() == 0


def test_strict_import(ledger, tmp_path):
    files = manifest(tmp_path)
    with pytest.raises(RejectedRows):
        ledger.import_statements(files, strict=True)
    assert ledger.count("transactions") == 0
    with pytest.raises(ValueError, match="No such account"):
        ledger.import_statements([("Nobody", files[0][1])])


def test_add_transactions(ledger, spark):
    rows = spark.createDataFrame(
        [
            (datetime(2025, 1, 1), None, None, 0.125, 1.0, "GBP", None, 1),
            (datetime(2025, 1, 1), None, "x", 9.0, 1.0, "GBP", None, 2),
            (datetime(2025, 1, 2), "a", "x", None, 1.0, "GBP", None, 3),
        ],
        "date timestamp_ntz, name string, category string, amount double, balance double, currency string, "
        "notes string, place int",
    )
    ledger.add_transactions("Main", rows, ["place"])
    ledger.add_transactions("Main", rows, ["place"])
    stored = ledger.retrieve_transactions().collect()
    assert [(r.name, r.category, r.amount, r.account_name) for r in stored] == [
        ("Unknown", "UNCATEGORISED", Decimal("0.12"), "Main")
    ]


def test_stream(ledger, tmp_path, spark):
    drops = tmp_path / "drops"
    checkpoint = str(tmp_path / "checkpoint")

    def run():
        account = lambda path: F.element_at(F.split(path, "/"), -2)
        stream_statements(ledger.store, str(drops / "*"), LLOYDS_CC, account, checkpoint).awaitTermination()

    write(drops / "Card", "one.csv", LLOYDS_LINES)
    run()
    assert ledger.count("transactions") == 4
    write(drops / "Card", "two.csv", [LLOYDS_LINES[0], "01/03/2026,x,y,New,3", LLOYDS_LINES[3]])
    run()
    run()
    # The repeated row has the balance it had in the first file, so it is the same transaction.
    assert sorted(r.name for r in ledger.transactions.collect()) == [*["CORNER BAKERY 12"] * 3, "New", "Unknown"]
    assert ledger.count("imported_statements") == 2


def test_manifest_with_repeats(spark, tmp_path):
    """A file counts once for an account, and goes whole to every account that lists it."""
    path = write(tmp_path / "in", "card.csv", ["a,b,c,d,e", "25/02/2026,x,k,one,1", "26/02/2026,x,k,two,2"])
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    ledger.add_accounts([("Mine", "lloyds", "credit"), ("Ours", "lloyds", "credit")])
    ledger.import_statements([("Mine", path), ("Mine", path), ("Mine", str(tmp_path / "in")), ("Ours", path)])
    rows = ledger.transactions.collect()
    for account in ("Mine", "Ours"):
        own = sorted((r.name, r.amount, r.balance) for r in rows if r.account_name == account)
        assert own == [("one", Decimal("-1.00"), Decimal("-1.00")), ("two", Decimal("-2.00"), Decimal("-3.00"))]
    assert ledger.statements.count() == 2
    assert sorted(r.account for r in ledger.statements.collect()) == ["Mine", "Ours"]


def test_blank_lines_are_no_rows(spark, tmp_path):
    path = write(tmp_path, "card.csv", ["   ", "", "a,b,c,d,e", "25/02/2026,x,k,one,1", " \t ", "26/02/2026,x,k,two,2"])
    found = []
    for large_file in (10, 10**8):
        raw = read_statements(spark, [path], LLOYDS_CC, large_file=large_file)
        assert raw.rejected_files.count() == 0
        found.append(sorted((r.name, r.amount) for r in standardise(raw, LLOYDS_CC).collect()))
    assert found[0] == found[1] == [("one", Decimal("-1.00")), ("two", Decimal("-2.00"))]


def test_ledger_refuses_broken_references(spark, tmp_path):
    path = write(tmp_path / "in", "card.csv", ["a,b,c,d,e", "25/02/2026,x,k,one,1"])
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    ledger.add_accounts([("Mine", "lloyds", "credit"), ("Idle", "lloyds", "credit")])
    ledger.import_statement("Mine", path)
    totals = {r.account_name: (r.net, r.n_tx) for r in ledger.account_summary().collect()}
    assert totals == {"Mine": (Decimal("-1.00"), 1), "Idle": (Decimal("0.00"), 0)}
    assert ledger.summary_of("idle").first().turnover == 0
    with pytest.raises(ValueError, match="No statement has the id"):
        ledger.add_transactions("Mine", ledger.transactions, ["date"], imported_from="nowhere")
    ledger.add_rules([Rule((Condition("name", "eq", "one"),), (Action("name", "set", "other"),))])
    with pytest.raises(ValueError, match="cannot change name"):
        ledger.apply_rules()
    plan = ledger.transactions
    assert [r.name for r in plan.collect()] == ["one"]


def test_date_filters_choose_months(spark, tmp_path):
    path = write(tmp_path / "in", "card.csv", ["a,b,c,d,e", "25/02/2026,x,k,one,1", "26/03/2026,x,k,two,2"])
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    ledger.add_account("Mine", "lloyds", "credit")
    ledger.import_statement("Mine", path)
    settings = ["25/02/2026", ["25/02/2026", "1 May 2026"], ("1/2/2026", "1/4/2026"), ">='1 Mar 2026'"]
    for setting, count in zip(settings, (1, 1, 2, 1), strict=True):
        found = ledger.filter(date=setting)
        assert found.count() == count
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: []" not in plan and "month" in plan.split("PartitionFilters:")[1].split("]")[0]
    ledger.reclassify("rent", date="26/03/2026")
    assert {r.name: r.category for r in ledger.transactions.collect()} == {"one": "None", "two": "rent"}


def test_many_small_files_share_tasks(spark, tmp_path, monkeypatch):
    for number in range(600):
        write(tmp_path / "in", f"{number}.csv", [LLOYDS_LINES[0], f"25/02/2026,x,k,n{number},1"])
    tasks, number_rows = [], statements.number_rows
    monkeypatch.setattr(
        statements, "number_rows", lambda rows, blocks: tasks.append(rows.rdd.getNumPartitions()) or number_rows(rows, blocks)
    )
    raw = read_statements(spark, [str(tmp_path / "in")], LLOYDS_CC, staged=True)
    assert raw.rows.select("_c3").distinct().count() == 600
    assert max(tasks) <= 10


def test_statement_files_of_many_users(spark, tmp_path, monkeypatch):
    from registry import statements as registry

    monkeypatch.setattr(registry, "FOLDER_FILES", 5)
    rows = [(event, datetime(2025, 1, 1), event % 17, "view", 1.5, None) for event in range(100)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    for layout, head in ((CHASE, 2), (LLOYDS_CC, 1), (MONZO, 1)):
        pattern = registry.write_statements(events, layout, f"file://{tmp_path}/{layout.name}")
        files = list((tmp_path / layout.name).glob("part=*/account=*/*"))
        assert len({file.parent.parent for file in files}) > 1
        # Imports give ties to the first file: the order of files is that of accounts, whatever the folders.
        by_path = [file.parent.name for file in sorted(files, key=str)]
        assert by_path == sorted(by_path, key=lambda name: f"{name}/")
        lines = {file.parent.name: file.read_text().splitlines() for file in files}
        assert {name: len(own) for name, own in lines.items()} == {
            f"account={layout.name}-{user}": head + len(range(user, 100, 17)) for user in range(17)
        }
        raw = read_statements(spark, [pattern], layout, staged=True)
        assert raw.rows.count() == 100 and raw.files.count() == 17
        if layout is MONZO:
            assert [line.split(",")[0] for line in lines["account=Monzo-3"]] == ["Key", *(f'"{n}"' for n in range(3, 100, 17))]


def test_folders_are_read_in_parts(spark, tmp_path, monkeypatch):
    names = ["a.csv", "b [1].csv", "c{d,e}.csv", "f*g.csv", "h+i j%20.csv", "k.csv", "l.csv"]
    for name in names:
        write(tmp_path / "flat", name, [LLOYDS_LINES[0], f"25/02/2026,x,k,{name},1"])
        write(tmp_path / "deep" / f"part={len(name)}" / f"of={name[0]}", "s.csv", [LLOYDS_LINES[0], f"25/02/2026,x,k,{name},1"])
    for name in ("_no.csv", ".no.csv"):
        write(tmp_path / "flat", name, ["a,b", "1,2"])
    # A folder that the pattern does not find anything in.
    write(tmp_path / "deep" / "part=other", "s.txt", ["a,b"])
    patterns = [str(tmp_path / "flat"), f"{tmp_path}/flat/*.csv", f"{tmp_path}/deep/part=*/of=*", f"{tmp_path}/deep/*/of=?"]
    for pattern in patterns:
        whole = read_statements(spark, [pattern], LLOYDS_CC)
        expected = sorted((r._c3, r._src_file, r._row) for r in whole.rows.collect())
        assert len(expected) == len(names)
        for most in (2, 3, 100):
            monkeypatch.setattr(shared, "LISTED", most)
            parts = list(in_parts(spark, [pattern]))
            assert most == 100 or len(parts) > 2
            files = [spark.read.text(part).inputFiles() for part in parts]
            assert max(map(len, files)) <= most and sum(map(len, files)) == len(names)
            raw = read_statements(spark, [pattern], LLOYDS_CC, staged=True)
            assert sorted((r._c3, r._src_file, r._row) for r in raw.rows.collect()) == expected
            monkeypatch.undo()
    with pytest.raises(AnalysisException):
        read_statements(spark, [f"{tmp_path}/nothing/*/here"], LLOYDS_CC, staged=True)


def test_manifest_names_are_held_in_parts(spark, tmp_path, monkeypatch):
    for name in ("a", "b [1]", "c", "d e+f", "g", "h", "i"):
        write(tmp_path / "in", f"{name}.csv", ["a,b,c,d,e", f"25/02/2026,x,k,{name},1"])
    folder, one = str(tmp_path / "in"), str(tmp_path / "in" / "a.csv")
    manifests = {
        "once": [("Mine", folder), ("Mine", folder), ("Ours", folder)],
        "overlapping": [("Mine", folder), ("Ours", one), ("Mine", f"{folder}/*.csv"), ("Ours", folder), ("Mine", one)],
    }
    monkeypatch.setattr(shared, "LISTED", 2)
    sizes, create = [], type(spark).createDataFrame

    def counted(self, data, *rest, **more):
        sizes.append(len(data) if isinstance(data, list) else 0)
        return create(self, data, *rest, **more)

    for case, manifest in manifests.items():
        ledger = Ledger(spark, str(tmp_path / case))
        ledger.add_accounts([("Mine", "lloyds", "credit"), ("Ours", "lloyds", "credit")])
        monkeypatch.setattr(type(spark), "createDataFrame", counted)
        ledger.import_statements(manifest)
        monkeypatch.setattr(type(spark), "createDataFrame", create)
        rows = sorted((r.account_name, r.name, r.balance) for r in ledger.transactions.collect())
        names = sorted(["a", "b [1]", "c", "d e+f", "g", "h", "i"])
        assert rows == [(account, name, Decimal("-1.00")) for account in ("Mine", "Ours") for name in names]
        assert ledger.count("imported_statements") == 14
    assert max(sizes) <= 4


def test_stream_by_folder(ledger, tmp_path, spark):
    drops, checkpoint = tmp_path / "drops", str(tmp_path / "checkpoint")

    def run(**more):
        account = lambda path: F.element_at(F.split(path, "/"), -2)
        pattern = f"{drops}/part=*/*"
        return stream_statements(ledger.store, pattern, LLOYDS_CC, account, checkpoint, by_folder=True, files_at_once=2, **more)

    for part in range(3):
        for number in range(3):
            write(drops / f"part={part}" / "Card", f"{number}.csv", [LLOYDS_LINES[0], f"25/02/2026,x,k,n{part}{number},1"])
    (drops / "part=empty").mkdir()
    for _ in range(2):
        query = run()
        query.awaitTermination()
        assert ledger.count("transactions") == ledger.count("imported_statements") == 9
    # One stream for each folder that holds files, batches of two files.
    assert len([found for found in (tmp_path / "checkpoint").iterdir() if found.is_dir()]) == 3
    assert ledger.statements.select("id", "source_file").distinct().count() == 9
    batches = [sorted(int(b.name) for b in (found / "commits").glob("[0-9]")) for found in (tmp_path / "checkpoint").iterdir()]
    assert batches == [[0, 1]] * 3
    write(drops / "part=1" / "Card", "late.csv", [LLOYDS_LINES[0], "25/02/2026,x,k,late,1"])
    run().awaitTermination()
    assert ledger.count("transactions") == ledger.count("imported_statements") == 10
    with pytest.raises(ValueError):
        run(available_now=False)
