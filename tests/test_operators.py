"""Column functions and operators on small frames, brute force where there is no SQL for it."""

from datetime import date, datetime, time
from decimal import Decimal
from difflib import get_close_matches

import pytest
from pyspark.sql import functions as F

from ledgerloom import Action, Condition, Matches, PerValue, Rule, Text, category_rule, filter_frame, filter_ledger
from ledgerloom.functions.cleaning import clean_money, decode_html, null_if_na, quantise
from ledgerloom.functions.dates import as_timestamp, parse_dates
from ledgerloom.functions.names import AmbiguousMatch, CloseNames, NoMatch, fold, match_name, resolve_name
from ledgerloom.operators import relations
from ledgerloom.operators.dedupe import first_wins
from ledgerloom.operators.filtering import NoRows
from ledgerloom.operators.lookup import lookup
from ledgerloom.operators import resolve
from ledgerloom.operators.resolve import resolve_names
from ledgerloom.operators.rules import apply_rules, load_rules, rules_from_json, rules_table, tag_rules
from ledgerloom.schema import DIRECTIONS
from ledgerloom.sources.layouts import (
    CHASE,
    LLOYDS_CC,
    MONZO,
    chase_foreign_purchases,
    chase_round_ups,
    chase_withdrawals,
    find_layout,
    monzo_flex,
    monzo_overdraft,
    monzo_round_ups,
)
from ledgerloom.sources.shared import shared_folder


def one(df, *columns):
    single = len(columns) == 1 and columns != ("*",)
    return [row[0] if single else tuple(row) for row in df.select(*columns).collect()]


def column(spark, values, type="string"):
    return spark.createDataFrame([(value,) for value in values], f"v {type}")


DATES = {
    "04/11/2023": datetime(2023, 11, 4),
    "04 11 2023": datetime(2023, 11, 4),
    "4 11 23 9:15": datetime(2023, 11, 4, 9, 15),
    "04.11.2023": datetime(2023, 11, 4),
    "12/25/2024": datetime(2024, 12, 25),
    "04/11/2023 18:20:31": datetime(2023, 11, 4, 18, 20, 31),
    "23 Aug 2024 07:45": datetime(2024, 8, 23, 7, 45),
    "3 AUG 2024 07:45:10": datetime(2024, 8, 3, 7, 45, 10),
    "14 March 2011": datetime(2011, 3, 14),
    "22nd April 31": datetime(2031, 4, 22),
    "April 22 31": datetime(2031, 4, 22),
    "30-Oct-19": datetime(2019, 10, 30),
    "2019-10-30T06:05:04.5": datetime(2019, 10, 30, 6, 5, 4, 500000),
    "2019-10-30T06:05:04Z": datetime(2019, 10, 30, 6, 5, 4),
    "2019-10-30 06:05+02:00": datetime(2019, 10, 30, 6, 5),
    "2019 10 30": datetime(2019, 10, 30),
    "20191030": datetime(2019, 10, 30),
    "Tue, Sept 6th, 2022 11:40 pm": datetime(2022, 9, 6, 23, 40),
    "3-4-81 12:10 am": datetime(1981, 4, 3, 0, 10),
    "5 december 97": datetime(1997, 12, 5),
    "7 Xyz 2025": None,
    "18:20": None,
    "30/02/2024": None,
    "2019-10": None,
    "23 Aug 2024 15:05 pm": None,
    "3 Augusty 2020": None,
    "today": None,
}


def test_dates(spark):
    found = column(spark, [*DATES, None]).select("v", parse_dates(F.col("v")).alias("t")).collect()
    assert {row.v: row.t for row in found} == {**DATES, None: None}
    for text, expected in DATES.items():
        if expected is None:
            with pytest.raises(ValueError, match="full date"):
                as_timestamp(text)
        else:
            assert as_timestamp(text) == expected
    assert as_timestamp(date(2005, 1, 1)) == datetime(2005, 1, 1)
    stamp = datetime(2005, 1, 1, 12, 3)
    assert as_timestamp(stamp) is stamp
    for wrong in (12, time(3), [0]):
        with pytest.raises(TypeError, match="Neither a date"):
            as_timestamp(wrong)


def test_money(spark):
    texts = {
        "£1,234.56": "1234.56",
        "$7.89": "7.89",
        "-10": "-10",
        "invalid": None,
        "12d": None,
        "nan": None,
        "inf": None,
        "": None,
        " 12 ": "12",
        "1e3": "1000",
        "-£0.125": "-0.125",
    }
    found = column(spark, [*texts, None]).select("v", clean_money(F.col("v")).alias("m")).collect()
    assert {r.v: r.m for r in found} == {**{k: v and Decimal(v) for k, v in texts.items()}, None: None}
    halves = column(spark, ["0.125", "1234.565", "2.675", "99999999999"]).select(
        quantise(F.col("v").cast("decimal(24,10)")).alias("q")
    )
    assert one(halves, "q") == [Decimal("0.12"), Decimal("1234.56"), Decimal("2.68"), None]


def test_text(spark):
    texts = ["Coach &amp; Horses", "A &lt; B", None, "&#163;5 &nosuch;", "plain"]
    assert one(column(spark, texts).select(decode_html(F.col("v")).alias("d")), "d") == [
        "Coach & Horses",
        "A < B",
        None,
        "£5 &nosuch;",
        "plain",
    ]
    assert one(column(spark, ["NA", "", "x", "null", None]).select(null_if_na(F.col("v")).alias("d")), "d") == [
        None,
        None,
        "x",
        None,
        None,
    ]


FRAME = [(3.0, 7.25, "tea"), (12.0, 9.5, "oat"), (250.375, 20.0, "oat tea"), (None, None, None)]
FRAME_TYPES = "weight double, price double, label string"


@pytest.mark.parametrize(
    "name, setting, rows",
    [
        ("weight", 3, [0]),
        ("weight", "> 10", [1, 2]),
        ("weight", "!=12", [0, 2, 3]),
        ("weight", "13(2.5)", [1]),
        ("weight", "13(.5)", []),
        ("weight", "text", []),
        ("weight", "^50.3", [2]),
        ("weight", lambda x: x > 10, [1, 2]),
        ("weight", list(range(3000)), [0, 1]),
        ("price", (7, 9), [0]),
        ("price", 9.50000001, [1]),
        ("price", Decimal("9.5"), [1]),
        ("label", "oat", [1]),
        ("label", "OAT", []),
        ("label", "", []),
        ("label", ["tea", "oat"], [0, 1]),
        ("label", ["tea", None], [0, 3]),
        ("label", "^oAt", [1, 2]),
        ("label", "!oat", [0, 3]),
        ("label", Text("13(2.5)"), []),
        ("label", Matches("^.{3}$"), [0, 1]),
        ("label", PerValue(lambda x: "t" in x and "o" not in x), [0]),
        ("lab", "=='tea'", [0]),
    ],
)
def test_frame_filters(spark, name, setting, rows):
    df = spark.createDataFrame(FRAME, FRAME_TYPES)
    assert sorted(map(str, one(filter_frame(df, **{name: setting}), "*"))) == sorted(str(FRAME[i]) for i in rows)


@pytest.mark.parametrize(
    "name, setting, rows",
    [
        ("label", "OAT", [1]),
        ("label", "!oat", [0]),
        ("label", "^T_A", [0, 2]),
        ("price", 9.50000001, []),
        ("price", 9.5, [1]),
        ("weight", "!=12", [0, 2]),
        ("weight", (0, 12), [0, 1]),
    ],
)
def test_ledger_filters(spark, name, setting, rows):
    df = spark.createDataFrame(FRAME, FRAME_TYPES)
    assert sorted(map(str, one(filter_ledger(df, **{name: setting}), "*"))) == sorted(str(FRAME[i]) for i in rows)


@pytest.mark.parametrize("keep", [filter_frame, filter_ledger])
def test_long_lists_mean_what_short_ones_mean(spark, keep):
    df = spark.createDataFrame(
        [(datetime(2025, 2, 1), Decimal("10.01"), "5"), (datetime(2025, 2, 2), Decimal("10.00"), "x"), (None, None, None)],
        "at timestamp_ntz, sum decimal(12,2), label string",
    )
    filling = {"at": "01/01/1990", "sum": Decimal("-1"), "label": "none"}
    for column, value in (("at", "01/02/2025"), ("sum", 10.005), ("sum", Decimal("10.01")), ("label", 5), ("label", None)):
        short = keep(df, **{column: [value, filling[column]]}).count()
        assert keep(df, **{column: [value] + [filling[column]] * 1500}).count() == short


def test_tolerances():
    from ledgerloom.functions.predicates import read_shorthand

    for text, ends in {"10(2)": ("8", "12"), "-1.5(.25)": ("-1.75", "-1.25"), " +3(0.5) ": ("2.5", "3.5")}.items():
        assert read_shorthand(text).value == tuple(map(Decimal, ends))
    for text in ("10(", "10()", "10(-2)", "(2)", "1.(2)", ".5(2)", "10(2.)", "1e3(2)", "10(2)x", "a(2)", "10((2)"):
        assert read_shorthand(text) is None


def test_filter_errors(spark):
    df = spark.createDataFrame(FRAME, FRAME_TYPES)
    for setting, message in [
        (max, "not a predicate"),
        (df, "No filter is written"),
        (datetime(2025, 1, 1), "No filter is written"),
        ("==abc", "Not a literal"),
        (("a", "b"), "Cannot compare"),
    ]:
        with pytest.raises(ValueError, match=message):
            filter_frame(df, weight=setting)
    with pytest.raises(NoMatch):
        filter_frame(df, zzz=1)
    with pytest.raises(NoRows, match="weight = 5"):
        filter_ledger(df, require_nonempty=True, weight=5)
    assert filter_frame(df, weight=">1", label="oat").count() == 1


def test_times_are_compared_as_times(spark):
    df = spark.createDataFrame([(datetime(2025, 5, d),) for d in range(1, 6)], "date timestamp_ntz")
    assert filter_ledger(df, date=("02/05/2025", "4 May 2025")).count() == 3
    assert filter_ledger(df, date="3 May 2025").count() == 1
    assert filter_ledger(df, date=">'3 May 2025'").count() == 2
    plan = filter_ledger(df, date=("02/05/2025", "4 May 2025"))._jdf.queryExecution().toString()
    assert "cast(date" not in plan.split("Optimized Logical Plan")[1]


NAMES = [
    ("bakre", ("baker", "tailor"), "similar", "baker"),
    ("ba", ("baker", "barber", "tailor"), "ambiguous", None),
    ("barbre", ("barber", "barbers", "tailor"), "ambiguous", None),
    ("tailo", ("tailor", "tailos", "baker"), "ambiguous", None),
    ("qqq", ("butcher", "baker"), "none", None),
    ("grocer", ("thegreengrocershop", "butcher"), "substring", "thegreengrocershop"),
    ("gre", ("Greengrocer", "Butcher"), "prefix", "Greengrocer"),
    (" Corner CAFE, ltd", ("Cafe Corner", "Corner Cafe Ltd", "Corner Cafe Limited"), "exact", "Corner Cafe Ltd"),
    ("corner cafe", ("Corner Cafe", "Corner Cafe 2"), "exact", "Corner Cafe"),
]


@pytest.mark.parametrize("query, candidates, method, match", NAMES)
def test_names(spark, query, candidates, method, match):
    found = match_name(query, candidates)
    assert (found.method, found.match) == (method, match)
    for limits in ({}, {"local_candidates": 0, "name_block": 1, "candidate_block": 2}):
        row = resolve_names(column(spark, [query]), "v", column(spark, candidates), "v", **limits).collect()
        assert [(r.input, r.method, r.match, r.n_candidates) for r in row] == [
            (query, method, match, found.n_candidates)
        ]


def test_name_errors_and_banks():
    with pytest.raises(NoMatch):
        resolve_name("qqq", ("butcher",))
    with pytest.raises(AmbiguousMatch):
        resolve_name("ba", ("baker", "barber"))
    for layout, spellings in {
        CHASE: ("CHASE", "chace", "Chaes"), LLOYDS_CC: ("lloyds cc", "Lloyd", "LoydsCC"), MONZO: ("monz", "Mozno", "MONZO "),
    }.items():
        for spelling in spellings:
            assert find_layout(spelling) is layout


def test_layouts_are_values():
    assert len({CHASE, LLOYDS_CC, MONZO, CHASE}) == 3
    assert hash(CHASE.with_after(lambda df: df)) != hash(CHASE)


def test_similarity_in_blocks_equals_brute_force(spark):
    candidates = [f"{a}{b}{'x' * n}" for a in ("shop", "store", "shoop") for b in ("one", "two", "noe") for n in (0, 1, 9)]
    queries = ["shopon", "stor", "shoptwoxxxxxxxxx", "soreone", "shopnoex", "xxxxx", "shoopne", "q", "tow", "opon"]

    def brute(query):
        keys = {fold(c): c for c in candidates}
        started = [k for k in keys if k.startswith(query)]
        if query in keys or len(started) == 1:
            return keys.get(query) or keys[started[0]]
        close = get_close_matches(query, list(keys), cutoff=0.75)
        held = [k for k in keys if query in k]
        return keys[close[0]] if len(close) == 1 else keys[held[0]] if not close and len(held) == 1 else None

    expected = {query: brute(query) for query in queries}
    for limits in ({}, {"local_candidates": 3, "name_block": 2, "candidate_block": 4}):
        found = resolve_names(column(spark, queries * 3), "v", column(spark, candidates), "v", **limits)
        assert {row.input: row.match for row in found.collect()} == expected


def test_names_among_many_alike_are_not_compared_with_all(spark, monkeypatch):
    candidates = [f"Customer#{n:09d}" for n in range(500)] + ["baker", "tailor", "a greengrocer", "greengrocers b"]
    queries = [c[:2] + c[3:] for c in candidates[:500]] + ["bakre", "grocer", "zzz", "ailor", "Customer#000000007"]
    for limits in ({}, {"local_candidates": 0, "name_block": 2, "candidate_block": 100}):
        compared = []
        for name in ("_compare_locally", "_compare_in_blocks"):
            compare = getattr(resolve, name)
            monkeypatch.setattr(
                resolve, name, lambda names, *rest, compare=compare: compared.append(names.count()) or compare(names, *rest)
            )
        rows = resolve_names(column(spark, queries), "v", column(spark, candidates), "v", **limits).collect()
        monkeypatch.undo()
        assert sum(compared) == 4
        expected = {query: match_name(query, candidates) for query in queries[::50] + queries[500:]}
        found = {r.input: (r.match, r.method, r.n_candidates) for r in rows}
        assert len(rows) == len(queries)
        assert {query: found[query] for query in expected} == {
            query: (m.match, m.method, m.n_candidates) for query, m in expected.items()
        }


def test_names_with_the_same_letters_are_all_found():
    folded = ["abcdef", "fedcba", "abcdfe", "abcde", "uvwxyz"]
    assert sorted(CloseNames(folded).similar("abcdef")) == ["abcde", "abcdef", "abcdfe"]
    assert CloseNames(folded).similar("fedcbx") == ["fedcba"]
    assert CloseNames([]).similar("abc") == CloseNames(folded).similar("") == []


def test_bank_steps(spark):
    rows = spark.createDataFrame(
        [
            ("Weekly Round Up", "Card", ""),
            ("Round the corner", "Transfer", ""),
            ("Market, Till 4", "Cash Withdrawal | USD 60.20", ""),
            ("Hotel", "Purchase | USD 81.40 | FX rate", ""),
            ("Shop", "Purchase", "keep"),
            (None, None, None),
        ],
        "name string, category string, notes string",
    )
    done = rows.transform(chase_round_ups).transform(chase_withdrawals).transform(chase_foreign_purchases)
    assert one(done, "category", "notes") == [
        ("roundup", ""),
        ("Transfer", ""),
        ("cash_withdrawal", "Cash Withdrawal | USD 60.20"),
        ("Purchase", "USD 81.40 | FX rate"),
        ("Purchase", "keep"),
        (None, None),
    ]
    monzo = spark.createDataFrame(
        [
            (None, "Shopping", "second FLEX part"),
            ("Bank", "Shopping", "May overdraft interest"),
            ("all round ups of May", "Pots", None),
            ("A round up", "Pots", "plain"),
        ],
        "name string, category string, notes string",
    )
    done = monzo.transform(monzo_flex).transform(monzo_overdraft).transform(monzo_round_ups)
    assert one(done, "name", "category") == [
        ("Flex payment", "Shopping"),
        ("Overdraft fees", "fee"),
        ("all round ups of May", "roundup"),
        ("A round up", "Pots"),
    ]


def test_passes_do_not_change_amounts(spark):
    """Numbers are rounded once, after the last rule, however many passes the rules take."""
    rows = spark.createDataFrame([("a", Decimal("1.00")), ("b", Decimal("2.00"))], "name string, amount decimal(12,2)")
    for count in (2, 3, 300):
        rules = [
            Rule((Condition("name", "eq", "a"),), (Action("amount", "increment", Decimal("0.005")),), n, id=f"{n:03d}")
            for n in range(count)
        ]
        expected = (Decimal("1.00") + count * Decimal("0.005")).quantize(Decimal("0.01"), "ROUND_HALF_EVEN")
        for per_pass in (250, 99, 1) if count < 100 else (250, 99):
            done = apply_rules(rows, rules, per_pass=per_pass).collect()
            assert {r.name: r.amount for r in done} == {"a": expected, "b": Decimal("2.00")}


def test_first_wins_and_partitions(spark):
    rows = [(n % 5, n // 7, n, None if n % 3 else f"t{n}") for n in range(300)]
    df = spark.createDataFrame(rows, "k int, j int, place int, text string").repartition(7)
    best = {}
    for row in sorted(rows, key=lambda r: r[2]):
        best.setdefault(row[:2], row)
    for partitions in ("1", "8"):  # the session default comes last
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        assert set(one(first_wins(df, ["k", "j"], ["place"]), "*")) == set(best.values())


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_lookup_equals_broadcast(spark, how):
    facts = spark.createDataFrame([("hot" if n % 3 else f"k{n % 8}", n % 4) for n in range(400)], "k string, n int")
    names = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), ("unused", 4)], "key string, size int")
    plain = lookup(facts, names, "k", "key", how)
    salted = lookup(facts, names, "k", "key", how, broadcast_rows=0, hot_rows=20)
    assert salted.columns == plain.columns
    assert sorted(map(str, one(salted, "*"))) == sorted(map(str, one(plain, "*")))


def test_relations(spark):
    accounts = spark.createDataFrame([("a", "Chase"), ("b", "Monzo")], "name string, bank string")
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("c", "z", 3)], "account_name string, name string, n int")
    joined = relations.account_transactions(accounts, rows)
    assert sorted(map(str, one(joined, "name", "tx_name", "n"))) == sorted(
        map(str, [("a", "x", 1), ("a", "y", 2), ("b", None, None)])
    )
    assert one(relations.orphans(rows, "account_name", accounts, "name"), "missing_key", "n_rows") == [("c", 1)]


def test_rules(spark):
    rows = spark.createDataFrame(
        [("tesco", "x", Decimal("-5.00"), None), ("council tax", "x", Decimal("-100.00"), "n"), ("pay", "x", Decimal("9.99"), "n")],
        "name string, category string, amount decimal(12,2), notes string",
    )
    fixed = {"created_at": datetime(2025, 1, 1)}
    rules = [
        category_rule({"name": "^TESCO"}, "groceries", id="1", **fixed),
        category_rule({"name": "^council", "amount": (-200, 0)}, "bill", priority=1, id="2", **fixed),
        category_rule({"amount": "<0"}, "spent", id="0", **fixed),
        category_rule({"name": Matches("^p.y$")}, "salary", id="5", **fixed),
        Rule((Condition("amount", "lt", 0),), (Action("notes", "append", "+"), Action("notes", "prepend", "-")), id="3", **fixed),
        Rule((Condition("name", "in", ["pay"]),), (Action("amount", "decrement", "0.005"),), id="4", **fixed),
    ]
    expected = [
        ("groceries", Decimal("-5.00"), "-+"),
        ("bill", Decimal("-100.00"), "-n+"),
        ("salary", Decimal("9.98"), "n"),
    ]
    stored = load_rules(rules_table(spark, rules))
    assert [rule.id for rule in stored] == [rule.id for rule in rules]
    for each in (rules, stored):
        for per_pass in (250, 2):
            done = apply_rules(rows, each, changed="changed", per_pass=per_pass)
            assert sorted(one(done, "category", "amount", "notes")) == sorted(expected)
            assert one(done, "changed") == [True] * 3
    tags = {row.name: (row.rule_ids, row.rule_id) for row in tag_rules(rows, rules).collect()}
    assert tags["tesco"] == (["3", "1", "0"], "3") and tags["council tax"] == (["2", "3", "0"], "2")
    with pytest.raises(ValueError, match="cannot store"):
        category_rule({"name": lambda c: c == "x"}, "y")
    with pytest.raises(ValueError, match="Unknown action"):
        Action("name", "drop", 1)


def test_rules_from_json(spark):
    raw = spark.createDataFrame(
        [
            (
                "1",
                datetime(2025, 1, 1),
                None,
                '[{"apply_to":"name","operation":"in","value":["5","b"]},{"apply_to":"amount","operation":"between",'
                '"value":[-2,1.5]},{"apply_to":"name","operation":"eq","value":"5"}]',
                '[{"apply_to":"category","operation":"set","value":"bill"},'
                '{"apply_to":"amount","operation":"increment","value":2.5}]',
                None,
            )
        ],
        "id string, created_at timestamp, name string, conditions string, actions string, priority int",
    )
    (rule,) = load_rules(rules_from_json(raw))
    assert [condition.value for condition in rule.conditions] == [["5", "b"], [Decimal(-2), Decimal("1.5")], "5"]
    assert [action.value for action in rule.actions] == ["bill", Decimal("2.5")]
    assert rule.priority == 0


def test_taxonomy_and_shared_folder(spark):
    names = [name for group in DIRECTIONS.values() for name in group]
    assert len(names) == len(set(names)) == 21
    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
