"""Rules as data give what compiled rules give."""

from __future__ import annotations

import random
from datetime import date, datetime
from decimal import Decimal

from ledgerloom import Rule
from ledgerloom.operators.rules import Action, Condition, apply_rules, rule_audit, tag_rules
from ledgerloom.operators.ruleset import RuleSet

MADE = datetime(2025, 1, 1)
COLUMNS = "id int, name string, day date, at timestamp_ntz, amount decimal(12,2), size double, n long, flag boolean, notes string"


def rows(spark):
    dice = random.Random(5)

    def maybe(value):
        return None if dice.random() < 0.15 else value

    return spark.createDataFrame(
        [
            (
                place,
                maybe(dice.choice(["shop", "Shop", "bank", "café", ""])),
                maybe(date(2025, 1, dice.randint(1, 4))),
                maybe(datetime(2025, 1, dice.randint(1, 4), dice.choice([0, 12]))),
                maybe(Decimal(dice.randint(-500, 500)) / 100),
                maybe(dice.choice([0.1, 0.1 + 1e-9, 2.5, -1.0])),
                maybe(dice.randint(0, 5)),
                maybe(dice.random() < 0.5),
                maybe(dice.choice(["one", "two", "a.b"])),
            )
            for place in range(120)
        ],
        COLUMNS,
    )


def some_rules(count, seed):
    dice = random.Random(seed)
    conditions = [
        lambda: Condition("name", "eq", dice.choice(["shop", "bank", "nobody", ""])),
        lambda: Condition("name", "in", dice.choice([["shop", "bank", "shop"], ["café", None], [None], [], ["x", 1]])),
        lambda: Condition("name", dice.choice(["contains", "not_contains"]), dice.choice(["SH", "é", ""])),
        lambda: Condition("name", "regex", dice.choice(["^s", "[a-c]", "k$"])),
        lambda: Condition("amount", "between", (dice.randint(-5, 0), Decimal("1.505"))),
        lambda: Condition("amount", dice.choice(["gt", "gte", "lt", "lte", "eq"]), dice.choice([0, 1.25, Decimal("-2.50")])),
        lambda: Condition("amount", "approx_eq", 1.25),
        lambda: Condition("size", dice.choice(["approx_eq", "eq", "lte"]), dice.choice([0.1, 2.5])),
        lambda: Condition("size", "in", [2.5, -1]),
        lambda: Condition("n", "in", dice.choice([[1, 2], [3.0, 4], [5, None]])),
        lambda: Condition("n", "contains", "1"),
        lambda: Condition("day", "eq", dice.choice(["2025-01-02", date(2025, 1, 3), datetime(2025, 1, 3, 9)])),
        lambda: Condition("day", "in", ["2025-01-02", datetime(2025, 1, 2, 9), date(2025, 1, 4)]),
        lambda: Condition("at", "between", ["2025-01-01", "2025-01-03 06:00:00"]),
        lambda: Condition("at", "eq", "2025-01-03 12:00:00"),
        lambda: Condition("flag", dice.choice(["eq", "gte"]), dice.choice([True, 0])),
        lambda: Condition("name", "eq", 7),
    ]
    actions = [
        lambda: Action("notes", dice.choice(["set", "append", "prepend"]), dice.choice(["x", "yy", 3])),
        lambda: Action("amount", dice.choice(["increment", "decrement"]), dice.choice(["0.005", 2, Decimal("0.125")])),
        lambda: Action("amount", "set", dice.choice([1, Decimal("2.345"), 0.5])),
        lambda: Action("n", dice.choice(["set", "increment"]), dice.randint(1, 9)),
        lambda: Action("size", "set", 1.5),
        lambda: Action("flag", "set", True),
        lambda: Action("day", "set", "2026-02-03"),
        lambda: Action("notes", "set", None),
    ]
    return [
        Rule(
            tuple(dice.choice(conditions)() for _ in range(dice.choice([0, 1, 1, 2, 2, 3]))),
            tuple(dice.choice(actions)() for _ in range(dice.randint(0, 2))),
            dice.randint(-1, 1),
            id=f"{place:04d}",
            created_at=MADE,
        )
        for place in range(count)
    ]


def test_data_equals_compiled(spark):
    df = rows(spark).cache()
    for seed in range(2):
        rules = some_rules(40, seed)
        compiled = apply_rules(df, rules, changed="changed", per_pass=1_000)
        data = apply_rules(df, rules, changed="changed", per_pass=0)
        assert data.schema.simpleString() == compiled.schema.simpleString()
        assert by_id(data) == by_id(compiled)
        assert by_id(tag_rules(df, rules, per_pass=0)) == by_id(tag_rules(df, rules, per_pass=1_000))


def by_id(df):
    return {row.id: row for row in df.collect()}


def test_index_beyond_broadcast_and_hot_values(spark):
    df = rows(spark)
    rules = some_rules(40, 7)
    known = RuleSet(df, sorted(rules, key=lambda rule: rule.rank))
    ids = {row.id: [hit.id for hit in row.hits] for row in known.with_hits(df, "hits", broadcast_rows=0).collect()}
    expected = {row.id: row.rule_ids[::-1] for row in tag_rules(df, rules).collect()}
    assert ids == expected and any(ids.values())


def test_plan_does_not_grow(spark):
    df = rows(spark)

    def plan(count):
        rules = [Rule((Condition("name", "eq", f"{n}"), Condition("n", "gt", n)), (Action("notes", "set", f"{n}"),), id=f"{n:05d}") for n in range(count)]
        return apply_rules(df, rules)._jdf.queryExecution().optimizedPlan().treeString()

    small, large = plan(101), plan(3_000)
    assert len(large.splitlines()) == len(small.splitlines()) and abs(len(large) - len(small)) < 500


def test_nothing_to_do(spark):
    df = rows(spark)
    for rules in ([], [Rule((), (Action("notes", "set", "x"),))], [Rule((Condition("name", "eq", 7),), (Action("notes", "set", "x"),))]):
        assert by_id(apply_rules(df, rules, per_pass=-1)) == by_id(df)
        assert all(row.rule_ids == [] and row.rule_id is None for row in tag_rules(df, rules, per_pass=-1).collect())
    audited = rule_audit(df, some_rules(120, 1)).collect()
    plain = {}
    for row in tag_rules(df, some_rules(120, 1), per_pass=1_000).collect():
        for place, id in enumerate(row.rule_ids):
            hits, wins = plain.get(id, (0, 0))
            plain[id] = (hits + 1, wins + (place == 0))
    assert {row.rule_id: (row.hits, row.wins) for row in audited} == {f"{n:04d}": plain.get(f"{n:04d}", (0, 0)) for n in range(120)}
