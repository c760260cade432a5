"""Categorisation rules: conditions that must all hold, and changes to make where they do.

Conditions see the row as it came in. Changes are applied from low to high priority (then by creation time
and id), so a higher rule overrides a lower one. A rule without conditions matches nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.dates import as_timestamp
from ledgerloom.functions.predicates import Test, predicate, read_setting
from ledgerloom.operators.ruleset import RuleSet
from ledgerloom.schema import RULES

# What a condition can test and what an action can do.
OPERATIONS = ("eq", "approx_eq", "in", "between", "contains", "not_contains", "gt", "gte", "lt", "lte", "regex")
MODIFIERS = ("set", "append", "prepend", "increment", "decrement")

# Up to this many rules become expressions of one projection; the code of a larger one does not compile, so more
# rules are data.
RULES_PER_PASS = 100


@dataclass(frozen=True)
class Condition:
    apply_to: str
    operation: str
    value: Any

    def __post_init__(self) -> None:
        if self.operation not in OPERATIONS:
            raise ValueError(f"Unknown condition {self.operation!r}; use one of {', '.join(OPERATIONS)}")


@dataclass(frozen=True)
class Action:
    apply_to: str
    operation: str
    value: Any

    def __post_init__(self) -> None:
        if self.operation not in MODIFIERS:
            raise ValueError(f"Unknown action {self.operation!r}; use one of {', '.join(MODIFIERS)}")


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...] = ()
    actions: tuple[Action, ...] = ()
    priority: int = 0
    name: str | None = None
    id: str = field(default_factory=lambda: str(uuid.uuid4()))
    created_at: datetime = field(default_factory=datetime.now)

    @property
    def rank(self) -> tuple:
        return (self.priority, self.created_at, self.id)


def category_rule(conditions: Mapping[str, Any], category: str, priority: int = 0, **more: Any) -> Rule:
    """A rule in the filter language: `category_rule({"name": "^tesco"}, "groceries")`."""
    return Rule(
        tuple(_condition(column, setting) for column, setting in conditions.items()),
        (Action("category", "set", category),),
        priority,
        **more,
    )


def _condition(column: str, setting: Any) -> Condition:
    test = read_setting(setting)
    operation = "eq" if test.op == "same" else test.op
    if operation not in OPERATIONS:
        raise ValueError(f"A rule cannot store the condition {column} = {setting!r}")
    value = list(test.value) if operation in ("in", "between") else test.value
    return Condition(column, operation, value)


def matches(df: DataFrame, rule: Rule, folded: Mapping[str, Column] | None = None) -> Column:
    """Whether a row satisfies every condition of the rule; never null."""
    tests = []
    for condition in rule.conditions:
        value = condition.value
        if condition.operation == "between":
            value = tuple(value)
        if condition.operation == "in":
            value = list(value)
        tests.append(
            predicate(
                F.col(condition.apply_to),
                df.schema[condition.apply_to].dataType,
                Test(condition.operation, value),
                folded=(folded or {}).get(condition.apply_to),
            )
        )
    return F.coalesce(reduce(and_, tests), F.lit(False)) if tests else F.lit(False)


def _with_folded(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, dict[str, Column]]:
    """Upper-case each text column that is searched once, not once per rule."""
    searched = sorted(
        {
            condition.apply_to
            for rule in rules
            for condition in rule.conditions
            if condition.operation in ("contains", "not_contains")
        }
    )
    names = {column: f"_upper_{column}" for column in searched}
    prepared = df.withColumns({name: F.upper(F.col(column).cast("string")) for column, name in names.items()})
    return prepared, {column: F.col(name) for column, name in names.items()}


def apply_rules(
    df: DataFrame, rules: Iterable[Rule], changed: str | None = None, per_pass: int = RULES_PER_PASS
) -> DataFrame:
    """Apply all rules; `changed` names a flag to add for rows that came out different.

    Up to `per_pass` rules are compiled into one projection. More are data that one projection interprets.
    """
    ordered = sorted(rules, key=lambda rule: rule.rank)
    targets = sorted({action.apply_to for rule in ordered for action in rule.actions})
    if not targets:
        return df.withColumn(changed, F.lit(False)) if changed else df
    # Between rules a number keeps all its places: it is rounded once, after the last rule.
    running = {column: _running_type(df.schema[column].dataType, column, ordered) for column in targets}
    if len(ordered) > per_pass:
        known = RuleSet(df, ordered)
        before = {column: F.col(column) for column in targets}
        current = known.with_hits(df, "_hits").withColumn("_new", known.changed(F.col("_hits"), before, running))
        new = {column: F.col("_new")[column] for column in targets}
    else:
        prepared, folded = _with_folded(df, ordered)
        hits = [matches(df, rule, folded) for rule in ordered]
        names = {column: f"_new_{column}" for column in targets}
        current = prepared.withColumns(
            {
                name: _changed(F.col(column).cast(running[column]), df.schema[column].dataType, running[column], column, ordered, hits)
                for column, name in names.items()
            }
        )
        new = {column: F.col(name) for column, name in names.items()}
    final = {column: _final(value, df.schema[column].dataType) for column, value in new.items()}
    after = [final[column].alias(column) if column in new else F.col(column) for column in df.columns]
    if changed:
        differs = reduce(or_, [~F.col(column).eqNullSafe(final[column]) for column in new])
        after.append(differs.alias(changed))
    return current.select(*after)


def _running_type(dtype: T.DataType, column: str, rules: list[Rule]) -> T.DataType:
    """The type that holds a column between rules: a decimal with the places of every step."""
    if not isinstance(dtype, T.DecimalType):
        return dtype
    places = [
        -Decimal(str(action.value)).as_tuple().exponent
        for rule in rules
        for action in rule.actions
        if action.apply_to == column and action.operation in ("increment", "decrement")
    ]
    scale = min(max([dtype.scale, *places]), 38 - (dtype.precision - dtype.scale))
    return T.DecimalType(38, scale)


def _final(value: Column, dtype: T.DataType) -> Column:
    return (F.bround(value, dtype.scale) if isinstance(dtype, T.DecimalType) else value).cast(dtype)


def _changed(
    value: Column, dtype: T.DataType, running: T.DataType, column: str, rules: list[Rule], hits: list[Column]
) -> Column:
    """Fold the actions on one column. Each step refers to the value before it once only."""
    steps = [
        (hit, action)
        for rule, hit in zip(rules, hits, strict=True)
        for action in rule.actions
        if action.apply_to == column
    ]
    edited = [hit for hit, action in steps if action.operation in ("append", "prepend")]
    if edited:
        value = F.coalesce(value, F.when(reduce(or_, edited), F.lit("")))
    sets: list[Column] = []
    adds: list[Column] = []
    for hit, action in steps:
        if adds and action.operation not in ("increment", "decrement"):
            value, adds = _added(value, adds, running), []
        if action.operation == "set":
            sets.append(F.when(hit, _literal(action.value, dtype).cast(running)))
            continue
        value = _latest(sets, value)
        sets = []
        if action.operation == "append":
            value = F.concat(value, F.when(hit, F.lit(str(action.value))).otherwise(F.lit("")))
        elif action.operation == "prepend":
            value = F.concat(F.when(hit, F.lit(str(action.value))).otherwise(F.lit("")), value)
        else:
            step = Decimal(str(action.value)) * (1 if action.operation == "increment" else -1)
            adds.append(F.when(hit, F.lit(step)).otherwise(F.lit(0)).cast(running))
    if adds:
        value = _added(value, adds, running)
    return _latest(sets, value).cast(running)


def _added(value: Column, steps: list[Column], running: T.DataType) -> Column:
    """The value plus all steps, as one flat sum: nested additions of many rules would be too deep a tree."""
    total = F.aggregate(F.array(*steps), F.lit(0).cast(running), lambda a, b: (a + b).cast(running))
    return (value + total).cast(running)


def _latest(sets: list[Column], value: Column) -> Column:
    return F.coalesce(*reversed(sets), value) if sets else value


def _literal(value: Any, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType)):
        return F.lit(as_timestamp(value).isoformat(sep=" ")).cast(dtype)
    if isinstance(dtype, T.DecimalType):
        return F.bround(F.lit(Decimal(str(value))), dtype.scale).cast(dtype)
    return F.lit(value).cast(dtype)


def tag_rules(df: DataFrame, rules: Iterable[Rule], per_pass: int = RULES_PER_PASS) -> DataFrame:
    """Add `rule_ids`, every rule that matches, and `rule_id`, the one that wins (null when none).

    More than `per_pass` rules are data, as in `apply_rules`.
    """
    ordered = sorted(rules, key=lambda rule: rule.rank)
    if len(ordered) > per_pass:
        hit = RuleSet(df, ordered).with_hits(df, "_hits")
        tagged = hit.withColumn("rule_ids", F.reverse(F.transform("_hits", lambda rule: rule["id"])))
    else:
        prepared, folded = _with_folded(df, ordered)
        hits = [F.when(matches(df, rule, folded), F.lit(rule.id)) for rule in reversed(ordered)]
        tagged = prepared.withColumn("rule_ids", F.array_compact(F.array(*hits)))
    return tagged.select(*df.columns, "rule_ids", F.try_element_at("rule_ids", F.lit(1)).alias("rule_id"))


def rule_audit(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Per rule: how many rows match it, and on how many it wins. Counts are combined map-side."""
    rules = list(rules)
    spark = df.sparkSession
    hits = (
        tag_rules(df, rules)
        .select(F.posexplode("rule_ids").alias("place", "rule_id"))
        .groupBy("rule_id")
        .agg(F.count("*").alias("hits"), F.count_if(F.col("place") == 0).alias("wins"))
    )
    known = spark.createDataFrame([(rule.id, rule.priority) for rule in rules], "rule_id string, priority int")
    return known.join(hits, "rule_id", "left").fillna(0, ["hits", "wins"])


def rules_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """Rules as rows of the rules table."""
    rows = [
        (
            rule.id,
            rule.created_at,
            rule.name,
            [(part.apply_to, part.operation, _slots(part.value)) for part in rule.conditions],
            [(part.apply_to, part.operation, _slots(part.value)) for part in rule.actions],
            rule.priority,
        )
        for rule in rules
    ]
    return spark.createDataFrame(rows, RULES)


def _slots(value: Any) -> tuple:
    """The typed slots (str, num, ts, strs, nums, tss) with the one that fits filled."""
    if isinstance(value, (list, tuple)):
        items = [_slots(item) for item in value]
        for kind in range(3):
            if items and all(item[kind] is not None for item in items):
                lists = [None, None, None]
                lists[kind] = [item[kind] for item in items]
                return (None, None, None, *lists)
        raise ValueError(f"A list in a rule holds values of one kind: {value!r}")
    if isinstance(value, str):
        return (value, None, None, None, None, None)
    if isinstance(value, (int, float, Decimal)):
        exact = Decimal(str(int(value) if isinstance(value, bool) else value))
        return (None, exact, None, None, None, None)
    if isinstance(value, date):
        return (None, None, as_timestamp(value), None, None, None)
    raise ValueError(f"A rule cannot store the value {value!r}")


def load_rules(table: DataFrame) -> list[Rule]:
    """Rules of a rules table. They become part of the query plan, so the driver reads them."""
    return [
        Rule(
            tuple(Condition(part.apply_to, part.operation, _value(part.value)) for part in row.conditions or []),
            tuple(Action(part.apply_to, part.operation, _value(part.value)) for part in row.actions or []),
            row.priority or 0,
            row.name,
            row.id,
            row.created_at,
        )
        for row in table.toLocalIterator()
    ]


def _value(slots: Any) -> Any:
    return next((value for value in slots if value is not None), None)


def rules_from_json(df: DataFrame) -> DataFrame:
    """A rules table from rows whose `conditions` and `actions` are JSON lists.

    Expects `id, created_at, name, conditions, actions, priority`; values may be text, numbers or lists.
    """
    parts = "array<struct<apply_to string, operation string, value variant>>"

    def typed(column: str) -> Column:
        return F.expr(
            f"""transform(from_json({column}, '{parts}'), part -> named_struct(
                'apply_to', part.apply_to,
                'operation', part.operation,
                'value', named_struct(
                    'str', if(schema_of_variant(part.value) = 'STRING',
                              try_variant_get(part.value, '$', 'string'), null),
                    'num', if(schema_of_variant(part.value) rlike '^(BIGINT|DECIMAL|DOUBLE)',
                              try_variant_get(part.value, '$', 'decimal(38,10)'), null),
                    'ts', cast(null as timestamp_ntz),
                    'strs', if(schema_of_variant(part.value) = 'ARRAY<STRING>',
                               try_variant_get(part.value, '$', 'array<string>'), null),
                    'nums', if(schema_of_variant(part.value) rlike '^ARRAY<(BIGINT|DECIMAL|DOUBLE)',
                               try_variant_get(part.value, '$', 'array<decimal(38,10)>'), null),
                    'tss', cast(null as array<timestamp_ntz>))))"""
        )

    return df.select(
        "id",
        "created_at",
        "name",
        typed("conditions").alias("conditions"),
        typed("actions").alias("actions"),
        F.coalesce(F.col("priority").cast("int"), F.lit(0)).alias("priority"),
    )


def reclassify(df: DataFrame, condition: Column, category: str, changed: str | None = None) -> DataFrame:
    """Set the category of all rows that satisfy a condition; `changed` names a flag to add for them."""
    hit = F.coalesce(condition, F.lit(False))
    changes = {"category": F.when(hit, F.lit(category)).otherwise(F.col("category"))}
    if changed:
        changes[changed] = hit
    return df.withColumns(changes)
