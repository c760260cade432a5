"""Long rule lists as data: one array of structs that built-in higher-order functions interpret for each row.

The plan holds a branch per kind of condition and action (column, operation and type of value), so it is as large for
ten thousand rules as for ten. The array travels once, as the one row of a scalar subquery. A rule with an `eq` or
`in` condition is found through a join of that column with the values asked for, and only its remaining conditions
are interpreted; rules without one are interpreted for every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from decimal import Decimal
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.dates import as_timestamp
from ledgerloom.functions.predicates import approximate_reach, comparable
from ledgerloom.operators.lookup import BROADCAST_ROWS, lookup

# The slots a value can lie in; the other slots are null.
_TEXT, _NUMBER, _REAL, _TIME = "texts", "numbers", "reals", "times"
_ORDERED: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda column, value: column == value,
    "gt": lambda column, value: column > value,
    "gte": lambda column, value: column >= value,
    "lt": lambda column, value: column < value,
    "lte": lambda column, value: column <= value,
}
_LISTS = ("in", "in_or_null")
_MOST_DIGITS = 38


class _Kind(NamedTuple):
    """What is common to all conditions, or all actions, that one branch of the plan serves."""

    column: str
    operation: str
    slot: str


class _Part(NamedTuple):
    kind: _Kind
    values: tuple


class _Encoded(NamedTuple):
    """A rule whose conditions can hold, with the rank that its place in the list gives it."""

    rank: int
    id: str
    conditions: list[_Part]
    actions: list[_Part]


class RuleSet:
    """Rules in ascending order, made ready for one DataFrame's columns."""

    def __init__(self, df: DataFrame, ordered: Sequence[Any]):
        self._types = {field.name: field.dataType for field in df.schema}
        self._rules = []
        for rank, rule in enumerate(ordered):
            conditions = [self._condition(each) for each in rule.conditions]
            if conditions and None not in conditions:  # else it matches nothing
                actions = [part for each in rule.actions if (part := self._action(each)) is not None]
                # Comparisons of numbers cost less than searches in text.
                conditions.sort(key=lambda part: part.kind.slot == _TEXT)
                self._rules.append(_Encoded(rank, rule.id, conditions, actions))
        self._condition_kinds = self._kinds(part for rule in self._rules for part in rule.conditions)
        self._action_kinds = self._kinds(part for rule in self._rules for part in rule.actions)
        numbers = [
            part
            for rule in self._rules
            for part in (*rule.conditions, *rule.actions)
            if part.kind.slot == _NUMBER
        ]
        self._exact = _common_decimal(
            {self._types[part.kind.column] for part in numbers}, (value for part in numbers for value in part.values)
        )

    def with_hits(self, df: DataFrame, hits: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
        """Add the rules that match a row, in ascending order, as an array of structs."""
        folded = {
            kind.column: f"_upper_{kind.column}"
            for kind in self._condition_kinds
            if kind.operation in ("contains", "not_contains")
        }
        found = df.withColumns({name: F.upper(F.col(column).cast("string")) for column, name in folded.items()})
        index, scanned = self._index()
        helpers = list(folded.values())
        candidates = []
        # Each array is named once and read once, so that the optimiser puts the subquery in its place: no row holds it.
        if index:
            ranks = [f"_ranks_{at}" for at in range(len(index))]
            for name, (kind, places) in zip(ranks, index.items(), strict=True):
                found = self._joined(found, kind, places, name, broadcast_rows)
            found = found.withColumn("_every", self._array(df, self._rules))
            helpers += [*ranks, "_every"]
            none = F.array().cast("array<int>")
            asked = F.concat(*[F.coalesce(F.col(name), none) for name in ranks])
            candidates.append(F.transform(asked, lambda place: F.get("_every", place)))
        uppers = {column: F.col(name) for column, name in folded.items()}
        for kind, rules in scanned.items():
            # The first condition has a branch of its own: few rules are left for the general test.
            name = f"_scanned_{self._condition_kinds[kind]}"
            found = found.withColumn(name, self._array(df, rules))
            helpers.append(name)
            candidates.append(F.filter(name, self._first_holds(kind, uppers)))
        if not candidates:
            return df.withColumn(hits, self._array(df, []))
        holds = self._holds(uppers)
        matching = [F.filter(each, lambda rule: F.forall(rule["conditions"], holds)) for each in candidates]
        return found.withColumn(hits, F.array_sort(F.concat(*matching))).drop(*helpers)

    def changed(self, hits: Column, before: dict[str, Column], running: dict[str, T.DataType]) -> Column:
        """A struct of the columns in `before` after the actions of all rules that hit, in their order."""

        def after(values: Column, action: Column) -> Column:
            fields = []
            for column in before:
                value = values[column]
                steps = [
                    (at, self._step(kind, value, action, running[column]))
                    for kind, at in self._action_kinds.items()
                    if kind.column == column
                ]
                fields.append(_choose(action["kind"], steps, value).cast(running[column]).alias(column))
            return F.struct(*fields)

        start = F.struct(*[value.cast(running[column]).alias(column) for column, value in before.items()])
        return F.aggregate(F.flatten(F.transform(hits, lambda rule: rule["actions"])), start, after)

    def _step(self, kind: _Kind, value: Column, action: Column, running: T.DataType) -> Column:
        given = F.get(action[kind.slot], F.lit(0))
        if kind.operation == "set":
            return given.cast(self._types[kind.column]).cast(running)
        if kind.operation == "append":
            return F.concat(F.coalesce(value.cast("string"), F.lit("")), given).cast(running)
        if kind.operation == "prepend":
            return F.concat(given, F.coalesce(value.cast("string"), F.lit(""))).cast(running)
        return (value + given.cast(running)).cast(running)

    def _condition(self, condition: Any) -> _Part | None:
        """The condition with typed values; None when no row can satisfy it."""
        column, operation, value = condition.apply_to, condition.operation, condition.value
        dtype = self._types[column]
        if operation in ("contains", "not_contains"):
            return _Part(_Kind(column, operation, _TEXT), (value.upper(),))
        if operation == "regex":
            return _Part(_Kind(column, operation, _TEXT), (value,))
        if operation == "approx_eq":
            return _Part(_Kind(column, operation, _REAL), (float(value), approximate_reach(dtype, value)))
        values = list(value) if operation in ("in", "between") else [value]
        if operation in ("eq", "in"):
            if None in values and operation == "in":
                operation = "in_or_null"
            values = [each for each in values if each is not None and comparable(dtype, each)]
            if not values and operation != "in_or_null":
                return None
        for each in values:
            if not comparable(dtype, each):
                raise ValueError(f"Cannot compare a {dtype.simpleString()} column with {each!r}")
        slot = _slot(dtype, values)
        return _Part(_Kind(column, operation, slot), tuple(_typed(slot, each) for each in values))

    def _action(self, action: Any) -> _Part | None:
        """The action with a typed value; None when it sets nothing."""
        column, operation, value = action.apply_to, action.operation, action.value
        dtype = self._types[column]
        if operation in ("increment", "decrement"):
            step = Decimal(str(value))
            return _Part(_Kind(column, "increment", _NUMBER), (step if operation == "increment" else -step,))
        if operation in ("append", "prepend"):
            return _Part(_Kind(column, operation, _TEXT), (str(value),))
        if value is None:
            return None
        if isinstance(dtype, T.DecimalType):
            value = Decimal(str(value)).quantize(Decimal(1).scaleb(-dtype.scale), "ROUND_HALF_EVEN")
        slot = _slot(dtype, [value]) if comparable(dtype, value) else _TEXT
        return _Part(_Kind(column, operation, slot), (_typed(slot, value),))

    @staticmethod
    def _kinds(parts: Any) -> dict[_Kind, int]:
        return {kind: at for at, kind in enumerate(sorted({part.kind for part in parts}))}

    def _index(self) -> tuple[dict[_Kind, dict[Any, list[int]]], dict[_Kind, list[_Encoded]]]:
        """Per column and slot, the places of the rules by a value they ask for; and the others by their first condition."""
        index: dict[_Kind, dict[Any, list[int]]] = {}
        scanned: dict[_Kind, list[_Encoded]] = {}
        for place, rule in enumerate(self._rules):
            asked = [part for part in rule.conditions if self._is_indexed(part.kind)]
            if not asked:
                scanned.setdefault(rule.conditions[0].kind, []).append(rule)
                continue
            part = min(asked, key=lambda p: len(p.values))
            values = index.setdefault(part.kind._replace(operation="in"), {})
            for value in set(part.values):
                values.setdefault(value, []).append(place)
        return index, scanned

    def _is_indexed(self, kind: _Kind) -> bool:
        """Flags have two values only, and fractions are compared in their own type."""
        flag = isinstance(self._types[kind.column], T.BooleanType)
        return kind.operation in ("eq", "in") and kind.slot in (_TEXT, _NUMBER, _TIME) and not flag

    def _joined(
        self, df: DataFrame, kind: _Kind, places: dict[Any, list[int]], name: str, broadcast_rows: int
    ) -> DataFrame:
        """Add the places of the rules that ask for a row's value of one column."""
        key = f"_asked{name}"
        dtype = {_TEXT: T.StringType(), _NUMBER: self._exact, _TIME: T.TimestampNTZType()}[kind.slot]
        schema = T.StructType([T.StructField(key, dtype), T.StructField(name, T.ArrayType(T.IntegerType()))])
        table = df.sparkSession.createDataFrame(list(places.items()), schema)
        if kind.slot == _TIME:
            # Times of one day are one date.
            table = table.groupBy(F.col(key).cast(self._types[kind.column]).alias(key)).agg(
                F.array_distinct(F.flatten(F.collect_list(name))).alias(name)
            )
        if sum(map(len, places.values())) <= broadcast_rows:
            return df.join(F.broadcast(table), F.col(kind.column) == F.col(key), "left").drop(key)
        return lookup(df, table, kind.column, key, "left", broadcast_rows=0)

    def _array(self, df: DataFrame, rules: list[_Encoded]) -> Column:
        """The rules as one value."""
        slots = [
            T.StructField("kind", T.IntegerType()),
            T.StructField(_TEXT, T.ArrayType(T.StringType())),
            T.StructField(_NUMBER, T.ArrayType(self._exact)),
            T.StructField(_REAL, T.ArrayType(T.DoubleType())),
            T.StructField(_TIME, T.ArrayType(T.TimestampNTZType())),
        ]
        parts = T.ArrayType(T.StructType(slots))
        rule = T.StructType(
            [
                T.StructField("rank", T.IntegerType()),
                T.StructField("id", T.StringType()),
                T.StructField("text", T.StringType()),
                T.StructField("low", self._exact),
                T.StructField("high", self._exact),
                T.StructField("conditions", parts),
                T.StructField("actions", parts),
            ]
        )

        def row(part: _Part, kinds: dict[_Kind, int]) -> tuple:
            return (
                kinds[part.kind],
                *(list(part.values) if part.kind.slot == slot else None for slot in (_TEXT, _NUMBER, _REAL, _TIME)),
            )

        def first(part: _Part) -> tuple:
            ends = part.values[:2] if part.kind.slot == _NUMBER else ()
            return (part.values[0] if part.kind.slot == _TEXT and part.values else None, *ends, *[None] * (2 - len(ends)))

        rows = [
            (
                each.rank,
                each.id,
                *first(each.conditions[0]),
                [row(part, self._condition_kinds) for part in each.conditions],
                [row(part, self._action_kinds) for part in each.actions],
            )
            for each in rules
        ]
        one = df.sparkSession.createDataFrame([(rows,)], T.StructType([T.StructField("rules", T.ArrayType(rule))]))
        return one.scalar()

    def _holds(self, folded: dict[str, Column]) -> Callable[[Column], Column]:
        def holds(part: Column) -> Column:
            branches = [(at, self._part_test(kind, part, folded)) for kind, at in self._condition_kinds.items()]
            return F.coalesce(_choose(part["kind"], branches, F.lit(False)), F.lit(False))

        return holds

    def _first_holds(self, kind: _Kind, folded: dict[str, Column]) -> Callable[[Column], Column]:
        """The test of a rule's first condition; texts and numbers lie beside the rule for it, which is faster to read."""
        if kind.slot == _TEXT and kind.operation not in _LISTS:
            return lambda rule: self._test(kind, rule["text"], None, None, folded)
        if kind.slot == _NUMBER and kind.operation not in _LISTS:
            return lambda rule: self._test(kind, rule["low"], rule["high"], None, folded)
        return lambda rule: self._part_test(kind, F.get(rule["conditions"], F.lit(0)), folded)

    def _part_test(self, kind: _Kind, part: Column, folded: dict[str, Column]) -> Column:
        values = part[kind.slot]
        return self._test(kind, F.get(values, F.lit(0)), F.get(values, F.lit(1)), values, folded)

    def _test(
        self, kind: _Kind, first: Column, second: Column | None, values: Column | None, folded: dict[str, Column]
    ) -> Column:
        dtype, column = self._types[kind.column], F.col(kind.column)
        if kind.operation in ("contains", "not_contains"):
            held = F.coalesce(folded[kind.column].contains(first), F.lit(False))
            return held if kind.operation == "contains" else ~held
        if kind.operation == "regex":
            return F.rlike(column.cast("string"), first)
        if kind.operation == "approx_eq":
            return F.abs(column.cast("double") - first) <= second
        if isinstance(dtype, T.BooleanType):
            column = column.cast("int")

        def as_asked(value: Column) -> Column:
            return value.cast(dtype) if kind.slot == _TIME else value

        if kind.operation in _LISTS:
            hit = F.exists(values, lambda value: column == as_asked(value))
            return hit if kind.operation == "in" else column.isNull() | hit
        if kind.operation == "between":
            return column.between(as_asked(first), as_asked(second))
        return _ORDERED[kind.operation](column, as_asked(first))


def _choose(kind: Column, branches: list[tuple[int, Column]], otherwise: Column) -> Column:
    if not branches:
        return otherwise
    at, value = branches[0]
    first = F.when(kind == at, value)
    return reduce(lambda chain, branch: chain.when(kind == branch[0], branch[1]), branches[1:], first).otherwise(otherwise)


def _slot(dtype: T.DataType, values: list[Any]) -> str:
    if isinstance(dtype, T.StringType):
        return _TEXT
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return _TIME
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return _REAL
    if isinstance(dtype, T.IntegralType) and any(isinstance(value, float) for value in values):
        return _REAL
    return _NUMBER


def _typed(slot: str, value: Any) -> Any:
    if slot == _TEXT:
        return str(value).lower() if isinstance(value, bool) else str(value)
    if slot == _TIME:
        return as_timestamp(value)
    if slot == _REAL:
        return float(value)
    return Decimal(str(int(value) if isinstance(value, bool) else value))


def _common_decimal(types: set[T.DataType], values: Iterable[Decimal]) -> T.DecimalType:
    """The decimal type that holds all values, and the columns' own where that is possible, which saves casts."""
    units, places = 1, 0
    for value in values:
        digits = value.as_tuple()
        places = max(places, -digits.exponent)
        units = max(units, len(digits.digits) + digits.exponent)
    if units + places > _MOST_DIGITS:
        raise ValueError(f"The numbers in the rules need more than {_MOST_DIGITS} digits together")
    decimals = [dtype for dtype in types if isinstance(dtype, T.DecimalType)]
    wide = max([units, *(dtype.precision - dtype.scale for dtype in decimals)])
    fine = max([places, *(dtype.scale for dtype in decimals)])
    return T.DecimalType(wide + fine, fine) if wide + fine <= _MOST_DIGITS else T.DecimalType(units + places, places)
