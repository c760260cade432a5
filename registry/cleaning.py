"""Column cleaners, categories, rules and name resolution."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions import cleaning
from ledgerloom.functions.dates import parse_dates as parse
from ledgerloom.operators.categories import map_categories, with_direction
from ledgerloom.operators.resolve import resolve_names
from ledgerloom.operators.rules import Action, Condition, Rule, category_rule, load_rules, rules_from_json
from ledgerloom.operators.rules import apply_rules as run_rules
from ledgerloom.operators.rules import rule_audit as audit
from ledgerloom.operators.rules import tag_rules
from registry.catalogue import catalogue
from registry.views import TX_EVENTS, TX_ORDERS, table, tx_events, tx_orders, with_views

query, QUERIES, ORACLES = catalogue()


@query(
    """select event_id, case when event_type = 'error' then null else cast(value as decimal(24,10)) end as amount
       from events"""
)
def clean_money(spark, sf):
    text = F.when(F.col("event_type") == "error", F.concat(F.col("value").cast("string"), F.lit("d"))).otherwise(
        F.concat(F.lit(" £"), F.format_number("value", 2))
    )
    return table(spark, sf, "events").select("event_id", cleaning.clean_money(text).alias("amount"))


@query(
    """select l_orderkey, l_linenumber, l_partkey, l_shipdate,
              cast(round_even(cast(l_extendedprice as decimal(12,2)) * cast(l_discount as decimal(4,2)), 2)
                   as decimal(12,2)) as amount
       from lineitem"""
)
def quantise_half_even(spark, sf):
    product = F.col("l_extendedprice").cast("decimal(12,2)") * F.col("l_discount").cast("decimal(4,2)")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", cleaning.quantise(product).alias("amount")
    )


@query(
    """select o_orderkey, style, case when style in ('clock', 'iso') then o_orderdate + interval 754 minute
              else o_orderdate end as parsed
       from orders, (values ('slashes'), ('words'), ('short'), ('clock'), ('iso'), ('ordinal'), ('american')) s(style)
       union all select o_orderkey, 'nonsense', null from orders"""
)
def parse_dates(spark, sf):
    """Every order date in seven notations, and once as a text that is no date."""
    day = F.col("o_orderdate")
    noon = day + F.expr("interval 754 minutes")
    texts = {
        "slashes": F.date_format(day, "dd/MM/yyyy"),
        "words": F.date_format(day, "d MMMM yyyy"),
        "short": F.date_format(day, "d-MMM-yy"),
        "clock": F.date_format(noon, "dd.MM.yyyy h:mm a"),
        "iso": F.date_format(noon, "yyyy-MM-dd'T'HH:mm:ss"),
        "ordinal": F.concat(F.dayofmonth(day).cast("string"), F.lit("th "), F.date_format(day, "MMM yyyy")),
        "american": F.date_format(day, "MMMM d, yyyy"),
        "nonsense": F.concat(F.lit("order "), F.col("o_orderkey").cast("string")),
    }
    styles = F.array(*[F.struct(F.lit(style).alias("style"), text.alias("text")) for style, text in texts.items()])
    return (
        table(spark, sf, "orders")
        .select("o_orderkey", F.inline(styles))
        .select("o_orderkey", "style", parse(F.col("text")).alias("parsed"))
    )


@query(
    """select page_id, replace(replace(replace(replace(html, '&middot;', chr(183)), '&copy;', chr(169)),
              '&quot;', '"'), '&amp;', '&') as html from pages"""
)
def decode_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", cleaning.decode_html(F.col("html")).alias("html"))


@query(
    with_views(
        TX_EVENTS,
        query="""select event_id, nullif(name, 'view') is null as missing,
               coalesce(nullif(name, 'view'), 'Unknown') as name,
               coalesce(nullif(category, 'click'), 'UNCATEGORISED') as category,
               nullif(notes, '{"k": 1}') as notes from tx_events""",
    )
)
def null_domain(spark, sf):
    name, category = F.nullif(F.col("name"), F.lit("view")), F.nullif(F.col("category"), F.lit("click"))
    return tx_events(spark, sf).select(
        "event_id",
        name.isNull().alias("missing"),
        cleaning.known_name(name).alias("name"),
        cleaning.known_category(category).alias("category"),
        F.nullif(F.col("notes"), F.lit('{"k": 1}')).alias("notes"),
    )


_CATEGORY_MAP = {"purchase": "groceries", "signup": "INCOME", "click": "transfer", "error": "fee"}


@query(
    with_views(
        TX_EVENTS,
        query="""select event_id, coalesce(m.standard, category) as category from tx_events left join
        (values ('purchase', 'groceries'), ('signup', 'INCOME'), ('click', 'transfer'), ('error', 'fee'))
        m(raw, standard) on m.raw = category""",
    )
)
def category_map(spark, sf):
    return map_categories(tx_events(spark, sf).select("event_id", "category"), _CATEGORY_MAP)


@query(
    with_views(
        TX_EVENTS,
        query="""select event_id, coalesce(m.standard, category) as category, m.direction from tx_events left join
        (values ('purchase', 'groceries', 'outgoing'), ('signup', 'INCOME', 'incoming'),
                ('click', 'transfer', 'internal'), ('error', 'fee', 'outgoing')) m(raw, standard, direction)
        on m.raw = category""",
    )
)
def category_direction(spark, sf):
    return with_direction(map_categories(tx_events(spark, sf).select("event_id", "category"), _CATEGORY_MAP))


def _fixed(id: str) -> dict:
    return {"id": id, "created_at": datetime(2025, 1, 1)}


RULES = [
    category_rule({"name": "^purchase"}, "groceries", **_fixed("a")),
    category_rule({"name": "^e", "amount": (-20, 0)}, "bill", 1, **_fixed("b")),
    category_rule({"amount": ">=40", "name": "!click"}, "salary", 2, **_fixed("c")),
    Rule(
        (Condition("name", "in", ["view", "click"]), Condition("amount", "lt", 30)),
        (Action("notes", "append", " seen"), Action("amount", "increment", 1.25)),
        0,
        "seen",
        **_fixed("d"),
    ),
    Rule(
        (Condition("name", "eq", "view"),),
        (Action("notes", "prepend", "low: "), Action("category", "set", "leisure"), Action("amount", "decrement", 1)),
        -1,
        "views",
        **_fixed("e"),
    ),
    Rule((), (Action("category", "set", "never"),), 9, "empty", **_fixed("f")),
]

# One column per rule, then the fold from low to high priority.
_HITS = """hits as (select *,
    contains(upper(name), 'PURCHASE') as a,
    contains(upper(name), 'E') and amount between -20 and 0 as b,
    amount >= 40 and not contains(upper(name), 'CLICK') as c,
    name in ('view', 'click') and amount < 30 as d,
    name = 'view' as e from tx_events)"""
_CATEGORY = """case when c then 'salary' when b then 'bill' when a then 'groceries' when e then 'leisure'
    else category end as category"""


@query(
    with_views(
        TX_EVENTS,
        _HITS,
        query=f"""select event_id, {_CATEGORY},
               case when e then 'low: ' else '' end || notes || case when d then ' seen' else '' end as notes,
               cast(amount - case when e then 1 else 0 end + case when d then 1.25 else 0 end as decimal(12,2)) amount
        from hits""",
    )
)
def apply_rules(spark, sf):
    return run_rules(tx_events(spark, sf), RULES).select("event_id", "category", "notes", "amount")


@query(
    with_views(
        TX_EVENTS,
        _HITS,
        query="""select event_id, case when c then 'c' when b then 'b' when d then 'd' when a then 'a'
        when e then 'e' end as rule_id from hits""",
    )
)
def rule_priority(spark, sf):
    """Rule `d` outranks `a` at the same priority and time by its id."""
    return tag_rules(tx_events(spark, sf), RULES).select("event_id", "rule_id")


@query(
    with_views(
        TX_EVENTS,
        _HITS,
        """wins as (select *, case when c then 'c' when b then 'b' when d then 'd' when a then 'a'
        when e then 'e' end as winner from hits)""",
        query=" union all ".join(
            f"select '{id}' rule_id, {priority} priority, count(*) filter (where {id}) hits, "
            f"count(*) filter (where winner = '{id}') wins from wins"
            for id, priority in (("a", 0), ("b", 1), ("c", 2), ("d", 0), ("e", -1))
        )
        + " union all select 'f', 9, 0, 0",
    )
)
def rule_audit(spark, sf):
    return audit(tx_events(spark, sf), RULES)


@query(
    with_views(
        TX_ORDERS,
        query="""select o_orderkey, category, amount, changed from (
            select o_orderkey, amount, case when name ilike '%urgent%' and amount between -200000 and 0 then 'bill'
                   when name ilike '%high%' then 'groceries' when abs(balance - 300000) <= 100000 then 'loan_payment'
                   else category end as category,
                   (name ilike '%urgent%' and amount between -200000 and 0) or name ilike '%high%'
                   or abs(balance - 300000) <= 100000 as changed
            from tx_orders)""",
    )
)
def rule_shorthand(spark, sf):
    rules = [
        category_rule({"balance": "300000(100000)"}, "loan_payment", **_fixed("a")),
        category_rule({"name": "^high"}, "groceries", 1, **_fixed("b")),
        category_rule({"name": "^urgent", "amount": (-200000, 0)}, "bill", 2, **_fixed("c")),
    ]
    changed = run_rules(tx_orders(spark, sf), rules, changed="changed")
    return changed.select("o_orderkey", "category", "amount", "changed")


def _numbered(number: int) -> Rule:
    """Rules by account and amount, then by text in the notes, then by a band of amounts without clicks."""
    if number < 1500:
        conditions = (
            Condition("account_name", "eq", str(number)),
            Condition("amount", "between", (-50 - number % 7, 100)),
        )
    elif number < 1900:
        conditions = (Condition("notes", "contains", str(number - 1500)),)
    else:
        conditions = (
            Condition("amount", "between", (number - 1900, number - 1899)),
            Condition("name", "not_contains", "click"),
        )
    return Rule(conditions, (Action("category", "set", f"category {number}"),), number % 7, **_fixed(f"{number:04d}"))


@query(
    with_views(
        TX_EVENTS,
        """hits as (
            select event_id, (i % 7) * 10000 + i as place, i from tx_events, range(2000) r(i)
            where (i < 1500 and account_name = cast(i as varchar) and amount between -50 - i % 7 and 100)
               or (i between 1500 and 1899 and contains(upper(notes), cast(i - 1500 as varchar)))
               or (i >= 1900 and amount between i - 1900 and i - 1899 and not contains(upper(name), 'CLICK')))""",
        """found as (select event_id, count(*) n_rules, max(place) % 10000 last from hits group by event_id)""",
        query="""select event_id, coalesce(n_rules, 0) n_rules, printf('%04d', last) as rule_id,
               coalesce('category ' || cast(last as varchar), category) as category
        from tx_events left join found using (event_id)""",
    )
)
def rules_2000(spark, sf):
    """Two thousand rules as data: which win, how many match, and the categories they give."""
    rules = [_numbered(number) for number in range(2000)]
    tagged = tag_rules(run_rules(tx_events(spark, sf).withColumn("label", F.col("category")), _labelled(rules)), rules)
    return tagged.select(
        "event_id", F.size("rule_ids").cast("bigint").alias("n_rules"), "rule_id", F.col("label").alias("category")
    )


def _labelled(rules: list[Rule]) -> list[Rule]:
    """The rules with their changes made to the column `label`."""
    return [
        replace(rule, actions=tuple(replace(action, apply_to="label") for action in rule.actions)) for rule in rules
    ]


_OPERATIONS = [
    Condition("amount", "approx_eq", 10.5),
    Condition("amount", "gt", 40),
    Condition("amount", "gte", Decimal("40.25")),
    Condition("amount", "lt", -30),
    Condition("amount", "lte", -12.5),
    Condition("name", "regex", "^(view|sig)"),
    Condition("name", "not_contains", "I"),
    Condition("date", "between", ("2024-01-05", "2024-01-20")),
    Condition("account_name", "in", ["1", "22", "333"]),
]


_OPERATIONS_SQL = with_views(
    TX_EVENTS,
    query="""select event_id, concat_ws(',',
        case when abs(amount - 10.5) <= 0.00010501 then '0' end, case when amount > 40 then '1' end,
        case when amount >= 40.25 then '2' end, case when amount < -30 then '3' end,
        case when amount <= -12.5 then '4' end, case when regexp_matches(name, '^(view|sig)') then '5' end,
        case when not contains(upper(name), 'I') then '6' end,
        case when date between timestamp '2024-01-05' and timestamp '2024-01-20' then '7' end,
        case when account_name in ('1', '22', '333') then '8' end) as rules
    from tx_events""",
)


def _matching(spark, sf, per_pass):
    rules = [
        Rule((condition,), (), -place, **_fixed(str(place))) for place, condition in enumerate(_OPERATIONS)
    ]
    tagged = tag_rules(tx_events(spark, sf), rules, per_pass=per_pass)
    return tagged.select("event_id", F.concat_ws(",", "rule_ids").alias("rules"))


@query(_OPERATIONS_SQL)
def rule_operations(spark, sf):
    """A rule for each operation of conditions, compiled."""
    return _matching(spark, sf, per_pass=len(_OPERATIONS))


@query(_OPERATIONS_SQL)
def rule_operations_as_data(spark, sf):
    """The same rules, interpreted."""
    return _matching(spark, sf, per_pass=0)


@query(
    with_views(
        TX_EVENTS,
        query="""select event_id,
               case when name in ('view', 'click') and amount between -2 and 30.5 then 'browsing' else category end
                   as category,
               case when notes = '{"k": 7}' then 'k7 ' else '' end || notes as notes,
               cast(amount + case when name in ('view', 'click') and amount between -2 and 30.5 then 2.5 else 0 end
                    as decimal(12,2)) as amount
        from tx_events""",
    )
)
def rules_json(spark, sf):
    """Rules that are stored as JSON lists of conditions and actions."""
    stored = spark.createDataFrame(
        [
            (
                "1",
                datetime(2025, 1, 1),
                None,
                """[{"apply_to": "name", "operation": "in", "value": ["view", "click"]},
                    {"apply_to": "amount", "operation": "between", "value": [-2, 30.5]}]""",
                """[{"apply_to": "category", "operation": "set", "value": "browsing"},
                    {"apply_to": "amount", "operation": "increment", "value": 2.5}]""",
                None,
            ),
            (
                "2",
                datetime(2025, 1, 1),
                "sevens",
                """[{"apply_to": "notes", "operation": "eq", "value": "{\\"k\\": 7}"}]""",
                """[{"apply_to": "notes", "operation": "prepend", "value": "k7 "}]""",
                4,
            ),
        ],
        "id string, created_at timestamp, name string, conditions string, actions string, priority int",
    )
    changed = run_rules(tx_events(spark, sf), load_rules(rules_from_json(stored)))
    return changed.select("event_id", "category", "notes", "amount")


@query(
    """with known as (select distinct p_brand as name, replace(lower(p_brand), ' ', '') as key from part),
       inputs as (
           select distinct upper(p_brand) as input from part
           union select distinct replace(p_brand, '#', ' #, ') from part
           union select distinct substr(p_brand, instr(p_brand, '#')) from part
           union select distinct 'zz' || reverse(p_brand) || 'zz' from part),
       folded as (select input, replace(replace(lower(input), ' ', ''), ',', '') as folded from inputs),
       counted as (
           select input, max(name) filter (where key = folded) as exact,
                  count(*) filter (where starts_with(key, folded)) as n_started,
                  max(name) filter (where starts_with(key, folded)) as started,
                  count(*) filter (where contains(key, folded)) as n_held,
                  max(name) filter (where contains(key, folded)) as held
           from folded, known group by input)
       select input,
              case when exact is not null then exact when n_started = 1 then started when n_held = 1 then held
              end as match,
              case when exact is not null then 'exact' when n_started = 1 then 'prefix'
                   when n_held = 1 then 'substring' when n_held > 1 then 'ambiguous' else 'none' end as method,
              case when exact is not null or n_started = 1 then 1 else n_held end as n_candidates
       from counted"""
)
def fuzzy_resolve(spark, sf):
    """Spellings that are settled without similarity: case, spaces, suffixes, and texts like nothing known."""
    brand = F.col("p_brand")
    spellings = F.array(
        F.upper(brand),
        F.replace(brand, F.lit("#"), F.lit(" #, ")),
        F.substring(brand, F.instr(brand, "#"), F.length(brand)),
        F.concat(F.lit("zz"), F.reverse(brand), F.lit("zz")),
    )
    parts = table(spark, sf, "part")
    return resolve_names(parts.select(F.explode(spellings).alias("spelt")), "spelt", parts, "p_brand")


@query()
def fuzzy_resolve_similar(spark, sf):
    """Part and customer names with a letter dropped, two swapped or one doubled, against the right ones."""
    parts, customers = table(spark, sf, "part"), table(spark, sf, "customer")
    names = parts.select(F.col("p_name").alias("name")).unionByName(customers.select(F.col("c_name").alias("name")))
    name, size = F.col("name"), F.length("name")
    spellings = F.array(
        F.concat(F.substring(name, 1, 2), F.substring(name, F.lit(4), size)),
        F.concat(F.substring(name, 2, 1), F.substring(name, 1, 1), F.substring(name, F.lit(3), size)),
        F.concat(F.substring(name, 1, 1), name),
    )
    return resolve_names(names.select(F.explode(spellings).alias("spelt")), "spelt", names, "name")
