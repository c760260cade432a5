"""Day-first dates, as a column expression and as a driver-side value parser.

Both read the same shapes: `25/02/2026`, `17 May 2025`, `20th June 27`, `June 19 27`, `2025-05-01`, each
with an optional time. Blanks separate numbers as well as `/`, `.` and `-` do. ISO dates are read as ISO. A zone after
the time is dropped, as ledger times have none. Texts without a full date are not dates.
"""

from __future__ import annotations

import re
from datetime import date, datetime, time, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# Looks ahead for a month name or its abbreviation, then takes the first three letters.
_MONTH = (
    "(?=(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?"
    "|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)(?![a-z]))([a-z]{3})[a-z]*"
)
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
_YEAR = r"(\d{4}|\d{2})"
_WEEKDAY = "(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[ ,]+)?"
_CLOCK = (
    r"(?:[ t,]+((?:0?[1-9]|1[0-2]):\d{2}(?::\d{2})?(?= ?[ap]m$)|\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?=$))"
    r"(?: ?[ap]m)?)?"
)
_AFTERNOON = r"\b(?:0?[1-9]|1[01]):[0-9:]+ ?pm$"
_AFTER_MIDNIGHT = r"\b12:[0-9:]+ ?am$"

# A zone after a time of day.
_ZONE = r"(\d:\d{2}(?:\.\d+)?) ?(?:z|utc|gmt|[+\-]\d{2}:?\d{2})$"

# (date pattern, group of the year, of the month, of the day).
_NUMBER_SHAPES = (
    (r"(\d{1,2})[/.\- ](0?[1-9]|1[0-2])[/.\- ]" + _YEAR, 3, 2, 1),
    # 05/13/2025 can only be read month first.
    (r"(0?[1-9]|1[0-2])[/.\- ](1[3-9]|2\d|3[01])[/.\- ]" + _YEAR, 3, 1, 2),
    (r"(\d{4})[/.\- ](\d{1,2})[/.\- ](\d{1,2})", 1, 2, 3),
    (r"(\d{4})(\d{2})(\d{2})", 1, 2, 3),
)
_NAME_SHAPES = (
    (_DAY + r"[ \-/.,]*" + _MONTH + r"[ \-/.,]*" + _YEAR, 3, 2, 1),
    (_MONTH + r"[ \-/.,]*" + _DAY + r"[ \-/.,]+" + _YEAR, 3, 1, 2),
)


def _any_of(shapes: tuple) -> tuple[str, tuple[list[int], list[int], list[int], int]]:
    """One pattern for all shapes, and its groups: years, months, days and the clock.

    Only the groups of the shape that matched hold text, so a field is all its groups written together.
    """
    fields: tuple[list[int], list[int], list[int]] = ([], [], [])
    for place, (_, *groups) in enumerate(shapes):
        for field, group in zip(fields, groups, strict=True):
            field.append(3 * place + group)
    pattern = "|".join(shape for shape, *_ in shapes)
    return f"^{_WEEKDAY}(?:{pattern}){_CLOCK}$", (*fields, 3 * len(shapes) + 1)


def _centuries() -> dict[int, list[str]]:
    """Which century a two-digit year belongs to: the one within fifty years of today."""
    this_year = datetime.now().year
    found: dict[int, list[str]] = {}
    for year in range(this_year - 50, this_year + 50):
        found.setdefault(year // 100, []).append(f"{year % 100:02d}")
    return found


def parse_dates(col: Column) -> Column:
    """Timestamp (no zone) from day-first text; null when the text is not a full date."""
    return F.coalesce(_usual_shapes(F.trim(col)), _any_shape(F.lower(F.trim(col))))


def _usual_shapes(text: Column) -> Column:
    """`25/02/2026`, `17 May 2025` and `2025-05-17`, alone or before `10:54` or `10:54:00`, by position.

    Most statements use these, and cutting them apart costs a fraction of the patterns.
    """

    def signs(at: dict[int, str]) -> Column:
        return reduce(and_, [F.substring(text, place, 1) == sign for place, sign in at.items()])

    def clocked(date_length: int) -> Column:
        size, hour = F.length(text), date_length + 4
        return (
            (size == date_length)
            | ((size == date_length + 6) & signs({date_length + 1: " ", hour: ":"}))
            | ((size == date_length + 9) & signs({date_length + 1: " ", hour: ":", hour + 3: ":"}))
        )

    def part(start: int, length: int = 9) -> Column:
        return F.substring(text, start, length)

    def dated(year: int, month: Column, day: int, day_size: int, rest: int) -> Column:
        dash = F.lit("-")
        return F.concat(part(year, 4), dash, month, dash, part(day, day_size), part(rest))

    def month_at(start: int) -> Column:
        found = F.instr(F.lit("".join(_MONTHS)), F.lower(part(start, 3)))
        return F.when(found % 3 == 1, ((found + 2) / 3).cast("int").cast("string"))

    iso = (
        F.when(signs({3: "/", 6: "/"}) & clocked(10), dated(7, part(4, 2), 1, 2, 11))
        .when(signs({3: " ", 7: " "}) & clocked(11), dated(8, month_at(4), 1, 2, 12))
        .when(signs({2: " ", 6: " "}) & clocked(10), dated(7, month_at(3), 1, 1, 11))
        .when(signs({5: "-", 8: "-"}) & clocked(10), text)
    )
    return iso.try_cast("timestamp_ntz")


def _any_shape(text: Column) -> Column:
    """All shapes, by pattern.

    The text is rewritten to `@year-month-day clock`, each step using the one before once, so the expression
    stays small; only texts that a shape recognised carry the mark.
    """
    text = F.regexp_replace(text, _ZONE, "$1")
    named = _rewritten(text, _NAME_SHAPES)
    for number, month in enumerate(_MONTHS, start=1):
        named = F.replace(named, F.lit(f"-{month}-"), F.lit(f"-{number}-"))
    marked = F.when(text.rlike("[a-z]{3}"), named).otherwise(_rewritten(text, _NUMBER_SHAPES))
    for century, years in _centuries().items():
        marked = F.regexp_replace(marked, f"^@({'|'.join(years)})-", f"@{century}$1-")
    stamp = F.split_part(marked, F.lit("@"), F.lit(2)).try_cast("timestamp_ntz")
    halved = text.endswith("m")
    shift = (
        F.when(halved & text.rlike(_AFTERNOON), 12)
        .when(halved & text.rlike(_AFTER_MIDNIGHT), -12)
        .otherwise(0)
    )
    return stamp + F.make_dt_interval(F.lit(0), shift)


def _rewritten(text: Column, shapes: tuple) -> Column:
    pattern, (years, months, days, clock) = _any_of(shapes)
    year, month, day = ("".join(f"${group}" for group in field) for field in (years, months, days))
    return F.regexp_replace(text, pattern, f"@{year}-{month}-{day} ${clock}")


def as_timestamp(value: str | date | datetime) -> datetime:
    """The driver-side counterpart of `parse_dates`, for query endpoints."""
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime.combine(value, time.min)
    if not isinstance(value, str):
        raise TypeError(f"Neither a date nor a text: {value!r}")
    text = re.sub(_ZONE, r"\1", value.strip().lower())
    for shapes in (_NUMBER_SHAPES, _NAME_SHAPES):
        pattern, (years, months, days, clock) = _any_of(shapes)
        found = re.match(pattern, text)
        if found is None:
            continue
        year, month, day = (
            "".join(found[group] or "" for group in field) for field in (years, months, days)
        )
        if len(year) == 2:
            year = next(f"{century}{year}" for century, years in _centuries().items() if year in years)
        if month in _MONTHS:
            month = _MONTHS.index(month) + 1
        hour, minute, second = (*(found[clock] or "0:0").split(":"), "0")[:3]
        whole, _, fraction = second.partition(".")
        try:
            stamp = datetime(int(year), int(month), int(day), int(hour), int(minute), int(whole))
        except ValueError:
            break
        if re.search(_AFTERNOON, text):
            stamp += timedelta(hours=12)
        if re.search(_AFTER_MIDNIGHT, text):
            stamp -= timedelta(hours=12)
        return stamp + timedelta(microseconds=int(fraction[:6].ljust(6, "0")))
    raise ValueError(f"Not a full date: {value!r}")
