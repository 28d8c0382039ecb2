"""Written periods as half-open intervals: ``struct(start date, end date, grain string)``.

The fiscal year is named by the year in which it ends and runs from April to
March.  An instant has equal ends.  Nothing stated gives null.  Differences
from a naive reading: the second half of a year is six months long; a month
without a day is that month; a date always needs a year; ISO dates are read as
such, other all-number dates day first; numbers that go on after a span
(01-02-2024) are a date, not a span.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.binding import let, matched, squeeze

# How documents word a period.
INSTANT = r"\bas (?:at|of|on)\b"
ENDED = r"\b(?:year|period|twelve months?|12 months?) ended\b"
FISCAL_WORD = r"(?:fy|f\.y\.|fiscal(?: year)?|financial year)"
SPAN = rf"(?<![\d/.-])(?:{FISCAL_WORD}\s*)?(\d{{4}}|\d{{2}})\s*[-/–]\s*(\d{{4}}|\d{{2}})\b(?!\s*[-/–.]\s*\d)"
SINGLE = rf"\b{FISCAL_WORD}\s*[' ]?(\d{{4}}|\d{{2}})\b"
CALENDAR = r"\b(?:cy|calendar year)\s*(\d{4}|\d{2})\b"
QUARTER = r"\bq([1-4])\b"
PART = r"\b(h1|h2|1h|2h|9m)\b"
FIRST_MONTHS = r"\bfirst (one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|\d{1,2}) months?\b"
BARE_YEAR = r"^((?:19|20)\d{2})\b.{0,2}$"
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve".split()
MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"

_TYPE = "struct<start:date,end:date,grain:string>"


def _interval(start: Column, end: Column, grain: str | Column) -> Column:
    whole = F.struct(start.alias("start"), end.alias("end"), (F.lit(grain) if isinstance(grain, str) else grain).alias("grain"))
    return F.when(start.isNotNull() & end.isNotNull(), whole)


def _year(digits: Column) -> Column:
    """Two digits never mean the last century."""
    n = digits.try_cast("int")
    return F.when(n < 100, n + 2000).otherwise(n)


def _day(year: Column, month: Column | int, day: Column | int) -> Column:
    """A date, null where the year is missing (a failed parse would be caught, but dearly) or there is no such day."""
    pad = lambda x: F.lpad(x.cast("string"), 2, "0") if isinstance(x, Column) else F.lit(f"{x:02d}")
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), pad(month), pad(day))
    return F.when(F.length(year.cast("string")) > 0, F.try_to_date(text, "yyyy-MM-dd"))


def _month_number(name: Column) -> Column:
    return ((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), name) + 2) / 3).cast("int")


def full_date(low: Column) -> Column:
    """The first complete date in a lower-case text."""
    iso = r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b"
    numbers = r"(?<!\d)(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})\b"
    day_first = rf"\b(\d{{1,2}})(?:st|nd|rd|th)? (?:of )?{MONTH},? (\d{{4}})\b"
    month_first = rf"\b{MONTH} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})\b"
    group = lambda p, g: F.regexp_extract(low, p, g)
    return F.coalesce(
        _day(group(iso, 1), group(iso, 2), group(iso, 3)),
        _day(group(day_first, 3), _month_number(matched(low, day_first, 2)), group(day_first, 1)),
        _day(group(month_first, 3), _month_number(matched(low, month_first, 1)), group(month_first, 2)),
        _day(group(numbers, 3), group(numbers, 2), group(numbers, 1)),
    )


def _fiscal(closing: Column) -> Column:
    return _interval(_day(closing - 1, 4, 1), _day(closing, 4, 1), "year")


def _fiscal_base(low: Column) -> Column:
    """The fiscal year or years that a lower-case text names."""
    a, b = _year(matched(low, SPAN, 1)), _year(matched(low, SPAN, 2))
    span = F.when(b == a + 1, _fiscal(b)).when(b > a, _interval(_day(a, 4, 1), _day(b, 4, 1), "multi"))
    return F.coalesce(span, _fiscal(_year(matched(low, SINGLE))))


def _within(base: Column, low: Column) -> Column:
    """The part of a fiscal year that the text names, else the year."""
    word = matched(low, FIRST_MONTHS)
    position = F.array_position(F.array(*[F.lit(w) for w in NUMBER_WORDS]), word).cast("int")
    months = F.greatest(F.lit(1), F.least(F.lit(12), F.coalesce(F.nullif(position, F.lit(0)), word.try_cast("int"))))
    quarter = matched(low, QUARTER).try_cast("int")
    last_year = F.add_months(base["end"], -12)
    quarter_start = F.when(quarter == 4, F.add_months(last_year, 9)).otherwise(F.add_months(base["start"], (quarter - 1) * 3))
    part = matched(low, PART)
    return (
        F.when(word.isNotNull(), _interval(base["start"], F.add_months(base["start"], months), F.when(months == 12, "year").otherwise("part")))
        .when(quarter.isNotNull(), _interval(quarter_start, F.add_months(quarter_start, 3), "quarter"))
        .when(part.isin("h1", "1h"), _interval(base["start"], F.add_months(base["start"], 6), "half"))
        .when(part.isin("h2", "2h"), _interval(F.add_months(base["start"], 6), F.add_months(base["start"], 12), "half"))
        .when(part == "9m", _interval(base["start"], F.add_months(base["start"], 9), "period"))
        .otherwise(base)
    )


def _calendar(year: Column) -> Column:
    return _interval(_day(year, 1, 1), _day(year + 1, 1, 1), "year")


def parse_period(text: Column) -> Column:
    """The interval that a text states, null if it states none.

    In order: an instant ("as at" and a date); a year ended on a date; a fiscal
    year with its quarter, half, nine or first months; a calendar year; a date
    or month alone; a year alone.
    """

    def read(low: Column) -> Column:
        def dated(day: Column) -> Column:
            ended = F.when(F.month(day) == 3, _fiscal(F.year(day))).otherwise(_interval(F.add_months(day, -12), day, "year"))
            framed = F.when(low.rlike(INSTANT), _interval(day, day, "instant")).when(low.rlike(ENDED), ended)
            month_only = rf"\b{MONTH},? (?:of )?(\d{{4}})\b"
            first = _day(matched(low, month_only, 2), _month_number(matched(low, month_only, 1)), 1)
            return F.coalesce(
                F.when(day.isNotNull(), framed),
                let(_fiscal_base(low), lambda base: F.when(base.isNotNull(), _within(base, low))),
                _calendar(_year(matched(low, CALENDAR))),
                _interval(day, day, "instant"),
                _interval(first, F.add_months(first, 1), "month"),
                F.when(F.length(low) <= 6, _calendar(_year(matched(low, BARE_YEAR)))),
            )

        return let(full_date(low), dated)

    return let(F.lower(squeeze(text)), read).cast(_TYPE)


def is_instant(p: Column) -> Column:
    return p["start"] == p["end"]


def overlaps(a: Column, b: Column) -> Column:
    """Half-open overlap; an instant overlaps only what starts with it."""
    return F.when(is_instant(a) | is_instant(b), a["start"] == b["start"]).otherwise((a["start"] < b["end"]) & (b["start"] < a["end"]))


def contains(a: Column, b: Column) -> Column:
    """Both ends inclusive, so a period contains itself."""
    return (a["start"] <= b["start"]) & (b["end"] <= a["end"])


def same_period(a: Column, b: Column) -> Column:
    """Equal ends and grain; null equals null."""
    return a["start"].eqNullSafe(b["start"]) & a["end"].eqNullSafe(b["end"]) & a["grain"].eqNullSafe(b["grain"])


def format_period(p: Column) -> Column:
    return F.when(is_instant(p), F.concat(F.lit("on "), p["start"].cast("string"))).otherwise(F.concat(F.lit("["), p["start"].cast("string"), F.lit(", "), p["end"].cast("string"), F.lit(")")))


def relation(a: Column, b: Column) -> Column:
    """How two periods lie: unstated, equal, disjoint, nested or partial."""
    return (
        F.when(a.isNull() | b.isNull(), "unstated")
        .when(same_period(a, b), "equal")
        .when(~overlaps(a, b), "disjoint")
        .when(contains(a, b) | contains(b, a), "nested")
        .otherwise("partial")
    )


def describe_difference(a: Column, b: Column) -> Column:
    """A sentence on how two periods differ, null where they do not."""
    kind = relation(a, b)
    inner = F.when(contains(a, b), format_period(b)).otherwise(format_period(a))
    outer = F.when(contains(a, b), format_period(a)).otherwise(format_period(b))
    return (
        F.when(kind == "disjoint", F.concat(format_period(a), F.lit(" and "), format_period(b), F.lit(" share no day")))
        .when(kind == "nested", F.concat(inner, F.lit(" is part of "), outer))
        .when(kind == "partial", F.concat(format_period(a), F.lit(" and "), format_period(b), F.lit(" overlap in part")))
    )
