"""Dates in free text, as months since year 0. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Words for an end that has not come.
PRESENT = ("present", "current", "now", "today", "ongoing", "date")
SEPARATOR = r"(?i)\s*(?:-|–|—|to|through|thru|until|until\s+present)\s*"
LEAST_YEAR, MOST_YEAR, PIVOT = 1900, 2100, 70


def month_index(year: Column, month: Column) -> Column:
    return (year * 12 + month - 1).cast("int")


def _year(text: Column) -> Column:
    y = F.expr("try_cast(null as int)") if text is None else text.try_cast("int")
    y = F.when(F.length(text) == 2, F.when(y >= PIVOT, 1900 + y).otherwise(2000 + y)).otherwise(y)
    return F.when(y.between(LEAST_YEAR, MOST_YEAR), y)


def parse_month(text: Column) -> Column:
    """Month index of ``2020-03``, ``03/2020``, ``Mar 2020``, ``Mar '21`` or ``2020``, tried in this order; else null."""
    t = F.lower(F.trim(text))
    grab = lambda p, g: F.nullif(F.regexp_extract(t, p, g), F.lit(""))
    iso, numeric = r"\b((?:19|20)\d{2})\s*[-/]\s*(0?[1-9]|1[0-2])\b", r"\b(0?[1-9]|1[0-2])\s*[-/.]\s*((?:19|20)\d{2})\b"
    name = r"^[^a-z]*([a-z]{3})[a-z]{0,6}\b"
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.coalesce(grab(name, 1), F.lit("")))
    year = F.coalesce(_year(grab(r"\b((?:19|20)\d{2})\b", 1)), _year(grab(r"'?\b(\d{2})\b", 1)))
    return F.coalesce(
        month_index(_year(grab(iso, 1)), grab(iso, 2).cast("int")),
        month_index(_year(grab(numeric, 2)), grab(numeric, 1).cast("int")),
        F.when(number > 0, month_index(year, number)),
        month_index(_year(grab(r"\b((?:19|20)\d{2})\b", 1)), F.lit(1)),
    )


def parse_range(text: Column, now_month: Column) -> Column:
    """``struct<start, end>`` in months; ends like ``present`` are ``now_month``; one date alone is its whole year; null parts where nothing can be read."""

    def read(parts: Column) -> Column:
        rest = F.array_join(F.slice(parts, 2, 999), " ")
        end = F.when(F.lower(rest).rlike("|".join(PRESENT)), now_month).otherwise(parse_month(rest))
        year = F.floor(parse_month(F.trim(text)) / 12).cast("int") * 12
        several = F.size(parts) >= 2
        return F.struct(F.when(several, parse_month(F.get(parts, F.lit(0)))).otherwise(year).alias("start"), F.when(several, end).otherwise(year + 11).alias("end"))

    return bound(F.filter(F.split(F.trim(text), SEPARATOR), lambda p: F.trim(p) != ""), read)


def range_status(start: Column, end: Column, now_month: Column) -> Column:
    """``unparsed``, ``invalid`` (ends before it starts, over 50 years, from before 1950 or past next year's end) or ``ok``."""
    bad = (end < start) | (end - start + 1 > 600) | (start < 1950 * 12) | (F.floor(end / 12) > F.floor(now_month / 12) + 1)
    return F.when(start.isNull() | end.isNull(), "unparsed").when(bad, "invalid").otherwise("ok")


#: The styles of dates that are told apart.
STYLES = ("YEAR_MONTH", "NUMERIC_MONTH_YEAR", "MONTH_NAME_YEAR", "YEAR_ONLY")


def date_style(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return (
        F.when(t.rlike(r"\b(19|20)\d{2}\s*[-/]\s*(0?[1-9]|1[0-2])\b"), "YEAR_MONTH")
        .when(t.rlike(r"\b(0?[1-9]|1[0-2])\s*[-/.]\s*(19|20)\d{2}\b"), "NUMERIC_MONTH_YEAR")
        .when(t.rlike(r"\b[a-z]{3,9}\.?[\s,]+\d{2,4}\b"), "MONTH_NAME_YEAR")
        .when(t.rlike(r"\b(19|20)\d{2}\b"), "YEAR_ONLY")
        .otherwise("UNKNOWN")
    )


def years(months: Column) -> Column:
    """Months as years of one place."""
    return F.floor(months / 12 * 10 + 0.5) / 10


def month_label(month: Column) -> Column:
    """``Mar 2020`` from a month index."""
    names = F.array(*[F.lit(m.capitalize()) for m in MONTHS])
    return F.concat_ws(" ", F.get(names, F.pmod(month, F.lit(12)).cast("int")), F.floor(month / 12).cast("string"))


def is_current(end: Column) -> Column:
    """Whether an end is open: null, or told by a word like ``present``."""
    return end.isNull() | F.lower(end).rlike("|".join(PRESENT))


def duration(ms: Column) -> Column:
    """``412ms`` below a second, ``3.2s`` below a minute, else whole minutes as ``4m``."""
    seconds = F.format_string("%.1f", F.floor(ms / 100 + 0.5) / 10)
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60000, F.concat(seconds, F.lit("s"))).otherwise(F.concat(F.floor(ms / 60000).cast("string"), F.lit("m")))
