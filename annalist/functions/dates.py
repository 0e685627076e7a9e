"""Date, duration and number functions as Column builders.  What cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def day_first(c: Column | str) -> Column:
    """DD.MM.YYYY"""
    return F.try_to_date(F.trim(col(c)), "dd.MM.yyyy")


# Months by their first three letters.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}


def month_number(c: Column | str) -> Column:
    """By the first three letters, so that common misspellings count."""
    names = F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in kv))
    return F.try_element_at(names, F.lower(F.substring(F.trim(col(c)), 1, 3)))


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")


def long_date(c: Column | str) -> Column:
    """ "January 3, 2002" or "3 January 2002", with month typos."""
    x = col(c)
    mdy, dmy = r"([A-Za-z]+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})", r"(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]+)\.?,?\s+(\d{4})"
    part = lambda p, i: F.nullif(F.regexp_extract(x, p, i), F.lit(""))
    a = _date(part(mdy, 3).cast("int"), month_number(part(mdy, 1)), part(mdy, 2).cast("int"))
    b = _date(part(dmy, 3).cast("int"), month_number(part(dmy, 2)), part(dmy, 1).cast("int"))
    return F.coalesce(a, b)


def pivot_year(c: Column) -> Column:
    """Two-digit years: below 70 are of this century."""
    return F.when(c < 70, c + 2000).when(c < 100, c + 1900).otherwise(c)


def short_date(c: Column | str) -> Column:
    """M/D/YY or M/D/YYYY"""
    p = r"^\s*(\d{1,2})/(\d{1,2})/(\d{2,4})"
    part = lambda i: F.nullif(F.regexp_extract(col(c), p, i), F.lit("")).cast("int")
    return _date(pivot_year(part(3)), part(1), part(2))


def any_date(c: Column | str) -> Column:
    """The first of the known shapes that reads."""
    return F.coalesce(F.try_to_date(F.trim(col(c)), "yyyy-MM-dd"), day_first(c), short_date(c), long_date(c))


def nights(c: Column | str) -> Column:
    """Dates of "April 2-3, 2022" (each day) or of one date; impossible days are dropped."""
    p = r"([A-Za-z]+)\s+(\d{1,2})\s*(?:-|–|and|&)\s*(\d{1,2}),?\s+(\d{4})"
    part = lambda i: F.nullif(F.regexp_extract(col(c), p, i), F.lit(""))
    lo, hi = part(2).cast("int"), part(3).cast("int")
    days = F.when(lo.isNotNull() & (lo <= hi), F.sequence(lo, hi))
    many = F.filter(F.transform(days, lambda d: _date(part(4).cast("int"), month_number(part(1)), d)), lambda d: d.isNotNull())
    one = F.filter(F.array(long_date(c)), lambda d: d.isNotNull())
    return F.coalesce(many, one)


def on_or_after(day: Column | str, weekday: str) -> Column:
    """The first such weekday on or after the day."""
    return F.next_day(F.date_sub(col(day).cast("date"), 1), weekday)


# From which taping day on a show aired on which weekday, and whether live.
AIR_ERAS = [("1900-01-01", "Thu", False), ("2005-09-07", "Fri", False), ("2015-01-10", "Thu", False), ("2016-07-19", "Tue", True), ("2019-10-04", "Fri", False)]


def air_day(tape: Column | str, eras: list = AIR_ERAS) -> Column:
    """struct(air_date, derivation) of a show taped on a day: the era's air weekday on or after it."""
    day = col(tape).cast("date")
    air, live = on_or_after(day, eras[0][1]), F.lit(eras[0][2])
    for start, weekday, is_live in eras[1:]:
        now = day >= F.lit(start).cast("date")
        air, live = F.when(now, on_or_after(day, weekday)).otherwise(air), F.when(now, F.lit(is_live)).otherwise(live)
    return F.struct(air.alias("air_date"), F.when(live & (air == day), "live-broadcast").otherwise("air-night-estimate").alias("derivation"))


def duration_seconds(c: Column | str) -> Column:
    """(M:SS) or (H:MM:SS) anywhere in the text."""
    h = F.regexp_extract(col(c), r"(\d+):(\d{2}):(\d{2})", 0)
    three = [F.regexp_extract(col(c), r"(\d+):(\d{2}):(\d{2})", i).try_cast("int") for i in (1, 2, 3)]
    two = [F.regexp_extract(col(c), r"(\d+):(\d{2})(?!\d)", i).try_cast("int") for i in (1, 2)]
    return F.when(h != "", three[0] * 3600 + three[1] * 60 + three[2]).otherwise(two[0] * 60 + two[1])


def digits(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "[^0-9]", "").try_cast("int")


def stars(c: Column | str) -> Column:
    """Star ratings: "****", "***1/2", "1/2*", "-*"; DUD is 0."""
    t = F.trim(col(c))
    n = F.length(F.regexp_replace(t, r"[^*]", "")).cast("double")
    frac = F.when(t.contains("1/4"), 0.25).when(t.contains("1/2"), 0.5).when(t.contains("3/4"), 0.75).otherwise(0.0)
    lead = t.rlike(r"^-?\s*[123]/[24]\s*\*")
    size = F.when(lead, frac + n - 1).otherwise(n + frac)
    return F.when(F.upper(t) == "DUD", 0.0).when(n == 0, F.lit(None)).when(t.startswith("-"), -size).otherwise(size)


def month_span(c: Column | str) -> Column:
    """struct(start, end) as YYYY-MM of "MM/YYYY - MM/YYYY"."""
    p = r"(\d{2})/(\d{4})(?:\s*-\s*(\d{2})/(\d{4}))?"
    g = lambda i: F.nullif(F.regexp_extract(col(c), p, i), F.lit(""))
    return F.struct(F.concat(g(2), F.lit("-"), g(1)).alias("start"), F.coalesce(F.concat(g(4), F.lit("-"), g(3)), F.concat(g(2), F.lit("-"), g(1))).alias("end"))


def bound(c: Column | str, low: bool) -> Column:
    """A year alone becomes its first or last day, as yyyymmdd."""
    x = col(c).cast("string")
    return F.when(F.length(x) == 8, x).when(F.length(x) == 4, F.concat(x, F.lit("0101" if low else "1231")))


def era_start(year: Column | str, width: int = 3) -> Column:
    """The first year of the bucket; 0 where there is no year."""
    y = col(year).try_cast("int")
    return F.coalesce((F.floor(y / width) * width).cast("int"), F.lit(0))


def month_start(c: Column | str) -> Column:
    """The first day of "Mar 2001" or "March 2001"."""
    p = r"([A-Za-z]{3})[a-z]*\.?\s+(\d{4})"
    part = lambda i: F.nullif(F.regexp_extract(col(c), p, i), F.lit(""))
    return _date(part(2).cast("int"), month_number(part(1)), F.lit(1))


def days_apart(a: Column | str, b: Column | str) -> Column:
    """Signed days from b to a."""
    return F.datediff(col(a), col(b))
