"""Timestamps: parsing what boards send, and the local calendar."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let

# The ISO-8601 forms of a date, a time of day and an offset. A date and a time
# may each be written with separators or without, and one character of any kind joins them.
_DATES = r"(?:(\d{4})-(\d{2})-(\d{2})|(\d{4})(\d{2})(\d{2})|(\d{4})-W(\d{2})(?:-(\d))?|(\d{4})W(\d{2})(\d)?)"
_TIMES = r"(\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d+))?)?|(\d{2})(?:(\d{2})(?:[.,](\d+))?)?)?"
_OFFSETS = r"(?:([+-])(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,]\d+)?)?)?)?"
ISO_FORM = rf"(?s)^{_DATES}(?:.{_TIMES}{_OFFSETS})?$"


def parse_iso_datetime(text: Column) -> Column:
    """An ISO-8601 text as a UTC timestamp; no offset means UTC, anything else is null.

    The whole text must be one of the forms: a bare time, a year or month alone, names of
    zones and padding are none. The session time zone must be UTC (`build_session` sets it).
    """
    plain = F.replace(text, F.lit("Z"), F.lit("+00:00"))
    groups = F.array(*[F.nullif(F.regexp_extract(plain, ISO_FORM, k), F.lit("")) for k in range(1, 24)])

    def parsed(g: Column) -> Column:
        def pick(*numbers: int) -> Column:
            return F.coalesce(*[g[n - 1] for n in numbers])

        year, week, weekday = pick(1, 4, 7, 10), pick(8, 11), F.coalesce(pick(9, 12), F.lit("1"))
        day = F.when(week.isNull(), F.try_to_date(F.concat_ws("-", year, pick(2, 5), pick(3, 6)), "yyyy-MM-dd"))
        day = day.otherwise(_of_week(year, week, weekday))
        hour, minute, second = (F.coalesce(x, F.lit("00")) for x in (pick(13), pick(14, 17), pick(15, 18)))
        fraction = F.rpad(F.substring(F.coalesce(pick(16, 19), F.lit("0")), 1, 6), 6, "0")
        moment = F.try_to_timestamp(F.concat(
            F.date_format(day, "yyyy-MM-dd"), F.lit(" "), hour, F.lit(":"), minute, F.lit(":"), second, F.lit("."), fraction))
        hours, minutes, seconds = (F.coalesce(g[n - 1].cast("int"), F.lit(0)) for n in (21, 22, 23))
        away = F.when(g[19] == "-", F.lit(-1)).otherwise(F.lit(1)) * (hours * 3600 + minutes * 60 + seconds)
        valid = (hours < 24) & (minutes < 60) & (seconds < 60)
        return F.when(valid, F.timestamp_micros(F.unix_micros(moment) - away.cast("bigint") * 1_000_000))

    return F.when(F.regexp_like(plain, F.lit(ISO_FORM)), let(groups, parsed))


def _of_week(year: Column, week: Column, weekday: Column) -> Column:
    """The day of an ISO week date; null for a week or weekday that the year has not."""
    # The fourth of January lies in the first week of its year.
    monday = F.date_trunc("week", F.try_to_date(F.concat(year, F.lit("-01-04")), "yyyy-MM-dd")).cast("date")
    week, weekday = week.cast("int"), weekday.cast("int")
    thursday = F.date_add(monday, (week - 1) * 7 + 3)
    return F.when(
        (week >= 1) & weekday.between(1, 7) & (F.year(thursday) == year.cast("int")), F.date_add(thursday, weekday - 4))


def local_day(moment: Column, zone: str) -> Column:
    """The calendar day of a UTC moment where the reader is."""
    return F.to_date(F.from_utc_timestamp(moment, zone))


def noon_of(day: Column, zone: str) -> Column:
    """A typed calendar day as the UTC moment of its local noon."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 12:00:00"))), zone)
