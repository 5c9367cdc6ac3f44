"""Dates and times as pages print them: parsed strictly, in the zone that the page means, else null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Kolkata"
# Hours after which a collection is stale, a sweep overdue, a run stuck.
STALE_HOURS, SWEEP_HOURS, STUCK_HOURS = 48, 26, 2
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def ist_datetime(text: Column) -> Column:
    """dd-MMM-yyyy hh:mm AM/PM in India, as an instant; calendar-checked."""
    p = r"^\s*[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4} (0?[1-9]|1[0-2]):[0-5][0-9] [APap][Mm]\s*$"
    wall = F.when(text.rlike(p), F.try_to_timestamp(F.trim(text), F.lit("d-MMM-yyyy h:mm a")))
    return F.to_utc_timestamp(wall, ZONE)


def month_number(name: Column, fallback: int | None = None) -> Column:
    """1 to 12 from a month's name or its first three letters."""
    at = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.substring(F.lower(F.trim(name)), 1, 3)).cast("int")
    return F.when(at > 0, at).otherwise(F.lit(fallback).cast("int"))


def twenty_four_hour(hour: Column, afternoon: Column) -> Column:
    return hour % 12 + F.when(afternoon, 12).otherwise(0)


def _date(year: Column, month: Column, day: Column) -> Column:
    """A calendar date, or null where there is no such day."""
    return F.try_to_timestamp(F.concat_ws("-", year, month.cast("string"), day), F.lit("yyyy-M-d")).cast("date")


def printed_month_date(text: Column) -> Column:
    """17 September 2026 as a date, or null."""
    p = r"^\s*([0-9]{1,2})\s+([A-Za-z]+)\.?,?\s+([0-9]{4})\s*$"
    return _date(F.regexp_extract(text, p, 3), month_number(F.regexp_extract(text, p, 2)), F.regexp_extract(text, p, 1))


def day_first_date(text: Column) -> Column:
    """struct(date, ambiguous): 05/09/2026 read day first; ambiguous if the day could be a month."""
    plain = F.translate(F.regexp_replace(text, r"^\s+|\s+$", ""), "./", "--")
    read = F.when(plain.rlike("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"), F.try_to_timestamp(plain, F.lit("d-M-yyyy")).cast("date"))

    def judged(date: Column) -> Column:
        return F.struct(date.alias("date"), F.when(date.isNotNull(), (F.dayofmonth(date) <= 12) & (F.dayofmonth(date) != F.month(date))).alias("ambiguous"))

    return F.element_at(F.transform(F.array(read), judged), 1)


def marathi_hour(period: Column, hour: Column) -> Column:
    """The 24-hour hour of a named part of the day, or null where no clock shows it."""
    evening = period.isin("सायंकाळी", "संध्याकाळी")
    return F.when(
        hour.between(1, 12),
        F.when(period == "सकाळी", F.when(hour == 12, 0).otherwise(hour))
        .when(period == "दुपारी", F.when(hour == 12, 12).when(hour <= 6, hour + 12))
        .when(evening, F.when(hour < 12, hour + 12))
        .when(period == "रात्री", F.when(hour.between(7, 11), hour + 12)),
    )


def same_instant(a: Column, b: Column) -> Column:
    """Equal to the millisecond, null-safe: a difference below it is no change."""
    return F.date_trunc("MILLISECOND", a).eqNullSafe(F.date_trunc("MILLISECOND", b))


def iso_instant(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def tender_status(closing_at: Column, as_of: Column) -> Column:
    return F.when(closing_at.isNull(), "unknown").when(closing_at > as_of, "open").otherwise("closed")


def collection_status(last_success: Column, last_check: Column, as_of: Column) -> Column:
    """failing if tried since it last succeeded, stale after two days without success, else collected."""
    failing = last_check.isNotNull() & (last_success.isNull() | (last_check > last_success))
    stale = last_success.isNull() | (last_success < as_of - F.expr(f"INTERVAL {STALE_HOURS} HOURS"))
    return F.when(failing, "failing").when(stale, "stale").otherwise("collected")


def overdue(last_started: Column, as_of: Column) -> Column:
    return last_started.isNull() | (last_started < as_of - F.expr(f"INTERVAL {SWEEP_HOURS} HOURS"))


def stuck(status: Column, started: Column, as_of: Column) -> Column:
    return (status == "running") & (started < as_of - F.expr(f"INTERVAL {STUCK_HOURS} HOURS"))


def after_coverage_start(fiscal_year: Column, expenditure: Column, first_year: int = 2021) -> Column:
    """Expenditure of years before the credible series counts as not published."""
    return F.when(fiscal_year >= first_year, expenditure)
