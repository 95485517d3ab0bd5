"""Date and stamp expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def utc_day(ts: Column, zone: str | None = None) -> Column:
    """Calendar day in UTC of a stamp; naive stamps keep their own day."""
    return F.to_date(F.to_utc_timestamp(ts, zone) if zone else ts)


def compact_date(raw: Column) -> Column:
    """Day of a ``YYYYMMDDTHHMMSSZ`` style stamp; null when it has none."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    head = F.substring(digits, 1, 8)
    return F.when(F.length(digits) >= 8, F.to_date(F.try_to_timestamp(head, F.lit("yyyyMMdd"))))


def iso_date(raw: Column) -> Column:
    """Day of an ISO-8601 date or stamp as written; null when it is neither."""
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)?)?$"
    return F.when(raw.rlike(shape), F.substring(raw, 1, 10).try_cast("date"))


def stamp(raw: Column) -> Column:
    """Timestamp of a plain UTC stamp, an ISO-8601 stamp or an RFC-822 stamp."""
    text = F.trim(raw.cast("string"))
    iso = text.try_cast("timestamp")
    mail = F.try_to_timestamp(F.regexp_replace(text, r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.when(text.rlike(r"^\d{4}-\d{2}"), iso).when(text.rlike(r"^([A-Za-z]{3}, )?\d{1,2} [A-Za-z]{3} \d{4}"), mail)


def age_days(raw: Column, now: Column) -> Column:
    return (now.cast("timestamp").cast("double") - stamp(raw).cast("double")) / 86400


def is_fresh(posted: Column, first_seen: Column, now: Column, max_age: float | None, strict: bool = False) -> Column:
    """Age of the posted date, else of the first sighting, within the limit."""
    if max_age is None:
        max_age = float("inf")
    age = F.coalesce(age_days(posted, now), age_days(first_seen, now))
    return F.coalesce(age <= F.lit(float(max_age)), F.lit(not strict))


def relative_date(text: Column, now: Column) -> Column:
    """"Posted Today", "Posted Yesterday", "Posted 3+ Days Ago" as timestamps."""
    s = F.lower(text)
    pattern = r"posted\s+(\d+)\+?\s+(day|week|month)s?\s+ago"
    n = F.regexp_extract(s, pattern, 1).try_cast("int")
    unit = F.regexp_extract(s, pattern, 2)
    days = F.make_interval(days=F.when(unit == "week", n * 7).otherwise(n))
    months = F.make_interval(months=n)
    return (F.when(s.rlike("just posted|posted today"), now)
            .when(s.contains("posted yesterday"), now - F.expr("INTERVAL 1 DAY"))
            .when(unit.isin("day", "week"), now - days)
            .when(unit == "month", now - months))
