"""Dates as text without a zone, as records hold them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the form of dates in files' tags.
DISK_DATE = r"(?U)^\s*(\d{4})[:/-](\d{2})[:/-](\d{2})\s+(\d{2}):(\d{2}):(\d{2})"


def normalize_disk_date(text: Column) -> Column:
    """ISO text of a disk date; fractions and zones are dropped, anything else is null. Ranges aren't checked."""
    part = [F.regexp_extract(text, DISK_DATE, i) for i in range(1, 7)]
    iso = F.concat(part[0], F.lit("-"), part[1], F.lit("-"), part[2], F.lit("T"), part[3], F.lit(":"), part[4], F.lit(":"), part[5])
    return F.when(text.rlike(DISK_DATE), iso)


def _epoch_text(seconds: Column, rest: str) -> Column:
    """The year of epoch seconds given as text, then the rest by its pattern, in UTC. date_format would sign years beyond 9999."""
    time = F.timestamp_seconds(seconds.try_cast("bigint")).cast("timestamp_ntz")
    year = F.year(time).cast("string")
    return F.concat(F.when(F.year(time).between(0, 999), F.lpad(year, 4, "0")).otherwise(year), F.date_format(time, rest))


def epoch_to_iso(seconds: Column) -> Column:
    """ISO text in UTC of epoch seconds given as text; null if that isn't a whole number."""
    return _epoch_text(seconds, "-MM-dd'T'HH:mm:ss")


def epoch_to_exif(seconds: Column) -> Column:
    """The text that a tag gets for epoch seconds: the time in UTC with its zone."""
    return F.concat(_epoch_text(seconds, ":MM:dd HH:mm:ss"), F.lit("+00:00"))


#: A date with or without hyphens, then perhaps a time with or without colons, a fraction and a zone.
ISO_DATE = r"^(\d{4})(-?)(\d{2})\2(\d{2})(?:\D(\d{2})(?:(:?)(\d{2})(?:\6(\d{2})(?:[.,](\d{1,6})\d*)?)?)?(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2}(?:\.\d+)?)?)?)?)?$"


def parse_iso(text: Column) -> Column:
    """The time on the clock of ISO text, null if it is none; a zone is left out. Dates by week numbers aren't read."""
    y, mo, d, h, mi, s, f = (F.regexp_extract(text, ISO_DATE, i) for i in (1, 3, 4, 5, 7, 8, 9))
    or_zero = lambda c, zero: F.when(c == "", zero).otherwise(c)
    whole = F.concat(y, F.lit("-"), mo, F.lit("-"), d, F.lit(" "), or_zero(h, "00"), F.lit(":"), or_zero(mi, "00"), F.lit(":"), or_zero(s, "00"), F.lit("."), or_zero(f, "0"))
    return F.when(text.rlike(ISO_DATE), whole).try_cast("timestamp_ntz")


def first_date(dates: Column) -> Column:
    """A record's first date; a record without one, or with one that isn't a date, fails the query."""
    found = parse_iso(F.get(dates, F.lit(0)))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("record has no valid first date: "), F.coalesce(F.get(dates, F.lit(0)), F.lit("none")))).cast("timestamp_ntz"))


def stamp(date: Column) -> Column:
    """The file-name form of a timestamp."""
    return F.date_format(date, "yyyyMMdd-HHmmss")
