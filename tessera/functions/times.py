"""Capture times: parsing, provenance, calendar buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Trust in where a time comes from.
TIME_TRUST = {"exif": 1.0, "exif-datetime": 0.9, "filename": 0.9, "epoch-name": 0.8, "filename-date": 0.6, "mtime": 0.3}
#: Patterns of dates and times in file names.
DATE = r"((?:19|20)\d{2})[-_.]?(0[1-9]|1[0-2])[-_.]?(0[1-9]|[12]\d|3[01])"
TIME = r"([01]\d|2[0-3])[-_.:]?([0-5]\d)[-_.:]?([0-5]\d)"
NAME_DATETIME = rf"(?iu)(?<!\d){DATE}(?:[ _T-]|\s+(?:at|в)\s+|_?-?){TIME}(?:\d{{1,3}})?(?!\d)"
NAME_DATE = rf"(?<!\d){DATE}(?!\d)"
NAME_EPOCH = r"(?<!\d)(1[0-9]{12})(?!\d)"


def plausible(moment: Column, now: Column) -> Column:
    """From 1990 to two days ahead."""
    return moment.between(F.to_timestamp_ntz(F.lit("1990-01-01 00:00:00")), now + F.expr("INTERVAL 2 DAYS"))


def parsed_exif(raw: Column, now: Column) -> Column:
    """A camera's date and time in one of four patterns; null if none fits or it isn't plausible."""
    text = F.substring(F.trim(F.translate(raw, "\x00", "")), 1, 19)
    found = F.coalesce(*(F.try_to_timestamp(text, F.lit(p)).cast("timestamp_ntz") for p in ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy:MM:dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss")))
    return F.when(plausible(found, now), found)


def _moments(name: Column, pattern: str, build, kind: str, trust) -> Column:
    found = F.transform(F.regexp_extract_all(name, F.lit(pattern), F.lit(0)), lambda m: F.struct(build(m).alias("at"), F.lit(kind).alias("how")))
    return F.filter(found, lambda x: x["at"].isNotNull() & trust(x["at"]))


def time_from_name(stem: Column, now: Column) -> Column:
    """struct(at, how) of the earliest plausible time that a file name holds; null without one.

    Kinds: date and time, milliseconds since 1970 (from 2005), a bare date (taken as noon, and
    only if no other kind names the same day).
    """
    digits = lambda m: F.regexp_replace(m, r"\D", "")
    full = lambda m: F.try_to_timestamp(F.substring(digits(m), 1, 14), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    day = lambda m: F.try_to_timestamp(F.concat(digits(m), F.lit("120000")), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    epoch = lambda m: F.timestamp_millis(m.cast("long")).cast("timestamp_ntz")
    sure = F.concat(
        _moments(stem, NAME_DATETIME, full, "filename", lambda x: plausible(x, now)),
        _moments(stem, NAME_EPOCH, epoch, "epoch-name", lambda x: plausible(x, now) & (x >= F.to_timestamp_ntz(F.lit("2005-01-01 00:00:00")))),
    )
    days = F.filter(_moments(stem, NAME_DATE, day, "filename-date", lambda x: plausible(x, now)), lambda d: ~F.exists(sure, lambda s: s["at"].cast("date") == d["at"].cast("date")))
    return F.get(F.array_sort(F.concat(sure, days), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)), F.lit(0))


def taken_time(exif: Column, stem: Column, modified: Column, now: Column, source: Column | None = None) -> Column:
    """struct(at, how): camera, else file name, else modification; the latter's clock refines a bare date of its day.

    source tells which of the camera's fields it is, `exif` or `exif-datetime`.
    """
    named = time_from_name(stem, now)
    refined = (named["how"] == "filename-date") & (modified.cast("date") == named["at"].cast("date"))
    made = lambda at, how: F.struct(at.alias("at"), how.alias("how"))
    return (
        F.when(exif.isNotNull(), made(exif, F.lit("exif") if source is None else F.coalesce(source, F.lit("exif"))))
        .when(named.isNotNull() & F.coalesce(refined, F.lit(False)), made(modified, F.lit("filename")))
        .when(named.isNotNull(), named)
        .when(modified.isNotNull(), made(modified, F.lit("mtime")))
    )


def trust(how: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in TIME_TRUST.items() for x in pair))[how]


def wall_seconds(moment: Column) -> Column:
    """Seconds of the wall clock since 1970, as if in UTC."""
    return F.unix_timestamp(moment.cast("timestamp"))


def anniversary_offset(day: Column, today: Column) -> Column:
    """Days from today to the day's anniversary in today's year; 29 February becomes the 28th."""
    shifted = F.add_months(day, (F.year(today) - F.year(day)) * 12)
    return F.datediff(shifted, today)


def period(year: Column, width: int) -> Column:
    return year - F.pmod(year, F.lit(width))


def range_title(start: Column, end: Column) -> Column:
    """A day, a range of days, of months or of years, as short as it can be told."""
    day = lambda c: F.dayofmonth(c).cast("string")
    month, year = (lambda c: F.date_format(c, "MMMM")), (lambda c: F.year(c).cast("string"))
    full = lambda c: F.concat_ws(" ", day(c), month(c), year(c))
    same_year = F.year(start) == F.year(end)
    same_month = same_year & (F.month(start) == F.month(end))
    return (
        F.when(start.cast("date") == end.cast("date"), full(start))
        .when(same_month, F.concat(day(start), F.lit("–"), full(end)))
        .when(same_year, F.concat(day(start), F.lit(" "), month(start), F.lit(" – "), full(end)))
        .otherwise(F.concat(full(start), F.lit(" – "), full(end)))
    )


def years_ago(years: Column) -> Column:
    return F.when(years == 1, F.lit("1 year ago")).otherwise(F.concat(years.cast("string"), F.lit(" years ago")))
