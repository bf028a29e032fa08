"""Reading dates, durations, estimates and progress as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 4294967295


def day_index(d: Column) -> Column:
    return F.datediff(d, F.lit("2000-01-01").cast("date"))


def date_of_index(i: Column) -> Column:
    return F.date_add(F.lit("2000-01-01").cast("date"), i)


def weekday(d: Column) -> Column:
    """Monday is 0."""
    return F.weekday(d)


def valid_date(y: Column, m: Column, d: Column) -> Column:
    """Whether year (2000 to 2099), month and day make a date."""
    made = F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")
    return F.coalesce(made.isNotNull() & y.between(2000, 2099), F.lit(False))


def leap_year(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def bucket(hour: Column) -> Column:
    return F.when(hour.between(5, 11), "morning").when(hour.between(12, 16), "afternoon").when(hour.between(17, 20), "evening").when(hour.isNotNull(), "night")


def _boundary_hour(h: Column) -> Column:
    return F.when(h < 5, 5).when(h < 12, 12).when(h < 17, 17).when(h < 21, 21).otherwise(24)


def next_boundary(ts: Column) -> Column:
    """The next moment at which the bucket or the day changes: 5, 12, 17, 21 or 24 o'clock."""
    return F.date_trunc("day", ts) + F.make_dt_interval(F.lit(0), _boundary_hour(F.hour(ts)))


def seconds_to_boundary(ts: Column) -> Column:
    """Clock seconds to the next boundary, halves to even; exact, as doubles of whole moments lose the last digits."""
    left = (_boundary_hour(F.hour(ts)) - F.hour(ts)) * 3600 - F.minute(ts) * 60
    return F.bround(left - F.extract(F.lit("SECOND"), ts), 0).cast("bigint")


def saturating_add(a: Column, b: Column) -> Column:
    return F.least(a + b, F.lit(LONGEST))


def sequence_newer(a: Column, b: Column) -> Column:
    """Whether a follows b among 32-bit numbers that wrap."""
    return F.pmod(a - b, F.lit(1 << 32)).between(1, (1 << 31) - 1)


def duration(seconds: Column) -> Column:
    """"2h 5m", "5m" or "40s"."""
    h, m = F.floor(seconds / 3600), F.floor(seconds / 60) % 60
    return F.when(h > 0, F.concat(h, F.lit("h "), m, F.lit("m"))).when(m > 0, F.concat(m, F.lit("m"))).otherwise(F.concat(seconds, F.lit("s")))


def time_left(seconds: Column, percent: Column) -> Column:
    """Seconds left at the pace so far; null before two minutes or outside 0 to 100 percent."""
    return F.when((seconds >= 120) & (percent > 0) & (percent < 100), F.floor(seconds * (100 - percent) / percent))


def pages_per_minute(pages: Column, seconds: Column) -> Column:
    return F.when(seconds <= 60, F.lit(0.0)).otherwise(pages * 60.0 / seconds)


def finish_date(today: Column, left: Column, done: Column, days: Column) -> Column:
    """Today and as many days as what is left takes at the daily pace (rounded up); null without a pace."""
    return F.when((done > 0) & (days > 0), F.date_add(today, F.ceil(left * days / done).cast("int")))


def word_progress(reached: Column, total: Column) -> Column:
    return F.when((total > 0) & (reached <= total), reached / total)


def size_progress(before: Column, size: Column, part: Column, total: Column) -> Column:
    return F.when(total > 0, (before + F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)) * size) / total)
