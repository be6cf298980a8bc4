"""Time columns: 14- and 17-digit stamps, partial stamps, seconds, page times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FILL = "00000101000000000"


def iso_to_ts14(iso: Column) -> Column:
    """Digits of an ISO time, 14 of them."""
    return F.substring(F.regexp_replace(iso, r"[-:TZ.\s]", ""), 1, 14)


def iso_to_ts17(iso: Column) -> Column:
    """Digits of an ISO time to the millisecond."""
    return F.substring(F.regexp_replace(iso, r"[-:TZ.\s]", ""), 1, 17)


def ms_to_ts14(ms: Column) -> Column:
    """14-digit stamp, UTC, of epoch milliseconds, in any session time zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int"))
    s = F.floor(F.pmod(ms, F.lit(86_400_000)) / 1000)
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(F.date_format(day, "yyyyMMdd"), two(F.floor(s / 3600)), two(F.pmod(F.floor(s / 60), F.lit(60))), two(F.pmod(s, F.lit(60))))


def ts_to_ms(digits: Column) -> Column:
    """Epoch milliseconds of a full or partial stamp; null for '', non-digits and days or hours that don't exist (D3).

    Missing digits come from January the first, midnight.
    """
    full = F.concat(digits, F.substring(F.lit(_FILL), F.length(digits) + 1, F.lit(17)))
    num = lambda a, n: F.substring(full, a, n).try_cast("int")
    month, of_month = num(5, 2), num(7, 2)
    first = F.when(month.between(1, 12), F.make_date(num(1, 4), month, F.lit(1)))
    day = F.when(of_month.between(1, F.dayofmonth(F.last_day(first))), F.unix_date(first) + of_month - 1).cast("long")
    clock = (num(9, 2) < 24) & (num(11, 2) < 60) & (num(13, 2) < 60)
    ms = ((day * 24 + num(9, 2)) * 60 + num(11, 2)) * 60 + num(13, 2)
    return F.when(digits.rlike(r"^[0-9]{4,17}\z") & clock, ms * 1000 + num(15, 3))


def ms_to_seconds(ms: Column) -> Column:
    return F.floor(ms / 1000).cast("long")


def page_ts(ts_ms: Column, stamp: Column, iso: Column) -> Column:
    """A page's time: the number, else its stamp, else its ISO date."""
    return F.coalesce(ts_ms, ts_to_ms(stamp), ts_to_ms(iso_to_ts17(iso)))
