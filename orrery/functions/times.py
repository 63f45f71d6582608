"""Dates and times as column expressions; the session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._columns import col

MARKET_ZONE = "America/New_York"
#: Hosts that publish a day's articles under its midnight.
MIDNIGHT_HOSTS = ("investorplace.com", "fool.com")


def utc_timestamp(c) -> Column:
    """An ISO string, with or without an offset, as a time; null if it is none."""
    return F.try_to_timestamp(col(c).cast("string"))


def any_timestamp(c) -> Column:
    """ISO, seconds (10 digits) or milliseconds (13 digits) since 1970, or RFC 2822; else null."""
    s = F.trim(col(c).cast("string"))
    digits = F.when(s.rlike(r"^\d{10}$|^\d{13}$"), s.try_cast("bigint"))
    day_first = F.regexp_replace(s, r"^[A-Za-z]{3},\s*", "")
    numeric = F.regexp_replace(day_first, r"(GMT|UTC|Z)$", "+0000")
    return F.coalesce(
        F.when(s.rlike(r"^\d{10}$"), F.timestamp_seconds(digits)),
        F.when(s.rlike(r"^\d{13}$"), F.timestamp_millis(digits)),
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.regexp_replace(s, r"^(\S{10}[T ]\d{2}:\d{2})(Z|[+-]\d{2}:?\d{2})$", "$1:00$2"))),
        F.when(numeric.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"), F.try_to_timestamp(numeric, F.lit("d MMM yyyy HH:mm:ss Z"))),
    )


def date_int(c) -> Column:
    """A date as the integer yyyymmdd."""
    return F.date_format(col(c), "yyyyMMdd").cast("int")


def int_date(c) -> Column:
    return F.to_date(col(c).cast("string"), "yyyyMMdd")


def business_days(start, end) -> Column:
    """Mondays to Fridays from ``start`` up to but without ``end``."""
    monday = F.lit("1970-01-05").cast("date")
    since = lambda d: F.datediff(d, monday)
    upto = lambda d: 5 * F.floor(since(d) / 7) + F.least(F.pmod(since(d), F.lit(7)), F.lit(5))
    return (upto(col(end)) - upto(col(start))).cast("int")


def market_time(date, hour: int, zone: str = MARKET_ZONE) -> Column:
    """``hour`` o'clock of ``zone`` on a date, as UTC."""
    return F.to_utc_timestamp(col(date).cast("timestamp") + F.expr(f"interval {hour} hours"), zone)


def article_time(published, link, hosts=MIDNIGHT_HOSTS) -> Column:
    """The time of an article; exact midnights of ``hosts`` and their subdomains count a day later."""
    host = F.regexp_replace(F.try_parse_url(F.lower(F.trim(col(link))), F.lit("HOST")), r"^www\.", "")
    ours = F.lit(False)
    for h in hosts:
        ours = ours | (host == h) | host.endswith("." + h)
    at = col(published)
    return F.when((at == F.date_trunc("day", at)) & F.coalesce(ours, F.lit(False)), at + F.expr("interval 1 day")).otherwise(at)


def hours_between(later, earlier) -> Column:
    """Signed hours, two decimals."""
    return F.round((F.unix_micros(col(later)) - F.unix_micros(col(earlier))) / 3.6e9, 2)


def split_of(date_as_int, train: tuple[int, int], validation: tuple[int, int]) -> Column:
    """train or val by yyyymmdd ranges (both ends in), train first; null outside."""
    d = col(date_as_int)
    return F.when(d.between(*train), F.lit("train")).when(d.between(*validation), F.lit("val"))
