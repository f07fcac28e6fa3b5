"""Times: parsing of publisher and feed times, windows, gaps, and their text forms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
# Time zones in which publishers write times without a zone.
DOMESTIC_ZONE = "Asia/Ho_Chi_Minh"
PUBLISHER_ZONES = {
    "bbc.com": "Europe/London",
    "channelnewsasia.com": "Asia/Singapore",
    "scmp.com": "Asia/Hong_Kong",
    "asia.nikkei.com": "Asia/Tokyo",
    "straitstimes.com": "Asia/Singapore",
}
ZONED = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z")
UNZONED = ("d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd")


def instant(text: Column) -> Column:
    """Timestamp of an ISO text, null if it is none.  Texts without a zone are UTC."""
    return F.try_to_timestamp(text)


def iso_text(time: Column) -> Column:
    """UTC text with seconds; fractions are cut."""
    return F.date_format(time, ISO)


@pandas_udf(StringType())
def _any_format(text: pd.Series) -> pd.Series:
    """ISO text with or without an offset, by a lenient parser."""
    from dateutil import parser

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        try:
            return parser.parse(s).isoformat()
        except (ValueError, OverflowError, TypeError):
            return None

    return text.map(one)


def publisher_time(text: Column, zone: Column | None = None) -> tuple[Column, Column]:
    """(UTC timestamp, confidence) of a time as publishers write it.

    A time with a zone is ``publisher_reported``; one without is read in ``zone`` (default: the domestic
    one) and ``publisher_reported_timezone_inferred``; with a null zone, unreadable, blank or null it is null and ``unavailable``.
    The usual formats are read in the JVM, the rest by a lenient parser.
    """
    zone = F.lit(DOMESTIC_ZONE) if zone is None else zone
    s = F.regexp_replace(F.trim(text), r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "")
    offset = s.rlike(r"\d[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:Z|[+-]\d{2}:?\d{2})$")
    zoned = F.coalesce(*(F.try_to_timestamp(s, F.lit(p)) for p in ZONED), F.when(offset, F.try_to_timestamp(s)))
    naive = F.coalesce(*(F.when(zoned.isNull(), F.try_to_timestamp(s, F.lit(p))) for p in UNZONED))
    hard = F.when(zoned.isNull() & naive.isNull() & (s != ""), s)
    loose = _any_format(hard)
    has_zone = loose.rlike(r"T.*[+-]\d{2}:\d{2}$")
    zoned = F.coalesce(zoned, F.when(has_zone, F.try_to_timestamp(loose)))
    naive = F.to_utc_timestamp(F.coalesce(naive, F.when(~has_zone, F.try_to_timestamp(loose))), zone)
    time = F.coalesce(zoned, naive)
    confidence = F.when(zoned.isNotNull(), "publisher_reported").when(naive.isNotNull(), "publisher_reported_timezone_inferred").otherwise("unavailable")
    return time, confidence


def zone_of(domain: Column) -> Column:
    """Time zone of an international publisher, null if unknown."""
    pairs = F.create_map(*(F.lit(x) for kv in PUBLISHER_ZONES.items() for x in kv))
    return F.try_element_at(pairs, domain)


def compact_seen_date(text: Column) -> Column:
    """Time written like ``20260301T101500Z``."""
    return F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss'Z'"))


def effective_time(published: Column, first_seen: Column) -> tuple[Column, Column]:
    """(time, its source): the publisher's time, else the first sighting, else null and ``missing``."""
    p, f = instant(published), instant(first_seen)
    return F.coalesce(p, f), F.when(p.isNotNull(), "published_at").when(f.isNotNull(), "first_seen_at").otherwise("missing")


def days(time: Column) -> Column:
    """Days since the epoch."""
    return F.unix_micros(time) / F.lit(86_400_000_000.0)


def hours_apart(a: Column, b: Column) -> Column:
    """Hours between two times, null unless both are known."""
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) / F.lit(3_600_000_000.0)


def in_window(text: Column, since: str | None = None, until: str | None = None) -> Column:
    """Whether a time lies in [since, until); an unreadable time lies in no window, an open end is open."""
    t = instant(text)
    inside = t.isNotNull()
    if since is not None:
        inside &= t >= F.to_timestamp(F.lit(since))
    if until is not None:
        inside &= t < F.to_timestamp(F.lit(until))
    return inside


def in_pilot(mode: Column, first_seen: Column, start: str, hours: int = 48) -> Column:
    """Prospective and first seen within ``hours`` of ``start``."""
    begin = F.to_timestamp(F.lit(start))
    t = instant(first_seen)
    return F.coalesce((mode == "prospective") & (t >= begin) & (t < begin + F.make_dt_interval(hours=F.lit(hours))), F.lit(False))


def is_pre_start(published: Column, feed_started: Column) -> Column:
    """Published before its feed was watched: null if either time is unknown."""
    return instant(published) < instant(feed_started)


def has_zero_offset(text: Column) -> Column:
    """Whether a text is a readable time with an explicit zero offset."""
    return F.coalesce(text.rlike(r"(?:[Zz]|[+-]00:?00)$") & instant(text).isNotNull(), F.lit(False))
