"""URL forms: canonical address, matching key, host, article id.

Addresses are taken apart and put together in Catalyst.  Only addresses whose query needs
re-encoding go through Python; all others cross to it as nulls.
"""

from __future__ import annotations

from urllib.parse import parse_qs, parse_qsl, urlencode

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Tracking parameters, different on purpose in each place that drops them.
DOMESTIC_TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid", "gidzl", "oc")
INTERNATIONAL_TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid", "oc")
MATCHING_TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid")

SHAPE = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
#: A query whose keys and values read the same after decoding and encoding again.
PLAIN_QUERY = r"^[A-Za-z0-9_.~\-=&]*$"


class Parts:
    """Columns of an address; all null where it has no scheme or no host."""

    def __init__(self, url: Column):
        trimmed = F.regexp_replace(url, r"^[\s\x00]+|[\s\x00]+$", "")
        ok = F.regexp_extract(trimmed, SHAPE, 2) != ""
        piece = lambda k: F.when(ok, F.regexp_extract(trimmed, SHAPE, k))
        server = F.regexp_replace(piece(2), r"^.*@", "")
        self.scheme = F.lower(piece(1))
        self.host = F.nullif(F.lower(F.regexp_replace(server, r":[0-9]*$", "")), F.lit(""))
        self.port = F.nullif(F.regexp_extract(server, r":([0-9]+)$", 1), F.lit(""))
        self.path = piece(3)
        self.query = piece(4)


def _items(query: Column, tracking: tuple[str, ...]) -> Column:
    """The kept ``key=value`` items of a plain query, in their order."""
    items = F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.lower(F.split_part(x, F.lit("="), F.lit(1))).isin(*tracking))
    return F.transform(items, lambda x: F.when(F.contains(x, F.lit("=")), x).otherwise(F.concat(x, F.lit("="))))


def _is_plain(query: Column) -> Column:
    """No re-encoding needed, and no key stands twice apart from its first place."""
    keys = F.transform(F.split(query, "&"), lambda x: F.split_part(x, F.lit("="), F.lit(1)))
    return query.rlike(PLAIN_QUERY) & (F.size(keys) == F.size(F.array_distinct(keys)))


def _requery(tracking: tuple[str, ...], as_sorted: bool):
    @pandas_udf(StringType())
    def encode(query: pd.Series) -> pd.Series:
        def one(q: str | None) -> str | None:
            if q is None:
                return None
            if as_sorted:
                return urlencode(sorted((k, v) for k, v in parse_qsl(q, keep_blank_values=True) if k.lower() not in tracking))
            return urlencode({k: v for k, v in parse_qs(q, keep_blank_values=True).items() if k.lower() not in tracking}, doseq=True)

        return query.map(one)

    return encode


def _query(query: Column, tracking: tuple[str, ...], as_sorted: bool = False) -> Column:
    items = _items(query, tracking)
    easy = F.array_join(F.array_sort(items) if as_sorted else items, "&")
    plain = _is_plain(query)
    return F.when(plain, easy).otherwise(_requery(tracking, as_sorted)(F.when(~plain, query)))


def plain_host(host: Column, mobile: bool = True) -> Column:
    """Host without a leading ``www.`` or (``mobile``) ``m.``: one of them, once."""
    return F.regexp_replace(F.lower(host), r"^(?:www|m)\." if mobile else r"^www\.", "")


def canonical_url(url: Column, tracking: tuple[str, ...] = DOMESTIC_TRACKING) -> Column:
    """Canonical address; empty text where there is none (relative, broken, blank, null).

    Scheme and host in lower case, host without ``www.`` or ``m.``, no user, port, parameters or
    fragment, no slash at the end of the path, no tracking parameters; the path keeps its case.
    """
    p = Parts(url)
    # parameters after the last segment's semicolon are no part of the path
    path = F.regexp_replace(F.regexp_replace(p.path, r";[^/]*$", ""), r"/+$", "")
    query = _query(F.coalesce(p.query, F.lit("")), tracking)
    whole = F.concat(p.scheme, F.lit("://"), plain_host(p.host), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.coalesce(whole, F.lit(""))


def matching_key(url: Column) -> Column:
    """Key under which two addresses are the same page; empty text matches nothing.

    Unlike ``canonical_url`` it keeps the port and ``m.`` and sorts the query.
    """
    p = Parts(url)
    path = F.regexp_replace(p.path, r"/+$", "")
    query = _query(F.coalesce(p.query, F.lit("")), MATCHING_TRACKING, as_sorted=True)
    port = F.when(p.port.isNotNull(), F.concat(F.lit(":"), p.port.cast("int").cast("string"))).otherwise("")
    whole = F.concat(p.scheme, F.lit("://"), plain_host(p.host, mobile=False), port, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.coalesce(whole, F.lit(""))


def host_of(url: Column, mobile: bool = False) -> Column:
    """Plain host of an address, empty text if there is none."""
    return F.coalesce(plain_host(Parts(url).host, mobile), F.lit(""))


def article_id(canonical: Column) -> Column:
    """First 16 hex digits of the address's SHA-256; null for no address."""
    return F.when(canonical != "", F.substring(F.sha2(canonical, 256), 1, 16))
