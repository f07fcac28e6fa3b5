"""Identities of records."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def _canonical_json_hash(text: pd.Series) -> pd.Series:
    def one(s: str | None) -> str:
        blob = json.dumps(None if s is None else json.loads(s), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(blob.encode()).hexdigest()

    return text.map(one)


def content_hash(payload_json: Column) -> Column:
    """SHA-256 of a JSON text in canonical form: keys sorted at every depth, no blanks."""
    return _canonical_json_hash(payload_json)


def entry_key(url: Column, fallback_hash: Column) -> Column:
    """The trimmed address, else ``nourl:`` and the hash."""
    return F.coalesce(F.nullif(F.trim(url), F.lit("")), F.concat(F.lit("nourl:"), fallback_hash))


def record_id(key: Column, content: Column) -> Column:
    """Name of one archived line: SHA-256 of ``key|hash``."""
    return F.sha2(F.concat(key, F.lit("|"), content), 256)


def _literal(text: Column) -> Column:
    """JSON literal of a text, ``null`` for null."""
    wrapped = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNull(), "null").otherwise(F.substr(wrapped, F.lit(6), F.length(wrapped) - 6))


def poll_record_id(source: Column, locator: Column, observed_at: Column, payload_json: Column) -> Column:
    """Name of one polled record, different in each poll: hash over source, place, time and payload."""
    named = {"observed_at": _literal(observed_at), "payload": F.coalesce(payload_json, F.lit("null")), "source_locator": _literal(locator), "source_system": _literal(source)}
    items = [F.concat(F.lit(f'"{k}":'), v) for k, v in named.items()]
    return _canonical_json_hash(F.concat(F.lit("{"), F.concat_ws(",", *items), F.lit("}")))


def candidate_key(url: Column, ref: Column) -> Column:
    """The address if it is more than blanks, else the payload reference."""
    return F.when(F.coalesce(F.trim(url), F.lit("")) != "", url).otherwise(ref)


def exact_reference(ref: Column) -> Column:
    """Whether a reference names one archived line."""
    return F.coalesce(F.contains(ref, F.lit("#raw_record_id=")) & (F.substring_index(ref, "=", -1) != ""), F.lit(False))


def event_id(anchor: Column) -> Column:
    return F.concat(F.lit("evt_"), F.substring(F.sha2(anchor, 256), 1, 12))


def family_id(sorted_ids: Column) -> Column:
    return F.concat(F.lit("dupfam_"), F.substring(F.sha2(F.array_join(sorted_ids, "|"), 256), 1, 12))


def fingerprint(columns: list[str]) -> Column:
    """Aggregate: order-free fingerprint of all rows, as text: the sum of 60 bits of each row's MD5, so that any engine can check it."""
    row = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns)))
    return F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")


def archive_label(path: Column) -> Column:
    """Place of an archive file: without scheme and compression suffix."""
    return F.regexp_replace(F.regexp_replace(path, "^file:/*", "/"), r"\.gz$", "")
