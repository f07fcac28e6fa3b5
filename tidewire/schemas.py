"""Declared schemas of the tables, so that readers never infer and the contract can be checked."""

from __future__ import annotations

# The shared article columns in contract order; all text but the relevance flag.
ARTICLE_COLUMNS = [
    "article_id", "title", "url", "canonical_url", "publisher_domain", "publisher_id", "publisher_group_id", "source_system",
    "first_seen_at", "published_at", "timestamp_confidence", "language", "publisher_country", "description", "category",
    "vietnam_relevance", "duplicate_family_id", "branch", "collection_mode", "raw_payload_ref",
]
AUDIT_COLUMNS = [*ARTICLE_COLUMNS, "source_seen_at", "rejection_reason"]
CLUSTERED_COLUMNS = [*ARTICLE_COLUMNS, "event_cluster_id"]


def _text(columns: list[str]) -> str:
    return ", ".join(f"{c} {'boolean' if c == 'vietnam_relevance' else 'string'}" for c in columns)


ARTICLE = _text(ARTICLE_COLUMNS)
AUDIT = _text(AUDIT_COLUMNS)
CLUSTERED = _text(CLUSTERED_COLUMNS)
ENTRY = "link string, title string, summary string, description string, published string, pubDate string, updated string, category string"
PAYLOAD = (
    "raw_record_id string, entry_key string, content_hash string, source_system string, source_locator string, "
    f"publisher_id_hint string, observed_at string, payload struct<{ENTRY.replace(' string', ': string')}>"
)
SIGHTING = (
    "observed_at string, run_id string, branch string, collector_host string, entry_key string, content_hash string, is_new boolean, payload_ref string"
)
SEEN = "entry_key string, content_hash string, first_seen_at string, last_seen_at string, payload_ref string"
CANDIDATE = (
    "url string, publisher_id_hint string, feed_url string, source_system string, first_seen_at string, last_seen_at string, "
    "collection_mode string, raw_payload_ref string, entry_json string"
)
FEED_RESULT = "struct<feed_id: string, feed_url: string, http_status: int, content_encoding: string, n_entries: int, n_new: int, error: string>"
HEARTBEAT = (
    "run_id string, run_at string, collector_host string, duration_seconds double, "
    f"children map<string, struct<ok: boolean, duration_seconds: double, new_payloads: int, entries_seen: int, error: string, per_feed: array<{FEED_RESULT}>>>, "
    "overall_ok boolean, feed_issues array<string>, stale_feed_issues array<string>, ping_ok boolean"
)
FEED_STATE = "map<string, map<string, map<string, struct<feed_started_at: string, publisher_id_hint: string>>>>"

# Permitted values of the contract's enumerations.
BRANCHES = ("domestic", "international")
COLLECTION_MODES = ("prospective", "historical_backfill")
CONFIDENCES = ("publisher_reported", "publisher_reported_timezone_inferred", "unavailable")
SOURCE_SYSTEMS = ("rss", "gdelt_doc")
