"""Candidate rows to audit rows: one projection per branch, no row loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.hashing import exact_reference
from ..functions.relevance import domestic_relevance, international_relevance, with_deciding_rule
from ..functions.times import in_window, instant, iso_text, publisher_time
from ..schemas import AUDIT_COLUMNS, COLLECTION_MODES, ENTRY, SOURCE_SYSTEMS
from .history import keep_first
from .stage import Stage

# Publishers by host: id, group, country.
DOMESTIC_PUBLISHERS = {
    "vnexpress.net": ("vnexpress", None, "VN"),
    "tuoitre.vn": ("tuoitre", None, "VN"),
    "thanhnien.vn": ("thanhnien", None, "VN"),
    "dantri.com.vn": ("dantri", None, "VN"),
    "vietnamnet.vn": ("vietnamnet", None, "VN"),
    "vietnamplus.vn": ("vietnamplus", None, "VN"),
    "baotintuc.vn": ("baotintuc", None, "VN"),
    "tienphong.vn": ("tienphong", None, "VN"),
    "sggp.org.vn": ("sggp", None, "VN"),
    "nhandan.vn": ("nhandan", None, "VN"),
}
INTERNATIONAL_PUBLISHERS = {
    "reuters.com": ("reuters", "thomson_reuters", "GB"),
    "bbc.com": ("bbc", "bbc", "GB"),
    "bbc.co.uk": ("bbc", "bbc", "GB"),
    "apnews.com": ("ap", "ap", "US"),
    "scmp.com": ("scmp", "scmp", "HK"),
    "straitstimes.com": ("straits_times", "sph_media", "SG"),
    "channelnewsasia.com": ("cna", "mediacorp", "SG"),
    "asia.nikkei.com": ("nikkei_asia", "nikkei", "JP"),
}


def publisher_dimension(df: DataFrame, publishers: dict[str, tuple]) -> DataFrame:
    """Dimension table (host, dim_id, dim_group, dim_country) from a fixed list."""
    rows = [(h, *v) for h, v in publishers.items()]
    return df.sparkSession.createDataFrame(rows, "host string, dim_id string, dim_group string, dim_country string")


def with_publisher(df: DataFrame, dimension: DataFrame, host: str, fallback: dict[str, Column]) -> DataFrame:
    """Adds ``publisher_id``, ``publisher_group_id``, ``publisher_country``: a known host takes all three from
    the dimension, nulls too; others take the fallback."""
    known = dimension.withColumn("_known", F.lit(True))
    joined = df.join(known, df[host] == known["host"], "left")
    pick = lambda dim, name: F.when(F.col("_known"), F.col(dim)).otherwise(fallback[name])
    names = {"publisher_id": "dim_id", "publisher_group_id": "dim_group", "publisher_country": "dim_country"}
    return joined.withColumns({f"_{n}": pick(d, n) for n, d in names.items()}).drop("_known", "host", *names.values(), *names).withColumnsRenamed({f"_{n}": n for n in names})


def reasons(*named: tuple[str, Column]) -> Column:
    """The names whose condition holds, joined by ``;`` in order; null if none."""
    return F.nullif(F.concat_ws(";", *(F.when(F.coalesce(broken, F.lit(False)), name) for name, broken in named)), F.lit(""))


def clean_domestic(candidates: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """Audit rows of domestic candidates.  An unreadable entry leaves its fields missing.

    A missing publisher hint stays null.
    """
    dimension = publisher_dimension(candidates, DOMESTIC_PUBLISHERS) if dimension is None else dimension
    entry = F.from_json(F.coalesce("entry_json", F.lit("{}")), ENTRY)
    rows = candidates.withColumn("_e", entry).withColumn("_bad", F.col("entry_json").isNotNull() & (F.col("entry_json") != "") & F.expr("try_parse_json(entry_json) is null"))
    e = lambda name: F.col(f"_e.{name}")
    rows = rows.withColumn("_url", F.trim(F.coalesce(T.first_filled(F.col("url"), e("link")), F.lit(""))))
    rows = rows.withColumn("_canonical", U.canonical_url(F.col("_url"), U.DOMESTIC_TRACKING))
    rows = rows.withColumn("_title", T.clean_html(e("title"))).withColumn("_description", T.clean_html(T.first_filled(e("summary"), e("description"))))
    rows = rows.withColumn("_category", T.clean_html(e("category"))).withColumn("_domain", U.host_of(F.col("_canonical")))
    time, confidence = publisher_time(T.first_filled(e("published"), e("pubDate"), e("updated")))
    rows = rows.withColumn("_time", time).withColumn("_confidence", confidence)
    rows = with_deciding_rule(rows, "_title", "_description", "_canonical", "_rule")
    none = F.lit(None).cast("string")
    rows = with_publisher(rows, dimension, "_domain", {"publisher_id": F.nullif(F.trim("publisher_id_hint"), F.lit("")), "publisher_group_id": none, "publisher_country": F.lit("VN")})
    seen = instant(F.col("first_seen_at"))
    why = reasons(
        ("invalid_entry_json", F.col("_bad")), ("missing_title", F.col("_title") == ""), ("invalid_url", F.col("_canonical") == ""),
        ("non_exact_raw_payload_ref", ~exact_reference(F.col("raw_payload_ref"))), ("missing_first_seen_at", seen.isNull()),
        ("invalid_collection_mode", ~F.coalesce(F.col("collection_mode").isin(*COLLECTION_MODES), F.lit(False))),
    )
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    made = {
        "article_id": U.article_id(F.col("_canonical")), "title": text("_title"), "url": text("_url"), "canonical_url": text("_canonical"), "publisher_domain": text("_domain"),
        "publisher_id": F.col("publisher_id"), "publisher_group_id": F.col("publisher_group_id"), "source_system": F.lit("rss"), "first_seen_at": iso_text(seen), "published_at": iso_text(F.col("_time")),
        "timestamp_confidence": F.col("_confidence"), "language": F.lit("vi"), "publisher_country": F.lit("VN"), "description": text("_description"), "category": text("_category"),
        "vietnam_relevance": domestic_relevance(F.col("_rule")), "duplicate_family_id": none, "branch": F.lit("domestic"), "collection_mode": F.col("collection_mode"),
        "raw_payload_ref": F.col("raw_payload_ref"), "source_seen_at": none, "rejection_reason": why,
    }
    return rows.select(*(made[c].alias(c) for c in AUDIT_COLUMNS))


def clean_international(candidates: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """Audit rows of international candidates; a news-index source never gives a publisher time."""
    dimension = publisher_dimension(candidates, INTERNATIONAL_PUBLISHERS) if dimension is None else dimension
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    rows = candidates.withColumn("_url", blank("url")).withColumn("_title", blank("title"))
    rows = rows.withColumn("_canonical", U.canonical_url(F.col("_url"), U.INTERNATIONAL_TRACKING))
    own = U.plain_host(F.trim(F.coalesce("publisher_domain", F.lit(""))))
    rows = rows.withColumn("_domain", F.when(F.col("_canonical") != "", U.host_of(F.col("_canonical"), mobile=True)).otherwise(own)).withColumn("_system", blank("source_system"))
    fallback = {c: F.col(c) for c in ("publisher_id", "publisher_group_id", "publisher_country")}
    # the fallback columns are read before the join replaces them
    rows = with_publisher(rows, dimension, "_domain", fallback)
    indexed = F.col("_system") == "gdelt_doc"
    published = F.when(~indexed, instant(F.col("published_at")))
    confidence = F.when(published.isNull(), "unavailable").when(
        F.col("timestamp_confidence").isin("publisher_reported", "publisher_reported_timezone_inferred"), F.col("timestamp_confidence")
    ).otherwise("publisher_reported")
    seen = instant(F.col("first_seen_at"))
    why = reasons(
        ("missing_title", F.col("_title") == ""), ("invalid_url", F.col("_canonical") == ""), ("invalid_source_system", ~F.col("_system").isin(*SOURCE_SYSTEMS)),
        ("missing_first_seen_at", seen.isNull()), ("non_exact_raw_payload_ref", ~exact_reference(F.col("raw_payload_ref"))),
        ("invalid_collection_mode", ~F.coalesce(F.col("collection_mode").isin(*COLLECTION_MODES), F.lit(False))),
    )
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    made = {
        "article_id": U.article_id(F.col("_canonical")), "title": text("_title"), "url": text("_url"), "canonical_url": text("_canonical"), "publisher_domain": text("_domain"),
        "publisher_id": F.col("publisher_id"), "publisher_group_id": F.col("publisher_group_id"), "source_system": text("_system"), "first_seen_at": iso_text(seen), "published_at": iso_text(published),
        "timestamp_confidence": confidence, "language": F.col("language"), "publisher_country": F.col("publisher_country"), "description": F.col("description"), "category": F.col("category"),
        "vietnam_relevance": international_relevance(F.col("_title"), F.col("description")), "duplicate_family_id": F.lit(None).cast("string"), "branch": F.lit("international"),
        "collection_mode": F.col("collection_mode"), "raw_payload_ref": F.col("raw_payload_ref"), "source_seen_at": iso_text(instant(F.col("source_seen_at"))), "rejection_reason": why,
    }
    return rows.select(*(made[c].alias(c) for c in AUDIT_COLUMNS))


def relevant(audit: DataFrame) -> DataFrame:
    """Accepted relevant articles, the first seen of each canonical address."""
    kept = audit.filter("rejection_reason is null and vietnam_relevance")
    return keep_first(kept, ["canonical_url"], [F.col("first_seen_at"), F.col("raw_payload_ref")]).drop("source_seen_at", "rejection_reason")


def snapshot(candidates: DataFrame, branch: str, since: str | None = None, until: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(relevant, audit) of one branch over all collectors within a window of first sightings."""
    inside = candidates if since is None and until is None else candidates.filter(in_window(F.col("first_seen_at"), since, until))
    audit = {"domestic": clean_domestic, "international": clean_international}[branch](inside)
    # written: it is a result of its own, and a filter on a column that a cascade of searches makes would repeat them
    audit = Stage(candidates.sparkSession, "audit").write(audit)
    return relevant(audit), audit
