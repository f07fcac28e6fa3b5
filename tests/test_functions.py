from __future__ import annotations

import hashlib
import json

import pytest
from conftest import rows_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.functions import hashing, text, times, urls
from tidewire.functions.relevance import deciding_rule, domestic_relevance, international_relevance, searched_text
from tidewire.functions.vectors import cosine_distance, unit


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    row = tuple(values.values()) or (None,)
    return spark.createDataFrame([row], schema).select(column.alias("r")).head()["r"]


@pytest.mark.parametrize(
    "url, canonical",
    [
        ("https://www.a.example/p/?utm_source=x&id=123#top", "https://a.example/p?id=123"),
        ("HTTP://M.A.Example/Path/", "http://a.example/Path"),
        ("https://a.example/p?fbclid=1&gclid=2&gidzl=3&oc=4", "https://a.example/p"),
        ("https://a.example:8080/x?b=", "https://a.example/x?b="),
        ("https://u:p@a.example/x;v=1?q=a b", "https://a.example/x?q=a+b"),
        ("https://a.example/x?a=1&b=2&a=3", "https://a.example/x?a=1&a=3&b=2"),
        ("https://a.example/x?UTM_Source=1&k=đ", "https://a.example/x?k=%C4%91"),
        ("not a url", ""),
        ("/relative/path", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_canonical_url(spark, url, canonical):
    assert one(spark, urls.canonical_url(F.col("u")), u=url) == canonical


def test_international_urls_keep_one_more_parameter(spark):
    assert one(spark, urls.canonical_url(F.col("u"), urls.INTERNATIONAL_TRACKING), u="https://a.example/x?gidzl=3&oc=1") == "https://a.example/x?gidzl=3"


def test_matching_key(spark):
    key = urls.matching_key(F.col("u"))
    assert one(spark, key, u="HTTPS://WWW.Example.com/news/item/?utm_source=feed&gclid=abc#top") == one(spark, key, u="https://example.com/news/item")
    assert one(spark, key, u="https://m.example.com:81/x?b=2&a=1") == "https://m.example.com:81/x?a=1&b=2"
    assert one(spark, key, u="//example.com/x") == ""


def test_article_id(spark):
    made = one(spark, urls.article_id(F.col("u")), u="https://a.example/p")
    assert made == hashlib.sha256(b"https://a.example/p").hexdigest()[:16]
    assert one(spark, urls.article_id(F.col("u")), u="") is None


def test_normalized_text(spark):
    assert one(spark, text.normalized(F.col("t")), t="Biển người &apos;đi bão&apos; <b>TPHCM</b>!") == "biển người đi bão tphcm"
    assert one(spark, text.normalized(F.col("t")), t="ệ đà-nẵng") == "ệ đà nẵng"
    assert one(spark, text.normalized(F.col("t")), t=None) == ""


def test_clean_html(spark):
    assert one(spark, text.clean_html(F.col("t")), t="<p> a &amp; b </p><img src='x'/>c") == "a & b c"
    assert one(spark, text.clean_html(F.col("t")), t=None) == ""


def test_embedding_text(spark):
    make = text.embedding_text(F.col("t"), F.col("d"))
    assert one(spark, make, t=" A  b ", d="c") == "A b. c"
    assert one(spark, make, t="A", d=None) == "A"


def test_word_pairs_and_jaccard(spark):
    df = spark.createDataFrame([("a b a b",), ("a",), ("",)], "t string")
    pairs = text.word_pairs(text.tokens(F.col("t")))
    assert [r[0] for r in df.select(pairs).collect()] == [["a b", "b a"], ["a"], []]
    assert [r[0] for r in df.select(text.jaccard(pairs, F.array(F.lit("a b"), F.lit("x y")))).collect()] == [pytest.approx(1 / 3), 0.0, 0.0]


@pytest.mark.parametrize(
    "value, expected, confidence",
    [
        ("Sun, 01 Mar 2026 22:10:57 +0000", "2026-03-01T22:10:57Z", "publisher_reported"),
        ("01 Mar 2026 22:10:57 +0700", "2026-03-01T15:10:57Z", "publisher_reported"),
        ("2026-03-01T10:00:00+07:00", "2026-03-01T03:00:00Z", "publisher_reported"),
        ("2026-03-01 10:00:00", "2026-03-01T03:00:00Z", "publisher_reported_timezone_inferred"),
        ("March 1, 2026 10:00", "2026-03-01T03:00:00Z", "publisher_reported_timezone_inferred"),
        ("no time", None, "unavailable"),
        ("", None, "unavailable"),
        (None, None, "unavailable"),
    ],
)
def test_publisher_time(spark, value, expected, confidence):
    time, how = times.publisher_time(F.col("t"))
    assert one(spark, times.iso_text(time), t=value) == expected
    assert one(spark, how, t=value) == confidence


def test_unknown_zone_is_unavailable(spark):
    time, how = times.publisher_time(F.col("t"), times.zone_of(F.col("h")))
    assert one(spark, how, t="2026-03-01 10:00:00", h="other.example") == "unavailable"
    assert one(spark, times.iso_text(time), t="2026-03-01 10:00:00", h="asia.nikkei.com") == "2026-03-01T01:00:00Z"


def test_pre_start_has_three_values(spark):
    flag = times.is_pre_start(F.col("p"), F.col("s"))
    start = "2026-09-10T00:00:00Z"
    assert one(spark, flag, p="2026-09-01T00:00:00Z", s=start) is True
    assert one(spark, flag, p="2026-09-27T00:00:00Z", s=start) is False
    assert one(spark, flag, p="bad", s=start) is None
    assert one(spark, flag, p="2026-09-01T00:00:00Z", s=None) is None


def test_window_bounds(spark):
    df = spark.createDataFrame([(f"2026-09-{d}T00:00:00Z",) for d in (25, 26, 27)] + [("bad",), (None,)], "t string")
    kept = df.filter(times.in_window(F.col("t"), "2026-09-26T00:00:00Z", "2026-09-27T00:00:00Z"))
    assert rows_of(kept) == [("2026-09-26T00:00:00Z",)]


def test_zero_offset(spark):
    ok = times.has_zero_offset(F.col("t"))
    assert [one(spark, ok, t=t) for t in ("2026-01-01T00:00:00Z", "2026-01-01T00:00:00+00:00", "2026-01-01T00:00:00", "2026-01-01T00:00:00+07:00", None)] == [True, True, False, False, False]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), min_size=1, max_size=4), st.one_of(st.none(), st.text(st.characters(exclude_categories=["Cs"]), max_size=8), st.integers(-5, 5)), max_size=4))
def test_content_hash_ignores_key_order(spark, payload):
    expected = hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode("utf-8", "surrogatepass")).hexdigest()
    backwards = json.dumps(dict(reversed(payload.items())), ensure_ascii=True)
    assert one(spark, hashing.content_hash(F.col("j")), j=backwards) == expected


def test_record_names(spark):
    assert one(spark, hashing.entry_key(F.col("u"), F.lit("h")), u="  ") == "nourl:h"
    assert one(spark, hashing.exact_reference(F.col("u")), u="f#raw_record_id=") is False
    assert one(spark, hashing.exact_reference(F.col("u")), u="f#raw_record_id=a") is True
    made = one(spark, hashing.poll_record_id(F.lit("rss"), F.lit("u"), F.lit("t"), F.col("j")), j='{"b":1,"a":null}')
    blob = json.dumps({"source_system": "rss", "source_locator": "u", "observed_at": "t", "payload": {"a": None, "b": 1}}, sort_keys=True, separators=(",", ":"))
    assert made == hashlib.sha256(blob.encode()).hexdigest()


@pytest.mark.parametrize(
    "title, description, url, rule, relevant",
    [
        ("", "Việt Nam", "", 0, False),
        ("Tin VIỆT NAM", "", "", 1, True),
        ("Bây giờ theo giờ Việt Nam", "", "", 18, True),
        ("Bộ Y tế của Nhật Bản họp", "", "", 18, True),
        ("Bộ Y tế họp", "", "", 2, True),
        ("Tìm bạn đời ở Hà Nội", "", "", 9, False),
        ("Ngập ở Đà Nẵng", "", "", 11, True),
        ("Tin lạ", "", "https://a.example/the-gioi/x", 13, False),
        ("Arsenal thắng", "", "", 14, False),
        ("NASA phóng tàu", "", "", 15, False),
        ("Chiến sự ở Ukraine", "", "", 17, False),
    ],
)
def test_domestic_relevance(spark, title, description, url, rule, relevant):
    decided = deciding_rule(F.col("t"), searched_text(F.col("t"), F.col("d")), F.col("u"))
    assert one(spark, decided, t=title, d=description, u=url) == rule
    assert one(spark, domestic_relevance(decided), t=title, d=description, u=url) is relevant


def test_international_relevance(spark):
    flag = international_relevance(F.col("t"), F.col("d"))
    assert one(spark, flag, t="Flood in HANOI", d=None) is True
    assert one(spark, flag, t=None, d=None) is False


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    assert df.select(unit(F.col("a"))).head()[0] == pytest.approx([0.6, 0.8])
    assert df.select(unit(F.col("b"))).head()[0] == [0.0, 0.0]
    assert df.select(cosine_distance(unit(F.col("a")), unit(F.col("a")))).head()[0] == pytest.approx(0.0)
