from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from tidewire.operators import analysis, cleaning, cluster, contract, dedup, health, history, profile, review, embedding, run, snapshot, stage
from tidewire.operators.components import components
from tidewire.schemas import ARTICLE, ARTICLE_COLUMNS, AUDIT_COLUMNS, CANDIDATE, CLUSTERED, HEARTBEAT, PAYLOAD, SIGHTING

LEDE = "một chiếc xe khách va chạm với xe tải trên quốc lộ sáng nay khiến nhiều người bị thương"


def articles(spark, rows, schema=ARTICLE):
    names = [f.split()[0] for f in schema.split(", ")]
    base = {"branch": "domestic", "collection_mode": "prospective", "timestamp_confidence": "unavailable", "vietnam_relevance": True, "first_seen_at": "2026-09-30T00:00:00Z"}
    made = []
    for k, r in enumerate(rows):
        full = {"article_id": f"a{k}", "raw_payload_ref": f"f#raw_record_id={k}", "canonical_url": f"https://x.example/{k}", "title": "t"} | base | r
        made.append(tuple(full.get(n) for n in names))
    return spark.createDataFrame(made, schema)


def families(spark, rows):
    feats = dedup.features(articles(spark, rows))
    related = dedup.related_pairs(feats)
    assignment, found = dedup.families(related)
    return {(r["a"], r["b"]): (r["relation"], r["reason"]) for r in related.collect()}, {r["article_id"]: r["duplicate_family_id"] for r in assignment.collect()}, found.collect()


def test_exact_url_family(spark):
    rows = [{"title": "x", "canonical_url": "HTTPS://WWW.Example.com/news/item/?utm_source=feed&gclid=abc#top"}, {"title": "y", "canonical_url": "https://example.com/news/item"}]
    pairs, assigned, found = families(spark, rows)
    assert pairs == {("a0", "a1"): (dedup.EXACT, dedup.REASONS["url"])}
    assert set(assigned) == {"a0", "a1"}
    assert assigned["a0"] == "dupfam_" + hashlib.sha256(b"a0|a1").hexdigest()[:12]
    assert (found[0]["family_type"], found[0]["family_size"], found[0]["edge_density"]) == (dedup.EXACT, 2, 1.0)


def test_exact_text_beats_the_veto(spark):
    rows = [{"title": "Same Title", "description": "one two three four five six seven", "published_at": "2026-09-01T00:00:00Z"}, {"title": "same  title!", "description": "one two three four five six seven.", "published_at": "2026-09-20T00:00:00Z"}]
    pairs, assigned, _ = families(spark, rows)
    assert pairs[("a0", "a1")] == (dedup.EXACT, dedup.REASONS["text"])
    assert len(assigned) == 2


@pytest.mark.parametrize(
    "left, right, relation, reason",
    [
        ({"title": "headline one", "description": LEDE}, {"title": "another word", "description": LEDE}, dedup.COPY, "description_overlap>=0.6"),
        ({"description": LEDE, "published_at": "2026-09-01T00:00:00Z"}, {"title": "u", "description": LEDE, "published_at": "2026-09-20T00:00:00Z"}, dedup.SAME_EVENT, dedup.REASONS["week"]),
        ({"title": "u", "description": LEDE + " 18 năm"}, {"description": LEDE + " 14 16 năm"}, dedup.SAME_EVENT, dedup.REASONS["numbers"]),
        ({"description": LEDE, "language": "vi"}, {"title": "u", "description": LEDE, "language": "en"}, dedup.UNRELATED, dedup.REASONS["language"]),
        ({"title": "cháy lớn ở chợ trung tâm", "description": None}, {"title": "cháy lớn ở chợ trung tâm quận", "description": LEDE}, dedup.SAME_EVENT, dedup.REASONS["headline"]),
    ],
)
def test_pair_rules(spark, left, right, relation, reason):
    pairs, assigned, _ = families(spark, [left, right])
    assert pairs[("a0", "a1")] == (relation, reason)
    assert bool(assigned) == (relation == dedup.COPY)


def test_empty_descriptions_make_no_family(spark):
    pairs, assigned, _ = families(spark, [{"title": "a b", "description": None}, {"title": "c d", "description": ""}])
    assert not pairs and not assigned


def test_families_do_not_depend_on_row_order(spark):
    rows = [{"article_id": f"k{i}", "title": f"t{i}", "description": LEDE} for i in range(5)]
    assert families(spark, rows)[1] == families(spark, rows[::-1])[1]


def test_annotate_changes_one_column(spark):
    df = articles(spark, [{}, {"title": None}])
    out = dedup.annotate(df, spark.createDataFrame([("a0", "fam")], "article_id string, duplicate_family_id string"))
    assert out.columns == ARTICLE_COLUMNS
    assert contract.same_rows(out.drop("duplicate_family_id"), df.drop("duplicate_family_id"))


@pytest.mark.parametrize("hottest", [1, 50_000])
def test_blocked_pairs_compute_features_once_and_count_as_brute_force(spark, monkeypatch, hottest):
    monkeypatch.setattr(dedup, "HOTTEST", hottest, raising=False)
    rng = random.Random(4)
    made = [(f"a{rng.randrange(1000):04}" if k % 9 else f"a{k % 4}", [rng.randrange(3) for _ in range(2)] + rng.sample(range(60), 5), rng.sample(range(60, 90), 3)) for k in range(120)]
    made += [(None, [7, 8, 9], [61]), ("z", None, []), ("y", [7, 7, 8], [8])]
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    kind = "article_id string, tp array<long>, dp array<long>"
    feats = spark.createDataFrame(made, kind).mapInArrow(counted, kind)
    rules = dedup.Rules(most_articles=9)
    got = rows_of(dedup.blocked_pairs(feats, rules).select("a", "b", "shared"))
    assert calls.value == len(made)
    holders = {}
    for i, tp, dp in made:
        for x in set(tp or []) | set(dp) if tp is not None else ():
            holders.setdefault(x, []).append(i)
    shared = {}
    for ids in (x for x in holders.values() if 2 <= len(x) <= 9):
        for a in ids:
            for b in ids:
                if a is not None and b is not None and a < b:
                    shared[a, b] = shared.get((a, b), 0) + 1
    assert any(len(x) > 9 for x in holders.values())
    assert got == sorted(((a, b, n) for (a, b), n in shared.items() if n >= 2), key=repr)


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(120):03}", f"n{rng.randrange(120):03}") for _ in range(90)] + [(f"c{k:03}", f"c{k + 1:03}") for k in range(40)] + [("hub", f"h{k}") for k in range(50)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert dict(rows_of(components(spark.createDataFrame(edges, "a string, b string")))) == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert rows_of(components(spark.createDataFrame([("a", "a"), (None, "b")], "a string, b string"))) == []


def units(spark, angles, days):
    rows = [(f"u{k:02}", d, 1, [float(np.cos(np.radians(a))), float(np.sin(np.radians(a)))]) for k, (a, d) in enumerate(zip(angles, days))]
    return spark.createDataFrame(rows, "unit string, day double, n long, vector array<double>")


def test_singletons(spark):
    found = dict(rows_of(cluster.cluster(units(spark, [0, 1, 90, 180], [0.0] * 4), 0.05, 5.0)))
    assert found["u00"] == found["u01"] and len(set(found.values())) == 3


def test_hard_gate_and_unknown_times(spark):
    found = dict(rows_of(cluster.cluster(units(spark, [0, 0, 0], [0.0, 4.0, 8.0]), 0.3, 5.0)))
    assert len(set(found.values())) == 2
    assert len(set(dict(rows_of(cluster.cluster(units(spark, [0, 0], [None, None]), 0.3, 5.0))).values())) == 2
    with pytest.raises(ValueError):
        cluster.cluster(units(spark, [0], [0.0]), 0.3, 5.0, "single")


@pytest.mark.parametrize("linkage", cluster.LINKAGES)
def test_clusters_by_component_equal_the_whole(spark, linkage):
    rng = np.random.default_rng(3)
    angles, days = rng.uniform(0, 360, 60), rng.uniform(0, 20, 60).round(2)
    df = units(spark, angles, [float(d) for d in days])
    found = dict(rows_of(cluster.cluster(df, 0.05, 5.0, linkage)))
    x = np.stack([[np.cos(np.radians(a)), np.sin(np.radians(a))] for a in angles])
    whole = cluster.agglomerate(x, days, 0.05, 5.0, linkage)
    expected = {}
    for k, label in enumerate(whole):
        expected.setdefault(label, set()).add(f"u{k:02}")
    got = {}
    for u, c in found.items():
        got.setdefault(c, set()).add(u)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def events(spark, angles, days, families=None, publishers=None):
    rows = []
    for k, d in enumerate(days):
        rows.append({"published_at": None if d is None else f"2026-09-{1 + d:02}T00:00:00Z", "duplicate_family_id": (families or {}).get(k), "publisher_domain": (publishers or {}).get(k, "p.example")})
    vectors = spark.createDataFrame([(f"a{k}", [float(np.cos(np.radians(a))), float(np.sin(np.radians(a)))]) for k, a in enumerate(angles)], "article_id string, embedding array<float>")
    return articles(spark, rows), vectors


def test_family_beats_distance_and_ids_are_stable(spark):
    df, vectors = events(spark, [0, 90, 180], [0, 0, 0], families={0: "f", 1: "f"})
    out = {r["article_id"]: r["event_cluster_id"] for r in cluster.propagate(df, cluster.cluster(cluster.units(df, vectors), 0.05)).collect()}
    assert out["a0"] == out["a1"] != out["a2"]
    assert out["a0"] == "evt_" + hashlib.sha256(b"a0").hexdigest()[:12]


def test_summary_and_metrics(spark):
    df, vectors = events(spark, [0, 4, 2, 180], [0, 1, 2, 0], families={0: "f", 1: "f"}, publishers={0: "a", 1: "b", 2: "c", 3: "a"})
    out = cluster.propagate(df, cluster.cluster(cluster.units(df, vectors), 0.05))
    assert rows_of(contract.output_problems(df, out)) == [("family_split", 0), ("no_event", 0), ("rows_added", 0), ("rows_lost", 0)]
    top = cluster.summaries(out, vectors).orderBy(F.desc("cluster_size")).head()
    assert (top["cluster_size"], top["n_publishers"], top["n_duplicate_families"], top["n_units"], top["span_days"]) == (3, 3, 1, 2, 2.0)
    x = np.array([[np.cos(np.radians(a)), np.sin(np.radians(a))] for a in (0, 4, 2)])
    assert top["mean_intra_similarity"] == pytest.approx(np.mean([x[0] @ x[1], x[0] @ x[2], x[1] @ x[2]]), abs=1e-4)
    figures = cluster.metrics(cluster.summaries(out, vectors)).head()
    assert (figures["total_articles"], figures["total_events"], figures["singleton_events"], figures["cross_publisher_events"]) == (4, 2, 1, 1)


def test_sweep_gives_every_setting_its_own_figures(spark):
    rng = random.Random(8)
    df, vectors = events(spark, [rng.uniform(0, 360) for _ in range(36)], [rng.randrange(20) for _ in range(36)], {0: "f", 1: "f"})
    vectors = vectors.filter("article_id <> 'a5'")
    found = {(r["distance_threshold"], r["window_days"], r["linkage"]): r for r in cluster.sweep(df, vectors).collect()}
    assert set(found) == {(t, w, k) for t in (0.2, 0.25, 0.3, 0.35) for w in (3.0, 5.0, 10.0) for k in ("average", "complete")}
    assert [k for k, r in found.items() if r["is_previous_baseline"]] == [(0.35, 10.0, "average")]
    assert len({r["total_events"] for r in found.values()}) > 3
    for setting in [(0.2, 3.0, "complete"), (0.25, 5.0, "average"), (0.35, 10.0, "average"), (0.35, 10.0, "complete")]:
        out = cluster.propagate(df, cluster.cluster(cluster.units(df, vectors), *setting))
        alone = cluster.metrics(cluster.summaries(out, vectors)).head().asDict()
        row = found[setting].asDict()
        assert {k: v for k, v in row.items() if k in alone} == {k: v for k, v in alone.items() if k in row}
        assert row["singleton_article_share"] == round(alone["singleton_events"] / alone["total_articles"], 4)


def test_one_run_over_a_component_gives_the_clusters_of_every_setting():
    rng = np.random.default_rng(6)
    thresholds, windows = (0.02, 0.05, 0.1), (3.0, 5.0, 10.0)
    for n, widest, days in [(2, 20, 4), (3, 3, 2), (9, 40, 12), (40, 90, 15)]:
        angles, times = np.radians(rng.uniform(0, widest, n)), rng.uniform(0, days, n)
        x = np.stack([np.cos(angles), np.sin(angles)], 1)
        found = cluster.swept(x, times, thresholds, windows, cluster.LINKAGES)
        assert len({tuple(m) for m, _ in found}) == len(found)
        for bit, (t, w, k) in enumerate((t, w, k) for t in thresholds for w in windows for k in cluster.LINKAGES):
            label = cluster.agglomerate(x, times, t, w, k)
            assert sorted(m.tolist() for m, bits in found if bits >> bit & 1) == sorted(np.flatnonzero(label == r).tolist() for r in set(label))


def test_near_join_holds_a_unit_twice_at_most(spark):
    rng = np.random.default_rng(7)
    df = units(spark, rng.uniform(0, 60, 60), [float(x) for x in rng.uniform(0, 30, 60).round(2)])
    assert cluster.block_pairs(df, 5.0).count() <= 2 * df.count()


def test_sweep_with_unknown_times_and_publishers(spark):
    df, vectors = events(spark, [0, 3, 6, 90, 93, 180, 270, 270, 45], [0, 1, 2, 3, 4, 5, 6, 6, 7], {0: "f", 5: "f", 3: "g", 8: "g"}, {0: None, 1: "a", 2: "b", 3: None, 4: None, 6: "a", 7: "a"})
    late = F.col("article_id").isin("a6", "a8")
    df = df.withColumns({c: F.when(~late, F.col(c)) for c in ("published_at", "first_seen_at")}).drop("event_cluster_id")
    vectors = vectors.filter("article_id <> 'a8'")
    out = cluster.propagate(df, cluster.cluster(cluster.units(df, vectors), 0.3, 5.0, "average"))
    alone = cluster.metrics(cluster.summaries(out, vectors)).head().asDict()
    row = cluster.sweep(df, vectors, (0.3,), (5.0,), ("average",)).head().asDict()
    assert {k: v for k, v in row.items() if k in alone} == {k: v for k, v in alone.items() if k in row}
    assert alone["cross_publisher_events"] and alone["multi_article_events"] > 1


def test_nearest_pair_is_the_brute_force_minimum(spark):
    angles = [0, 4, 30, 34, 60, 64, 120, 125, 200]
    df, vectors = events(spark, angles, [0] * len(angles))
    out = cluster.propagate(df, cluster.cluster(cluster.units(df, vectors), 0.02))
    near = cluster.nearest_events(cluster.inter_pairs(out, vectors, 5.0, 2.1), 3).collect()
    event = {r["article_id"]: r["event_cluster_id"] for r in out.collect()}
    best = min(1 - np.cos(np.radians(a - b)) for i, a in enumerate(angles) for j, b in enumerate(angles) if i < j and event[f"a{i}"] != event[f"a{j}"])
    assert near[0]["distance"] == pytest.approx(best, abs=1e-6)
    assert [r["distance"] for r in near] == sorted(r["distance"] for r in near) and len(near) == 3


def test_strata_exclude_families_and_repeat(spark):
    df, vectors = events(spark, [0, 0, 1, 2, 90], [0] * 5, families={0: "f", 1: "f"}, publishers={k: f"p{k % 2}" for k in range(5)})
    out = cluster.propagate(df, cluster.cluster(cluster.units(df, vectors), 0.05))
    first = rows_of(cluster.qc_strata(out, vectors, 5.0))
    assert first == rows_of(cluster.qc_strata(out, vectors, 5.0))
    assert not any({"a0", "a1"} <= set(r) for r in first)


def test_co_report_needs_a_different_unit(spark):
    rows = [
        {"publisher_domain": "a", "duplicate_family_id": "f", "event_cluster_id": "e1"}, {"publisher_domain": "b", "duplicate_family_id": "f", "event_cluster_id": "e1"},
        {"publisher_domain": "a", "event_cluster_id": "e2"}, {"publisher_domain": "b", "event_cluster_id": "e2"},
    ]
    edge = analysis.co_report_edges(articles(spark, rows, CLUSTERED)).head()
    assert (edge["weight_all"], edge["weight_independent"], edge["events_a"]) == (2, 1, 2)


def test_pivot_and_join_once(spark):
    labels = spark.createDataFrame([("s", "SAME_EVENT"), ("s", "SAME_EVENT"), ("t", "OTHER")], "stratum string, manual_label string")
    assert rows_of(analysis.pivot_labels(labels, "stratum")) == [("s", 2, 0, 0, 2), ("t", 0, 0, 0, 0)]
    with pytest.raises(ValueError):
        analysis.joined_once(labels, labels, "stratum")


PAYLOADS = [
    ("r1", "https://a.example/1", "h1", "rss", "feed", "pub", "2026-09-01T00:00:00Z", ("https://a.example/1", "Hà Nội", "s", None, None, None, None, None)),
    ("r2", "https://a.example/1", "h2", "rss", "feed", "pub", "2026-09-01T00:20:00Z", ("https://a.example/1", "Hà Nội 2", None, "d", None, None, None, None)),
    ("r3", "nourl:h3", "h3", "rss", "feed", None, "2026-09-01T00:00:00Z", (None, "x", None, None, None, None, None, None)),
]


def logs(spark):
    payloads = spark.createDataFrame(PAYLOADS, PAYLOAD.replace("pubDate", "pubdate"))
    seen = [("2026-09-01T00:00:00Z", "h1", True), ("2026-09-01T00:10:00Z", "h1", False), ("2026-09-01T00:20:00Z", "h2", True)]
    sightings = spark.createDataFrame([(t, "run", "domestic", "host", "https://a.example/1", h, n, "ref") for t, h, n in seen], SIGHTING)
    return payloads, sightings, F.concat(F.lit("log#raw_record_id="), "raw_record_id")


def test_edited_page_is_one_candidate(spark):
    payloads, sightings, ref = logs(spark)
    rows = {r["url"]: r for r in history.candidates(payloads, sightings, ref, "domestic").collect()}
    page = rows["https://a.example/1"]
    assert (page["first_seen_at"], page["last_seen_at"], page["raw_payload_ref"]) == ("2026-09-01T00:00:00Z", "2026-09-01T00:20:00Z", "log#raw_record_id=r1")
    assert rows[""]["first_seen_at"] == "2026-09-01T00:00:00Z"
    with pytest.raises(ValueError):
        history.candidates(payloads, sightings, ref, "other")


def test_rebuilt_seen_equals_incremental(spark):
    payloads, sightings, ref = logs(spark)
    live = spark.createDataFrame([], "entry_key string, content_hash string, first_seen_at string, last_seen_at string, payload_ref string")
    for r in sorted(sightings.collect(), key=lambda r: r["observed_at"]):
        live = history.upsert_seen(live, spark.createDataFrame([r], SIGHTING))
    keys = ["entry_key", "content_hash", "first_seen_at", "last_seen_at"]
    assert rows_of(history.rebuild_seen(payloads.filter("entry_key not like 'nourl%'"), sightings, ref).select(keys)) == rows_of(live.select(keys))


def test_flag_new_counts_the_first_of_a_batch(spark):
    batch = spark.createDataFrame([(1, "k", "h"), (2, "k", "h"), (3, "o", "h")], "n int, entry_key string, content_hash string")
    seen = spark.createDataFrame([("o", "h")], "entry_key string, content_hash string")
    assert [r["is_new"] for r in history.flag_new(batch, seen, [F.col("n")]).orderBy("n").collect()] == [True, False, False]


def test_cleaning_reasons_and_publishers(spark):
    entry = '{"link":"https://www.tuoitre.vn/a?oc=1","title":"Hà <b>Nội</b>","summary":"<p>mưa</p>","published":"2026-09-01 10:00:00"}'
    rows = [
        ("", None, "feed", "rss", "2026-09-01T00:00:00Z", None, "prospective", "f#raw_record_id=1", entry),
        ("not a url", "hint", "feed", "rss", "bad", None, "other", "f", "{broken"),
    ]
    first, second = cleaning.clean_domestic(spark.createDataFrame(rows, CANDIDATE)).collect()
    assert (first["canonical_url"], first["publisher_id"], first["title"], first["description"]) == ("https://tuoitre.vn/a", "tuoitre", "Hà Nội", "mưa")
    assert (first["published_at"], first["timestamp_confidence"], first["vietnam_relevance"], first["rejection_reason"]) == ("2026-09-01T03:00:00Z", "publisher_reported_timezone_inferred", True, None)
    assert second["rejection_reason"] == "invalid_entry_json;missing_title;invalid_url;non_exact_raw_payload_ref;missing_first_seen_at;invalid_collection_mode"
    assert second["publisher_id"] == "hint" and second["vietnam_relevance"] is False


def test_international_cleaning(spark):
    df = articles(spark, [{"url": "https://www.bbc.co.uk/n/", "title": "Hanoi", "source_system": "gdelt_doc", "published_at": "2026-09-01T00:00:00Z"}, {"url": "x", "title": " ", "source_system": "fax"}])
    df = df.withColumn("source_seen_at", F.lit("2026-09-02T00:00:00Z"))
    first, second = cleaning.clean_international(df).collect()
    assert (first["publisher_id"], first["publisher_country"], first["published_at"], first["timestamp_confidence"]) == ("bbc", "GB", None, "unavailable")
    assert second["rejection_reason"] == "missing_title;invalid_url;invalid_source_system"
    assert cleaning.clean_international(df).columns == AUDIT_COLUMNS


def test_contract(spark):
    good = articles(spark, [{}])
    other = articles(spark, [{"branch": "international"}])
    master, _ = contract.build_master(good, other)
    assert master.count() == 2
    with pytest.raises(contract.ContractError):
        contract.build_master(other, good)
    with pytest.raises(contract.ContractError):
        contract.check_columns(good.drop("title"), ARTICLE_COLUMNS)
    bad = articles(spark, [{"first_seen_at": "2026-01-01T00:00:00"}, {"vietnam_relevance": None}])
    broken = {r for r, n in rows_of(contract.violations(bad, contract.row_rules())) if n}
    assert broken == {"first_seen_at", "vietnam_relevance"}


def test_shared_folder_is_required_on_a_cluster():
    assert stage.folder_for("hdfs:///shared/", "yarn", "a") == "hdfs:///shared"
    assert stage.folder_for(None, "local[4]", "a").startswith("file:")
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            stage.folder_for(None, master, "a")


def test_numbering_by_ranges(spark):
    df = spark.range(1000).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(50)))
    found = stage.numbered(df, [F.desc("x"), F.col("id")], stage.Stage(spark, "n"), "k").collect()
    assert [r["k"] for r in sorted(found, key=lambda r: (-r["x"], r["id"]))] == list(range(1, 1001))


def test_blocks_of_a_hot_time_bucket(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = units(spark, rng.uniform(0, 60, 80), [float(x) for x in rng.uniform(0, 12, 80).round(2)])
    whole = rows_of(cluster.near_units(df, 0.1, 5.0).select("a", "b", F.round("distance", 9)))
    monkeypatch.setattr(cluster, "BLOCK", 7)
    assert rows_of(cluster.near_units(df, 0.1, 5.0).select("a", "b", F.round("distance", 9))) == whole
    rows = df.collect()
    near = {(p["unit"], q["unit"]) for p in rows for q in rows if p["unit"] < q["unit"] and abs(p["day"] - q["day"]) <= 5 and 1 - np.dot(p["vector"], q["vector"]) < 0.1}
    assert {r[:2] for r in whole} == near and near


@pytest.mark.parametrize("linkage", cluster.LINKAGES)
def test_agglomeration_against_the_plain_rule(linkage):
    def plain(x, times, threshold, window):
        distance = np.clip(1 - x @ x.T, 0, 2)
        distance[~(np.abs(times[:, None] - times[None, :]) <= window)] = cluster.GATED
        np.fill_diagonal(distance, np.inf)
        label, size = np.arange(len(x)), np.ones(len(x))
        while True:
            i, j = sorted(divmod(int(np.argmin(distance)), len(x)))
            if not distance[i, j] < threshold:
                return label
            d = np.maximum(distance[i], distance[j]) if linkage == "complete" else (size[i] * distance[i] + size[j] * distance[j]) / (size[i] + size[j])
            distance[i], distance[:, i] = d, d
            distance[i, i] = np.inf
            distance[j], distance[:, j] = np.inf, np.inf
            label[label == j] = i
            size[i] += size[j]

    rng = np.random.default_rng(6)
    for _ in range(20):
        angles = np.radians(rng.integers(0, 40, 50) * 3)  # many ties
        x, times = np.stack([np.cos(angles), np.sin(angles)], 1), rng.integers(0, 12, 50).astype(float)
        assert (plain(x, times, 0.3, 5) == cluster.agglomerate(x, times, 0.3, 5, linkage)).all()
    with pytest.MonkeyPatch.context() as m:
        m.setattr(cluster, "MOST_UNITS", 10)
        with pytest.raises(ValueError, match="50 units"):
            cluster.agglomerate(x, times, 0.3, 5, linkage)


def test_clustering_run(spark):
    df, vectors = events(spark, [0, 0, 3, 180], [0, 0, 1, 0])
    df = df.select(*ARTICLE_COLUMNS)
    done = run.clustering_run(df, vectors)
    row = done.manifest.head()
    assert (row["rows"], row["total_articles"], row["linkage"]) == (4, 4, "complete") and done.clustered.count() == 4
    assert run.clustering_run(df, vectors, expected=row["fingerprint"]).manifest.head() == row
    with pytest.raises(contract.ContractError, match="fingerprint"):
        run.clustering_run(df, vectors, expected="0")
    with pytest.raises(contract.ContractError):
        run.clustering_run(df.drop("title"), vectors)


def test_sources_starts_and_late_articles(spark):
    payloads = spark.createDataFrame([("r1", "feed"), ("r2", "other")], "raw_record_id string, source_locator string")
    seen = [("2026-09-10", "domestic", "h", "x#raw_record_id=r1"), ("2026-09-11", "domestic", "g", "x#raw_record_id=r1"), ("2026-09-12", "domestic", "h", "x#raw_record_id=r9"), ("2026-09-12", "domestic", "h", None)]
    sightings = spark.createDataFrame(seen, "observed_at string, branch string, collector_host string, payload_ref string").withColumn("observed_at", F.concat("observed_at", F.lit("T00:00:00Z")))
    sources = snapshot.reference_sources(payloads, sightings)
    assert rows_of(sources) == [("x#raw_record_id=r1", "domestic", "h", "feed"), ("x#raw_record_id=r9", "domestic", "h", None)]
    starts = snapshot.feed_starts(sightings, sources)
    assert ("domestic", "h", "feed", "2026-09-10T00:00:00Z") in rows_of(starts)
    articles = spark.createDataFrame([("a", "2026-09-01T00:00:00Z", "x#raw_record_id=r1"), ("b", "2026-09-27T00:00:00Z", "x#raw_record_id=r1"), ("c", "2026-09-01T00:00:00Z", "unknown"), ("d", None, "x#raw_record_id=r1")], "id string, published_at string, raw_payload_ref string")
    assert {r["id"]: r["is_pre_start"] for r in snapshot.with_pre_start(articles, sources, starts).collect()} == {"a": True, "b": False, "c": None, "d": None}
    other = sources.limit(0).union(spark.sql("select 'x#raw_record_id=r1', 'international', 'z', null"))
    assert ("x#raw_record_id=r1", "international", "z", None) in rows_of(snapshot.merged(sources, other)) and snapshot.merged(sources, other).count() == 2


def test_results_in_printed_lines(spark):
    line = health.result_line(F.array(health.feed_result(F.lit("f"), F.lit("u"), F.lit(200), F.lit(None).cast("string"), F.lit(3), F.lit(1), F.lit("x"))))
    df = spark.range(1).select(F.concat(F.lit("FEED_RESULTS broken\n"), line, F.lit("\nend")).alias("a"), F.lit("no line").alias("b"), F.lit("FEED_RESULTS {").alias("c"))
    row = df.select(*(health.results_of(F.col(c)).alias(c) for c in "abc")).head()
    assert row["a"][0]["n_entries"] == 3 and row["a"][0]["error"] == "x" and row["b"] is None and row["c"] is None


def test_embedding_by_an_encoder(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "id long, t string")
    found = {r["id"]: r["embedding"] for r in embedding.embedded(df, "id", "t", lambda: embedding.hashed_words(16), 1).collect()}
    assert found["2"] is None and np.isclose(np.linalg.norm(found["1"]), 1) and not any(found["3"])


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    assert rows_of(contract.content_fingerprint(df)) == rows_of(contract.content_fingerprint(df.orderBy(F.desc("id"))))
    assert rows_of(contract.content_fingerprint(df)) != rows_of(contract.content_fingerprint(df.limit(99)))


def test_heartbeats_and_staleness(spark):
    feed = lambda new, n=3, e=None: ("f", "https://f", 200, None, n, new, e)
    beat = lambda hour, new: (f"r{hour}", f"2026-09-{29 + hour // 24:02}T{hour % 24:02}:00:00Z", "h", 1.0, {"domestic": (True, 1.0, new, 3, None, [feed(new)])}, True, [], [], True)
    results = health.feed_results(spark.createDataFrame([beat(0, 2), beat(5, 0), beat(30, 0)], HEARTBEAT))
    now = F.to_timestamp(F.lit("2026-09-30T07:00:00Z"))
    assert rows_of(health.hours_since_new(results, now, 48, "feed_id")) == [("f", 31.0)]
    assert rows_of(health.hours_since_new(results, now, 3, "feed_id")) == [("f", 1.0)]
    stale = health.stale_feeds(results, results.filter("run_id = 'r30'"), now, "feed_id").head()
    assert stale["issue"] == "f: no new payload in 31.0h (threshold 6.0h)"
    assert health.stale_feeds(results, results.filter("run_id = 'r0'"), now, "feed_id").isEmpty()


def test_feed_issues(spark):
    rows = [("r1", 1, "d", "h", "old", 3, None), ("r2", 2, "d", "h", "old", 0, None), ("r2", 2, "d", "h", "new", 0, None), ("r2", 2, "d", "h", "bad", 0, "timeout")]
    results = spark.createDataFrame(rows, "run_id string, run_at long, branch string, collector_host string, feed_url string, n_entries int, error string").withColumn("run_at", F.timestamp_seconds("run_at"))
    issues = {(r["feed_url"], r["issue"]) for r in health.feed_issues(results.filter("run_id = 'r2'"), health.feed_starts(results)).collect()}
    assert issues == {("bad", "timeout"), ("old", "0 entries this run (established feed)")}


def test_review_sheets(spark):
    schema = "review_id int, item_type string, reference string, stratum_or_event string, context string, allowed_human_labels string, human_label string, reviewer string, review_comment string, ai_label string, second_pass_label string"
    sheet = spark.createDataFrame([(1, "t", "r", "s", "c", "A / B", "A", "x", None, "A", "B"), (2, "t", "r", "s", "c", "A / B", "C", " ", None, None, "C")], schema)
    assert rows_of(review.label_problems(sheet)) == [(2, "label_not_allowed"), (2, "reviewer_empty")]
    assert rows_of(review.agreement_counts(review.agreement_flags(sheet))) == [(2, 1, 1)]
    assert review.changed_cells(sheet, review.blind_sheet(sheet)).isEmpty()
    assert rows_of(review.changed_cells(sheet, sheet.filter("review_id = 1")))[0][0] == 2


def test_samples_keep_quotas(spark):
    df = articles(spark, [{"vietnam_relevance": k % 5 == 0} for k in range(50)]).withColumn("rejection_reason", F.lit(None).cast("string"))
    picked = review.review_sample(df, 20).collect()
    assert len(picked) == 20 and sum(r["vietnam_relevance"] for r in picked) == 10
    assert {r["article_id"] for r in picked} == {r["article_id"] for r in review.review_sample(df.orderBy(F.desc("article_id")), 20).collect()}


def test_profiles(spark):
    df = spark.createDataFrame([("a", None), ("a", 1), ("b", 1)], "x string, y int")
    assert rows_of(profile.column_profile(df)) == [("x", "string", 0, 2), ("y", "int", 1, 1)]
    assert rows_of(profile.top_values(df, "x", 1)) == [("a", 2)]
    state = spark.sql("select map('d', map('h', map('u', named_struct('feed_started_at', 't', 'publisher_id_hint', 'p')))) as state")
    assert rows_of(profile.flatten_feed_state(state)) == [("d", "h", "u", "t", "p")]


@pytest.mark.parametrize("schema", [ARTICLE])
def test_empty_tables(spark, schema):
    empty = spark.createDataFrame([], schema)
    assert dedup.related_pairs(dedup.features(empty)).isEmpty()
    vectors = spark.createDataFrame([], "article_id string, embedding array<float>")
    assert cluster.cluster(cluster.units(empty, vectors)).isEmpty()
    assert cluster.summaries(empty.withColumn("event_cluster_id", F.lit(None).cast("string")), vectors).isEmpty()
