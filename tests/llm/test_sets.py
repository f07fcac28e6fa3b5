from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from tidewire.llm import consensus, mixing, packing


def documents(spark, sizes, sources=None):
    rows = [(k, None if s is None else "x" * s, (sources or ["s"])[k % len(sources or ["s"])], 5, "p") for k, s in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, pack_name string")


def packs(spark, *capacities):
    return spark.createDataFrame([(f"c{c}", c) for c in capacities], "pack_name string, capacity_tokens int")


def test_every_text_is_packed_whole(spark):
    rng = random.Random(1)
    sizes = [rng.randrange(1, 90) for _ in range(300)] + [0, 100, 101, 350, None, 0]
    out, _ = packing.pack_documents(documents(spark, sizes), packs(spark, 100, 1000))
    rows = out.collect()
    for c in (100, 1000):
        own = [r for r in rows if r["pack_name"] == f"c{c}"]
        by_doc, by_bin = {}, {}
        for r in own:
            by_doc.setdefault(r["doc_id"], []).append(r)
            by_bin[r["container"]] = by_bin.get(r["container"], 0) + r["size"]
        assert {d: sum(r["size"] for r in p) for d, p in by_doc.items()} == {k: s for k, s in enumerate(sizes) if s is not None}
        assert all(len(p) == max(1, -(-sizes[d] // c)) for d, p in by_doc.items())
        assert max(by_bin.values()) <= c
        assert len(by_bin) <= 1.1 * sum(s or 0 for s in sizes) / c + 1


def test_pack_edges(spark):
    empty, _ = packing.pack_documents(documents(spark, [3]).limit(0), packs(spark, 10))
    assert empty.isEmpty()
    none, _ = packing.pack_documents(documents(spark, [3]), spark.createDataFrame([("x", None), (None, 3), ("y", 0)], "pack_name string, capacity_tokens int"))
    assert none.isEmpty()


def test_exchange_between_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_ROWS", 20)
    rng = random.Random(2)
    sizes = [rng.randrange(20, 60) for _ in range(200)]
    out, _ = packing.pack_documents(documents(spark, sizes), packs(spark, 100))
    bins = {}
    for r in out.collect():
        bins[r["container"]] = bins.get(r["container"], 0) + r["size"]
    assert sum(bins.values()) == sum(sizes) and max(bins.values()) <= 100
    assert out.count() == 200


def test_bounds_never_exceed_a_packing():
    rng = np.random.default_rng(3)
    for _ in range(200):
        c = int(rng.integers(10, 200))
        sizes = rng.integers(1, c + 1, rng.integers(1, 40))
        bins = packing.best_fit_decreasing(sizes, c)
        assert np.bincount(bins, sizes).max() <= c
        assert packing.lower_bound(sizes, c) <= bins.max() + 1
    assert packing.lower_bound(np.array([60, 60, 60]), 100) == 3
    assert packing.lower_bound(np.array([51, 51, 26, 26]), 100) == 2


def test_report_and_bounds(spark):
    rng = random.Random(6)
    sizes = [rng.randrange(1, 90) for _ in range(200)] + [250, 0]
    out, _ = packing.pack_documents(documents(spark, sizes), packs(spark, 100))
    report = packing.packing_report(out).head()
    pieces = [p for s in sizes for p in ([100] * (s // 100) + [s % 100] if s >= 100 else [s])]
    assert report["containers"] >= report["least_containers"] >= -(-sum(sizes) // 100)
    assert report["least_containers"] <= packing.best_fit_decreasing(np.array(pieces), 100).max() + 1
    assert report["gap"] == report["containers"] - report["least_containers"] and 0 <= report["certified_share"] <= 1


def test_too_many_packs_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_PACKS", 1)
    with pytest.raises(ValueError, match="packs"):
        packing.pieces(documents(spark, [3]), packs(spark, 10, 20))


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_mix_reaches_its_shares(spark):
    rng = random.Random(4)
    df = documents(spark, [rng.randrange(50, 150) for _ in range(3000)], ["A ", "www.b", "b", "c", None])
    mix, shares, _ = mixing.mix_to_targets(df, targets(spark, [("a", 0.3, 2), ("B", 0.6, 3), ("c", 0.1, 1), ("gone", 0.0, 4)]))
    found = {r["source"]: r for r in shares.collect()}
    for s, want in (("a", 0.3), ("b", 0.6), ("c", 0.1)):
        assert found[s]["actual_share"] == pytest.approx(want, abs=0.01) and found[s]["reachable"]
    assert found["gone"]["used"] == 0
    total = mix.agg(F.sum("size")).head()[0]
    assert 0 <= found["a"]["total"] - total < 150
    assert mix.groupBy("doc_id", "copy_no").count().filter("count > 1").isEmpty()


def test_capped_source_is_reported(spark):
    df = documents(spark, [100] * 100, ["big"] * 9 + ["small"])
    mix, shares, _ = mixing.mix_to_targets(df, targets(spark, [("big", 0.5, 1), ("small", 0.5, 2), ("none", 0.2, 1)]))
    found = {r["source"]: r for r in shares.collect()}
    assert not found["small"]["reachable"] and found["big"]["reachable"] and not found["none"]["reachable"]
    assert mix.filter("source = 'small'").groupBy("doc_id").count().agg(F.max("count")).head()[0] == 2
    again, _, _ = mixing.mix_to_targets(df, targets(spark, [("big", 0.5, 1), ("small", 0.5, 2), ("none", 0.2, 1)]))
    assert rows_of(again) == rows_of(mix)


def test_budget_that_holds_the_shares(spark):
    rng = random.Random(9)
    df = documents(spark, [rng.randrange(50, 150) for _ in range(2000)], ["big"] * 9 + ["small"])
    mix, shares, _ = mixing.mix_to_targets(df, targets(spark, [("big", 0.5, 1), ("small", 0.5, 2)]), hold_shares=True)
    assert all(r["actual_share"] == pytest.approx(0.5, abs=0.01) for r in shares.collect())


def test_nothing_within_the_budget_is_left_out_early(spark):
    rng = random.Random(10)
    df = documents(spark, [rng.randrange(1, 400) for _ in range(500)], ["a", "b", "b", "c", "c", "c"])
    rows = [("a", 0.6, 3), ("b", 0.3, 1), ("c", 0.1, 2)]
    for budget in (5_000, 60_000, 10**9):
        mix, _, _ = mixing.mix_to_targets(df, targets(spark, rows), budget=budget)
        served = mixing.served_copies(df, mixing.wanted_sources(targets(spark, rows))).collect()
        order = sorted(served, key=lambda r: (r["served"] / r["target_share"], r["source"], r["at"], r["copy_no"], r["doc_id"]))
        kept, running = set(), 0
        for r in order:
            running += r["size"]
            if running <= budget:
                kept.add((r["doc_id"], r["copy_no"]))
        assert {(r["doc_id"], r["copy_no"]) for r in mix.collect()} == kept


def test_mix_of_nothing(spark):
    mix, shares, _ = mixing.mix_to_targets(documents(spark, [1]).limit(0), targets(spark, [("a", 1.0, 1), (None, None, None)]))
    assert mix.isEmpty() and shares.count() == 1


SHEET = (
    "review_id long, item_type string, reference string, context string, ai_label string, allowed_human_labels string, human_label string, reviewer string, "
    "second_pass_label string, second_pass_reviewer string, plain string"
)


def sheet(spark, n=300, seed=5):
    rng = random.Random(seed)
    labels = ["SAME_EVENT", "PLAUSIBLE", "MIXED"]
    care = {"good": 0.95, "fine": 0.9, "poor": 0.3, "second": 0.9, "ai": 0.6}
    truth, rows, k = {}, [], 0

    def says(who, true):
        return true if rng.random() < care[who] else rng.choice([x for x in labels if x != true])

    for i in range(n):
        true = truth[f"r{i}"] = rng.choice(labels)
        ai = says("ai", true)
        for who in rng.sample(["good", "fine", "poor"], 2):
            k += 1
            label = says(who, true)
            rows.append((k, "T", f"r{i}", f"about {true}", ai.lower(), "SAME_EVENT / PLAUSIBLE / MIXED", rng.choice([label, f" {label.lower().replace('_', ' ')} "]), who, says("second", true), "second", "x"))
    rows += rows[:20] + [(k + 1, None, None, None, None, None, None, None, None, None, None), (None, "T", "r0", None, None, None, "x", None, None, None, None), (k + 2, "T", "empty", "c", "?", "A / B", "N/A", None, None, None, None)]
    return spark.createDataFrame(rows, SHEET), truth


def test_consensus(spark):
    df, truth = sheet(spark)
    items, people, _ = consensus.fit_consensus(df, ["item_type", "context"])
    found = {r["reference"]: r for r in items.collect()}
    assert set(found) == set(truth)
    assert sum(found[r]["consensus_label"] == t for r, t in truth.items()) >= 0.97 * len(truth)
    reliable = {r["annotator"]: r["reliability"] for r in people.collect()}
    assert reliable["poor"] < 0.5 < reliable["fine"] and reliable["good"] > 0.85
    assert all(0 < r["confidence"] <= 1 and 0 <= r["agreement"] <= 1 for r in found.values())


def test_a_fit_that_has_not_settled_is_an_error(spark, monkeypatch):
    df, _ = sheet(spark, 20)
    with pytest.raises(RuntimeError, match="still moves"):
        consensus.fit_consensus(df, ["context"], rounds=1)
    monkeypatch.setattr(consensus, "MOST_NUMBERS", 10)
    with pytest.raises(ValueError, match="numbers"):
        consensus.fit_consensus(df, ["context"])


def test_inverse_by_elimination():
    x = np.random.default_rng(1).normal(size=(40, 12))
    m = x.T @ x + np.eye(12)
    assert np.allclose(consensus._inverse(m) @ m, np.eye(12))


def test_one_vote_per_review_and_ai(spark):
    row = (1, "T", "r", "c", "A", "A / B", "b", "x", None, None, "p")
    votes = consensus.valid_votes(spark.createDataFrame([row, row, (2, *row[1:6], "?", "y", "B", "z", "p")], SHEET))
    assert rows_of(votes.select("annotator", "label", "n")) == [("(ai)", "A", 1.0), ("x", "B", 1.0), ("z", "B", 1.0)]


def test_consensus_of_nothing(spark):
    df, _ = sheet(spark, 2)
    items, people, _ = consensus.fit_consensus(df.limit(0), ["context"])
    assert items.isEmpty() and people.isEmpty()
