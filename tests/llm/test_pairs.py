from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from tidewire.llm import cooccur, groups, history_dedup, markov, near_copies
from tidewire.llm.visible import parity_map, word_pair_hashes, words

WORDS = [f"w{k}" for k in range(400)]


def edited(rng, tokens, edits):
    out = list(tokens)
    for _ in range(edits):
        k = rng.randrange(len(out))
        rng.choice([lambda: out.pop(k), lambda: out.insert(k, rng.choice(WORDS)), lambda: out.__setitem__(k, rng.choice(WORDS))])()
    return out


def overlap(a, b):
    a, b = set(zip(a, a[1:])), set(zip(b, b[1:]))
    return len(a & b) / len(a | b) if a and b else 0.0


def collection(seed, n, common=8):
    """Texts over few words, many near the threshold, some copies, empties and one long text."""
    rng = random.Random(seed)
    phrases = [[rng.choice(WORDS) for _ in range(6)] for _ in range(common)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.5:
            texts.append(edited(rng, rng.choice(texts) or ["x", "y"], rng.randrange(9)) if rng.random() < 0.9 else list(rng.choice(texts)))
        else:
            texts.append([w for _ in range(4) for w in rng.choice(phrases)] + [rng.choice(WORDS) for _ in range(12)])
    return [*texts, [], ["one"], [WORDS[k % 400] for k in range(5000)]]


def articles(spark, texts):
    rows = [(f"a{k:03}", " ".join(t[:5]), " ".join(t[5:]), "clash", 1) for k, t in enumerate(texts)]
    rows += [rows[0], ("zz", None, None, None, None), (None, "w1 w2 w3", "w4", None, None)]
    return spark.createDataFrame(rows, "article_id string, title string, description string, a string, hi int")


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_against_brute_force(spark, seed):
    texts = collection(seed, 120)
    pairs, members, _ = near_copies.near_copies(articles(spark, texts), "article_id", ["title", "description"])
    found = {tuple(r) for r in near_copies.near_copy_articles(pairs, members).collect()}
    expected = {(f"a{i:03}", f"a{j:03}") for i in range(len(texts)) for j in range(i + 1, len(texts)) if overlap(texts[i], texts[j]) >= 0.6}
    assert found == expected and len(expected) > 50


def test_hot_bytes_are_split_into_blocks(spark, monkeypatch):
    texts = collection(3, 60)
    whole = rows_of(near_copies.near_copy_articles(*near_copies.near_copies(articles(spark, texts), "article_id", ["title", "description"])[:2]))
    monkeypatch.setattr(near_copies, "BLOCK", 3)
    assert rows_of(near_copies.near_copy_articles(*near_copies.near_copies(articles(spark, texts), "article_id", ["title", "description"])[:2])) == whole


def test_pairs_at_the_threshold_reach_the_guaranteed_tally(spark):
    texts = collection(4, 60)
    scratch = near_copies.Scratch(spark, "t")
    read = near_copies.positional_bytes(articles(spark, texts).select(F.col("article_id").alias("record_id"), "title", "description"), ["title", "description"])
    classes = scratch.table(read.groupBy("hi", "lo").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("keys", *near_copies.PARITY))).select(F.monotonically_increasing_id().alias("cid"), F.size("keys").alias("n"), *near_copies.PARITY, "keys"))
    met = {(r["a"], r["b"]) for r in near_copies.tallied_pairs(scratch.table(near_copies.byte_index(classes)), 0.6, scratch).collect()}
    met |= {(b, a) for a, b in met}
    sets = {r["cid"]: set(r["keys"]) for r in classes.collect()}
    near = {(a, b) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert near <= met and near


def test_a_third_of_copies_is_one_class(spark):
    texts = [["w1", "w2", "w3", "w4", str(k) if k % 3 else "same", "w5", "w6"] for k in range(300)]
    pairs, members, _ = near_copies.near_copies(articles(spark, texts), "article_id", ["title", "description"])
    sizes = sorted(r["count"] for r in members.groupBy("class_id").count().collect())
    assert sizes[-1] == 100 and len(sizes) == 201


def test_nothing_near(spark):
    empty = articles(spark, [["a"]]).limit(0)
    pairs, members, _ = near_copies.near_copies(empty, "article_id", ["title", "description"])
    assert near_copies.near_copy_articles(pairs, members).isEmpty()


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x = rng.integers(0, 1 << 63, 80).astype(np.uint64)
        a, b = x[:60], x[rng.integers(0, 60) :]
        bits = sum(bin(int(p) ^ int(q)).count("1") if p >= 0 and q >= 0 else bin((int(p) ^ int(q)) & (1 << 64) - 1).count("1") for p, q in zip(parity_map(a), parity_map(b)))
        assert bits <= len(np.setxor1d(a, b))


def test_word_pairs_are_distinct_and_ordered():
    assert len(word_pair_hashes(words("a b a b"))) == 2
    assert len(word_pair_hashes(["a"])) == 0
    assert word_pair_hashes(["a", "b"])[0] != word_pair_hashes(["b", "a"])[0]


def records(spark, texts, first):
    rows = [(first + k, f"k{first + k}", f"h{first + k}", (" ".join(t[:5]), "<p>" + " ".join(t[5:]) + "</p>", None)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "item_no long, entry_key string, content_hash string, payload struct<title: string, summary: string, description: string>")


def test_incoming_against_brute_force(spark):
    texts = collection(5, 150)
    old, new = texts[:70], texts[70:]
    found, _ = history_dedup.repeated_records(records(spark, old, 0), records(spark, new, 1))
    found = {r["item_no"]: r["decision"] for r in found.collect()}
    best = {k + 1: max([overlap(t, o) for o in [*old, *new[:k]]], default=0) for k, t in enumerate(new)}
    assert found == {k: "copy" if v == 1 else "near_copy" for k, v in best.items() if v >= 0.6} and len(found) > 20


def test_incoming_short_texts_with_scattered_edits(spark):
    rng = random.Random(11)
    old = [[rng.choice(WORDS) for _ in range(n)] for n in (10, 20, 40) for _ in range(120)]
    new = []
    for text in old:
        out = list(text)
        for k in rng.sample(range(len(out)), rng.randint(1, max(1, len(out) // 7))):
            out[k] = f"x{len(new)}y{k}"
        new.append(out)
    long = [f"v{k}" for k in range(90)]
    old, new = [*old, long], [*new, [f"z{k}" if k % 8 == 4 else w for k, w in enumerate(long)]]
    found, _ = history_dedup.repeated_records(records(spark, old, 0), records(spark, new, 1))
    expected = {k + 1 for k, (t, o) in enumerate(zip(new, old)) if overlap(t, o) >= 0.6}
    assert {r["item_no"] for r in found.collect()} == expected and len(expected) > 200


def test_incoming_edge_cases(spark):
    none = records(spark, [["a", "b"]], 1).limit(0)
    batch = records(spark, [["a", "b", "c"], ["a", "b", "c"], [], ["x"]], 1)
    batch = batch.union(batch.limit(1)).union(spark.sql("select null, 'k', 'h', null")).union(spark.sql("select 9, null, null, null"))
    found, _ = history_dedup.repeated_records(none, batch)
    assert {r["item_no"] for r in found.filter("decision = 'copy'").collect()} == {2}
    found, _ = history_dedup.repeated_records(batch, none)
    assert found.isEmpty()


def batch_of(spark, rows):
    return spark.createDataFrame(rows, "ref long, since long, title string, body string")


def test_index_grows_by_batches(spark, tmp_path):
    fields = ["title", "body"]
    index = history_dedup.SeenIndex(spark, f"file://{tmp_path}/index")
    scratch = history_dedup.Scratch(spark, "t")
    text = " ".join(WORDS[:40])
    index.add(batch_of(spark, [(1, 0, "t", text)]), fields, scratch)
    batch = batch_of(spark, [(2, 1, "t", text + " extra"), (3, 1, "u", " ".join(WORDS[100:140]))])
    assert {(r["ref"], r["decision"]) for r in index.check(batch, fields, scratch).collect()} == {(2, "near_copy")}
    index.accept(batch.filter("ref = 3"), fields, scratch)
    index.accept(batch.filter("ref = 3"), fields, scratch)
    assert index.table("contents").count() == 2
    later = batch_of(spark, [(4, 2, "u", " ".join(WORDS[100:140]))])
    assert {(r["ref"], r["decision"]) for r in index.check(later, fields, scratch).collect()} == {(4, "copy")}
    other = index.divided(f"file://{tmp_path}/other", 6, scratch)
    assert {r["ref"] for r in other.check(later, fields, scratch).collect()} == {4}


def test_reading_depends_on_the_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history_dedup, "DIVISION_ROWS", 300)
    rng = random.Random(8)
    text = lambda n=20: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    batch = batch_of(spark, [(1, 5, text(5), text(5))])
    read = {}
    for size in (100, 1000):
        scratch = history_dedup.Scratch(spark, "t")
        index = history_dedup.SeenIndex(spark, f"file://{tmp_path}/{size}", history_dedup.bits_for(size))
        index.add(batch_of(spark, [(k, 0, text(), text()) for k in range(size)]), ["title", "body"], scratch)
        own = history_dedup.contents_of(history_dedup.read_records(batch, ["title", "body"]))
        read[size] = [index.near(t, history_dedup.keyed(own, t).select("key")).count() for t in ("chunks", "pairs")]
        assert index.check(batch, ["title", "body"], scratch).isEmpty()
    assert all(many <= 2 * few for few, many in zip(read[100], read[1000]))


def test_hot_keys_are_looked_up_in_parts(spark, monkeypatch):
    texts = collection(6, 80)
    old, new = records(spark, texts[:40], 0), records(spark, texts[40:], 1)
    whole = rows_of(history_dedup.repeated_records(old, new)[0].select("item_no", "decision"))
    monkeypatch.setattr(history_dedup, "HOT", 2)
    assert rows_of(history_dedup.repeated_records(old, new)[0].select("item_no", "decision")) == whole


def test_chunks_end_where_the_content_says():
    rng = random.Random(3)
    text = " ".join(rng.choice(WORDS) for _ in range(600)).encode()
    chunks = set(history_dedup.chunks_of(text).tolist())
    assert 8 < len(text) / len(chunks) < 32 and sum(c & 4095 for c in chunks) <= len(text)
    moved = set(history_dedup.chunks_of(b"new " + text).tolist())
    assert len(chunks - moved) <= 2  # an insertion moves only the boundaries next to it
    assert sum(int(c) & 4095 for c in history_dedup.chunks_of(b"a" * 9000)) in (4095 + 810, 9000)
    assert len(history_dedup.chunks_of(b"abc")) == 1 and len(history_dedup.chunks_of(b"")) == 0


def test_groups_against_union_find(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(200):03}", f"n{rng.randrange(200):03}") for _ in range(150)] + [(f"c{k:03}", f"c{k + 1:03}") for k in range(60)] + [("hub", f"h{k}") for k in range(200)]
    edges += [(None, "x"), ("x", None), ("loop", "loop"), *edges[:5]]
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    found, _ = groups.connected_groups(spark.createDataFrame(edges, "x string, y string"), "x", "y")
    assert dict(rows_of(found)) == {x: find(x) for x in parent}
    nothing, _ = groups.connected_groups(spark.createDataFrame([("a", "a")], "x string, y string"), "x", "y")
    assert nothing.isEmpty()


def test_links_of_dirty_rows(spark):
    families = spark.createDataFrame([(" a ;; b;c ",), ("d;",), (None,), ("a ;; b;c",)], "article_ids string")
    labels = spark.createDataFrame([("b", "e ", " same event"), ("a", "z", "DIFFERENT_EVENT"), ("f", None, "SAME_EVENT"), ("g", "h", None)], "left_article_id string, right_article_id string, manual_label string")
    found, _ = groups.connected_groups(groups.article_links(families, labels), "x", "y")
    assert rows_of(found) == [("a", "a"), ("b", "a"), ("c", "a"), ("e", "a")]


def test_items_together(spark):
    rng = random.Random(4)
    rows = [(f" WWW.p{rng.randrange(12)}.Example", f"e{rng.randrange(40)}") for _ in range(300)] + [("www.p1.example", None), (None, "e1"), (" ", "e1"), ("p1.example", "only")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "publisher_domain string, event_cluster_id string, k int, item string")
    found = {(r["item_a"], r["item_b"]): (r["k"], r["a"], r["b"], r["n"]) for r in cooccur.items_together(df, cooccur.plain_host("publisher_domain"), F.col("event_cluster_id"))[0].collect()}
    held: dict = {}
    for p, e in rows:
        if p and p.strip() and e:
            held.setdefault(p.strip().lower().removeprefix("www."), set()).add(e)
    n = len({e for _, e in rows if e})
    assert found == {(a, b): (len(held[a] & held[b]), len(held[a]), len(held[b]), n) for a in held for b in held if a < b and held[a] & held[b]}
    assert cooccur.items_together(df.limit(0), F.col("publisher_domain"), F.col("event_cluster_id"))[0].isEmpty()


def test_a_hot_basket_is_split(spark, monkeypatch):
    rows = [(f"p{k}", "hot") for k in range(40)] + [(f"p{k % 7}", f"e{k % 5}") for k in range(60)]
    df = spark.createDataFrame(rows, "publisher string, event string")
    whole = rows_of(cooccur.items_together(df, F.col("publisher"), F.col("event"))[0])
    monkeypatch.setattr(cooccur, "BLOCK", 6)
    assert rows_of(cooccur.items_together(df, F.col("publisher"), F.col("event"))[0]) == whole and len(whole) == 40 * 39 // 2


def blobs(seed, sizes, dim=64, noise=0.05):
    rng = np.random.default_rng(seed)
    out = []
    for k, size in enumerate(sizes):
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            v = centre + rng.normal(size=dim) * noise
            out.append((f"a{len(out):04}", k, (v * rng.uniform(0.5, 2)).astype(np.float32).tolist()))
    return out


def test_clusters_of_separate_blobs(spark):
    rows = blobs(1, [30, 7, 3, 2, 2, 1, 1, 1])
    extra = [("n1", None), ("n2", []), ("n3", [0.0] * 64), ("n4", [1.0] * 3), (None, rows[0][2]), ("n5", [float("nan")] * 64), ("copy", rows[0][2]), (rows[0][0], rows[0][2])]
    df = spark.createDataFrame([(i, v, "x", 0) for i, _, v in rows] + [(i, v, None, None) for i, v in extra], "article_id string, embedding array<float>, vid string, node int")
    members, clusters, _ = markov.similarity_clusters(df)
    expected = {}
    for i, k, _ in rows:
        expected.setdefault(k, []).append(i)
    expected[0].append("copy")
    assert rows_of(members.select("article_id", "first_article_id")) == sorted((i, min(v)) for v in expected.values() if len(v) > 1 for i in v)
    sizes = sorted(r["size"] for r in clusters.collect())
    assert sizes == [2, 2, 3, 7, 31]
    assert all(len(r["typical_members"].split(";")) == min(3, r["size"]) for r in clusters.collect())
    assert markov.similarity_clusters(df.limit(0))[0].isEmpty()
    # an article with two vectors links nothing but by one of them
    twice = spark.createDataFrame([(i, v) for i, v in (("x", [1.0, 0.0, 0.0]), ("y", [0.0, 1.0, 0.0]), ("z", [1.0, 0.0, 0.0]), ("z", [0.0, 1.0, 0.0]))], "article_id string, embedding array<float>")
    assert len({r["first_article_id"] for r in markov.similarity_clusters(twice)[0].collect()}) == 1


@pytest.mark.parametrize("dim, values", [(64, 1), (64, 2), (64, 3), (32, 2)])
def test_recall_of_the_index(spark, dim, values):
    rng, n, cosine = np.random.default_rng(7), 1500, 0.8005
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    y = cosine * x + np.sqrt(1 - cosine**2) * z
    rows = [(f"v{k}", v.astype(np.float32).tolist()) for k, v in enumerate(np.concatenate([x, y]))]
    df = spark.createDataFrame(rows, "article_id string, embedding array<float>")
    scratch = markov.Scratch(spark, "recall")
    different = markov.different_vectors(markov.hashed_vectors(df, dim, values), scratch)
    ids = {r["vid"] for r in markov.near_vectors(different, 0.8, scratch).select(F.explode(F.array("x", "y")).alias("vid")).collect()}
    assert len(ids) >= 0.97 * 2 * n


def test_hash_values_follow_the_number_of_vectors():
    assert [markov.hash_values(n, 64) for n in (0, 100, 10**5, 10**7, 10**10)] == [1, 1, 2, 3, 4]
    assert 0.28 < markov.meet_once(64, 0.8) < 0.33 > markov.meet_once(512, 0.8)


def dense_flow(joined, inflation=2.0, rounds=60):
    """Clusters of a dense Markov clustering: columns whose largest rows are linked."""
    m = joined / joined.sum(0)
    for _ in range(rounds):
        m = m @ m
        m = m**inflation
        m[m < 1e-9 * m.max(0)] = 0
        m /= m.sum(0)
    label = np.arange(len(m))
    links = m >= (1 - 1e-6) * m.max(0)
    for _ in range(len(m)):
        for c in range(len(m)):
            rows = [c, *np.flatnonzero(links[:, c])]
            label[rows] = label[rows].min()
    return label


def test_flow_against_dense_matrices(spark):
    rng = np.random.default_rng(12)
    rows = []
    for k in range(14):
        centre = rng.normal(size=64)
        centre /= np.linalg.norm(centre)
        for _ in range(rng.integers(3, 14)):
            v = centre + rng.normal(size=64) * 0.052
            rows.append((f"a{len(rows):03}", v.astype(np.float32).tolist()))
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    joined = (x @ x.T >= 0.85).astype(float)
    parts = dense_flow(joined)
    assert any((joined[i] != joined[j]).any() for i in range(len(x)) for j in range(i) if parts[i] == parts[j])  # not only twins
    want = {}
    for i, p in enumerate(parts):
        want.setdefault(p, []).append(f"a{i:03}")
    df = spark.createDataFrame(rows, "article_id string, embedding array<float>")
    members, _, _ = markov.similarity_clusters(df, 0.85)
    found = {}
    for r in members.collect():
        found.setdefault(r["first_article_id"], []).append(r["article_id"])
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_markov_flow_splits_two_cliques_with_a_bridge(spark):
    left, right = range(1, 7), range(11, 17)
    edges = [(a, b) for side in (left, right) for a in side for b in side if a < b] + [(1, 11)]
    scratch = markov.Scratch(spark, "flow")
    found = {r["node"]: r["attractor"] for r in markov.markov_flow(spark.createDataFrame(edges, "x long, y long"), scratch).collect()}
    assert len({found[a] for a in left}) == 1 and len({found[a] for a in right}) == 1 and found[2] != found[12]


def flow_clusters(spark, members, apart):
    """Clusters of indices with ``members[k]`` twins each, all joined but the pairs ``apart``."""
    ids = range(len(members))
    entries = [(c, r, members[r], 1.0) for c in ids for r in ids if (c, r) not in apart and (r, c) not in apart]
    scratch = markov.Scratch(spark, "still")
    first = scratch.table(markov._normalised(spark.createDataFrame(entries, "col long, row long, mr long, p double")))
    found, _ = groups.connected_groups(markov._links(markov._still(first, scratch)), "x", "y")
    group = {r["node"]: r["group"] for r in found.collect()}
    return len({group.get(k, k) for k in ids})


def test_large_near_cliques_stay_whole(spark):
    # 1,500 members, each without an edge to 50 others
    assert flow_clusters(spark, [50] * 30, {(k, k + 1) for k in range(0, 30, 2)}) == 1
    # 11,000 members, 100 of them with one missing edge
    assert flow_clusters(spark, [1] * 100 + [10_900], {(k, k + 1) for k in range(0, 100, 2)}) == 1
    # two large cliques that a twentieth of one side's members join stay apart
    assert flow_clusters(spark, [1_000, 50, 50, 1_000], {(0, 2), (0, 3), (1, 3)}) == 2


def test_hot_buckets_are_split(spark, monkeypatch):
    rows = blobs(2, [40, 3])
    df = spark.createDataFrame([(i, v) for i, _, v in rows], "article_id string, embedding array<float>")
    whole = rows_of(markov.similarity_clusters(df)[0].select("article_id", "first_article_id"))
    monkeypatch.setattr(markov, "BLOCK", 8)
    assert rows_of(markov.similarity_clusters(df)[0].select("article_id", "first_article_id")) == whole
