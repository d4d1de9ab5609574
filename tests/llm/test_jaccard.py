"""The Jaccard join against brute force."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join
from tidemark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def roots(n, links):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    root = roots(len(rows), links)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, len(s), least.get(r) if s else i) for (i, _), s, r in zip(rows, sets, root, strict=True)), key=repr)


def corpus(rng, n):
    base = [[f"w{x}" for x in rng.integers(0, 400, int(rng.integers(3, 90)))] for _ in range(8)]
    rows = []
    for i in range(n):
        own = list(base[int(rng.integers(len(base)))])
        for _ in range(int(rng.integers(0, 4))):
            own[int(rng.integers(len(own)))] = f"x{int(rng.integers(10**6))}"
        rows.append((i, " ".join(own).upper() if i % 3 else "\n ".join(own)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two"), (n + 5, "one two"), (None, rows[0][1]), (n + 6, "z" * 3_000_000), *((n + 7 + i, " ".join(f"l{x}" for x in range(9000 + 300 * i))) for i in range(3))]


@pytest.mark.parametrize(("k", "num", "size", "hot", "fan"), [(4, 85, 2048, 200_000, 1024), (5, 80, 16, 200_000, 1024), (5, 80, 4, 200_000, 4), (4, 85, 2048, 5, 4), (5, 80, 2048, 12, 1024), (4, 85, 6, 9, 4)])
def test_against_brute_force(spark, monkeypatch, k, num, size, hot, fan):
    monkeypatch.setattr(jaccard_join, "BLOCK", size)  # small: blocks are split, and open keys' parts meet
    monkeypatch.setattr(jaccard_join, "BUNDLE", max(2, size // 4))
    monkeypatch.setattr(jaccard_join, "FAN", fan)  # small: a second hop deals the buckets on
    monkeypatch.setattr(jaccard_join, "HELD", 300)
    monkeypatch.setattr(jaccard_join, "HOT", hot)  # small: most shingles that repeat are hot
    rows = corpus(np.random.default_rng(k), 150)
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, component_id int, cls string")
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(docs, k, num, 100).collect()), key=repr)
    assert got == brute(rows, k, num, 100)


@pytest.mark.parametrize("bits", [64, 1 << 14])
@pytest.mark.parametrize("seed", range(6))
def test_tree_against_brute_force(monkeypatch, seed, bits):
    monkeypatch.setattr(jaccard_join.Tree, "MAX_BITS", bits)
    rng = np.random.default_rng(seed)
    base = [np.unique(rng.integers(0, 2**63, int(rng.integers(3, 120))).astype(np.uint64)) for _ in range(4)]
    sets = []
    for _ in range(int(rng.integers(2, 200))):
        b = base[rng.integers(len(base))]
        own = np.unique(np.concatenate([b[rng.random(len(b)) > rng.random() * 0.15], rng.integers(0, 2**63, int(rng.integers(0, 6))).astype(np.uint64)]))
        sets.append(own if len(own) else b)
    plain = [set(s.tolist()) for s in sets]
    want = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(plain[i] & plain[j]) >= 85 * len(plain[i] | plain[j])]
    got = jaccard_join.tree_links(sets, np.zeros(len(sets), np.int64), 85, 100)
    assert roots(len(sets), got) == roots(len(sets), want)
    assert {(max(x), min(x)) for x in got} <= set(want)


def test_known_components_are_not_compared_again():
    sets = [np.arange(i, i + 40, dtype=np.uint64) for i in range(60)]
    for seed in range(4):
        known = np.random.default_rng(seed).integers(0, 5, len(sets))
        got = jaccard_join.tree_links(sets, np.zeros(len(sets), np.int64), 85, 100, known)
        assert all(known[i] != known[j] for i, j in got) and len(got) <= 4
        same = [(i, int(np.flatnonzero(known == known[i])[0])) for i in range(len(sets))]
        assert set(roots(len(sets), got + same)) == {0}


def test_large_blocks_send_no_component_to_itself(spark):
    """A key of one large component and one stranger: the large one's classes meet the stranger only."""
    keys = spark.createDataFrame([(i, 7) for i in range(100)], "id long, token long")
    large = spark.createDataFrame([(i, 50) for i in range(100)], "id long, n long")
    links = spark.createDataFrame([(0, i) for i in range(1, 99)], "a long, b long")
    assert jaccard_join.open_cells(keys, large, links).count() == 100
    assert jaccard_join.open_cells(keys, large.where("id < 99"), links).count() == 0


def test_one_of_each_keeps_one_row(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text, "a"), (3, text, "a"), (2, text + " end", "b"), (2, text + " end", "b"), (9, "other words entirely here now", "c"), (7, None, "d"), (8, "", "e"), (None, "lone null id row with words", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted(((r.doc_id, r.key) for r in jaccard_join.one_of_each(docs).collect()), key=repr)
    assert got == sorted([(2, "b"), (9, "c"), (7, "d"), (8, "e"), (None, "f")], key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_components(docs).count() == 0
    assert jaccard_join.one_of_each(docs).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in components(edges).collect()} == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_whole_class_names_give_the_same_keys(spark):
    docs = spark.createDataFrame([(i, t) for i, t in corpus(np.random.default_rng(2), 80)], "doc_id long, text string")
    classes, wide = jaccard_join.numbered(jaccard_join.set_sizes(docs, 4))
    assert not wide and classes.where("id <> place").count() == 0
    total = classes.agg(F.sum("n")).first()[0]
    few, all_ = (sorted(map(tuple, jaccard_join.keys_of(docs, classes, 4, 85, 100, total, np.zeros(0, np.uint64), w).collect())) for w in (False, True))
    assert few == all_ and few


def test_classes_of_one_place_are_numbered(spark):
    rows = spark.createDataFrame([(i, bytes([i // 2] * 12), 5, 7 if i < 6 else 8) for i in range(10)], "doc_id long, cls binary, n long, place long")
    classes, wide = jaccard_join.numbered(rows)
    assert wide and classes.select("id").distinct().count() == classes.count() == 5


def test_hot_shingles_are_found(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 8)
    docs = spark.createDataFrame([(i, f"a b c d e f g h x{i} y{i} z{i}") for i in range(12)], "doc_id long, text string").coalesce(1)
    rows = jaccard_join.set_sizes(docs, 4)
    hot = jaccard_join.hot_shingles(rows.where("common IS NOT NULL").select("common"), 100)
    assert len(hot) == 5
    packed = jaccard_join.packed_tokens(docs, 4, 8, hot, 50, 100).collect()
    assert sum(np.frombuffer(r.large, np.uint32).sum() for r in packed if r.bucket < 0) == 12 * 5
    assert {r.component_id for r in jaccard_join.jaccard_components(docs, 4, 45, 100).collect()} == {0}
    assert len({r.component_id for r in jaccard_join.jaccard_components(docs, 4, 50, 100).collect()}) == 12


def test_hot_shingles_are_cut_in_the_order_of_keys(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 5)
    rows = []
    for t in range(24):  # nine words, and six texts that add one: 6 / 7 in common with the template, 6 / 8 with each other
        words = " ".join(f"t{t}w{i}" for i in range(9))
        rows += [(100 * t + j, f"{words} own{j}" if j else words) for j in range(7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(docs, 4, 85, 100).collect()), key=repr)
    assert got == brute(rows, 4, 85, 100)
    assert {i - c for i, _, c in got} == set(range(7))
