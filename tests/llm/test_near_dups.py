from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest

from tessellar.llm import graph, near_dups

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size, percent=80):
    s = [(k, sets(t, size)) for k, t in rows]
    parent = {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in combinations(s, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return sorted((k, len(x), find(k), find(k) == k) for k, x in s)


def run(docs, **options):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(docs, **options).collect())


def copies(seed: int, bases: int, each: int, edits: int = 8):
    rng = random.Random(seed)
    rows = []
    for _ in range(bases):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 90))]
        for _ in range(each):
            words = list(base)
            for _ in range(rng.randrange(edits)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_equals_brute_force(make, size):
    rows = copies(1, 25, 6)
    assert run(make(rows), size=size) == brute(rows, size)


def test_a_large_group_goes_through_pivot_and_blocks(make):
    """Buckets of over `small` classes, with members that only some other copy links, and pairs that nothing links."""
    rows = copies(2, 2, 90, edits=14)
    assert run(make(rows, parts=5), size=2, small=4) == brute(rows, 2)


def test_edge_cases(make):
    rows = [(1, "One Two three"), (2, "one two THREE"), (3, ""), (4, None), (5, "solo"), (6, "SOLO"), (7, " \n"), (8, "É a b c d"), (9, "é a b c d"), (10, "x" * 5000), (11, "a b"), (12, "a b a b a b")]
    docs = make(rows).withColumnRenamed("lang", "id").withColumnRenamed("source", "key")
    assert run(docs, size=2) == brute(rows, 2)
    assert run(make([]), size=2) == []


def test_null_ids_stand_alone_and_shared_ids_are_one_node(make):
    got = near_dups.near_duplicates(make([(None, "a b c d"), (1, "a b c d"), (2, "a b c d"), (2, "other words here now"), (3, "other words here now"), (3, "other words here now")]), size=2).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (3, 1, False)]


def test_keep_first_drops_copies_only(make):
    docs = make([(5, "a b c d e f"), (3, "a b c d e f"), (9, "quite another text of words"), (None, "a b c d e f")])
    kept = near_dups.keep_first(docs, size=5)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 9]


def test_super_minhash_estimates_jaccard():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.9):
        est = []
        for _ in range(30):
            u = rng.integers(0, 2**63, 400).astype(np.uint64)
            k = int(400 * share)
            v = np.concatenate([u[:k], rng.integers(0, 2**63, 400 - k).astype(np.uint64)])
            est.append((near_dups.super_minhash(u, 160) == near_dups.super_minhash(v, 160)).mean())
        assert abs(np.mean(est) - k / (800 - k)) < 0.03


def test_super_minhash_stops_early_without_changing_the_result():
    u = np.arange(1, 60, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    full = near_dups.super_minhash(u, 64)
    assert np.isfinite(full).all() and (full == near_dups.super_minhash(u[::-1].copy(), 64)).all()
    assert np.minimum(near_dups.super_minhash(u[:30], 64), near_dups.super_minhash(u[30:], 64)).tolist() == full.tolist()


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(k, k + 1) for k in range(0, 200)] + [(500, k) for k in range(501, 560)] + [(900, 901), (901, 902), (902, 900)] + [(7, 7)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert all(got[k] == 0 for k in range(1, 201)) and all(got[k] == 500 for k in range(501, 560)) and got[902] == got[901] == 900
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []
