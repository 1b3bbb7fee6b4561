from __future__ import annotations

import hashlib
import random
import re

import pytest

from tessellar.llm import repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first, out = {}, []
    for k, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            seen = first.setdefault(tuple(w[p : p + window]), (k is None, k))
            if seen < (k is None, k):
                gone[p : p + window] = [True] * window
        out.append((k, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


def run(docs, window):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(docs, window=window).collect()], key=str)


def passages(seed: int, n: int, vocabulary: int = 400):
    rng = random.Random(seed)
    text = lambda k: [f"w{rng.randrange(vocabulary)}" for _ in range(k)]
    shared = [text(rng.randrange(15, 90)) for _ in range(6)]
    rows = []
    for k in range(n):
        words = text(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            a = rng.randrange(len(p))
            words += p[a : a + rng.randrange(10, 80)] + text(rng.randrange(6))
        rows.append((k, rng.choice([" ", "\n", "\t "]).join(words)))
    for k in range(n, n + 12):  # near copies
        words = WORD.findall(rows[rng.randrange(n)][1])
        for _ in range(rng.randrange(4)):
            if words:
                words[rng.randrange(len(words))] = "edit"
        rows.append((k, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(make, seed):
    rows = passages(seed, 60)
    for window in (20, 50):
        assert run(make(rows), window) == brute(rows, window)


def test_few_words_repeat_within_and_across(make):
    rows = [(0, "a b " * 60), (1, "b a " * 60), (2, "a " * 49), (3, "a " * 50), (4, "a " * 120), (5, "A " * 60)]
    assert run(make(rows), 50) == brute(rows, 50)


def test_hot_group_of_copies(make):
    body = " ".join(f"t{k}" for k in range(200))
    rows = [(k, body) for k in range(150)] + [(k, f"x{k} " + body[: 400 + k]) for k in range(150, 220)]
    assert run(make(rows, parts=7), 50) == brute(rows, 50)


def test_edge_cases(make):
    body = " ".join(f"é{k}" for k in range(60))
    rows = [(7, body), (None, body), (9, None), (10, ""), (11, " \n\t"), (12, "é" * 3000), (13, body.replace(" ", " ")), (14, body.replace(" ", "\x0b\x0c"))]
    docs = make(rows).withColumnRenamed("lang", "u").withColumnRenamed("source", "g")
    assert run(docs, 50) == brute(rows, 50)
    assert run(make([]), 50) == []


def test_rows_of_one_id_do_not_remove_from_each_other(make):
    body = " ".join(f"t{k}" for k in range(60))
    assert [r[2] for r in run(make([(1, body), (1, body), (1, body + " more")]), 50)] == [0, 0, 0]
    assert sorted(r[2] for r in run(make([(1, body), (2, body), (2, body)]), 50)) == [0, 60, 60]


def test_very_long_text(make):
    long = " ".join(f"z{k % 5000}" for k in range(30_000))
    rows = [(0, long), (1, "head " + long[1000:90_000]), (2, "other")]
    assert run(make(rows), 50) == brute(rows, 50)
