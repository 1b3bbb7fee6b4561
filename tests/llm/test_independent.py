"""Operators against plain versions that share no code with them, and the edges that other tests leave out."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from tessellar.llm import fingerprints, memory, neighbours, quality, repeats
from tessellar.llm.hashing import WORDS
from tests.llm.test_repeats import brute, passages


# Substring dedup
def plain_shard(found, window=6, phrase=2):
    s = repeats.Shard(window, phrase)
    for first, text in found:
        s.add(first, text)
    s.make()
    return lambda key, text: list(s.locate(key, text.split()))


def test_the_automaton_finds_passages_parts_of_them_and_nothing_else():
    body = [b"a%d" % k for k in range(30)]
    locate = plain_shard([(5, b" ".join(body)), (9, b" ".join(body[:8]) + b" q r s")])
    assert locate(6, b"x " + b" ".join(body) + b" y") == [0] + [1] * 30 + [0]
    assert locate(6, b" ".join(body[3:9]) + b" z " + b" ".join(body[10:15])) == [1] * 6 + [0] * 6  # five words are no window
    assert locate(5, b" ".join(body)) == [0] * 30 and locate(4, b" ".join(body)) == [0] * 30  # no earlier document has it
    assert locate(10, b" ".join(body[4:8]) + b" q r s") == [1] * 7 and locate(9, b" ".join(body[4:8]) + b" q r s") == [0] * 7
    assert plain_shard([])(3, b"a b c d e f g") == [0] * 7 and locate(6, b"") == []


def test_small_shards_several_sources_and_the_largest_id(spark):
    rows = passages(11, 40) + [(2**63 - 1, passages(11, 40)[3][1]), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(docs, window=20, shard=400).collect()], key=str)
    assert got == brute(rows, 20) and (2**63 - 1) in [r[0] for r in got]


# Fingerprints: the rolling hash, signatures and edit distance written plainly
def plain_fingerprint(data: bytes) -> str:
    if not data:
        return "3::"
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

    def roll(k: int) -> int:
        seven = [data[j] if j >= 0 else 0 for j in range(k - 6, k + 1)]
        return (int.from_bytes(bytes(seven), "little") * 0x9E3779B97F4A7C15 % 2**64) >> 32

    rolls = [roll(k) for k in range(len(data))]

    def signature(block: int, most: int) -> tuple[str, int]:
        out, start, hits = "", 0, 0
        for k, r in enumerate(rolls):
            if r % block == block - 1:
                hits += 1
                if len(out) < most - 1:
                    out, start = out + signs[zlib.crc32(data[start : k + 1]) % 64], k + 1
        return out + (signs[zlib.crc32(data[start:]) % 64] if start < len(data) else ""), hits

    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and signature(block, 64)[1] < 32:
        block //= 2
    return f"{block}:{signature(block, 64)[0]}:{signature(2 * block, 32)[0]}"


def plain_alike(a: str, b: str) -> float:
    if not any(a[k : k + 7] in b for k in range(len(a) - 6)):
        return 0.0
    row = list(range(len(b) + 1))  # insertions and deletions only
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(before[j - 1] if x == y else 1 + min(before[j], row[j - 1]))
    return 1 - row[-1] / (len(a) + len(b))


def plain_likeness(x: str, y: str) -> float:
    if x == y:
        return 1.0
    (p, a, a2), (q, b, b2) = x.split(":"), y.split(":")
    if p == q:
        return max(plain_alike(a, b), plain_alike(a2, b2))
    return plain_alike(a, b2) if int(p) == 2 * int(q) else plain_alike(a2, b) if 2 * int(p) == int(q) else 0.0


def test_fingerprints_equal_the_plain_scheme():
    rng = random.Random(5)
    texts = ["", "a", "aaaaaaa" * 40, *(" ".join(f"w{rng.randrange(90)}" for _ in range(rng.choice([3, 40, 300, 900]))) for _ in range(14))]
    texts += [t[: len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:])]
    marks = [fingerprints.fingerprint(t) for t in texts]
    assert marks == [plain_fingerprint(t.encode()) for t in texts]
    for x in marks[::2]:
        for y in marks:
            assert abs(fingerprints.likeness(x, y) - plain_likeness(x, y)) < 1e-12


def test_unrelated_texts_are_not_alike():
    rng = random.Random(6)
    text = lambda: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(300))
    marks = [fingerprints.fingerprint(text()) for _ in range(30)]
    assert max(fingerprints.likeness(x, y) for k, x in enumerate(marks) for y in marks[:k]) == 0.0


def test_a_frequent_id_and_ranges(spark):
    rows = [(7 if k % 3 == 0 else k, f"text {k % 40} " * (k % 5)) for k in range(300)] + [(None, "n"), (None, None)]
    got = fingerprints.compare_neighbours(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), task_bytes=300).collect()
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    order = [(r.doc_id, r.text or "") for r in spark.createDataFrame(rows, "doc_id long, text string").orderBy(F.col("doc_id").desc_nulls_last(), h).collect()]
    want = []
    for n, (k, t) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), plain_fingerprint(t.encode()), plain_likeness(plain_fingerprint(t.encode()), plain_fingerprint(after.encode()))))
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_next) for r in got], key=str) == sorted(want, key=str)


# Quality: statistics from the text, in plain Python
def plain_ratios(text: str) -> dict[str, float]:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    pieces = re.split(r"[\x20\x09-\x0D]+", text)
    n, w = len(text), max(len(words), 1)
    capitals = sum(c.isupper() for c in text)
    digits = sum(c.isdigit() for c in text)
    signs = sum(not (c.isalpha() or c.isdigit() or c in " \t\n\x0b\x0c\r.,;:!?'\"()|-") for c in text)
    return {
        "chars": n, "words": len(words), "word_length": n / w, "capitals": capitals / max(n, 1), "digits": digits / max(n, 1), "signs": signs / w, "bangs": text.count("!") / w,
        "bars": text.count("|") / w, "stops": text.count(".") / w, "lines": (text.count("\n") + 1) / w, "kinds": len(set(pieces)) / w,
    }


def test_scores_from_texts_to_rules(spark, make):
    texts = ["Plain words, here.\nAnd THERE!", "", "12 3|4 $$$ é É ß", "a a a b\tb\x0bc", None, "x" * 5000, "  lead and trail "]
    model = quality.RuleModel(-0.3, {(("word_length", True, 4.0),): 1.1, (("capitals", False, 0.1), ("kinds", True, 0.5)): -0.7, (("signs", True, 0.2),): 2.0, (("lines", True, 0.4), ("chars", False, 40.0)): 0.9})
    got = {r.doc_id: r.score for r in quality.score(make(list(enumerate(texts))), model).collect()}
    import math

    for k, t in enumerate(texts):
        f = plain_ratios(t or "")
        z = model.base + sum(w for rule, w in model.weights.items() if all((f[n] > c) == above for n, above, c in rule))
        assert abs(got[k] - 1 / (1 + math.exp(-z))) < 1e-12


def test_settings_are_chosen_by_folds_of_the_rows_given():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.random((400, 2))
    y = (x[:, 0] > 0.5).astype(float)
    usual, mute = {"trees": 5, "penalty": 1e-3}, {"trees": 5, "penalty": 10.0}  # the second keeps no rule
    assert quality.choose(x, y, ["a", "b"], [mute, usual]) == usual
    assert quality.choose(x, y, ["a", "b"], [usual, dict(usual)]) is not None
    noise = rng.integers(0, 2, 400).astype(float)
    assert quality.choose(x, noise, ["a", "b"], [usual, mute]) == mute  # nothing to learn: no rules
    model = quality.fit(x, y, ["a", "b"], **usual)
    assert np.mean((model.predict(x, ["a", "b"]) >= 0.5) == (y == 1)) > 0.97


def test_repeated_labels_and_documents_teach_once(spark, make):
    rows = [(k, "good words here. " * 5 if k % 2 else "!!! ### $$$ " * 9) for k in range(60)]
    labels = [(k, k % 2) for k in range(60)]
    table = lambda x: spark.createDataFrame(x, "doc_id long, quality int")
    once = quality.train(make(rows), table(labels))
    assert once.weights and quality.train(make(rows * 3), table(labels * 4)) == once


def test_a_filter_on_the_score_counts_once(make):
    model = quality.RuleModel(0.0, {(("capitals", True, 0.1),): 1.0, (("capitals", True, 0.2), ("digits", True, 0.1)): 1.0})
    df = quality.score(make([(1, "Ab")]), model).filter("predicted = 1").filter("doc_id > 0")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_count") <= 8 and "rand(" not in plan


# Neighbours
def test_repeated_ids_are_one_candidate_and_ask_once(spark):
    rows = [(1, [1.0, 0.0]), (1, [3.0, 0.0]), (2, [2.0, 0.0]), (3, [9.0, 9.0]), (3, [9.0, 9.0]), (4, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(df, df.filter("vec_id in (1, 4)"), k=10).collect())
    assert [(q, n, v) for q, n, v, _ in got] == [(1, 1, 4), (1, 2, 2), (1, 3, 3), (4, 1, 1), (4, 2, 2), (4, 3, 3)]
    assert got[0][3] == 0.5 and got[3][3] == 0.5


# What workers remember
def test_one_user_of_memory_at_a_time_and_long_words_are_not_kept():
    WORDS.of([b"short", b"l" * 65])
    assert b"short" in WORDS and b"l" * 65 not in WORDS
    told = []
    memory.holds(lambda: told.append(1))
    assert len(WORDS) == 0 and WORDS.of([b"short"]).size == 1 and told == [1]
