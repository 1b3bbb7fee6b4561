"""Mixing, neighbours, line dedup, quality, fingerprints and WARC."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellar.llm import fingerprints, lines, mixing, neighbours, quality, warc


def levels():
    return {"lang": F.col("lang"), "source": F.col("source")}



# Mixing
def test_shortages_go_to_siblings_first(make):
    rows = [(k, "w " * 10, "en", "a", 0) for k in range(2)] + [(k + 10, "w " * 10, "en", "b", 0) for k in range(20)] + [(k + 100, "w " * 10, "fr", "c", 0) for k in range(20)]
    got = mixing.mix(make(rows), levels(), {}, fraction=0.5, epochs=1).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n")).collect()
    # 210 of 420 tokens: 105 each for en and fr; a can give only 20, so b takes the rest of en's
    assert {r.source: r.n for r in got} == {"a": 20, "b": 80, "c": 100}


def test_whole_epochs_and_weights(make):
    rows = [(k, "w " * 10, "en", "a", 0) for k in range(10)] + [(k + 10, "w " * 10, "fr", "b", 0) for k in range(90)]
    got = mixing.mix(make(rows), levels(), {("fr",): 0.0}, fraction=0.25, epochs=4)
    by = {r.doc_id: r.copies for r in got.collect()}
    assert sum(by[k] for k in range(10)) == 25 and set(by[k] for k in range(10)) == {2, 3} and not any(by[k] for k in range(10, 100))
    again = {r.doc_id: r.copies for r in mixing.mix(make(rows, parts=5), levels(), {("fr",): 0.0}, fraction=0.25, epochs=4).collect()}
    assert by == again
    other = {r.doc_id: r.copies for r in mixing.mix(make(rows), levels(), {("fr",): 0.0}, fraction=0.25, epochs=4, seed=18).collect()}
    assert by != other and sum(other.values()) == 25


def test_a_shut_branch_below_the_top_leaves_its_budget_to_others(make):
    rows = [(k, "w " * 10, "en", "a", 0) for k in range(10)] + [(k + 10, "w " * 10, "en", "b", 0) for k in range(20)] + [(k + 100, "w " * 10, "fr", "c", 0) for k in range(100)]
    got = mixing.mix(make(rows), levels(), {("en", "b"): 0.0, ("fr", "c", "none"): 0.0}, fraction=0.5, epochs=1).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n")).collect()
    # 650 of 1300 tokens: en has only the 100 of a to give, so fr takes the other 550
    assert {r.source: r.n for r in got} == {"a": 100, "b": 0, "c": 550}


def test_mixing_edge_cases(make):
    assert mixing.mix(make([]), levels(), {}).collect() == []
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5)]
    docs = make(rows).withColumn("copies", F.lit("old")).withColumn("_l0", F.lit(1)).withColumn("id", F.lit(2))
    got = mixing.mix(docs, levels(), {}, fraction=1.0, epochs=1)
    assert got.columns.count("copies") == 1 and got.count() == 5
    assert [r.copies for r in got.filter("doc_id = 3").collect()] == [1, 1]
    assert mixing.mixture(make(rows), levels(), {}, fraction=1.0, epochs=1).columns == make(rows).columns


# Neighbours
def exact(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        n = np.lexsort((ids, d))[:k]
        out[q] = [(int(ids[j]), float(d[j])) for j in n if np.isfinite(d[j])]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(k, (centres[k % 12] + 0.4 * rng.normal(size=16)).tolist()) for k in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = found(neighbours.nearest(df, df.filter("vec_id % 50 = 0"), leaf_rows=50, block=300)), exact(rows, range(0, 3000, 50), 10)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    assert all(abs(s - dict(want[q]).get(i, s)) < 1e-12 for q in got for i, s in got[q])


def test_neighbours_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("leaf", F.lit("x")).withColumn("id", F.lit(1))
    got = found(neighbours.nearest(df, df, k=10))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [1, 2, 3], 1: [0, 2, 3], 2: [0, 1, 3], 3: [0, 1, 2]}
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert neighbours.nearest(none, none).collect() == [] and neighbours.nearest(df, none).collect() == []


def test_one_vector_in_a_third_of_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [1.0, 2.0, 3.0] if k % 3 == 0 else rng.normal(size=3).tolist()) for k in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got, want = found(neighbours.nearest(df, df.filter("vec_id % 30 = 0"), leaf_rows=40, block=64)), exact(rows, range(0, 900, 30), 10)
    assert got == want  # every query has its ten nearest among the equal vectors, by id


# Lines
def brute_lines(rows, threshold):
    sites = {}
    for _, t, _, s, _ in rows:
        for x in (t or "").split("\n"):
            sites.setdefault(x.strip(" "), set()).add(s)
    return {k: None if t is None else "\n".join(x for x in t.split("\n") if not x.strip(" ") or len(sites[x.strip(" ")]) < threshold) for k, t, *_ in rows}


@pytest.mark.parametrize("threshold", [2, 3, 12])
def test_lines_equal_exact_counts(make, threshold):
    rng = random.Random(threshold)
    common = [f"line {k}" for k in range(40)]
    rows = [(k, "\n".join(rng.choice(common[: rng.randrange(1, 40)]) if rng.random() < 0.6 else f"own {k} {j}" for j in range(rng.randrange(8))), "en", f"s{rng.randrange(25)}" if k % 30 else None, 0) for k in range(400)]
    got = lines.drop_boilerplate(make(rows), threshold=threshold)
    assert {r.doc_id: r.text for r in got.collect()} == brute_lines(rows, threshold)


def test_line_edge_cases(make):
    rows = [(1, None, "en", "a", 3), (2, "", "en", "a", 0), (3, "x\n\n x ", "en", "a", 9), (4, "x", "en", "b", 1), (4, "x", "en", "b", 1), (5, "x\ny", "en", None, 3), (None, "keep\nx", "en", "c", 6), (6, "z" * 20_000 + "\nx", "en", "d", 0)]
    docs = make(rows).withColumn("n_lines", F.lit("old")).withColumn("bad", F.lit(1)).withColumn("a", F.lit(2))
    got = lines.drop_boilerplate(docs, threshold=3)
    by = {(r.doc_id, r.text, r.n_chars, r.n_removed) for r in got.collect()}
    assert by == {(1, None, 0, 0), (2, "", 0, 0), (3, "", 0, 2), (4, "", 0, 1), (5, "y", 1, 1), (None, "keep", 4, 1), (6, "z" * 20_000, 20_000, 1)} and got.count() == 8
    assert got.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    assert lines.drop_boilerplate(make([])).collect() == []


# Quality
def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, quality.train(docs, labels)).withColumn("held_out", quality.held_out("doc_id"))
    assert scored.count() == docs.count() and scored.filter("score is null or score < 0 or score > 1").count() == 0
    rows = scored.join(labels, "doc_id").filter("held_out").select("quality", "predicted").collect()
    assert sum(r.quality == r.predicted for r in rows) / len(rows) > 0.95


def test_quality_edge_cases(make, spark):
    docs = make([(1, None), (2, ""), (3, "some words"), (None, "x"), (3, "some words"), (4, "!" * 30_000)]).withColumn("f_chars", F.lit(1)).withColumn("score", F.lit("old")).withColumn("y", F.lit(0))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.train(docs, none))
    assert got.count() == 6 and {r.score for r in got.collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(r.predicted == 1 for r in quality.score(docs, quality.train(docs, one)).collect())
    assert quality.score(make([]), quality.RuleModel(0.0, {})).collect() == []


def test_rules_as_columns_equal_rules_in_numpy(make):
    rng = np.random.default_rng(0)
    x, names = rng.normal(size=(500, len(quality.RATIOS))), list(quality.RATIOS)
    y = ((x[:, 0] > 0) & (x[:, 3] <= 0.5)).astype(float)
    model = quality.fit(x, y, names)
    z = model.base + sum(w * np.all([x[:, names.index(f)] > t if above else x[:, names.index(f)] <= t for f, above, t in rule], axis=0) for rule, w in model.weights.items())
    assert (((z > 0) == (y > 0)).mean()) > 0.97 and len(model.weights) < 60
    spark = make([]).sparkSession
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], ", ".join(f"f_{n} double" for n in names))
    assert np.allclose([r[0] for r in df.select(model.column()).collect()], 1 / (1 + np.exp(-z[:50])))


# Fingerprints
def test_fingerprints_of_neighbours(make, sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()][:120] + [(5000, ""), (5001, None), (5002, "é" * 9000)]
    got = {r.doc_id: r for r in fingerprints.compare_neighbours(make(rows, parts=5).withColumnRenamed("lang", "bucket")).collect()}
    order = sorted(rows, reverse=True)
    for n, (k, t) in enumerate(order):
        t, after = t or "", order[(n + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = map(fingerprints.fingerprint, (t, edited, after))
        r = got[k]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint, r.edited_sha256) == (len(t), a, b, hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(a, b), fingerprints.likeness(a, c))


def test_fingerprint_properties():
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(2000))
    a, b, other = fingerprints.fingerprint(text), fingerprints.fingerprint("new start " + text), fingerprints.fingerprint(" ".join(f"v{rng.randrange(500)}" for _ in range(2000)))
    assert fingerprints.likeness(a, a) == 1.0 and fingerprints.likeness(a, b) > 0.8 > 0.5 > fingerprints.likeness(a, other)
    assert fingerprints.likeness(a, b) == fingerprints.likeness(b, a) and fingerprints.fingerprint("") == "3::"
    data = text.encode()
    r = fingerprints.rolling(data)
    assert (fingerprints.rolling(data[100:])[7:] == r[107:]).all()  # it depends on the last seven bytes only


def test_fingerprint_edge_cases(make):
    assert fingerprints.compare_neighbours(make([])).collect() == []
    (one,) = fingerprints.compare_neighbours(make([(1, "alone here")])).collect()
    assert one.near_next == 1.0
    got = fingerprints.compare_neighbours(make([(1, "b"), (1, "a"), (None, "z"), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 0), (0, 1), (1, 1), (1, 1)]


# WARC
PAGES = "page_id long, url string, html string, length string"


def test_archives_round_trip(spark):
    rng = random.Random(1)
    bodies = [f"<html>{'é' * k} {k}</html>" for k in range(30)]
    rows = [(k, f"http://h{rng.randrange(5)}.Example.com:80/p/{rng.randrange(40)}?q={k % 7} x#f", rng.choice(bodies), "x") for k in range(300)] + [(900, None, None, None), (901, "", "", None), (902, "http://[bad", bodies[0], None), (903, "mailto:é b", "big" * 50_000, None)]
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    archive = warc.write_archive(pages, block_lines=16)
    got = {r.page_id: r for r in warc.lookup(archive, pages).collect()}
    first = {}
    for k, _, body, _ in sorted(rows, key=lambda r: r[0]):
        first.setdefault((body or "").encode(), k)
    assert len(got) == len(rows)
    for k, _, body, _ in rows:
        data, r = (body or "").encode(), got[k]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[data] == k else ("revisit", first[data]))
        assert bytes(r.payload) == (data if first[data] == k else b"")
    assert archive.directory.count() >= 300 // 16


def test_least_size_nulls_and_empty_archives(spark):
    rows = [(1, "http://a/", "tiny", ""), (2, "http://a/", "tiny", ""), (None, "http://b/", "a longer payload", ""), (3, "http://b/", "a longer payload", ""), (3, "http://b/", "a longer payload", "")]
    pages = spark.createDataFrame(rows, PAGES)
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.lookup(warc.write_archive(pages, least=10), pages).collect())
    assert got == [(0, "revisit", 3), (1, "response", None), (2, "response", None), (3, "response", None), (3, "response", None)]
    none = spark.createDataFrame([], PAGES)
    assert warc.lookup(warc.write_archive(none), pages).collect() == []
    assert warc.lookup(warc.write_archive(pages), spark.createDataFrame([(77, "http://zz/", "", "")], PAGES)).collect() == []


def test_surt_keys():
    assert warc.surt("http://A.example.COM/x?y=1#z") == "com,example,a)/x?y=1" and warc.surt("https://b.org") == "org,b)/" and warc.surt(None) == "-"


def test_damage_is_noticed():
    data = warc.record(1, "http://a/", b"payload", warc.digest32(b"other"), None, None, "2024-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        warc.parse(data)
