from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from tessellar.llm import lines, mixing, near_dups, packing, quality, settings
from tests.llm.test_near_dups import brute as brute_near
from tests.llm.test_other_operators import brute_lines

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        after = {r.doc_id: r for r in docs.collect()}
        seen.append(name)
        assert set(after) <= set(before)
        if name != "packing":
            assert docs.columns == columns
        if name == "quality":
            wrong = [k for k, q in labels.items() if k in before and (k in after) != (q == 1)]
            assert len(wrong) <= 0.03 * len(labels) and len(after) < len(before)
        if name == "line_dedup":
            assert {k: r.text for k, r in after.items()} == brute_lines([tuple(r) for r in before.values()], settings.BOILERPLATE_SITES)
            assert all(r.n_chars == len(r.text) for r in after.values())
        if name == "near_dedup":
            assert set(after) == {k for k, _, _, kept in brute_near([(r.doc_id, r.text) for r in before.values()], 5) if kept}
        if name == "mixing":
            total = lambda rows: sum(len(r.text.split()) for r in rows)
            assert 0.6 * total(before.values()) < total(after.values()) <= 0.8 * total(before.values())
        if name == "packing":
            assert set(after) == set(before)
            use = docs.groupBy("sequence_id").agg(F.sum("length").alias("n"))
            assert use.agg(F.max("n")).first()[0] <= 4096
    assert seen == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0


def test_every_stage_calls_an_operator():
    assert all(hasattr(m, n) for m, n in ((quality, "train"), (lines, "drop_boilerplate"), (near_dups, "keep_first"), (mixing, "mixture"), (packing, "pack")))


# Edges, as the stages' docstrings state them
EXTRAS = ["Score", "predicted", "n_lines", "n_removed", "copies", "N_TOKENS", "_copy", "kept", "component_id", "id", "piece"]
EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRAS)


def edges():
    good = lambda k: " ".join(f"Word{k}x{j} reads as well as any other plain one." for j in range(20))
    rows = [(k, good(k) + f" Number {k} ends here.", "en", f"s{k % 4}") for k in range(1, 9)]
    rows += [(20, "Shared line.\n" + good(20), "en", "s0"), (21, "Shared line.\n" + good(33), "en", "s1"), (22, "Shared line.\n" + good(47), None, None)]
    rows += [(30, good(60), "en", "s1"), (31, good(60), "en", "s2"), (32, good(60), "en", "s2"), (32, good(60), "en", "s2")]  # copies and a repeated row
    rows += [(40, None, None, None), (41, "", "en", "s3"), (None, good(80), "en", "s1"), (None, None, None, None), (50, " ".join(f"long{j % 6000} text" for j in range(30_000)), "en", "s0")]
    return [(*r, len(r[1] or ""), *(f"{c}-{r[0]}" for c in EXTRAS)) for r in rows]


def edge_folder(spark, folder, rows, labelled):
    spark.createDataFrame(rows, EDGE_SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labelled, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_every_stage_on_nulls_repeats_long_texts_and_clashing_names(spark, tmp_path):
    rows = edges()
    folder = edge_folder(spark, tmp_path, rows, [(1, 1), (None, 0), (2, None), (999, 0)])
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, folder).cache()
        seen[name] = [r.asDict() for r in docs.collect()]
        if name != "packing":
            assert docs.schema.simpleString() == before.schema.simpleString()
            assert all(r[c] == f"{c}-{r['doc_id']}" for r in seen[name] for c in EXTRAS)  # nobody's values are replaced
    assert len(seen["quality"]) == len(rows)  # labels of one kind only, or of no use, reject nothing
    by_line = {r["doc_id"]: r for r in seen["line_dedup"]}
    assert len(seen["line_dedup"]) == len(rows) and by_line[40]["text"] is None and by_line[40]["n_chars"] == 0 and by_line[41]["text"] == ""
    assert not any("Shared line." in (r["text"] or "") for r in seen["line_dedup"]) and len(by_line[50]["text"]) == len(rows[-1][1])
    ids = sorted([r["doc_id"] for r in seen["near_dedup"]], key=str)
    texts = [(r["doc_id"], r["text"]) for r in seen["line_dedup"] if r["doc_id"] is not None]
    first = {k for k, _, _, kept in brute_near(sorted(set(texts), key=str), 5) if kept}
    assert ids == sorted([r["doc_id"] for r in seen["line_dedup"] if r["doc_id"] is None or r["doc_id"] in first], key=str)
    assert {30, 40, 41, 50, None} <= set(ids) and not {31, 32} & set(ids) and ids.count(None) == 2
    taken = seen["mixing"]
    words = lambda found: sum(len((r["text"] or "").split()) for r in found)
    assert 0 < len(taken) <= len(ids) and words(taken) <= 0.8 * words(seen["near_dedup"])
    pieces = seen["packing"]
    assert sorted({str(p["doc_id"]) for p in pieces}) == sorted({str(r["doc_id"]) for r in taken})
    assert len([p for p in pieces if p["piece"] == 0]) == len(taken) and all(0 < p["length"] <= 4096 for p in pieces)
    places: dict[int, list] = {}
    for p in pieces:
        places.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for held in places.values():  # without gaps, within a sequence
        held.sort()
        assert [a for a, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 4096


def test_run_on_empty_tables(spark, tmp_path):
    folder = edge_folder(spark, tmp_path, [], [])
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() == 0
