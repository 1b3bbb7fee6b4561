from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessellar.llm import packing, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
EDGES = ["", " ", "  \n\n x", "It's 'S we'll", "a<|endoftext|>b", "naïve ÉCOLE straße 12½ x²", "İstanbul ΣΑΣ ﬁ", "日本語 テスト", "\x1c\x85\xa0 x", "é combining", "\U0001f600!!", "x" * 50_000, "don't\tstop\r\nnow  "]


def ids(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(list(texts), add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
@pytest.mark.parametrize("path", [BYTE, WORD])
def test_any_text_encodes_as_the_library_does(path, text):
    tok = tokens.PreTokens.of(path)
    assert list(np.frombuffer(tok.encode(text, 1000), "<u4")) == ids(path, [text])[0]
    assert tok.count(text, {}, 1000) == len(ids(path, [text])[0])


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_texts_of_any_characters_use_both_tiers(make, path):
    texts = ["“It’s” — 日本語", "x<|endoftext|>“y” <|ENDOFTEXT|>", "a\u2003\u2003b ٣Ⅷ K", "<|endoftext|>"]
    tok = tokens.PreTokens(path)
    assert None not in map(tok.pieces, [*EDGES, *texts])
    for t in texts:
        assert sum(len(x) for x in tok.ids(tok.pieces(t))) == len(ids(path, [t])[0]) == tok.count(t, {}, 1000)
    assert {"“", "’", "日本語"} <= {p.strip() for p in tokens.frequent_pretokens(make(enumerate(texts)), path)}


def test_counts_of_edge_cases_and_repeated_rows(make):
    rows = [(k, t) for k, t in enumerate(EDGES)] + [(3, EDGES[3]), (None, "null id"), (99, None)]
    docs = make(rows).selectExpr("*", "1 AS n_tokens", "'x' AS id", "2 AS n_bytes")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs, BYTE, limit=5, cache=7, frequent=4).collect())
    want = sorted((k if k is not None else -1, len((t or "").encode()), n := len(ids(BYTE, [t or ""])[0]), n > 5) for k, t in rows)
    assert got == want


def test_empty_table(make):
    assert tokens.count_tokens(make([]), BYTE).collect() == []
    assert packing.pack(make([]), WORD).collect() == []


def test_a_full_cache_starts_anew():
    tok = tokens.PreTokens(BYTE)
    text = " ".join(f"word{k}" for k in range(300))
    assert tok.count(text, {}, 5) == len(ids(BYTE, [text])[0])
    assert len(tok.counts) <= 600


def check_packing(rows, got, room):
    want = set()
    for (k, _), x in zip(rows, ids(WORD, [t or "" for _, t in rows])):
        data = np.array([*x, 1], "<u4").tobytes()
        want |= {(k, n, at // 4, len(data[at : at + 4 * room]) // 4, zlib.crc32(data[at : at + 4 * room])) for n, at in enumerate(range(0, len(data), 4 * room))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    return len(bins)


def test_packing_places_every_piece_without_gaps(make, sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()] + [(10_000 + k, t) for k, t in enumerate(EDGES)] + [(20_000, None)]
    got = packing.pack(make(rows).withColumnRenamed("lang", "length"), WORD, room=512, salts=4).collect()
    n = check_packing(rows, got, 512)
    assert n <= 1.01 * -(-sum(r.length for r in got) // 512) + 1


def test_repeated_rows_and_null_ids_are_packed_each(make):
    got = packing.pack(make([(1, "same text")] * 5 + [(None, "no id")]), WORD, room=64).collect()
    assert len(got) == 6 and len({(r.sequence_id, r.offset) for r in got}) == 6


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=8), st.integers(1, 60))
def test_fullest_is_the_best_subset_sum(counts, room):
    found = packing.fullest(room, counts, sorted(counts, reverse=True))
    assert all(n <= counts[k] for k, n in found.items())
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * j for s in sums for j in range(n + 1)}
    assert sum(k * n for k, n in found.items()) == max(s for s in sums if s <= room)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_uses_every_piece_once(counts):
    left = dict(counts)
    for bin_, times in packing.plan(counts, 64):
        assert sum(k * n for k, n in bin_.items()) <= 64 and times > 0
        for k, n in bin_.items():
            left[k] -= n * times
    assert not any(left.values())
