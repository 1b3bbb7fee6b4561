"""Token counts by a two-tier lookup that never shuffles pre-tokens (operator 7), and the token ids that packing uses.

Tier one is a broadcast table of the corpus's most frequent pre-tokens and their token counts; its size is bounded by a
parameter. Tier two is a cache in each Python worker: a pre-token found in neither is encoded by the tokenizer once
and remembered. Both tiers hold what the tokenizer itself returned for the pre-token, so they never change a result.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import memory
from .common import arrow_schema, map_arrow, text_or_empty

# Classes of the characters below U+0130, fixed values of Unicode; those of others come from the library:
_LETTER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-į"
_NUMBER = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = r"\t-\r \x85\xa0"
_PLAIN = re.compile(r"[\x00-į]*")
# The split patterns of the two vocabularies (fixed values, from their files), with the classes spelt out:
_SPLITS = {
    "byte": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"),
    "word": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+"),
}


#: Longer pre-tokens are encoded anew each time, so that tables are bounded in bytes.
LONGEST = 64


class Cache(dict):
    """What a worker remembers: a full table becomes the old one, whose entries are taken over when they are met again."""

    old: dict = {}

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()


class PreTokens:
    """A tokenizer file with its worker cache. pieces() gives a text's pre-tokens, or None where only the library may split it.

    The split patterns ask only which class a character has. Characters from U+0130 on get theirs from the library, once
    each in a worker; a text with such is split as its copy in which each of them is a plain character of its class.
    """

    _loaded: dict[str, PreTokens] = {}
    _plain: dict[int, str] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        import json

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        as_they_are = self.special and not any(t[k] for t in spec["added_tokens"] for k in ("normalized", "single_word", "lstrip", "rstrip"))
        self.parts = re.compile(f"({'|'.join(map(re.escape, self.special))})").split if as_they_are else None
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = spec["pre_tokenizer"] or {}
        self.lower = steps == ["NFC", "Replace", "Lowercase"]
        if spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            self.split, self.find = _SPLITS["byte"].findall, _SPLITS["byte"].finditer
        elif self.lower and [p["type"] for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]:
            self.split, self.find = _SPLITS["word"].findall, _SPLITS["word"].finditer
        else:
            self.split = None  # an unknown kind: the library does all
        self.counts, self.packed = Cache(), Cache()

    @classmethod
    def of(cls, path: str) -> PreTokens:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def pieces(self, text: str) -> list[str] | None:
        if self.split is None:
            return None
        if any(s in text for s in self.special):  # the library takes what is between special strings by itself
            found = [[x] if x in self.special else self.pieces(x) for x in self.parts(text)] if self.parts else [None]
            return None if None in found else [p for x in found for p in x]
        if _PLAIN.fullmatch(text):
            return self.split(text.lower() if self.lower else text)
        if self.lower:
            text = self.tokenizer.normalizer.normalize_str(text)
            if text != self.tokenizer.normalizer.normalize_str(text):
                return None  # its pieces would not be encoded as they are
        return [text[m.start() : m.end()] for m in self.find(text.translate(self.classes(text)))]

    @classmethod
    def classes(cls, text: str) -> dict[int, str]:
        """For each character from U+0130 on, those of text among them, a plain one of the same class."""
        for c in set(_PLAIN.sub("", text)):
            if ord(c) not in cls._plain:
                cls._plain[ord(c)] = _class(c)
        return cls._plain

    def forget(self) -> None:
        self.counts, self.packed = Cache(), Cache()

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def add(self, table: Cache, found: list[str], make, most: int) -> None:
        """Encode the pre-tokens that table lacks. It holds `most` entries, and the old one as many; long ones are not kept."""
        new = [p for p in set(found) if p not in table and len(p) <= LONGEST]
        if len(table) + len(new) > most:
            table.turn()
            new = [p for p in set(found) if len(p) <= LONGEST]
        known = {p: table.old[p] for p in new if p in table.old}
        table.update(known)
        new = [p for p in new if p not in known]
        for p, ids in zip(new, self.ids(new)):
            table[p] = make(ids)

    def count(self, text: str, frequent: dict[str, int], most: int) -> int:
        found = self.pieces(text)
        if found is None:
            return len(self.ids([text])[0])
        memory.holds(self.forget)
        cache = self.counts
        try:
            return sum([frequent[p] if p in frequent else cache[p] for p in found])
        except KeyError:
            rare = [p for p in found if p not in frequent]
            self.add(cache, rare, len, most)
            return sum([frequent[p] if p in frequent else cache[p] if p in cache else len(self.ids([p])[0]) for p in found])

    def encode(self, text: str, most: int) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        found = self.pieces(text)
        if found is None:
            return _pack(self.ids([text])[0])
        memory.holds(self.forget)
        try:
            return b"".join(map(self.packed.__getitem__, found))
        except KeyError:
            self.add(self.packed, found, _pack, most)
            return b"".join([self.packed[p] if p in self.packed else _pack(self.ids([p])[0]) for p in found])


def _class(c: str) -> str:
    """A letter, number, other sign or space that stands for c: what the library's pattern joins c to."""
    from tokenizers.pre_tokenizers import ByteLevel

    joined = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    return next((x for x in "\xaa\xb2\xa7" if len(joined(x + c)) == 1), "\x85")


def _pack(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


def frequent_pretokens(docs: DataFrame, vocab: str, text_col: str = "text", size: int = 32_768, per_task: int = 4_096, tracked: int = 200_000) -> dict[str, int]:
    """Token counts of the corpus's most frequent pre-tokens, at most `size` of them.

    Every text is read; those that only the library may split (see pieces()) add nothing. Each task keeps a bounded summary (lossy counting over `tracked` entries) and hands on its
    `per_task` most frequent entries, so what is merged is bounded by the number of tasks and never holds occurrences.
    """

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, counts, floor = PreTokens.of(vocab), Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(tok.pieces(text) or ())
                while len(counts) > tracked:
                    floor += 1
                    counts = Counter({p: n for p, n in counts.items() if n > floor})
        best = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:per_task]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], schema=arrow_schema("piece string, n long"))

    best = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(summary, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(size)
    found = [r.piece for r in best.select("piece").collect()]  # `size` rows at most
    return dict(zip(found, map(len, PreTokens.of(vocab).ids(found)))) if found else {}


def count_tokens(docs: DataFrame, vocab: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, frequent: int = 32_768, cache: int = 200_000) -> DataFrame:
    """Tokens of every whole text, as the tokenizer file `vocab` counts them without added begin or end tokens.

    Returns a row for each row of docs: the id as it is (null too), n_bytes (UTF-8), n_tokens, over_limit
    (n_tokens > limit). Null and empty texts have 0 of both; repeated rows and ids each keep their row; other columns,
    whatever their names, are left out. Special strings inside a text count as the library's default has them.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_pretokens(docs, vocab, text_col, frequent))

    def step(batch: pa.RecordBatch) -> dict:
        tok, known = PreTokens.of(vocab), table.value
        return {"id": batch.column(0), "n_bytes": batch.column(2), "n_tokens": [tok.count(t, known, cache) for t in batch.column(1).to_pylist()]}

    kind = docs.schema[id_col].dataType.simpleString()
    kind = {"bigint": "long"}.get(kind, kind)
    text = text_or_empty(text_col)
    counted = map_arrow(docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")), f"id {kind}, n_bytes long, n_tokens long", step)
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
