"""Removal of passages that an earlier document has already (operator 1), by repeated-phrase automata.

1. Each text names the phrases that anchor its windows: of the phrases of a window the one with the least hash, so equal
   windows have equal anchors. Neighbouring windows with one anchor form a span.
2. Anchors are aggregated over the corpus. Spans whose anchor recurs, and where contexts differ their single windows,
   are aggregated to the smallest document that has them: this confirms the recurring passages and where each is first.
3. What recurs of a first document is cut from it once, as its longest passages, and a hash of that document says which
   shard they belong to. The anchoring phrases of a shard's passages are compiled into one Aho-Corasick automaton over
   words. Documents stream through the shards of the documents they repeat: the automaton locates every occurrence of a
   phrase, and where the words around it go on as in an earlier document's passage for a whole window, they go.

Only hashes, places and the passages that recur are shuffled, and of the texts those that may hold one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_arrow, stage_table, text_or_empty
from .hashing import WORDS, Spans, signed

PHRASE = 16


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def anchor_places(g: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """Where the anchor of each window starts; g: the hashes of a text's phrases."""
    found = np.lib.stride_tricks.sliding_window_view(g, window - phrase + 1).argmin(1)
    return found + np.arange(len(found))


def anchors(hashes: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor of a text: its hash, the hash of its span, and the first and last window start it stands for."""
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return none.view(np.uint64), none.view(np.uint64), none, none
    spans, at = Spans(hashes), np.arange(len(hashes) - phrase + 1)
    g = spans.hash(at, at + phrase)
    place = anchor_places(g, window, phrase)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(place) - 1]])
    return g[place[first]], spans.hash(first, last + window), first, last


def _scan(docs: DataFrame, window: int) -> DataFrame:
    def step(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in ("n_words", "sha", "g", "s", "lo", "hi")}
        for data in batch.column(2).to_pylist():
            words = data.split()  # bytes: ASCII white space only
            g, s, lo, hi = anchors(WORDS.of(words), window, min(PHRASE, window))
            for name, v in zip(out, (len(words), _digest(words), signed(g), signed(s), lo.astype(np.int32), hi.astype(np.int32))):
                out[name].append(v)
        return {"id": batch.column(0), "unknown": batch.column(3), "u": batch.column(1)} | out

    return map_arrow(docs.select("id", "u", "text", "unknown"), "id long, unknown boolean, u long, n_words long, sha string, g array<long>, s array<long>, lo array<int>, hi array<int>", step)


def _window_rows(texts: DataFrame, window: int) -> DataFrame:
    """A row for each window that the listed anchors (g, lo, hi) of a text stand for: g, its hash w, its start p."""
    schema = "id long, u long, g long, w long, p int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            found = batch.column(3)
            cuts, each = found.offsets.to_pylist(), {name: found.values.field(name).to_numpy() for name in ("g", "lo", "hi")}
            for key, u, data, start, end in zip(*(c.to_pylist() for c in batch.columns[:3]), cuts, cuts[1:]):
                lo, n = each["lo"][start:end], each["hi"][start:end] - each["lo"][start:end] + 1
                total, before = int(n.sum()), np.cumsum(n) - n
                p = np.repeat(lo - before, n) + np.arange(total)
                spans = Spans(WORDS.of(data.split()))
                parts.append((np.full(total, key), np.full(total, u), np.repeat(each["g"][start:end], n), signed(spans.hash(p, p + window)), p.astype(np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], schema=arrow_schema(schema))

    return texts.mapInArrow(run, schema)


def _runs(spots: DataFrame, window: int) -> DataFrame:
    """Merge windows [lo, hi] of a document that lie in its source at src_lo and on without a gap: at and n count words."""
    schema = "id long, u long, src long, su long, at int, src_at int, n int"

    def step(batch: pa.RecordBatch) -> dict:
        found = batch.column(2)
        row = np.repeat(np.arange(batch.num_rows), np.diff(found.offsets.to_numpy()))
        held = found.flatten()
        src, su, lo, hi, src_lo = (held.field(name).to_numpy().astype(np.int64) for name in ("src", "su", "lo", "hi", "src_lo"))
        shift = src_lo - lo
        order = np.lexsort((lo, shift, su, src, row))
        row, src, su, shift, lo, hi = (v[order] for v in (row, src, su, shift, lo, hi))
        other = np.ones(len(row), bool)  # a row that begins another document, source or shift
        if len(row):
            other[1:] = (row[1:] != row[:-1]) | (src[1:] != src[:-1]) | (su[1:] != su[:-1]) | (shift[1:] != shift[:-1])
        # The furthest window so far of each such group: numbers of groups, above all windows, keep them apart.
        group = np.cumsum(other) << np.int64(32)
        furthest = np.maximum.accumulate(group + hi) - group if len(row) else hi
        new = other.copy()
        new[1:] |= lo[1:] > furthest[:-1] + 1
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(row))[: len(starts)] - 1
        row, lo = row[starts], lo[starts]
        n = furthest[ends] - lo + window
        key, u = (batch.column(k).to_numpy()[row] for k in (0, 1))
        return dict(zip(names, (key, u, src[starts], su[starts], lo.astype(np.int32), (lo + shift[starts]).astype(np.int32), n.astype(np.int32))))

    names = [part.split()[0] for part in schema.split(", ")]
    return map_arrow(spots.groupBy("id", "u").agg(F.collect_list(F.struct("lo", "hi", "src", "su", "src_lo")).alias("found")), schema, step)


class Shard:
    """The passages of some documents, and an automaton over their anchoring phrases. Its letters are words: each word of
    the passages has a number, all other words are 0.

    A window holds window - phrase words around its phrase, so at least half of them on one side. Contexts of a phrase
    are found by that half, before it or after it, so a phrase that stands in very many contexts costs no more.
    """

    def __init__(self, window: int, phrase: int):
        self.window, self.phrase, self.around, self.half = window, phrase, window - phrase, (window - phrase + 1) // 2
        self.letters: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        self.passages: list[bytes] = []  # as letters of four bytes
        # phrase -> {(side, half) -> {(words before, context): (first document, its passage, where the phrase is in it)}}
        self.known: dict[tuple, dict] = {}

    def add(self, first: int, passage: bytes) -> None:
        words = passage.split(b" ")
        letters = np.array([self.letters.setdefault(w, len(self.letters) + 1) for w in words], np.int32)
        self.passages.append(letters.tobytes())
        spans, at = Spans(WORDS.of(words)), np.arange(len(words) - self.phrase + 1)
        for p in np.unique(anchor_places(spans.hash(at, at + self.phrase), self.window, self.phrase)).tolist():
            end, start = p + self.phrase, max(0, p - self.around)
            sides = self.known.setdefault(tuple(letters[p:end].tolist()), {})
            context = (p - start, letters[start : end + self.around].tobytes())
            for side, part in ((0, letters[max(0, p - self.half) : p]), (1, letters[end : end + self.half])):
                if len(part) == self.half:
                    held = sides.setdefault((side, part.tobytes()), {})
                    held[context] = min((first, len(self.passages) - 1, p), held.get(context, (first, len(self.passages), 0)))

    def make(self) -> None:
        for phrase, sides in self.known.items():
            self.automaton.add_word(phrase, sides)
        if self.known:
            self.automaton.make_automaton()

    def locate(self, key: int, words: list[bytes]) -> bytearray:
        """A 1 for each word that a passage of an earlier document covers."""
        gone = bytearray(len(words))
        if not self.known:
            return gone
        row = tuple(map(self.letters.get, words, repeat(0)))
        letters = np.array(row, np.int32)
        data, half, phrase, around, tried = letters.tobytes(), 4 * self.half, self.phrase, self.around, set()
        for last, sides in self.automaton.iter(row):
            p = last + 1 - phrase
            if gone.find(0, max(0, p - around), last + 1 + around) < 0:
                continue  # all that a window here could cover is gone already
            at, end = 4 * p, 4 * (last + 1)
            for side, part in ((0, data[at - half : at] if at >= half else None), (1, data[end : end + half])):
                for (before, context), (first, which, place) in sides.get((side, part), {}).items():
                    if first >= key:
                        continue
                    whole = (which, p - place)
                    if whole not in tried:  # a copy of the whole passage is covered at once
                        tried.add(whole)
                        if p >= place and data.startswith(self.passages[which], 4 * (p - place)):
                            n = len(self.passages[which]) // 4
                            gone[p - place : p - place + n] = b"\x01" * n
                            continue
                    self._cover(gone, letters, data, p, before, context)
        return gone

    def _cover(self, gone: bytearray, letters: np.ndarray, data: bytes, p: int, before: int, context: bytes) -> None:
        start, n = p - before, len(context) // 4
        if start >= 0 and data[4 * start : 4 * (start + n)] == context:
            lo, hi = start, start + n
        else:
            theirs, end = np.frombuffer(context, np.int32), p + self.phrase
            ours, left = letters[max(0, start) : p][::-1], theirs[:before][::-1]
            lo = p - _same(ours, left)
            hi = end + _same(letters[end : start + n], theirs[before + self.phrase :])
        if hi - lo >= self.window:
            gone[lo:hi] = b"\x01" * (hi - lo)


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """How many letters agree from the start; the letter 0 agrees with none, as it is in no passage."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def remove_repeats(docs: DataFrame, *, window: int = 50, id_col: str = "doc_id", text_col: str = "text", shard: int = 500_000) -> DataFrame:
    """Find every word covered by a window of `window` words that also starts in a document with a smaller id.

    Returns a row for each row of docs: the id, n_words, n_removed, kept_sha256 (of the kept words, joined by spaces).
    Windows are judged on the input. Null and empty texts have no words; texts of fewer words than a window keep all;
    a null id counts as the largest there is (2**63 - 1) and comes back as null; rows of one id never remove from each
    other; repeats within one text stay; repeated rows get equal results; other columns are left out; an empty table
    gives no rows. `shard` is how many bytes of passages an automaton is compiled from.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("id"), F.col(id_col).isNull().alias("unknown"), F.xxhash64(text).alias("u"), text.cast("binary").alias("text"))
    scan = stage_table(_scan(rows, window), "anchors")
    each = scan.select("id", "u", F.explode(F.arrays_zip("g", "s", "lo", "hi")).alias("a")).select("id", "u", "a.g", "a.s", "a.lo", "a.hi")
    # Aggregates are written before they are joined: then both sides of a join have plain exchanges, and the rows of a
    # very frequent anchor can be split over tasks.
    recurring = stage_table(each.groupBy("g").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("g"), "recurring")
    met = stage_table(each.join(recurring, "g"), "recurring-anchors")

    contexts = stage_table(met.groupBy("g").agg(F.min("s").alias("s1"), F.max("s").alias("s2"), F.min(F.struct("id", "u", "lo")).alias("src")), "contexts")
    marked = met.join(contexts, "g")
    alike = marked.filter("s1 = s2 and id > src.id").select("id", "u", "lo", "hi", F.col("src.id").alias("src"), F.col("src.u").alias("su"), F.col("src.lo").alias("src_lo"))
    mixed = marked.filter("s1 != s2").groupBy("id", "u").agg(F.collect_list(F.struct("g", "lo", "hi")).alias("found"))
    texts = stage_table(rows.drop("unknown").join(_fits(stage_table(met.select("id", "u").distinct(), "candidates")), ["id", "u"], "left_semi").dropDuplicates(["id", "u"]), "candidate-texts")
    windows = stage_table(_window_rows(texts.join(mixed, ["id", "u"]).select("id", "u", "text", "found"), window), "windows")
    firsts = stage_table(windows.groupBy("g", "w").agg(F.min(F.struct("id", "u", "p")).alias("src"), F.max("id").alias("b")).filter("src.id < b"), "first-windows")
    single = windows.join(firsts, ["g", "w"]).filter("id > src.id").select("id", "u", F.col("p").alias("lo"), F.col("p").alias("hi"), F.col("src.id").alias("src"), F.col("src.u").alias("su"), F.col("src.p").alias("src_lo"))
    runs = stage_table(_runs(alike.unionAll(single), window), "runs")

    wanted = runs.select("src", "su", "src_at", "n").distinct().groupBy("src", "su", F.pmod(F.xxhash64("src_at", "n"), F.lit(16)).alias("salt")).agg(F.sort_array(F.collect_list(F.struct("src_at", "n"))).alias("found"))
    sources = _fits(stage_table(wanted.withColumnsRenamed({"src": "id", "su": "u"}).drop("salt"), "wanted"), lambda n: n + F.size("found")).join(texts, ["id", "u"]).select("id", "u", "text", "found")

    def cut(batch: pa.RecordBatch) -> dict:
        """The longest passages: what recurs, joined where windows overlap."""
        out: dict[str, list] = {"src": [], "su": [], "passage": []}
        for key, u, data, found in zip(*(c.to_pylist() for c in batch.columns)):
            words, ends = data.split(), []
            for r in found:
                start, end = r["src_at"], r["src_at"] + r["n"]
                if ends and start + window <= ends[-1][1] + 1:
                    ends[-1][1] = max(ends[-1][1], end)
                else:
                    ends.append([start, end])
            for start, end in ends:
                for name, v in zip(out, (key, u, b" ".join(words[start:end]))):
                    out[name].append(v)
        return out

    passages = stage_table(map_arrow(sources, "src long, su long, passage binary", cut), "passages")
    located = _locate(passages, runs.select("id", "u", "src", "su"), texts, window, shard)
    single = located.filter("gone is null").select("id", "u", "n_removed", "sha2")
    several = located.filter("gone is not null").select("id", "u", "gone")
    several = several.groupBy("id", "u").agg(F.collect_list("gone").alias("gone"))
    several = stage_table(several, "several-shards")
    rest = texts.join(_fits(several.select("id", "u")), ["id", "u"], "left_semi").join(several, ["id", "u"]).select("id", "u", "text", "gone")

    def drop(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"id": batch.column(0), "u": batch.column(1), "n_removed": [], "sha2": []}
        for data, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            words, gone = data.split(), np.frombuffer(found[0], np.uint8).copy()
            for more in found[1:]:
                gone |= np.frombuffer(more, np.uint8)
            gone = np.unpackbits(gone)[: len(words)]
            out["n_removed"].append(int(gone.sum()))
            out["sha2"].append(_digest([w for w, x in zip(words, gone.tolist()) if not x]))
        return out

    dropped = single.unionAll(map_arrow(rest, "id long, u long, n_removed long, sha2 string", drop))
    out = scan.select("id", "unknown", "u", "n_words", "sha").join(dropped, ["id", "u"], "left")
    return out.select(F.when(~F.col("unknown"), F.col("id")).alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("sha2", "sha").alias("kept_sha256"))


def _locate(passages: DataFrame, repeats: DataFrame, texts: DataFrame, window: int, shard: int, stream: int = 32_000_000) -> DataFrame:
    """What the passages (src, su, passage) cover in the documents that repeat their sources (id, u, src, su).

    Gives id, u, n_removed, sha2 for a document that has one shard, and gone (a bit for each word) where it has several,
    of which other rows tell more. A shard has about `shard` bytes of passages, or those of one document. The documents
    of a shard that many have are spread over streams of about `stream` bytes, each of which compiles the shard's
    automaton anew. A stream holds one automaton and one batch of documents.
    """
    total = passages.agg(F.sum(F.octet_length("passage"))).first()[0] or 0
    of = F.pmod(F.xxhash64("src", "su"), F.lit(max(1, -(-total // shard)))).alias("shard")
    routes = stage_table(repeats.select("id", "u", of).distinct().groupBy("id", "u").agg(F.collect_list("shard").alias("shards")), "routes")
    routed = _fits(routes, lambda n: n + F.size("shards")).join(texts, ["id", "u"])
    spread = routed.select(F.explode("shards").alias("shard"), F.octet_length("text").alias("size")).groupBy("shard").agg(F.ceil(F.sum("size") / stream).cast("int").alias("streams"))
    spread = _fits(stage_table(spread, "streams"))
    lines = routed.select("id", "u", "text", (F.size("shards") == 1).alias("alone"), F.explode("shards").alias("shard")).join(spread, "shard")
    lines = lines.select("shard", F.pmod(F.xxhash64("id", "u"), F.col("streams")).cast("int").alias("stream"), F.when(F.col("alone"), 1).otherwise(2).alias("kind"), "id", "u", F.col("text").alias("data"))
    own = passages.select("src", "passage", of).join(spread, "shard")
    own = own.select("shard", F.explode(F.sequence(F.lit(0), F.col("streams") - 1)).alias("stream"), F.lit(0).alias("kind"), F.col("src").alias("id"), F.lit(0).cast("long").alias("u"), F.col("passage").alias("data"))
    laid = own.unionByName(lines).repartition("shard", "stream").sortWithinPartitions("shard", "stream", "kind")
    schema = "id long, u long, n_removed long, sha2 string, gone binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, machine, made, kinds = None, None, False, arrow_schema(schema)
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in kinds}
            for which, stream_, kind, key, u, data in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (which, stream_):
                    at, machine, made = (which, stream_), Shard(window, min(PHRASE, window)), False
                if kind == 0:
                    machine.add(key, data)
                    continue
                if not made:
                    machine.make()
                    made = True
                words = data.split()
                gone = machine.locate(key, words)
                if kind == 2:
                    row = (key, u, None, None, np.packbits(np.frombuffer(gone, np.uint8)).tobytes())
                else:
                    row = (key, u, gone.count(1), _digest([w for w, x in zip(words, gone) if not x]), None)
                for name, v in zip(out, row):
                    out[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kinds], schema=kinds)

    return stage_table(laid.mapInArrow(run, schema), "located")


def _fits(rows: DataFrame, numbers: Callable[[int], Column | int] = lambda n: n) -> DataFrame:
    """Written rows, for a broadcast join where they have at most a million numbers; any number can be joined."""
    return F.broadcast(rows) if (rows.agg(F.sum(F.lit(0) + numbers(1))).first()[0] or 0) <= 1_000_000 else rows
