"""Packing token sequences into fixed-length training sequences by minimum bin slack (operator 8).

Pieces of equal length are alike to a bin, so the packing is planned on the histogram of lengths, which has as many
entries as a sequence has tokens whatever the corpus. Each bin takes the longest length left and fills the rest by
subset sums over the available lengths, kept as the bits of one integer; the fullest combination is taken out as often
as the counts allow. Executors then give each piece its place by its rank among pieces of the same length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, stage_table, text_or_empty
from .tokens import PreTokens


def fullest(room: int, counts: dict[int, int], lengths: list[int]) -> dict[int, int]:
    """Lengths (each with its number) whose sum is the largest of at most `room`. lengths: the usable ones, falling."""
    reach, mask, trail = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        if length > room:
            continue
        trail.append((length, reach))
        n, step = min(counts[length], room // length), 1
        while n > 0:  # powers of two give every multiple up to n
            take = min(step, n)
            reach |= (reach << (length * take)) & mask
            n, step = n - take, step * 2
        if reach >> room & 1:
            break
    target, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(trail):
        n = 0
        while not before >> (target - n * length) & 1:
            n += 1
        if n:
            chosen[length] = n
            target -= n * length
    return chosen


def plan(counts: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Bins as (lengths in one bin, number of such bins). Every piece is placed; 0-length pieces don't occur."""
    left, out = {k: v for k, v in counts.items() if v}, []
    lengths = sorted(left, reverse=True)
    while lengths:
        first = lengths[0]
        left[first] -= 1
        usable = [x for x in lengths if left[x]]
        bin_ = fullest(room - first, left, usable)
        left[first] += 1
        bin_[first] = bin_.get(first, 0) + 1
        times = min(left[k] // n for k, n in bin_.items())
        out.append((bin_, times))
        for k, n in bin_.items():
            left[k] -= n * times
        lengths = [x for x in lengths if left[x]]
    return out


def slots(bins: list[tuple[dict[int, int], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, runs of ranks: (first rank, first sequence, pieces in a sequence, offset of the first of them)."""
    used, out, base = defaultdict(int), defaultdict(list), 0
    for bin_, times in bins:
        at = 0
        for length, n in sorted(bin_.items(), reverse=True):
            out[length].append((used[length], base, n, at))
            used[length] += n * times
            at += n * length
        base += times
    return dict(out)


def token_pieces(docs: DataFrame, vocab: str, room: int, end_id: int, id_col: str, text_col: str, cache: int) -> DataFrame:
    def step(batch: pa.RecordBatch) -> dict:
        tok, end = PreTokens.of(vocab), end_id.to_bytes(4, "little")
        out: dict[str, list] = {"id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for key, text in zip(ids, texts):
            data = tok.encode(text, cache) + end
            for k, at in enumerate(range(0, len(data), 4 * room)):
                part = data[at : at + 4 * room]
                for name, v in zip(out, (key, k, at // 4, len(part) // 4, zlib.crc32(part))):
                    out[name].append(v)
        return out

    kind = {"bigint": "long"}.get(k := docs.schema[id_col].dataType.simpleString(), k)
    return map_arrow(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), f"id {kind}, piece int, start long, length long, ids_crc32 long", step)


def pack(docs: DataFrame, vocab: str, *, room: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", cache: int = 400_000, salts: int = 256) -> DataFrame:
    """Pack all documents into as few sequences of at most `room` tokens as minimum bin slack finds.

    A document is its ids and then end_id; only longer ones are cut, into pieces of `room` tokens (the last may be
    shorter). Returns a row for each piece: the id, piece, start, length, ids_crc32, sequence_id, offset. A null or
    empty text is one piece of one token; repeated rows are packed each; a null id stays null; other columns are left
    out; an empty table gives no rows. Ranks of equal lengths are counted in `salts` parts, so one frequent length is
    spread over tasks.
    """
    pieces = stage_table(token_pieces(docs, vocab, room, end_id, id_col, text_col, cache).withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(salts)).cast("int")), "pieces")
    sizes = pieces.groupBy("length", "salt").count()
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # `room` rows at most
    runs = {k: (([x[0] for x in v]), v) for k, v in slots(plan(counts, room)).items()}
    table = docs.sparkSession.sparkContext.broadcast(runs)
    before = sizes.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("rank", rank).join(before, ["length", "salt"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batch: pa.RecordBatch) -> dict:
        seq, off = [], []
        for length, rank in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist()):
            firsts, found = table.value[length]
            first, base, n, at = found[bisect_right(firsts, rank) - 1]
            seq.append(base + (rank - first) // n)
            off.append(at + (rank - first) % n * length)
        return {name: batch.column(k) for k, name in enumerate(("id", "piece", "start", "length", "ids_crc32"))} | {"sequence_id": seq, "offset": off}

    kind = {"bigint": "long"}.get(k := docs.schema[id_col].dataType.simpleString(), k)
    return map_arrow(ranked, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", place).withColumnRenamed("id", id_col)
