"""Context-triggered piecewise hashing (operator 6), after the published spamsum scheme.

A hash of the last seven bytes rolls over the text; where it meets the block size's trigger value a chunk ends. Each
chunk adds one character to a signature, so an edit changes the characters near it and leaves the others. A fingerprint
is `block size:signature:signature at twice the block size`; two are compared by edit distance where a block size
is common to them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_arrow, stage_table, text_or_empty

LEAST_BLOCK, LENGTH, GRAM = 3, 64, 7
_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def rolling(data: bytes) -> np.ndarray:
    """For each byte, 32 bits that depend on it and the six bytes before it only."""
    padded = np.frombuffer(bytes(7) + data, np.uint8)
    window = np.lib.stride_tricks.as_strided(padded.view(), (len(data), 8), (1, 1))
    packed = np.ascontiguousarray(window).view("<u8")[:, 0] >> np.uint64(8)
    return (packed * _SPREAD >> np.uint64(32)).astype(np.uint32)


def _signature(data: bytes, ends: np.ndarray, most: int) -> str:
    cuts = [0, *(ends[: most - 1] + 1).tolist()]
    out = [_SIGNS[crc32(data[a:b]) & 63] for a, b in zip(cuts, cuts[1:])]
    if cuts[-1] < len(data):
        out.append(_SIGNS[crc32(data[cuts[-1] :]) & 63])
    return "".join(out)


def fingerprint(text: str) -> str:
    """Equal texts have equal fingerprints; the empty text has '3::'."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return f"{LEAST_BLOCK}::"
    roll, block = rolling(data), LEAST_BLOCK
    while block * LENGTH < len(data):
        block *= 2
    while True:
        ends = np.flatnonzero(roll % np.uint32(block) == block - 1)
        if block == LEAST_BLOCK or len(ends) >= LENGTH // 2:
            break
        block //= 2
    wider = ends[roll[ends] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{_signature(data, ends, LENGTH)}:{_signature(data, wider, LENGTH // 2)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by the bits of one integer."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = state = (1 << len(a)) - 1
    for c in b:
        hit = state & where.get(c, 0)
        state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


def _alike(a: str, b: str) -> float:
    """1 less the edit distance (insertions and deletions) as a part of both lengths; 0 without GRAM signs in a row that
    both have, as two texts that share nothing still have many single signs in common."""
    grams = {a[k : k + GRAM] for k in range(len(a) - GRAM + 1)}
    if not any(b[k : k + GRAM] in grams for k in range(len(b) - GRAM + 1)):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1. 1 for equal fingerprints, 0 where no block size, or no stretch of GRAM signs, is common to both."""
    if x == y:
        return 1.0
    (p, a, a2), (q, b, b2) = x.split(":"), y.split(":")
    if p == q:
        return max(_alike(a, b), _alike(a2, b2))
    return _alike(a, b2) if int(p) == 2 * int(q) else _alike(a2, b) if 2 * int(p) == int(q) else 0.0


_RESULT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(key: int | None, text: str, mark: str, after: str, after_mark: str) -> tuple:
    n = len(text)
    edited = text[: n - n // 2] + after[: n // 2]
    changed = fingerprint(edited)
    return key, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark, changed, likeness(mark, changed), likeness(mark, after_mark)


def compare_neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", task_bytes: int = 16_000_000) -> DataFrame:
    """Fingerprint every whole text and its edited text, and compare both neighbours of each edit.

    The edited text keeps the first ceil(n/2) code points and goes on with the first floor(n/2) (or all) of the next
    document in falling order of the id; after the last comes the first. Returns a row for each row of docs: the id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts count as empty; null
    ids come last in order; rows of one id follow each other by a hash of the text; a single row is its own next; other
    columns are left out.

    Rows go to ranges of about `task_bytes` by id and that hash, so a frequent id is spread too. Each range compares its
    rows in order and gives its first and last ones beside the results; the ranges' ends are then joined, last to first.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-total // task_bytes))
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text").asc(), F.col("n").asc()]
    laid = rows.withColumn("n", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "text")
    schema = f"{_RESULT}, part int, first boolean, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, last, part, none = arrow_schema(schema), None, TaskContext.get().partitionId(), (None,) * 3
        end = lambda key, text, mark, first: (key, None, None, mark, *none, part, first, text)

        def rows_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out) if out else [[]] * len(kinds), kinds)], schema=kinds)

        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                mark = fingerprint(text)
                out.append((*_compared(*last, text, mark), *none) if last else end(key, text, mark, True))
                last = (key, text, mark)
            yield rows_of(out)
        if last:
            yield rows_of([end(*last, False)])

    done = stage_table(laid.mapInArrow(run, schema), "fingerprints")
    ends = done.filter("part is not null").select("part", "first", "id", "text", "fingerprint")
    used = sorted(r.part for r in ends.filter("first").select("part").collect())  # one number for each range
    follow = spark.createDataFrame([(p, used[(k + 1) % len(used)]) for k, p in enumerate(used)], "part int, then int")
    tails = ends.filter("not first").select("part", "id", "text", "fingerprint").join(follow, "part")
    heads = ends.filter("first").select(F.col("part").alias("then"), F.col("text").alias("after"), F.col("fingerprint").alias("after_mark"))

    def close(batch: pa.RecordBatch) -> dict:
        out = [_compared(*r) for r in zip(*(c.to_pylist() for c in batch.columns))]
        return {f.name: [r[k] for r in out] for k, f in enumerate(arrow_schema(_RESULT))}

    closed = map_arrow(tails.join(heads, "then").select("id", "text", "fingerprint", "after", "after_mark"), _RESULT, close)
    return done.filter("part is null").select(*closed.columns).unionAll(closed).withColumnRenamed("id", id_col)
