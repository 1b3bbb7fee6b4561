"""Connected components of a distributed set of links, by union-find within tasks and min-label stars between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, stage_table

_EDGE = "u long, v long"


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a task's links: emits a link from each node to the smallest of its set. Bounded memory."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    def flush() -> pa.RecordBatch:
        pairs = [(x, find(x)) for x in parent]
        parent.clear()
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], schema=arrow_schema(_EDGE))

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(a), find(b)
            parent.setdefault(x, x), parent.setdefault(y, y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 2_000_000:
            yield flush()
    yield flush()


def components(links: DataFrame) -> DataFrame:
    """Columns id, component (the smallest id reachable) for every node of the links u, v that reaches a smaller one.

    Alternates large stars and small stars until nothing changes; each round is written to the shared folder. Nodes
    with very many links are aggregated before they are shuffled, and nothing is collected but a checksum.
    """
    edges = stage_table(links.select("u", "v").mapInArrow(_contract, _EDGE), "links")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("m", F.explode(F.array("u", "v")).alias("x")).select(F.col("x").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        edges = stage_table(small.mapInArrow(_contract, _EDGE).distinct(), "stars")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now
