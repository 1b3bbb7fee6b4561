"""Nearest neighbours by a hierarchical k-means tree with best-bin-first search (operator 3).

The tree is fitted on a bounded sample and has a bounded number of leaves; every row of the table goes to a leaf. A
query visits leaves in the order a priority queue gives; how many is calibrated against exact neighbours of sample
queries, and a query goes on until it has enough candidates. Leaves are searched in bounded blocks.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, map_arrow, stage_table


@dataclass(frozen=True)
class Tree:
    """Node 0 is the root. children[i] is empty for a leaf, whose number is leaf[i]; centres has a row for each node."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by the nearest child from the root down."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not len(kids):
                out[rows] = self.leaf[node]
            elif len(rows):
                near = _squared(x[rows], self.centres[kids]).argmin(1)
                todo += [(int(kid), rows[near == k]) for k, kid in enumerate(kids)]
        return out

    def visits(self, q: np.ndarray):
        """Leaves, best bin first."""
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            kids = self.children[node]
            if not len(kids):
                yield int(self.leaf[node])
            else:
                for d, kid in zip(((self.centres[kids] - q) ** 2).sum(1).tolist(), kids.tolist()):
                    heapq.heappush(heap, (d, kid))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None]


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _squared(x, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def grow(x: np.ndarray, leaves: int, branch: int = 16, seed: int = 3) -> Tree:
    """A tree of about `leaves` leaves: a node of more than its share of x is split into `branch` at most."""
    rng, share = np.random.default_rng(seed), max(2, len(x) // max(1, leaves))
    centres, children, leaf, todo, n = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [np.zeros(0, int)], [-1], [(0, x)], 0
    while todo:
        node, rows = todo.pop()
        k = min(branch, len(rows) // share)
        near = None
        if k >= 2:
            found = _means(rows, k, rng)
            near = _squared(rows, found).argmin(1)
            used = [j for j in range(k) if (near == j).any()]
        if near is None or len(used) < 2:  # small enough, or all rows alike
            leaf[node], n = n, n + 1
            continue
        kids = np.arange(len(centres), len(centres) + len(used))
        children[node] = kids
        for j, kid in zip(used, kids):
            centres.append(found[j])
            children.append(np.zeros(0, int))
            leaf.append(-1)
            todo.append((int(kid), rows[near == j]))
    return Tree(np.array(centres), children, np.array(leaf))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(lists.flatten(), np.float64).reshape(-1, dim)


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.97, sample: int = 20_000, leaf_rows: int = 200, most_leaves: int = 4096, calibrate: int = 200, block: int = 4096, sample_bytes: int = 1 << 27) -> DataFrame:
    """The k nearest rows of `vectors` to each row of `queries` (ids not null), by Euclidean distance.

    Returns query_id, rank (from 1), vec_id, score, nearest first, ties to the smaller id. A query is no candidate of
    its own: rows with its id are left out. Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do those whose length is not the sample's most common; nor null ids. A query finds fewer than k only
    where there are fewer. Rows that share an id are one candidate, at its nearest vector found; of queries that share
    an id the least vector asks. The index is fitted on the `sample` vectors with the smallest hash of the id, or fewer
    where these are long (`sample_bytes` in all); leaf visits are calibrated to `recall` on `calibrate` rows that are
    no queries, or on queries where there are no others; every row is indexed. Hot leaves are searched in blocks of
    about `block` rows and queries.
    """
    spark = vectors.sparkSession

    def sound(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
        ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        return rows.filter(ok)

    rows, asked = sound(vectors), sound(queries)
    widest = rows.agg(F.max(F.size("v"))).first()[0] or 1
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(max(64, min(sample, sample_bytes // (8 * widest)))).collect()  # bounded by `sample` and `sample_bytes`
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not picked:
        return empty
    dims = [len(r.v) for r in picked]
    dim = max(set(dims), key=lambda d: (dims.count(d), d))
    rows, asked = rows.filter(F.size("v") == dim), asked.filter(F.size("v") == dim)
    total = rows.count()
    x = np.array(sorted(tuple(r.v) for r in picked if len(r.v) == dim))
    tree = spark.sparkContext.broadcast(grow(x, min(most_leaves, max(1, total // leaf_rows))))

    def to_leaf(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column(0), "v": batch.column(1), "leaf": tree.value.assign(_matrix(batch.column(1), dim))}

    placed = stage_table(map_arrow(rows, "id long, v array<double>, leaf int", to_leaf), "ann-rows")
    sizes = dict.fromkeys(range(tree.value.leaves), 0) | {r.leaf: r.n for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # most_leaves rows

    # Calibration: the leaves of exact neighbours, against the order in which the search would visit them.
    by_hash = lambda df: df.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(calibrate)
    asked = stage_table(asked.groupBy("id").agg(F.min("v").alias("v")), "ann-queries")
    if asked.isEmpty():
        return empty
    trial = by_hash(rows.join(asked.select("id"), "id", "left_anti")).collect() or by_hash(asked).collect()
    tq, tid = np.array([r.v for r in trial]), np.array([r.id for r in trial])
    send = spark.sparkContext.broadcast((tq, tid))

    def exact(batch: pa.RecordBatch) -> dict:
        q, qid = send.value
        d = _squared(q, _matrix(batch.column(1), dim))
        d[qid[:, None] == np.asarray(batch.column(0))[None]] = np.inf
        best = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
        leaf = np.asarray(batch.column(2))
        return {"q": np.repeat(np.arange(len(q)), best.shape[1]), "d": np.take_along_axis(d, best, 1).ravel(), "leaf": leaf[best].ravel()}

    best = map_arrow(placed, "q long, d double, leaf int", exact).filter(F.col("d") < float("inf"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d"))).filter(F.col("r") <= k).groupBy("q", "leaf").count().collect()  # calibrate * k rows at most
    order = [{leaf: n for n, leaf in enumerate(tree.value.visits(q))} for q in tq]
    met = np.zeros(tree.value.leaves + 1)
    for r in best:
        met[order[r.q][r.leaf]] += r["count"]
    share = np.cumsum(met) / max(1.0, met.sum())
    visits = int(np.argmax(share >= min(recall, share[-1]))) + 1

    def route(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"id": [], "v": [], "leaf": []}
        for key, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen = n = 0
            for leaf in tree.value.visits(np.array(v)):
                if sizes[leaf]:
                    for name, x in zip(out, (key, v, leaf)):
                        out[name].append(x)
                n, seen = n + 1, seen + sizes[leaf]
                if n >= visits and seen > k:
                    break
        return out

    routed = stage_table(map_arrow(asked, "id long, v array<double>, leaf int", route), "ann-visits")
    asks = {r.leaf: r.n for r in routed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # most_leaves rows
    parts = spark.createDataFrame([(leaf, -(-sizes[leaf] // block), -(-n // block)) for leaf, n in asks.items()], "leaf int, rb int, qb int")  # most_leaves rows
    spread = lambda df, mine, other: df.join(F.broadcast(parts), "leaf").withColumn(mine, F.pmod(F.xxhash64("id"), F.col(mine)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    left, right = spread(placed, "rb", "qb"), spread(routed, "qb", "rb")

    def search(rows: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and asks.num_rows:
            x, ids = _matrix(rows.column("v").combine_chunks(), dim), np.asarray(rows.column("id"))
            q, qids = _matrix(asks.column("v").combine_chunks(), dim), np.asarray(asks.column("id"))
            norm = (x * x).sum(1)
            repeated = len(np.unique(ids)) < len(ids)
            for lo in range(0, len(q), 256):
                d = norm[None] - 2 * q[lo : lo + 256] @ x.T
                for j, row in enumerate(d, lo):
                    row[ids == qids[j]] = np.inf
                    if repeated:  # only the nearest row of an id counts
                        by = np.lexsort((row, ids))
                        row[by[1:][ids[by[1:]] == ids[by[:-1]]]] = np.inf
                    kth = np.partition(row, min(k, len(row)) - 1)[min(k, len(row)) - 1]
                    near = np.flatnonzero((row <= kth + 1e-9 * (1 + abs(kth) + (q[j] ** 2).sum())) & np.isfinite(row))
                    score = np.sqrt(((x[near] - q[j]) ** 2).sum(1))
                    for n in np.lexsort((ids[near], score))[:k]:
                        out.append((int(qids[j]), int(ids[near[n]]), float(score[n])))
        return pa.table([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], schema=arrow_schema("query_id long, vec_id long, score double"))

    keys = ["leaf", "rb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
