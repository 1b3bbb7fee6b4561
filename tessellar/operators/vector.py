"""Exact nearest neighbours and vector arithmetic, in higher-order functions inside the JVM; many queries at once by blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def doubles(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def _sum(a: Column, b: Column, fn) -> Column:
    return F.aggregate(F.zip_with(a, b, fn), F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared(a, b))


def squared(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: (x - y) * (x - y))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: F.abs(x - y))


def cosine(a: Column, b: Column) -> Column:
    """Similarity; 0 where a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def normalise(a: Column) -> Column:
    """Length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def elementwise(a: Column, b: Column, op: str) -> Column:
    fns = {"add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y, "div": F.try_divide}
    return F.zip_with(a, b, fns[op])


def scale(a: Column, k: float) -> Column:
    return F.transform(a, lambda x: x * k)


METRICS = {
    "l2": l2, "l2_squared": squared, "cosine": lambda a, b: 1 - cosine(a, b), "dot": lambda a, b: -dot(a, b), "inner_product": lambda a, b: 1 - dot(a, b), "manhattan": manhattan,
}


def knn(df: DataFrame, vector_col: str, query: list[float], k: int, metric: str = "l2", where: Column | None = None, id_col: str | None = None) -> DataFrame:
    """The k rows nearest to one vector, with `distance`; a filter comes first. Each task keeps k rows only."""
    id_col = id_col or next(c for c in df.columns if c.endswith("id"))
    if where is not None:
        df = df.filter(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.withColumn("distance", METRICS[metric](doubles(vector_col), q)).orderBy("distance", id_col).limit(k)


def knn_batch(df: DataFrame, queries: DataFrame, vector_col: str, id_col: str, k: int, metric: str = "l2", most: int = 10_000) -> DataFrame:
    """The k nearest rows to each query, exactly; what has no distance (a null, another length) comes last. Rows and queries are
    packed in blocks, and a product of two blocks bounds the distances of all their pairs from below: only pairs that may be
    among the k nearest are computed as such. Blocks of up to `most` queries are broadcast; of more, each set of about `most`
    meets each partition of the rows in a task of its own. A task holds one block of rows and k rows a query.

    The metrics and ids that have no such bound (manhattan; ids that aren't whole numbers) go pair by pair."""
    kinds, asked = dict(df.dtypes), queries.count()
    if metric not in _BOUNDS or kinds[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        q = queries.select(F.col(id_col).alias("query_id"), doubles(vector_col).alias("_q"))
        q = F.broadcast(q) if asked <= most else q.repartition(-(-asked // most), "query_id").hint("shuffle_replicate_nl")
        pairs = df.select(id_col, doubles(vector_col).alias("_v")).join(q, F.col(id_col) != F.col("query_id"))
        scored = pairs.select("query_id", id_col, METRICS[metric](F.col("_v"), F.col("_q")).alias("distance"))
    else:
        pack = lambda x: x.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), doubles(vector_col).alias("v"))
        dealt = pack(queries).repartition(max(1, -(-asked // most)), "id").mapInArrow(_packed, "dim long, ids binary, v binary").toDF("q_dim", "q_ids", "q")
        dealt = F.broadcast(dealt) if asked <= most else dealt.hint("shuffle_replicate_nl")
        blocks = pack(df).mapInArrow(_packed, "dim long, ids binary, v binary").repartition(2 * df.sparkSession.sparkContext.defaultParallelism)
        scored = blocks.crossJoin(dealt).mapInArrow(_nearest(k, metric), "query_id long, id long, distance double")
        scored = scored.select(F.col("query_id").cast(kinds[id_col]), F.col("id").cast(kinds[id_col]).alias(id_col), "distance")
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), id_col)
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of at most 2 MB of vectors of one length (-1: null, or with a null inside): length, ids, values."""
    held: dict[int, list] = {}

    def block(dim: int) -> pa.RecordBatch:
        ids, values = (np.concatenate(x) for x in zip(*held.pop(dim)))
        return pa.RecordBatch.from_arrays([pa.array([dim]), pa.array([ids.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], ["dim", "ids", "v"])

    for batch in batches:
        ids, v = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        starts = v.offsets.to_numpy()
        dims = np.where(v.is_valid().to_numpy(zero_copy_only=False), np.diff(starts), -1)
        inner = v.values
        if inner.null_count:
            gaps = np.concatenate([[0], np.cumsum(inner.is_null().to_numpy(zero_copy_only=False))])
            dims = np.where(gaps[starts[1:]] > gaps[starts[:-1]], -1, dims)
            inner = inner.fill_null(0.0)
        values = inner.to_numpy()
        for dim in np.unique(dims).tolist():
            at, most = np.flatnonzero(dims == dim), max(16, min(4096, 2**18 // max(dim, 1)))
            for part in np.split(at, range(most, len(at), most)):
                x = values[starts[part][:, None] + np.arange(max(dim, 0))]
                if sum(len(i) for i, _ in held.get(dim, [])) + len(part) > most:
                    yield block(dim)
                held.setdefault(dim, []).append((ids[part], x))
        while sum(len(i) for h in held.values() for i, _ in h) > 16_384:  # of many lengths
            yield block(max(held, key=lambda d: sum(len(i) for i, _ in held[d])))
    for dim in list(held):
        yield block(dim)


def _seq(a: np.ndarray, b: np.ndarray, fn) -> np.ndarray:
    """The sum over the columns, from first to last as `_sum` adds them."""
    acc = np.zeros(len(a))
    for i in range(a.shape[1]):
        acc += fn(a[:, i], b[:, i])
    return acc


def _exact(metric: str, v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """METRICS of pairs of rows, to the last digit."""
    if metric in ("l2", "l2_squared"):
        s = _seq(v, q, lambda x, y: (x - y) * (x - y))
        return np.sqrt(s) if metric == "l2" else s
    s = _seq(v, q, np.multiply)
    if metric == "cosine":
        n = np.sqrt(_seq(v, v, np.multiply)) * np.sqrt(_seq(q, q, np.multiply))
        return 1 - np.where(n == 0, 0.0, s / np.where(n == 0, 1.0, n))
    return -s if metric == "dot" else 1 - s


#: Metrics that a product bounds: the factor of the product, that of the squared lengths, and what is added.
_BOUNDS = {"l2": (-2.0, 1.0, 0.0), "l2_squared": (-2.0, 1.0, 0.0), "cosine": (-1.0, 0.0, 1.0), "dot": (-1.0, 0.0, 0.0), "inner_product": (-1.0, 0.0, 1.0)}


def _sides(metric: str, x: np.ndarray, query: bool, kind: type) -> np.ndarray:
    """Rows whose products, one side by the other, are at most the distance (l2: its square), whatever is rounded: of a product
    the error is below its length times the unit times the squared lengths, of which several times as much is taken off."""
    factor, lengths, plus = _BOUNDS[metric]
    if metric == "cosine":
        n = np.sqrt((x * x).sum(1))[:, None]
        x = x / np.where(n == 0, 1.0, n)
    slack = 4 * (x.shape[1] + 16) * np.finfo(kind).eps
    own = (lengths - slack) * (x * x).sum(1) - (1e-30 if kind is np.float32 else 1e-290) + (plus * (1 - slack) / 2 if plus else 0.0) - (slack if plus else 0.0)
    one = np.ones(len(x))
    return np.column_stack([x * factor, own, one] if query else [x, one, own]).astype(kind)


def _nearest(k: int, metric: str):
    """mapInArrow over pairs of blocks: the k nearest of the task's rows to each of its queries."""

    class Block:
        """Queries, and the rows nearest to them so far."""

        def __init__(self, dim: int, ids: bytes, q: bytes):
            self.ids, self.dim = np.frombuffer(ids, np.int64), dim
            self.q = np.frombuffer(q, np.float64).reshape(len(self.ids), max(dim, 0))
            self.side: dict[type, np.ndarray] = {}
            self.limit = np.full(len(self.ids), np.inf)  # what the k-th has; nothing above can enter
            self.top = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))  # query, id, distance, none

        def enter(self, at: np.ndarray, ids: np.ndarray, d: np.ndarray, none: np.ndarray) -> None:
            other = ids != self.ids[at]
            at, ids, d, none = (np.concatenate([x, y[other]]) for x, y in zip(self.top, (at, ids, d, none)))
            order = np.lexsort((ids, d, none, at))
            rank = np.arange(len(at)) - np.searchsorted(at[order], at[order])
            keep, last = order[rank < k], order[rank == k - 1]
            self.lower(at[last], np.where(none[last], np.inf, d[last]))
            self.top = (at[keep], ids[keep], d[keep], none[keep])

        def lower(self, at: np.ndarray, kth: np.ndarray) -> None:
            self.limit[at] = np.fmin(self.limit[at], kth)

        def without(self, ids: np.ndarray) -> None:
            """Rows that have no distance to these queries (1 by cosine): the least ids, where there aren't k nearer ones."""
            few = np.sort(ids)[: k + np.unique(ids, return_counts=True)[1].max()]
            lacking = np.flatnonzero(self.limit >= 1 if metric == "cosine" else np.isinf(self.limit))
            for at in np.array_split(lacking, max(1, len(lacking) * len(few) // 2**18)):
                n = len(at) * len(few)
                self.enter(np.repeat(at, len(few)), np.tile(few, len(at)), np.ones(n), np.full(n, metric != "cosine"))

        def meet(self, ids: np.ndarray, v: np.ndarray) -> None:
            kind = np.float32 if max(np.abs(v).max(initial=0), np.abs(self.q).max(initial=0)) < 1e12 else np.float64
            if kind not in self.side:
                self.side[kind] = _sides(metric, self.q, True, kind)
            theirs = np.ascontiguousarray(_sides(metric, v, False, kind).T)
            for start in range(0, len(self.ids), 512):
                low = self.side[kind][start : start + 512] @ theirs
                at = np.arange(start, start + len(low))
                if len(ids) > k + 1 and np.isinf(self.limit[at]).any():  # a first limit, by the rows that look nearest
                    near = np.argpartition(low, k, axis=1)[:, : k + 1]
                    d = _exact(metric, v[near.ravel()], self.q[np.repeat(at, k + 1)]).reshape(near.shape)
                    self.lower(at, np.partition(np.where(ids[near] == self.ids[at, None], np.inf, d), k - 1, axis=1)[:, k - 1])
                limit = self.limit[at]
                limit = limit * limit * (1 + 1e-14) if metric == "l2" else limit + np.abs(limit) * 1e-14
                found = np.flatnonzero(~(low > np.nextafter(limit.astype(kind), kind(np.inf))[:, None]))
                for part in np.split(found, range(2**15, len(found), 2**15)):
                    one, row = part // len(ids) + start, part % len(ids)
                    self.enter(one, ids[row], _exact(metric, v[row], self.q[one]), np.zeros(len(part), bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[tuple[int, bytes, bytes], Block] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() if i in (0, 3) else c for i, c in enumerate(batch.columns))):
                dim, ids, v, q_dim, q_ids, q = (x if isinstance(x, int) else x.as_py() for x in row)
                key = (q_dim, q_ids, q)
                b = blocks.get(key) or blocks.setdefault(key, Block(*key))
                ids = np.frombuffer(ids, np.int64)
                with np.errstate(all="ignore"):
                    if dim == q_dim >= 0:
                        b.meet(ids, np.frombuffer(v, np.float64).reshape(len(ids), dim))
                    else:
                        b.without(ids)
        for b in blocks.values():
            at, ids, d, none = b.top
            yield pa.RecordBatch.from_arrays([pa.array(b.ids[at]), pa.array(ids), pa.array(d, mask=none)], ["query_id", "id", "distance"])

    return run


def hybrid(semantic: DataFrame, lexical: DataFrame, id_col: str, alpha: float) -> DataFrame:
    """alpha * semantic score + (1 - alpha) * lexical score; what one side lacks counts 0 there."""
    a, b = semantic.select(id_col, F.col("score").alias("_s")), lexical.select(id_col, F.col("score").alias("_l"))
    return a.join(b, id_col, "full").select(id_col, (alpha * F.coalesce("_s", F.lit(0.0)) + (1 - alpha) * F.coalesce("_l", F.lit(0.0))).alias("score"))
