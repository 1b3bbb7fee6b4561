"""Stages of document pipelines, and filters written as documents."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import field, text


def unwind(df: DataFrame, path: str) -> DataFrame:
    """A row for each element. Empty arrays and nulls drop the row; a column that is no array passes through."""
    kind = df.select(field(path)).schema[0].dataType
    if not isinstance(kind, T.ArrayType):
        return df
    return df.withColumn(path, F.explode(field(path)))


def where(query: dict[str, Any]) -> Column:
    """A filter document: fields with values or operators, $and, $or, $nor, $not. A missing field fails comparisons and
    satisfies $ne and $nin."""
    parts = []
    for key, spec in query.items():
        if key in ("$and", "$or", "$nor"):
            inner = [where(q) for q in spec]
            joined = reduce(and_ if key == "$and" else or_, inner)
            parts.append(~F.coalesce(joined, F.lit(False)) if key == "$nor" else joined)
        elif key == "$not":
            parts.append(~F.coalesce(where(spec), F.lit(False)))
        elif isinstance(spec, dict) and any(k.startswith("$") for k in spec):
            parts += [_operator(field(key), op, v, spec) for op, v in spec.items() if op != "$options"]
        else:
            parts.append(field(key).eqNullSafe(F.lit(spec)))
    return reduce(and_, parts, F.lit(True)) if parts else F.lit(True)


def _operator(c: Column, op: str, v: Any, spec: dict) -> Column:
    simple = {
        "$eq": lambda: c.eqNullSafe(F.lit(v)), "$ne": lambda: ~c.eqNullSafe(F.lit(v)), "$gt": lambda: c > v, "$gte": lambda: c >= v, "$lt": lambda: c < v, "$lte": lambda: c <= v,
        "$in": lambda: c.isin(*v), "$nin": lambda: ~F.coalesce(c.isin(*v), F.lit(False)), "$like": lambda: text(c).ilike(v), "$contains": lambda: text(c).contains(v),
        "$startsWith": lambda: text(c).startswith(v), "$endsWith": lambda: text(c).endswith(v), "$exists": lambda: c.isNotNull() if v else c.isNull(), "$between": lambda: c.between(*v),
        "$regex": lambda: text(c).rlike(("(?i)" if "i" in spec.get("$options", "") else "") + v), "$all": lambda: reduce(and_, [F.array_contains(c, x) for x in v]), "$size": lambda: F.size(c) == v,
    }
    if op == "$not":
        return ~F.coalesce(reduce(and_, [_operator(c, o, x, v) for o, x in v.items()]), F.lit(False))
    if op not in simple:
        raise ValueError(f"unknown operator {op}")
    return simple[op]()


def value(e: Any) -> Column:
    """'$path' is a field, a dict an expression, the rest a constant."""
    if isinstance(e, str) and e.startswith("$"):
        return field(e[1:])
    if isinstance(e, dict):
        (op, args), *more = e.items()
        if more or not op.startswith("$"):
            return F.struct(*[value(v).alias(k) for k, v in e.items()])
        args = [value(a) for a in (args if isinstance(args, list) else [args])]
        calls = {
            "$add": lambda: reduce(lambda a, b: a + b, args), "$multiply": lambda: reduce(lambda a, b: a * b, args), "$subtract": lambda: args[0] - args[1], "$divide": lambda: F.try_divide(*args), "$mod": lambda: F.try_mod(*args),
            "$concat": lambda: F.concat(*args), "$toUpper": lambda: F.upper(args[0]), "$toLower": lambda: F.lower(args[0]), "$size": lambda: F.size(args[0]).cast("long"), "$ifNull": lambda: F.coalesce(*args), "$abs": lambda: F.abs(args[0]),
            "$cond": lambda: F.when(*args[:2]).otherwise(args[2]), "$gt": lambda: args[0] > args[1], "$gte": lambda: args[0] >= args[1], "$lt": lambda: args[0] < args[1], "$lte": lambda: args[0] <= args[1], "$eq": lambda: args[0] == args[1],
            "$year": lambda: F.year(args[0]).cast("long"), "$month": lambda: F.month(args[0]).cast("long"), "$literal": lambda: args[0],
        }
        if op not in calls:
            raise ValueError(f"unknown expression {op}")
        return calls[op]()
    return F.lit(e)


def group(df: DataFrame, spec: dict[str, Any], order: dict[str, int] | None = None) -> DataFrame:
    """$group: _id is null, a '$field' or a document of keys. $first and $last follow `order` (the fields of the last
    $sort with 1 or -1); rows that are equal in it, or all without a $sort, are ordered by the whole row."""
    by = spec["_id"]
    keys = {} if by is None else {"_id": value(by)} if not isinstance(by, dict) else {k: value(v) for k, v in by.items()}
    ends = {"$first", "$last"} & {op for name, agg in spec.items() if name != "_id" for op in agg}
    if ends and order:  # rank by the sort, as keys that fall can't be compared in a struct
        by_group = Window.partitionBy(*keys.values() or [F.lit(0)])
        by_sort = by_group.orderBy(*[sort_key(k, d) for k, d in order.items()], *[F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith("map")])
        df = df.withColumn("_rank", F.row_number().over(by_sort))
    at = F.col("_rank") if ends and order else F.struct(*[F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith("map")])
    makers = {
        "$sum": lambda e: F.coalesce(F.sum(value(e)), F.lit(0)), "$avg": lambda e: F.avg(value(e)), "$min": lambda e: F.min(value(e)), "$max": lambda e: F.max(value(e)), "$count": lambda e: F.count(F.lit(1)),
        "$first": lambda e: F.min_by(value(e), at), "$last": lambda e: F.max_by(value(e), at), "$push": lambda e: F.sort_array(F.collect_list(value(e))), "$addToSet": lambda e: F.sort_array(F.collect_set(value(e))),
        "$stdDevPop": lambda e: F.stddev_pop(value(e)), "$stdDevSamp": lambda e: F.stddev_samp(value(e)),
    }
    items = []
    for name, agg in spec.items():
        if name != "_id":
            ((op, e),) = agg.items()
            if op not in makers:
                raise ValueError(f"unknown accumulator {op}")
            items.append(makers[op](e).alias(name))
    return df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(*items)


def project(df: DataFrame, spec: dict[str, Any], id_col: str = "_id") -> DataFrame:
    """Inclusion (1), computed fields, or exclusion (0). The id comes along in an inclusion unless it is excluded."""
    flags = {k: v for k, v in spec.items() if k != id_col}
    if flags and all(v in (0, False) for v in flags.values()):
        return df.drop(*flags, *([id_col] if spec.get(id_col, 1) == 0 else []))
    out = [field(id_col)] if id_col in df.columns and spec.get(id_col, 1) else []
    return df.select(*out, *[field(k).alias(k.rsplit(".", 1)[-1]) if v in (1, True) else value(v).alias(k) for k, v in flags.items()])


def sort_key(path: str, way: int) -> Column:
    return field(path).asc_nulls_first() if way > 0 else field(path).desc_nulls_last()


def pipeline(df: DataFrame, stages: list[dict], tables=None, id_col: str = "_id") -> DataFrame:
    """Stages in order. tables(name) gives the frame for $lookup and $unionWith."""
    from . import joins, vector

    order: dict[str, int] = {}
    for stage in stages:
        ((op, spec),) = stage.items()
        if op == "$match":
            df = df.filter(where(spec))
        elif op == "$group":
            df, order = group(df, spec, order), {}
        elif op == "$project":
            df = project(df, spec, id_col)
        elif op in ("$addFields", "$set"):
            df = df.withColumns({k: value(v) for k, v in spec.items()})
        elif op == "$unset":
            df = df.drop(*([spec] if isinstance(spec, str) else spec))
        elif op == "$sort":
            df, order = df.orderBy(*[sort_key(k, d) for k, d in spec.items()]), spec
        elif op == "$limit":
            df = df.limit(spec)
        elif op == "$skip":
            df = df.offset(spec)
        elif op == "$unwind":
            df = unwind(df, (spec if isinstance(spec, str) else spec["path"]).lstrip("$"))
        elif op == "$lookup":
            df = joins.lookup(df, tables(spec["from"]), spec["localField"], spec["foreignField"], spec["as"])
        elif op == "$unionWith":
            df = df.unionByName(tables(spec if isinstance(spec, str) else spec["coll"]), allowMissingColumns=True)
        elif op == "$count":
            df = df.agg(F.count("*").alias(spec))
        elif op == "$sortByCount":
            df = df.groupBy(value(spec).alias("_id")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "_id")
        elif op == "$sample":
            df = df.orderBy(F.xxhash64(*df.columns)).limit(spec["size"])
        elif op == "$vectorSearch":
            df = vector.knn(df, spec["path"], spec["queryVector"], spec.get("limit", 10), spec.get("metric", "cosine"), where(spec["filter"]) if "filter" in spec else None)
        else:
            raise ValueError(f"unknown stage {op}")
    return df


def update(df: DataFrame, query: dict, change: dict) -> DataFrame:
    """$set, $unset, $inc, $mul, $push, $pull, $addToSet on the rows that match."""
    hit = F.coalesce(where(query), F.lit(False))
    makers = {
        "$set": lambda c, v: F.lit(v), "$inc": lambda c, v: F.coalesce(c, F.lit(0)) + v, "$mul": lambda c, v: c * v, "$unset": lambda c, v: F.lit(None),
        "$push": lambda c, v: F.array_append(c, F.lit(v)), "$pull": lambda c, v: F.array_remove(c, v), "$addToSet": lambda c, v: F.array_union(c, F.array(F.lit(v))),
    }
    for op, fields in change.items():
        df = df.withColumns({k: F.when(hit, makers[op](field(k), v)).otherwise(field(k)) for k, v in fields.items()})
    return df
