"""Search requests written as JSON: bool queries with aggregations, and filters of vector stores."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import field, haversine, text


def _one(spec: dict) -> tuple[str, object]:
    ((k, v),) = spec.items()
    return k, v


def query(q: dict) -> Column:
    """match_all, match, term, terms, range, bool, wildcard, prefix, exists, ids, match_phrase. `should` counts only
    without must and filter, or where minimum_should_match asks for it."""
    kind, spec = _one(q)
    if kind == "match_all":
        return F.lit(True)
    if kind == "bool":
        listed = lambda k: [query(x) for x in (spec[k] if isinstance(spec.get(k, []), list) and k in spec else [spec[k]] if k in spec else [])]
        need, should = listed("must") + listed("filter"), listed("should")
        parts = need + [~F.coalesce(c, F.lit(False)) for c in listed("must_not")]
        least = spec.get("minimum_should_match", 0 if need else 1)
        if should and least:
            parts.append(reduce(or_, should) if least == 1 else reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in should]) >= least)
        return reduce(and_, parts, F.lit(True))
    if kind == "exists":
        return field(spec["field"]).isNotNull()
    name, v = _one(spec)
    c = field(name)
    if kind in ("match", "match_phrase"):
        wanted = str(v["query"] if isinstance(v, dict) else v).lower()
        return F.lower(text(c)).contains(wanted)
    v = v["value"] if isinstance(v, dict) and "value" in v else v
    if kind == "term":
        return c == v
    if kind == "terms":
        return c.isin(*v)
    if kind == "prefix":
        return text(c).startswith(v)
    if kind == "wildcard":
        return text(c).rlike("^" + "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in v) + "$")
    if kind == "range":
        ops = {"gt": lambda x: c > x, "gte": lambda x: c >= x, "lt": lambda x: c < x, "lte": lambda x: c <= x}
        return reduce(and_, [ops[o](x) for o, x in v.items() if o in ops])
    raise ValueError(f"unknown query {kind}")


def search(df: DataFrame, request: dict) -> DataFrame:
    """query, sort, from, size and _source of a request."""
    df = df.filter(query(request.get("query", {"match_all": {}})))
    keys = []
    for s in request.get("sort", []):
        name, order = (s, "asc") if isinstance(s, str) else _one(s)
        order = order["order"] if isinstance(order, dict) else order
        keys.append(field(name).desc_nulls_last() if order == "desc" else field(name).asc_nulls_last())
    if keys:
        df = df.orderBy(*keys)
    if request.get("from"):
        df = df.offset(request["from"])
    df = df.limit(request.get("size", 10))
    return df.select(*request["_source"]) if "_source" in request else df


def metric(kind: str, c: Column) -> Column:
    fns = {"sum": lambda: F.coalesce(F.sum(c), F.lit(0.0)), "avg": lambda: F.coalesce(F.avg(c), F.lit(0.0)), "min": lambda: F.min(c), "max": lambda: F.max(c), "value_count": lambda: F.count(c), "cardinality": lambda: F.count_distinct(c)}
    if kind not in fns:
        raise ValueError(f"unknown metric {kind}")
    return fns[kind]()


def aggregate(df: DataFrame, aggs: dict) -> DataFrame:
    """Aggregations side by side. One bucket aggregation (terms or histogram) gives key, doc_count and the metrics below
    it; metrics alone give one row. Several of which any has buckets give rows with the aggregation's name in `agg`; its
    key is text, and what another one has is null."""
    buckets = {n: s for n, s in aggs.items() if _kind(s) in ("terms", "histogram")}
    if buckets and len(aggs) > 1:
        alone = [aggregate(df, {n: s}).withColumn("key", F.col("key").cast("string")).withColumn("agg", F.lit(n)) for n, s in buckets.items()]
        rest = {n: s for n, s in aggs.items() if n not in buckets}
        if rest:
            alone.append(aggregate(df, rest).withColumn("agg", F.lit("_metrics")))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), alone)
    spec = next(iter(aggs.values()))
    kind = _kind(spec)
    if kind not in ("terms", "histogram"):
        items = []
        for n, s in aggs.items():
            k, v = _one(s)
            c = field(v["field"])
            items += [metric(m, c).alias(f"{n}_{m}") for m in ("value_count", "min", "max", "avg", "sum")] if k == "stats" else [metric(k, c).alias(n)]
        return df.agg(*items)
    c = field(spec[kind]["field"])
    below = [metric(*_metric(s)).alias(n) for n, s in spec.get("aggs", {}).items()]
    if kind == "histogram":
        step = spec[kind].get("interval", 10)
        return df.filter(c.isNotNull()).groupBy((F.floor(c / step) * step).cast("double").alias("key")).agg(F.count("*").alias("doc_count"), *below)
    return df.filter(c.isNotNull()).groupBy(c.alias("key")).agg(F.count("*").alias("doc_count"), *below).orderBy(F.desc("doc_count"), "key").limit(spec[kind].get("size", 10))


def _kind(spec: dict) -> str:
    return next(k for k in spec if k not in ("aggs", "aggregations"))


def _metric(s: dict) -> tuple[str, Column]:
    k, v = _one(s)
    return k, field(v["field"])


def points_filter(f: dict) -> Column:
    """must, should, must_not of conditions: match (value, any, except, text), range, geo_radius, geo_bounding_box,
    values_count, is_empty, is_null, has_id, nested."""
    parts = [points_condition(c) for c in f.get("must", [])]
    if f.get("should"):
        parts.append(reduce(or_, [points_condition(c) for c in f["should"]]))
    parts += [~F.coalesce(points_condition(c), F.lit(False)) for c in f.get("must_not", [])]
    return reduce(and_, parts, F.lit(True))


def points_condition(c: dict, of=field) -> Column:
    if any(k in c for k in ("must", "should", "must_not")):
        return points_filter(c)
    if "has_id" in c:
        return of("id").isin(*c["has_id"])
    if "is_null" in c:
        return of(c["is_null"]["key"]).isNull()
    if "is_empty" in c:
        col = of(c["is_empty"]["key"])
        return col.isNull() | (F.size(col) == 0)
    if "nested" in c:
        inner = c["nested"]["filter"]["must"]
        return F.exists(of(c["nested"]["key"]), lambda x: reduce(and_, [points_condition(k, lambda p: x[p]) for k in inner]))
    col = of(c["key"])
    if "match" in c:
        k, v = _one(c["match"])
        return {"value": lambda: col == v, "keyword": lambda: col == v, "integer": lambda: col == v, "boolean": lambda: col == v, "text": lambda: F.lower(text(col)).contains(str(v).lower()), "any": lambda: col.isin(*v), "except": lambda: ~F.coalesce(col.isin(*v), F.lit(False))}[k]()
    if "range" in c or "values_count" in c:
        x = col if "range" in c else F.size(col)
        ops = {"gt": lambda v: x > v, "gte": lambda v: x >= v, "lt": lambda v: x < v, "lte": lambda v: x <= v}
        return reduce(and_, [ops[o](v) for o, v in c.get("range", c.get("values_count")).items() if v is not None])
    if "geo_radius" in c:
        g = c["geo_radius"]
        return haversine(col["lat"], col["lon"], g["center"]["lat"], g["center"]["lon"]) <= g["radius"]
    if "geo_bounding_box" in c:
        a, b = c["geo_bounding_box"]["top_left"], c["geo_bounding_box"]["bottom_right"]
        return col["lat"].between(b["lat"], a["lat"]) & col["lon"].between(a["lon"], b["lon"])
    raise ValueError(f"unknown condition {c}")


def rest(df: DataFrame, params: str) -> DataFrame:
    """A REST query string: select, filters (eq neq gt gte lt lte like ilike in is cs cd ov match imatch fts, not.),
    order with nullsfirst/nullslast, limit and offset."""
    from urllib.parse import parse_qsl

    keys, limit, offset, shown = [], None, 0, None
    for name, v in parse_qsl(params, keep_blank_values=True):
        if name == "select":
            shown = [s.strip() for s in v.split(",") if s.strip() not in ("", "*")]
        elif name == "limit":
            limit = int(v)
        elif name == "offset":
            offset = int(v)
        elif name == "order":
            for part in v.split(","):
                col, *how = part.split(".")
                down = "desc" in how
                nulls = "first" if "nullsfirst" in how or (down and "nullslast" not in how) else "last"
                keys.append(getattr(field(col), f"{'desc' if down else 'asc'}_nulls_{nulls}")())
        else:
            df = df.filter(rest_filter(name, v))
    if keys:
        df = df.orderBy(*keys)
    if offset:
        df = df.offset(offset)
    if limit is not None:
        df = df.limit(limit)
    return df.select(*[field(s.partition(":")[2] or s).alias(s.partition(":")[0]) for s in shown]) if shown else df


def rest_filter(name: str, v: str) -> Column:
    op, _, arg = v.partition(".")
    if op == "not":
        return ~F.coalesce(rest_filter(name, arg), F.lit(False))
    c = field(name)
    items = [x.strip().strip('"') for x in arg.strip("(){}").split(",")]
    star = arg.replace("*", "%")
    fns = {
        "eq": lambda: c == arg, "neq": lambda: c != arg, "gt": lambda: c > arg, "gte": lambda: c >= arg, "lt": lambda: c < arg, "lte": lambda: c <= arg, "like": lambda: c.like(star), "ilike": lambda: c.ilike(star),
        "in": lambda: c.cast("string").isin(*items), "is": lambda: c.isNull() if arg == "null" else c == (arg == "true"), "match": lambda: c.rlike(arg), "imatch": lambda: c.rlike("(?i)" + arg),
        "cs": lambda: reduce(and_, [F.array_contains(c, x) for x in items]), "cd": lambda: F.size(F.array_except(c, F.array(*map(F.lit, items)))) == 0, "ov": lambda: F.arrays_overlap(c, F.array(*map(F.lit, items))),
        "fts": lambda: reduce(and_, [F.lower(text(c)).rlike(rf"\b{re.escape(w.lower())}\b") for w in re.split(r"[\s&]+", arg)]), "plfts": lambda: reduce(and_, [F.lower(text(c)).rlike(rf"\b{re.escape(w.lower())}\b") for w in arg.split()]), "phfts": lambda: F.lower(text(c)).contains(arg.lower()),
    }
    if op not in fns:
        raise ValueError(f"unknown operator {op}")
    return fns[op]()


def key_condition(df: DataFrame, pk: str, pk_value, sk: str | None = None, op: str | None = None, values: tuple = (), forward: bool = True, limit: int | None = None, after=None) -> DataFrame:
    """A partition-key query: equality on pk, one condition on sk (= < <= > >= between begins_with), in sk order."""
    out = df.filter(field(pk) == pk_value)
    if sk and op:
        c = field(sk)
        out = out.filter({"=": lambda: c == values[0], "<": lambda: c < values[0], "<=": lambda: c <= values[0], ">": lambda: c > values[0], ">=": lambda: c >= values[0], "between": lambda: c.between(*values), "begins_with": lambda: text(c).startswith(values[0])}[op]())
    if sk and after is not None:
        out = out.filter(field(sk) > after if forward else field(sk) < after)
    if sk:
        out = out.orderBy(field(sk).asc() if forward else field(sk).desc())
    return out.limit(limit) if limit is not None else out
