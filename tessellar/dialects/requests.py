"""Series requests written as JSON: metric queries with downsampling, and timeseries, topN, groupBy, scan, search,
timeBoundary and segmentMetadata queries."""

from __future__ import annotations

import json
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.scalars import field, floor_to
from ..functions.scalars import micros as us
from ..plans.durations import micros
from ..plans.grammar import ParseError
from .flux import _time

_FNS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": lambda c: F.count(c).cast("double"), "dev": F.stddev_pop, "first": lambda c: F.min_by(c, "t"), "last": lambda c: F.max_by(c, "t"), "zimsum": F.sum, "mimmin": F.min, "mimmax": F.max}


def metrics(catalog: Catalog, query: str | dict, now: int | None = None) -> DataFrame:
    """queries: [{metric, aggregator, tags, downsample '1h-avg', rate}]: columns metric, t, v. Tag values may be '*' or 'a|b'."""
    q = json.loads(query) if isinstance(query, str) else query
    out = None
    for one in q["queries"]:
        t = catalog[one["metric"]]
        df = catalog.frame(one["metric"])
        for k, v in one.get("tags", {}).items():
            if v != "*":
                df = df.filter(F.col(k).cast("string").isin(*v.split("|")))
        grouped = [k for k, v in one.get("tags", {}).items() if v == "*" or "|" in v]
        df = df.select(*t.tags, us(t.time).alias("t"), F.col(t.value).cast("double").alias("v"))
        for k, low in (("start", True), ("end", False)):
            if k in q:
                at = _time(str(q[k]).replace("-ago", ""), now) if not str(q[k]).endswith("-ago") else now - micros(str(q[k]).removesuffix("-ago"))
                df = df.filter(F.col("t") >= at if low else F.col("t") < at)
        series = list(t.tags)
        if "downsample" in one:
            size, _, fn = one["downsample"].partition("-")
            df = df.groupBy(*series, floor_to(F.col("t"), micros(size)).alias("w")).agg(_FNS[fn]("v").alias("v")).withColumnRenamed("w", "t")
        if one.get("rate"):
            w = Window.partitionBy(*series).orderBy("t")
            df = df.withColumn("v", F.try_divide((F.col("v") - F.lag("v").over(w)) * 1_000_000, F.col("t") - F.lag("t").over(w))).filter(F.col("v").isNotNull())
        row = df.groupBy(*grouped, "t").agg(_FNS[one.get("aggregator", "sum")]("v").alias("v")).select(F.lit(one["metric"]).alias("metric"), *grouped, "t", "v")
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    if out is None:
        raise ParseError("opentsdb: no queries")
    return out


def _filter(f: dict) -> Column:
    kind = f["type"]
    if kind in ("and", "or"):
        return reduce(and_ if kind == "and" else or_, [_filter(x) for x in f["fields"]])
    if kind == "not":
        return ~F.coalesce(_filter(f["field"]), F.lit(False))
    c = field(f["dimension"])
    if kind == "selector":
        return c.cast("string").eqNullSafe(F.lit(None if f["value"] is None else str(f["value"])))
    if kind == "in":
        return c.cast("string").isin(*map(str, f["values"]))
    if kind == "regex":
        return c.cast("string").rlike(f["pattern"])
    if kind == "like":
        return c.cast("string").like(f["pattern"])
    if kind == "search":
        return F.lower(c.cast("string")).contains(f["query"]["value"].lower())
    if kind == "bound":
        v = c.cast("double") if f.get("ordering") == "numeric" else c.cast("string")
        cast = float if f.get("ordering") == "numeric" else str
        parts = []
        if "lower" in f:
            parts.append(v > cast(f["lower"]) if f.get("lowerStrict") else v >= cast(f["lower"]))
        if "upper" in f:
            parts.append(v < cast(f["upper"]) if f.get("upperStrict") else v <= cast(f["upper"]))
        return reduce(and_, parts, F.lit(True))
    raise ParseError(f"druid: unknown filter {kind}")


def _aggregation(a: dict) -> Column:
    kind = a["type"]
    if kind == "filtered":
        inner = dict(a["aggregator"])
        return _aggregation(inner | {"_when": a["filter"]})
    v = field(a["fieldName"]) if "fieldName" in a else F.lit(1)
    if "_when" in a:
        v = F.when(_filter(a["_when"]), v)
    fns = {"count": F.count, "longSum": lambda c: F.sum(c.cast("long")), "doubleSum": F.sum, "floatSum": F.sum, "longMin": lambda c: F.min(c.cast("long")), "longMax": lambda c: F.max(c.cast("long")), "doubleMin": F.min, "doubleMax": F.max, "hyperUnique": F.approx_count_distinct, "cardinality": F.approx_count_distinct, "thetaSketch": F.approx_count_distinct}
    if kind not in fns:
        raise ParseError(f"druid: unknown aggregation {kind}")
    return fns[kind](v)


def _post(p: dict) -> Column:
    if p["type"] == "arithmetic":
        ops = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))}
        return reduce(ops[p["fn"]], [_post(x) for x in p["fields"]])
    return F.lit(p["value"]) if p["type"] == "constant" else field(p["fieldName"])


_GRAINS = {"second": "1s", "minute": "1m", "five_minute": "5m", "fifteen_minute": "15m", "thirty_minute": "30m", "hour": "1h", "six_hour": "6h", "day": "1d"}


def native(catalog: Catalog, query: str | dict) -> DataFrame:
    """Rows with t (microseconds; none for granularity 'all'), the dimensions and the aggregations."""
    q = json.loads(query) if isinstance(query, str) else query
    kind, source = q["queryType"], q["dataSource"]
    t, df = catalog[source], catalog.frame(source)
    if kind == "segmentMetadata":
        return catalog.describe(source)
    df = df.withColumn("_t", us(t.time))
    intervals = q.get("intervals", [])
    spans = []
    for interval in intervals if isinstance(intervals, list) else [intervals]:
        lo, _, hi = interval.partition("/")
        spans.append((F.col("_t") >= _time(lo, None)) & (F.col("_t") < _time(hi, None)))
    if spans:
        df = df.filter(reduce(or_, spans))
    if "filter" in q:
        df = df.filter(_filter(q["filter"]))
    if kind in ("timeBoundary", "dataSourceMetadata"):
        return df.agg(F.min("_t").alias("minTime"), F.max("_t").alias("maxTime"))
    if kind == "scan":
        shown = df.select(*q.get("columns", [c for c in df.columns if c != "_t"]))
        return shown.limit(q["limit"]) if "limit" in q else shown
    if kind == "search":
        found = None
        for d in q["searchDimensions"]:
            rows = df.filter(F.lower(F.col(d).cast("string")).contains(q["query"]["value"].lower())).groupBy(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")).agg(F.count("*").alias("count"))
            found = rows if found is None else found.unionAll(rows)
        return found
    grain = q.get("granularity", "all")
    keys = []
    if grain != "all":
        period = grain["period"] if isinstance(grain, dict) else grain
        unit = {"P1W": "week", "P1M": "month", "P3M": "quarter", "P1Y": "year"}.get(period, period)
        if unit in ("week", "month", "quarter", "year"):
            start = us(F.date_trunc(unit, F.timestamp_micros("_t").cast("timestamp_ntz")))
        elif isinstance(grain, dict) or grain in _GRAINS:
            start = floor_to(F.col("_t"), micros(period if isinstance(grain, dict) else _GRAINS[grain]))
        else:
            raise ParseError(f"druid: unknown granularity {grain}")
        keys.append(start.alias("t"))
    dims = [q["dimension"]] if kind == "topN" else q.get("dimensions", []) if kind == "groupBy" else []
    keys += [field(d["dimension"]).alias(d.get("outputName", d["dimension"])) if isinstance(d, dict) else field(d) for d in dims]
    names = [d.get("outputName", d["dimension"]) if isinstance(d, dict) else d for d in dims]
    out = df.groupBy(*keys).agg(*[_aggregation(a).alias(a["name"] if "name" in a else a["aggregator"]["name"]) for a in q["aggregations"]])
    out = out.withColumns({p["name"]: _post(p) for p in q.get("postAggregations", [])})
    if kind == "topN":
        m = q["metric"] if isinstance(q["metric"], str) else q["metric"]["metric"]
        order = [F.col(m).asc() if isinstance(q["metric"], dict) and q["metric"].get("type") == "inverted" else F.col(m).desc(), *names]
        if grain == "all":
            return out.orderBy(*order).limit(q["threshold"])
        return out.withColumn("_r", F.row_number().over(Window.partitionBy("t").orderBy(*order))).filter(F.col("_r") <= q["threshold"]).drop("_r")
    if "having" in q:
        h = q["having"]
        c = F.col(h["aggregation"])
        out = out.filter({"greaterThan": c > h["value"], "lessThan": c < h["value"], "equalTo": c == h["value"]}[h["type"]])
    if "limitSpec" in q:
        spec = q["limitSpec"]
        out = out.orderBy(*[F.col(c["dimension"]).desc() if c.get("direction", "ascending").startswith("desc") else F.col(c["dimension"]).asc() for c in spec.get("columns", [])])
        out = out.limit(spec["limit"]) if "limit" in spec else out
    return out
