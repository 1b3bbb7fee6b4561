"""Pipe queries: from |> range |> filter |> aggregateWindow |> ... over a table with tags and a value column."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.scalars import column, floor_to
from ..functions.scalars import micros as us
from ..operators import series, windows
from ..plans.durations import micros
from ..plans.grammar import Dialect, ParseError, Parser

_CALL = re.compile(r"\s*(\w+)\s*\(")


def calls(text: str) -> list[tuple[str, str]]:
    """The pipe's functions with the text of their arguments."""
    out, at = [], 0
    text = re.sub(r"//[^\n]*", "", text).strip()
    while at < len(text):
        m = _CALL.match(text, at)
        if not m:
            raise ParseError(f"flux: expected a function at {text[at : at + 20]!r}")
        depth, end, quoted = 1, m.end(), False
        while depth and end < len(text):
            c = text[end]
            quoted ^= c == '"'
            depth += 0 if quoted else (c in "([{") - (c in ")]}")
            end += 1
        if depth:
            raise ParseError("flux: a bracket is not closed")
        out.append((m.group(1), text[m.end() : end - 1]))
        pipe = re.compile(r"\s*\|>").match(text, end)
        if not pipe:
            if text[end:].strip():
                raise ParseError(f"flux: unexpected {text[end:].strip()[:20]!r}")
            break
        at = pipe.end()
    return out


def arguments(text: str) -> dict[str, str]:
    out, depth, part, quoted = {}, 0, "", False
    for c in text + ",":
        quoted ^= c == '"'
        depth += 0 if quoted else (c in "([{") - (c in ")]}")
        if c == "," and depth == 0 and not quoted:
            if part.strip():
                k, _, v = part.partition(":")
                out[k.strip()] = v.strip()
            part = ""
        else:
            part += c
    return out


def _strings(text: str) -> list[str]:
    return re.findall(r'"([^"]*)"', text)


def _predicate(text: str):
    """fn: (r) => r.a == "x" and r._value > 3"""
    body = re.sub(r"^\(\s*r\s*\)\s*=>\s*", "", text.strip())
    body = re.sub(r'r\[\s*"(\w+)"\s*\]', r"r.\1", body)
    body = re.sub(r"=~\s*/((?:[^/\\]|\\.)*)/", lambda m: "=~ '" + m.group(1).replace("\\/", "/") + "'", body)
    body = re.sub(r'"([^"]*)"', lambda m: "'" + m.group(1).replace("'", "''") + "'", body)
    body = re.sub(r"\br\.", "", body)
    p = Parser(body, Dialect("flux"))
    e = p.expression()
    p.done()
    return e


def run(catalog: Catalog, text: str, now: int | None = None) -> DataFrame:
    """Columns: the group's keys, _time (microseconds), _value. `now` (microseconds) anchors relative ranges.

    window() adds the window's _start (microseconds) to the group's keys, until window(every: inf) or group().
    """
    steps = calls(text)
    if not steps or steps[0][0] != "from":
        raise ParseError("flux: a query begins with from(bucket: ...)")
    source = _strings(steps[0][1])[0]
    named = next((m for _, a in steps for m in re.findall(r'r\._measurement\s*==\s*"([^"]+)"', a) or re.findall(r'r\["_measurement"\]\s*==\s*"([^"]+)"', a)), source)
    t = catalog[named]
    keys = [k for k in t.tags]
    df = catalog.frame(named).select(*keys, us(t.time).alias("_t"), F.col(t.value).cast("double").alias("_value"), F.lit(named).alias("_measurement"), F.lit(t.value).alias("_field"))
    order: list = []
    for name, raw in steps[1:]:
        a = arguments(raw)
        w = Window.partitionBy(*keys).orderBy("_t")
        if name == "range":
            for k, op in (("start", ">="), ("stop", "<")):
                if k in a:
                    df = df.filter(F.col("_t") >= _time(a[k], now) if op == ">=" else F.col("_t") < _time(a[k], now))
        elif name == "filter":
            df = df.filter(column(_predicate(a["fn"])))
        elif name == "group":
            keys = _strings(a.get("columns", ""))
        elif name == "window":
            if set(a) != {"every"}:
                raise ParseError("flux: window takes `every` alone")
            keys = [k for k in keys if k != "_start"]
            if a["every"] != "inf":
                df, keys = df.withColumn("_start", floor_to(F.col("_t"), micros(a["every"]))), [*keys, "_start"]
        elif name == "aggregateWindow":
            size, fn = micros(a["every"]), _fn(a["fn"])
            df = df.withColumn("_w", floor_to(F.col("_t"), size)).groupBy(*keys, "_w").agg(fn.alias("_value"))
            if a.get("createEmpty") == "true":
                df = windows.gap_fill(df, keys, size, ["_value"], "null")
            df = df.withColumnRenamed("_w", "_t")
        elif name == "fill":
            new = F.last("_value", True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if a.get("usePrevious") == "true" else F.coalesce("_value", F.lit(float(a["value"])))
            df = df.withColumn("_value", new)
        elif name in ("derivative", "difference", "cumulativeSum", "movingAverage", "increase", "elapsed"):
            step = (F.col("_t") - F.lag("_t").over(w))
            new = {
                "difference": lambda: series.difference("_value", w), "derivative": lambda: F.try_divide(series.difference("_value", w) * micros(a.get("unit", "1s")), step), "cumulativeSum": lambda: F.sum("_value").over(w.rowsBetween(Window.unboundedPreceding, 0)),
                "movingAverage": lambda: series.rolling(F.avg, "_value", w, int(a["n"])), "increase": lambda: F.sum(series.rise("_value", w)).over(w.rowsBetween(Window.unboundedPreceding, 0)), "elapsed": lambda: step / micros(a.get("unit", "1s")),
            }[name]()
            df = df.withColumn("_value", F.when(new >= 0, new) if a.get("nonNegative") == "true" else new)
            df = df if name == "cumulativeSum" else df.filter(F.col("_value").isNotNull())
        elif name in ("mean", "sum", "count", "min", "max", "first", "last", "median", "stddev", "spread"):
            df = df.groupBy(*keys).agg(_fn(name).alias("_value"), F.max("_t").alias("_t"))
        elif name == "map":
            body = re.search(r"_value\s*:\s*([^,}]+)", raw)
            if not body:
                raise ParseError("flux: map must set _value")
            df = df.withColumn("_value", column(_predicate(body.group(1))).cast("double"))
        elif name == "sort":
            names = [{"_time": "_t"}.get(c, c) for c in _strings(a.get("columns", '"_value"'))]
            order = [F.col(c).desc() if a.get("desc") == "true" else F.col(c).asc() for c in names]
            df = df.orderBy(*order)
        elif name in ("limit", "top", "bottom"):
            by = order if name == "limit" and order else [F.col("_value").desc(), "_t"] if name == "top" else [F.col("_value").asc(), "_t"] if name == "bottom" else ["_t"]
            df = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter(F.col("_r") <= int(a["n"])).drop("_r")
        elif name != "yield":
            raise ParseError(f"flux: unknown function {name}")
    return df.select(*keys, F.col("_t").alias("_time"), "_value")


def _fn(name: str):
    fns = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "median": lambda c: F.percentile(c, 0.5), "stddev": F.stddev_samp, "spread": lambda c: F.max(c) - F.min(c), "first": lambda c: F.min_by(c, "_t"), "last": lambda c: F.max_by(c, "_t")}
    if name not in fns:
        raise ParseError(f"flux: unknown aggregate {name}")
    return fns[name]("_value")


def _time(text: str, now: int | None) -> int:
    s = text.strip().strip('"')
    if s.startswith("-"):
        if now is None:
            raise ParseError("flux: a relative range needs `now`")
        return now - micros(s[1:])
    if s == "now()":
        return now
    if re.fullmatch(r"\d+", s):
        return int(s) * 1_000_000
    from datetime import datetime, timezone

    d = datetime.fromisoformat(s.replace("Z", "+00:00"))
    return int((d if d.tzinfo else d.replace(tzinfo=timezone.utc)).timestamp() * 1_000_000)
