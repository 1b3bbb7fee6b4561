"""Nested-function targets over dotted series names, such as summarize(events.click.*, '1h', 'avg')."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.scalars import floor_to
from ..functions.scalars import micros as us
from ..operators import series
from ..plans.durations import micros
from ..plans.grammar import ParseError

_TOKEN = re.compile(r"\s*(?:(?P<str>'[^']*'|\"[^\"]*\")|(?P<num>-?\d+(?:\.\d+)?(?![\w.*]))|(?P<path>(?:[\w*?\[\]\-.]|\{[^}]*\})+)|(?P<sign>[(),]))")


def parse(text: str):
    """Tuples (function, arguments); paths are ('path', text)."""
    found = list(_TOKEN.finditer(text))
    toks, at = [(m.lastgroup, m.group(m.lastgroup)) for m in found], 0

    def node():
        nonlocal at
        if at >= len(toks):
            raise ParseError("graphite: the target ends too early")
        kind, t = toks[at]
        at += 1
        if kind == "str":
            return t[1:-1]
        if kind == "num":
            return float(t)
        if kind == "path" and at < len(toks) and toks[at][1] == "(":
            at += 1
            args = []
            while toks[at][1] != ")":
                args.append(node())
                if toks[at][1] == ",":
                    at += 1
            at += 1
            return (t, args)
        if kind != "path":
            raise ParseError(f"graphite: unexpected {t!r}")
        return {"true": True, "false": False}.get(t, ("path", t))

    out = node()
    if at != len(toks):
        raise ParseError("graphite: unexpected text after the target")
    return out


def _glob(segment: str) -> str:
    s = re.sub(r"\{([^}]*)\}", lambda m: "(" + m.group(1).replace(",", "|") + ")", segment)
    return "^" + s.replace("*", ".*").replace("?", ".") + "$"


_FNS = {"avg": F.avg, "average": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": lambda c: F.count(c).cast("double"), "last": lambda c: F.max_by(c, "t"), "first": lambda c: F.min_by(c, "t"), "median": lambda c: F.percentile(c, 0.5)}


def run(catalog: Catalog, text: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Columns series, t (microseconds), v. A path is table.tag.tag..., with globs; left-out tags are combined.

    sumSeries and its like combine the samples of all their arguments; other functions take one path or function of one.
    """

    def ev(e) -> DataFrame:
        name, args = e
        if name == "path":
            table, *parts = args.split(".")
            t = catalog[table]
            df = catalog.frame(table)
            for tag, part in zip(t.tags, parts):
                df = df.filter(F.col(tag).cast("string").rlike(_glob(part)))
            label = F.concat_ws(".", F.lit(table), *[F.col(x).cast("string") for x in t.tags[: len(parts)]])
            df = df.select(label.alias("series"), us(t.time).alias("t"), F.col(t.value).cast("double").alias("v"))
            if start is not None:
                df = df.filter(F.col("t") >= start)
            return df.filter(F.col("t") < end) if end is not None else df
        low = name.lower()
        combined = low in ("sumseries", "sum", "averageseries", "avg", "minseries", "min", "maxseries", "max")
        paths = [a for a in args if isinstance(a, tuple)]
        if not args or not isinstance(args[0], tuple):
            raise ParseError(f"graphite: {name} begins with a path or a function of one")
        if len(paths) > 1 and not combined or combined and len(paths) < len(args):
            raise ParseError(f"graphite: {name} has no use for some of its arguments")
        df = reduce(DataFrame.unionByName, map(ev, paths))
        w = Window.partitionBy("series").orderBy("t")
        rest = args[1:]
        if low in ("summarize", "smartsummarize"):
            fn = _FNS[rest[1] if len(rest) > 1 else "sum"]
            return df.groupBy("series", floor_to(F.col("t"), micros(rest[0])).alias("w")).agg(fn("v").alias("v")).withColumnRenamed("w", "t")
        one = {
            "scale": lambda: F.col("v") * rest[0], "offset": lambda: F.col("v") + rest[0], "absolute": lambda: F.abs("v"), "abs": lambda: F.abs("v"), "derivative": lambda: series.difference("v", w), "nonnegativederivative": lambda: F.when(series.difference("v", w) >= 0, series.difference("v", w)),
            "integral": lambda: F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), "movingaverage": lambda: series.rolling(F.avg, "v", w, int(rest[0])), "movingmedian": lambda: series.rolling(lambda c: F.percentile(c, 0.5), "v", w, int(rest[0])),
            "persecond": lambda: F.try_divide(series.difference("v", w) * 1_000_000, F.col("t") - F.lag("t").over(w)),
        }
        if low in one:
            return df.withColumn("v", one[low]()).filter(F.col("v").isNotNull())
        if low == "alias":
            return df.withColumn("series", F.lit(rest[0]))
        if low in ("aliasbynode",):
            return df.withColumn("series", F.concat_ws(".", *[F.get(F.split("series", r"\."), F.lit(int(n))) for n in rest]))
        if combined:
            fn = _FNS[low.removesuffix("series")]
            return df.groupBy("t").agg(fn("v").alias("v")).select(F.lit(f"{low}").alias("series"), "t", "v")
        m = re.fullmatch(r"(highest|lowest)(current|max|min|average)", low)
        if m:
            fn = {"current": lambda c: F.max_by(c, "t"), "max": F.max, "min": F.min, "average": F.avg}[m.group(2)]
            rank = df.groupBy("series").agg(fn("v").alias("s"))
            top = rank.orderBy(F.col("s").desc() if m.group(1) == "highest" else F.col("s").asc(), "series").limit(int(rest[0]) if rest else 1)
            return df.join(F.broadcast(top.select("series")), "series", "left_semi")  # as many rows as the target asks for
        raise ParseError(f"graphite: unknown function {name}")

    tree = parse(text)
    if not isinstance(tree, tuple):
        raise ParseError("graphite: a target is a path or a function of one")
    return ev(tree).select("series", "t", "v")
