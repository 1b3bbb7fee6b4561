"""Scalar expressions of the plan as Spark columns."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..plans import ir

MICROS = "unix_micros(cast({0} as timestamp))"


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp column."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def stamp(us: Column) -> Column:
    return F.timestamp_micros(us.cast("long")).cast("timestamp_ntz")


def floor_to(us: Column, size: int, offset: Column | int = 0) -> Column:
    """The start of the bucket of `size` microseconds; floors, so times before 1970 are no exception."""
    return us - F.pmod(us - offset, F.lit(size))


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def haversine(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Metres on a sphere of radius 6,371,008.8 m."""
    a, b = F.radians(lat), F.radians(F.lit(lat0))
    h = F.pow(F.sin((a - b) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon) - F.radians(F.lit(lon0))) / 2), 2)
    return 2 * 6371008.8 * F.asin(F.sqrt(h))


_BINARY = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "loose_!=": lambda a, b: ~a.eqNullSafe(b), "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": F.try_divide, "%": F.try_mod,
    "&": lambda a, b: a.bitwiseAND(b), "|": lambda a, b: a.bitwiseOR(b), "^": lambda a, b: a.bitwiseXOR(b),
    "contains": lambda a, b: text(a).contains(b), "starts_with": lambda a, b: text(a).startswith(b), "ends_with": lambda a, b: text(a).endswith(b), "array_contains": lambda a, b: F.array_contains(a, b),
}

_CALLS = {
    "and": lambda *a: reduce(and_, a), "or": lambda *a: reduce(or_, a), "not": lambda a: ~a, "negate": lambda a: -a, "~": F.bitwise_not,
    "is_null": lambda a: a.isNull(), "is_not_null": lambda a: a.isNotNull(), "between": lambda a, lo, hi: a.between(lo, hi),
    "in": lambda a, *v: a.isin(*v), "loose_not_in": lambda a, *v: ~F.coalesce(a.isin(*v), F.lit(False)),
    "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "sqrt": F.sqrt, "exp": F.exp, "pow": F.pow, "power": F.pow, "ln": F.ln, "log": lambda *a: F.ln(a[0]) if len(a) == 1 else F.ln(a[1]) / F.ln(a[0]),
    "lower": F.lower, "upper": F.upper, "trim": F.trim, "concat": F.concat, "coalesce": F.coalesce, "length": lambda a: F.octet_length(a).cast("long"), "char_length": lambda a: F.length(a).cast("long"), "size": lambda a: F.size(a).cast("long"),
    "substring": F.substring, "substr": F.substring, "if": lambda c, a, b: F.when(c, a).otherwise(b), "array": lambda *a: F.array(*a), "levenshtein": lambda a, b: F.levenshtein(a, b).cast("long"),
    "array_append": F.array_append, "array_remove": F.array_remove, "array_union": F.array_union, "array_distinct": F.array_distinct, "arrays_overlap": F.arrays_overlap, "greatest": F.greatest, "least": F.least,
    "toint64": lambda a: a.cast("long"), "todouble": lambda a: a.cast("double"), "tostring": lambda a: a.cast("string"), "__time": lambda a: micros(a),
}

#: Truncation to calendar units; fixed widths otherwise.
_UNITS = ("microsecond", "millisecond", "second", "minute", "hour", "day", "week", "month", "quarter", "year")

#: Functions that callers register by name: columns in, column out.
REGISTERED: dict = {}


def register(name: str, function) -> None:
    """Make a function of columns (a pandas_udf too) known to every dialect."""
    REGISTERED[name.lower()] = function


def field(path: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def column(e, aggregate=None) -> Column:
    """A plan expression as a column. aggregate: how to lower ir.Agg, where aggregates are allowed."""
    if isinstance(e, Column):
        return e
    if isinstance(e, ir.Item):
        return column(e.expr, aggregate).alias(e.alias)
    if isinstance(e, ir.Field):
        return field(e.path)
    if isinstance(e, ir.Lit):
        return F.lit(e.value)
    if isinstance(e, ir.Agg):
        if aggregate is None:
            raise ValueError(f"aggregate {e.name} is not allowed here")
        return aggregate(e)
    if isinstance(e, ir.Over):
        return _over(e, aggregate)
    if not isinstance(e, ir.Op):
        raise ValueError(f"not an expression: {e!r}")
    name, constant = e.name, [a.value if isinstance(a, ir.Lit) else None for a in e.args]
    if name == "duration":
        return F.make_dt_interval(secs=F.lit(constant[0] / 1e6))
    if name == "bucket":  # size in microseconds, time, offset
        return stamp(floor_to(micros(column(e.args[1], aggregate)), constant[0], constant[2] if len(constant) > 2 else 0))
    if name == "trunc":
        return F.date_trunc(constant[0], column(e.args[1], aggregate)).cast("timestamp_ntz")
    if name in ("like", "ilike", "matches"):
        subject = column(e.args[0], aggregate)
        if name == "matches":
            return text(subject).rlike(constant[1])
        return text(subject).ilike(constant[1]) if name == "ilike" else subject.like(constant[1])
    if name == "cast":
        return column(e.args[0], aggregate).try_cast({"int64": "long", "float64": "double", "varchar": "string", "text": "string", "integer": "int", "float": "double"}.get(constant[1], constant[1]))
    args = [column(a, aggregate) for a in e.args]
    if name == "round":
        return F.round(args[0], constant[1] if len(args) > 1 else 0)
    if name == "case":
        tests = list(zip(args[::2], args[1::2]))
        out = reduce(lambda w, t: w.when(*t), tests[1:], F.when(*tests[0]))
        return out.otherwise(args[-1]) if len(args) % 2 else out
    if name in _BINARY and len(args) == 2:
        return _BINARY[name](*args)
    if name in _CALLS:
        return _CALLS[name](*args)
    if name in REGISTERED:
        return REGISTERED[name](*args)
    return F.call_function(name, *args)


def sort_key(k: ir.Key, aggregate=None) -> Column:
    c = column(k.expr, aggregate)
    nulls = k.nulls or ("last" if k.descending else "first")
    return getattr(c, f"{'desc' if k.descending else 'asc'}_nulls_{nulls}")()


#: Functions of OVER that give a place, as 64-bit numbers.
_PLACES = ("row_number", "rank", "dense_rank", "ntile")


def _over(e: ir.Over, aggregate) -> Column:
    from . import aggregates

    parts = [column(x, aggregate) for x in e.partition] or [F.lit(0)]
    w = Window.partitionBy(*parts)
    if e.order:
        w = w.orderBy(*[sort_key(k, aggregate) for k in e.order])
    elif e.call.name in (*_PLACES, "lag", "lead", "percent_rank", "cume_dist"):
        raise ValueError(f"{e.call.name} needs ORDER BY in OVER")
    if e.frame:
        kind, first, last = e.frame
        bounds = (Window.unboundedPreceding if first is None else first, Window.unboundedFollowing if last is None else last)
        w = w.rowsBetween(*bounds) if kind == "rows" else w.rangeBetween(*bounds)
    args = [column(a, aggregate) for a in e.call.args]
    if isinstance(e.call, ir.Agg):
        if e.call.name in ("first", "last"):
            return (F.first if e.call.name == "first" else F.last)(*args).over(w)
        return aggregates.lower(e.call.name, args, e.call.params, e.call.distinct, F.lit(0)).over(w)
    out = F.call_function(e.call.name, *args).over(w)
    return out.cast("long") if e.call.name in _PLACES else out
