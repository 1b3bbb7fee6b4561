"""Aggregates of the plan as Spark columns. `order` is the time column; ties in time are broken by the value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import REGISTERED, micros


def _at(v: Column, order: Column, last: bool) -> Column:
    """The value at the first or last time at which there is one."""
    key = F.when(v.isNotNull(), F.struct(order, v))
    return F.max_by(v, key) if last else F.min_by(v, key)


def truncated_percentile(v: Column, p: float) -> Column:
    """The element at position trunc(p/100 * (n-1)) of the sorted values."""
    values = F.sort_array(F.collect_list(v))
    return F.get(values, F.floor(F.lit(p / 100.0) * (F.size(values) - 1)).cast("int"))


#: Aggregates over each row and the one before it in time; their arguments are the value, that of the row before and the
#: seconds since it.
NEIGHBOURS = {"twa", "integral", "irate", "increase", "idelta", "resets", "changes"}


def neighbours(name: str, args: list[Column], params: tuple, order: Column) -> Column:
    v, before, secs = args
    rise, area = F.when(v < before, v).otherwise(v - before), F.sum((v + before) / 2 * secs)
    if name == "twa":  # of a single row, its value
        return F.coalesce(F.try_divide(area, F.sum(F.when(before.isNotNull(), secs))), _at(v, order, True))
    if name == "integral":  # per second, or in units of so many microseconds
        return F.coalesce(area, F.lit(0.0)) / (params[0] / 1e6 if params else 1.0)
    if name == "irate":
        return _at(F.try_divide(rise, secs), order, True)
    if name == "increase":
        return F.sum(rise)
    if name == "idelta":
        return _at(v - before, order, True)
    return F.coalesce(F.sum((v < before if name == "resets" else v != before).cast("long")), F.lit(0))


def lower(name: str, args: list[Column], params: tuple, distinct: bool, order: Column) -> Column:
    v = args[0] if args else None
    if name in REGISTERED:
        return REGISTERED[name](*args)
    if name in NEIGHBOURS:
        return neighbours(name, args, params, order)
    if name == "count":
        return F.count(F.lit(1)) if v is None else F.count_distinct(*args) if distinct else F.count(v)
    if name in ("count_distinct", "uniqexact", "hyperloglog"):
        return F.count_distinct(*args)
    if name in ("approx_count_distinct", "uniq"):
        return F.approx_count_distinct(v)
    if name in ("first", "last"):
        return _at(v, order, name == "last")
    if name == "last_row":
        return F.max_by(v, F.struct(order, v))
    if name in ("arg_min", "arg_max"):
        return F.min_by(*args) if name == "arg_min" else F.max_by(*args)
    if name in ("array_agg", "grouparray"):
        return F.sort_array(F.collect_list(v))
    if name in ("unique", "groupuniqarray"):
        return F.sort_array(F.collect_set(v))
    if name == "string_agg":
        return F.array_join(F.sort_array(F.collect_list(v.cast("string"))), params[0] if params else ", ")
    if name in ("percentile", "apercentile"):
        return truncated_percentile(v, params[0])
    if name in ("percentile_cont", "quantile", "median"):
        return F.percentile(v, 0.5 if name == "median" else params[0])
    if name in ("top", "bottom"):
        return F.slice(F.sort_array(F.collect_list(v), name == "bottom"), 1, int(params[0]))
    if name == "diff":
        return F.when(F.count(v) > 1, _at(v, order, True) - _at(v, order, False))
    if name == "derivative":  # per second, first to last
        return F.try_divide(_at(v, order, True) - _at(v, order, False), (F.max(micros(order)) - F.min(micros(order))) / 1e6)
    if name == "elapsed":  # milliseconds
        return ((F.max(micros(order)) - F.min(micros(order))) / 1000).cast("long")
    if name == "spread":
        return F.max(v) - F.min(v)
    if name == "mode":
        return F.mode(v, True)
    if name == "sum0":
        return F.coalesce(F.sum(v), F.lit(0))
    plain = {
        "sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "any": F.min, "stddev": F.stddev_pop, "stddev_pop": F.stddev_pop, "stddev_samp": F.stddev_samp,
        "variance": F.var_pop, "var_pop": F.var_pop, "var_samp": F.var_samp,
    }
    if name not in plain:
        raise ValueError(f"unknown aggregate {name}")
    return F.sum_distinct(v) if distinct and name == "sum" else plain[name](v)
