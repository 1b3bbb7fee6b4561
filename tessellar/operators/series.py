"""Functions over series in time order: differences, rates, rolling and smoothed values, anomalies, forecasts.

A series is the rows of one combination of `keys`; ties in time are broken by `ties`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import micros


#: Functions that have no value where a series starts; such rows are left out.
FIRST_UNDEFINED = ("difference", "non_negative_difference", "derivative", "non_negative_derivative", "elapsed", "moving_average")


def series(keys: list[str], ts: str, ties: list[str] = ()) -> Window:
    return (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(ts, *ties)


def difference(v: str, w: Window, periods: int = 1) -> Column:
    return F.col(v) - F.lag(v, periods).over(w)


def pct_change(v: str, w: Window, periods: int = 1) -> Column:
    """NaN where the value before is 0."""
    before = F.lag(v, periods).over(w)
    return F.when(before == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.col(v) - before, before))


def derivative(v: str, ts: str, w: Window, unit: int = 1_000_000, positive: bool = False) -> Column:
    """Change for each unit (microseconds) of time; with positive, falls give null."""
    d = F.try_divide(difference(v, w) * unit, micros(ts) - F.lag(micros(ts)).over(w))
    return F.when(d >= 0, d) if positive else d


def rise(v: str, w: Window) -> Column:
    """The increase of a counter since the row before; after a reset, the value itself."""
    d = difference(v, w)
    return F.when(d < 0, F.col(v)).otherwise(d)


def rolling(fn, v: str, w: Window, n: int) -> Column:
    """fn over the last n rows; null until there are n."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.row_number().over(w) >= n, fn(v).over(frame))


def counter_stats(df: DataFrame, keys: list[str], ts: str, v: str, ties: list[str] = ()) -> DataFrame:
    """For each series: increase, rate, irate, delta, idelta, resets, changes, deriv (least squares), twa, elapsed_ms.

    Rates are for each second between the first and last sample, without extrapolation; twa is the trapezoidal
    time-weighted mean, of a single row its value. irate and idelta are the last there are: rows at the time of the row before
    have no irate. delta is between the first and last values, and what has no value has no place in any of these.
    """
    w = series(keys, ts, ties)
    t = micros(ts)
    df = df.select(*keys, F.col(ts).alias("_ts"), F.col(v).alias("_v"), t.alias("_t"), rise(v, w).alias("_rise"), difference(v, w).alias("_d"), (t - F.lag(t).over(w)).alias("_dt"), F.lag(v).over(w).alias("_p"), *[F.col(x).alias(f"_tie_{x}") for x in ties])
    order = F.struct("_t", *[f"_tie_{x}" for x in ties])
    span = F.max("_t") - F.min("_t")
    latest = lambda x: F.max_by(x, F.when(x.isNotNull(), order))
    first, last = F.min_by("_v", F.when(F.col("_v").isNotNull(), order)), latest(F.col("_v"))
    secs = F.col("_t") / 1e6
    return df.groupBy(*keys).agg(
        F.sum("_rise").alias("increase"), F.try_divide(F.sum("_rise"), span / 1e6).alias("rate"), latest(F.try_divide(F.col("_rise"), F.col("_dt") / 1e6)).alias("irate"),
        (last - first).alias("delta"), latest(F.col("_d")).alias("idelta"), F.sum((F.col("_d") < 0).cast("long")).alias("resets"), F.sum((F.col("_d") != 0).cast("long")).alias("changes"),
        F.regr_slope("_v", secs).alias("deriv"), F.coalesce(F.try_divide(F.sum((F.col("_v") + F.col("_p")) / 2 * F.col("_dt")), F.sum("_dt")), last).alias("twa"), F.floor(span / 1000).alias("elapsed_ms"),
    )


def integral(df: DataFrame, keys: list[str], ts: str, v: str, unit: int = 1_000_000, ties: list[str] = ()) -> DataFrame:
    """The trapezoidal area under each series, in value times unit."""
    w = series(keys, ts, ties)
    return df.select(*keys, ((F.col(v) + F.lag(v).over(w)) / 2 * (micros(ts) - F.lag(micros(ts)).over(w)) / unit).alias("_a")).groupBy(*keys).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("integral"))


def _ordered(keys: list[str], ts: str, v: str, ties: list[str]):
    items = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), *[F.col(x).alias(f"k{n}") for n, x in enumerate(ties)], F.col(v).cast("double").alias("v"))))
    return items


def ema(df: DataFrame, keys: list[str], ts: str, v: str, span: int, ties: list[str] = ()) -> DataFrame:
    """Exponential moving average (alpha 2/(span+1), seeded by the first value), a row for each input row."""
    return smooth(df, keys, ts, v, 2.0 / (span + 1), ties, "ema")


def smooth(df: DataFrame, keys: list[str], ts: str, v: str, alpha: float, ties: list[str] = (), name: str = "level") -> DataFrame:
    """level = alpha * value + (1 - alpha) * level before: a true recursion, so each series is one linear pass in Arrow
    batches (an array in the JVM would be copied for every row)."""
    rows = df.select(*keys, ts, *[F.col(x).alias(f"_tie{n}") for n, x in enumerate(ties)], F.col(v).cast("double").alias(v))
    order = [ts, *[f"_tie{n}" for n in range(len(ties))]]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        part[name] = part[v].ewm(alpha=alpha, adjust=False).mean()
        return part[[*keys, ts, v, name]]

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, ts, v)) + f", `{name}` double"
    return rows.groupBy(*keys).applyInPandas(run, schema)


def forecast(df: DataFrame, keys: list[str], ts: str, v: str, steps: int, alpha: float = 0.3, band: float = 0.1, ties: list[str] = ()) -> DataFrame:
    """Simple exponential smoothing: the last level for each of the next steps, with bounds of ±band."""
    last = df.groupBy(*keys).agg(F.transform(_ordered(keys, ts, v, list(ties)), lambda x: x["v"]).alias("a"))
    level = F.aggregate(F.slice("a", 2, F.greatest(F.size("a") - 1, F.lit(0))), F.element_at("a", 1), lambda s, x: alpha * x + (1 - alpha) * s)
    return last.withColumn("forecast", level).select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), F.lit(steps).cast("long"))).alias("step"), "forecast", (F.col("forecast") * (1 - band)).alias("lower"), (F.col("forecast") * (1 + band)).alias("upper"))


def zscores(df: DataFrame, v: str, limit: float = 2.0, severe: float = 3.0) -> DataFrame:
    """Rows whose distance from the mean is over `limit` population standard deviations, with z and severity."""
    stats = df.agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s"))
    out = df.crossJoin(F.broadcast(stats)).withColumn("z", F.try_divide(F.col(v) - F.col("_m"), F.col("_s")))  # one row
    return out.filter(F.abs("z") > limit).withColumn("severity", F.when(F.abs("z") > severe, "high").otherwise("medium")).drop("_m", "_s")


def hash_sample(df: DataFrame, share: float, columns: list[str]) -> DataFrame:
    """About `share` of the rows, the same ones each time."""
    return df.filter(F.pmod(F.xxhash64(*columns), F.lit(1_000_000)) < int(share * 1_000_000))
