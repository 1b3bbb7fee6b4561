"""Time windows. Each function adds what tells windows apart, or groups by it; times are microseconds (`_t`).

Windows that depend on neighbours (session, state, event, count) need the rows of a series in order: give keys that
part the series, so that they are spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import floor_to


def _series(keys: list[str]) -> Window:
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def _with_origin(df: DataFrame, keys: list[str], origin: Column) -> DataFrame:
    """Adds `_o`, an aggregate of each series, by aggregation and join rather than by a window over raw rows."""
    least = df.groupBy(*keys).agg(origin.alias("_o"))
    return df.join(least, keys) if keys else df.crossJoin(F.broadcast(least))  # one row


def assign_interval(df: DataFrame, keys: list[str], size: int, slide: int = 0, offset: int = 0, align_first: bool = False) -> DataFrame:
    """Adds `_w`, the start of the window, and `_e`, its end; a row of several sliding windows is repeated.

    Tumbling windows start at multiples of size past the offset, or at the first row of the series. Sliding ones start
    at the aligned start of the first row and go on by slide, whether or not it divides size; none starts earlier.
    """
    if not slide or slide == size:
        if align_first:
            df = _with_origin(df, keys, F.min("_t"))
            return df.withColumn("_w", floor_to(F.col("_t"), size, F.col("_o"))).withColumn("_e", F.col("_w") + size).drop("_o")
        return df.withColumn("_w", floor_to(F.col("_t"), size, offset)).withColumn("_e", F.col("_w") + size)
    df = _with_origin(df, keys, floor_to(F.min("_t"), size, offset))
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("_t") - F.col("_o") - size) / slide) + 1)
    last = F.floor((F.col("_t") - F.col("_o")) / slide)
    df = df.filter(first <= last).withColumn("_k", F.explode(F.sequence(first, last)))
    return df.withColumn("_w", F.col("_o") + F.col("_k") * slide).withColumn("_e", F.col("_w") + size).drop("_o", "_k")


def assign_session(df: DataFrame, keys: list[str], gap: int, ties: list[str]) -> DataFrame:
    """Adds `_g`: a new session where the gap to the row before is more than `gap`."""
    w = _series(keys).orderBy("_t", *ties)
    return df.withColumn("_n", F.coalesce((F.col("_t") - F.lag("_t").over(w) > gap).cast("long"), F.lit(0))).withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_n")


def assign_state(df: DataFrame, keys: list[str], state: Column, ties: list[str]) -> DataFrame:
    """Adds `_g`: runs of one state. Null is a state of its own."""
    w = _series(keys).orderBy("_t", *ties)
    df = df.withColumn("_s", state)
    turn = F.when(F.row_number().over(w) == 1, 0).otherwise((~F.col("_s").eqNullSafe(F.lag("_s").over(w))).cast("int"))
    return df.withColumn("_n", turn).withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_n")


def assign_event(df: DataFrame, keys: list[str], start: Column, end: Column, ties: list[str], least: int = 0) -> DataFrame:
    """Adds `_g`: windows from a row where start holds to the next (or same) row where end holds; others are dropped."""
    w = _series(keys).orderBy("_t", *ties)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_b", F.coalesce(start, F.lit(False))).withColumn("_f", F.coalesce(end, F.lit(False)))
    df = df.withColumn("_g", F.coalesce(F.sum(F.col("_f").cast("int")).over(before), F.lit(0)))
    inner = Window.partitionBy(*keys, "_g").orderBy("_t", *ties)
    df = df.withColumn("_open", F.max(F.col("_b").cast("int")).over(inner.rowsBetween(Window.unboundedPreceding, 0))).filter("_open = 1")
    whole = Window.partitionBy(*keys, "_g")
    df = df.withColumn("_c", F.max(F.col("_f").cast("int")).over(whole)).filter("_c = 1")
    if least:
        df = df.withColumn("_d", F.max("_t").over(whole) - F.min("_t").over(whole)).filter(F.col("_d") >= least).drop("_d")
    return df.drop("_b", "_f", "_open", "_c")


def assign_count(df: DataFrame, keys: list[str], size: int, slide: int, ties: list[str]) -> DataFrame:
    """Adds `_g`: windows of `size` rows, a new one each `slide` rows; the last may be short."""
    df = df.withColumn("_i", (F.row_number().over(_series(keys).orderBy("_t", *ties)) - 1).cast("long"))
    slide = slide or size
    if slide == size:
        return df.withColumn("_g", F.floor(F.col("_i") / size)).drop("_i")
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("_i") - size + slide) / slide))
    last = F.floor(F.col("_i") / slide)
    return df.filter(first <= last).withColumn("_g", F.explode(F.sequence(first, last))).drop("_i")


def interpolate(df: DataFrame, keys: list[str], value: str, step: int, mode: str, ties: list[str]) -> DataFrame:
    """Values at the multiples of `step` (`_w`) from the first row of a series to its last: the value at that time, or
    what `mode` makes of the rows around it. Of rows at one time the last counts."""
    at = df.groupBy(*keys, "_t").agg(F.max_by(value, F.struct(*ties, value)).alias(value))
    ends = at.groupBy(*keys).agg(F.min("_t").alias("_a"), F.max("_t").alias("_z")).filter("_a is not null")
    first, last = -floor_to(-F.col("_a"), step), floor_to(F.col("_z"), step)
    grid = ends.filter(first <= last).select(*keys, F.explode(F.sequence(first, last, F.lit(step).cast("long"))).alias("_t"))
    both = at.withColumn("_grid", F.lit(False)).unionByName(grid.withColumn("_grid", F.lit(True)), allowMissingColumns=True)
    both = both.groupBy(*keys, "_t").agg(F.max(value).alias(value), F.max("_grid").alias("_grid")).withColumnRenamed("_t", "_w")
    return fill_around(both, keys, {value: mode}).filter("_grid").drop("_grid")


def gap_fill(df: DataFrame, keys: list[str], step: int, values: list[str], mode: str | dict[str, str], value: float | None = None, lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """Rows for the empty buckets of each series between its first and last `_w`, or further to lo and hi, filled by mode
    (one for all columns, or one for each by name; a column that isn't named stays empty).

    null leaves them empty; value sets a constant; prev and next repeat a neighbour; linear weighs both by distance in
    time; nearest takes the closer one, the earlier on a tie. What has no neighbour on a needed side stays null.
    """
    if mode == "none":
        return df
    bounds = df.groupBy(*keys).agg(F.min("_w").alias("_a"), F.max("_w").alias("_z"))
    if lo is not None:
        bounds = bounds.withColumn("_a", F.least("_a", lo))
    if hi is not None:
        bounds = bounds.withColumn("_z", F.greatest("_z", hi))
    grid = bounds.filter("_a is not null").select(*keys, F.explode(F.sequence("_a", "_z", F.lit(step))).alias("_w"))
    on = [*keys, "_w"]
    if keys:
        left, right = grid.alias("g"), df.alias("d")
        cond = [F.col(f"g.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys] + [F.col("g._w") == F.col("d._w")]
        out = left.join(right, cond, "left").select(*[F.col(f"g.{k}") for k in on], *[F.col(f"d.{v}") for v in values])
    else:
        out = grid.join(df, "_w", "left").select("_w", *values)
    return fill_around(out, keys, mode if isinstance(mode, dict) else dict.fromkeys(values, mode), value)


def fill_around(out: DataFrame, keys: list[str], modes: dict[str, str], value: float | None = None) -> DataFrame:
    """Fills the nulls of each named column, in the order of `_w` within a series."""
    # The next value is the last one in falling order: a growing frame takes one pass, a shrinking one would start anew
    # at every row.
    back, ahead = (_series(keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0) for order in (F.col("_w"), F.col("_w").desc()))
    filled = {}
    for v, mode in modes.items():
        has = F.col(v).isNotNull()
        if mode == "null":
            continue
        if mode == "value":
            filled[v] = F.coalesce(v, F.lit(value))
            continue
        p, n = F.last(v, True).over(back), F.last(v, True).over(ahead)
        if mode == "prev":
            filled[v] = p
        elif mode == "next":
            filled[v] = n
        else:
            pw, nw = F.last(F.when(has, F.col("_w")), True).over(back), F.last(F.when(has, F.col("_w")), True).over(ahead)
            if mode == "linear":
                filled[v] = F.when(has, F.col(v)).otherwise(p + (n - p) * F.try_divide(F.col("_w") - pw, nw - pw))
            elif mode == "nearest":
                filled[v] = F.when(p.isNull() | (nw - F.col("_w") < F.col("_w") - pw), F.coalesce(n, p)).otherwise(p)
            elif mode == "mean":  # the mean of both neighbours; at an edge the one there is
                filled[v] = F.when(has, F.col(v)).otherwise((F.coalesce(p, n) + F.coalesce(n, p)) / 2)
            else:
                raise ValueError(f"unknown fill {mode}")
    return out.withColumns(filled) if filled else out
