"""Joins: by equal keys, nested lookups, and joins of two time series."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def equi(left: DataFrame, right: DataFrame, how: str, pairs: list[tuple[str, str]], null_safe: bool = False, clash: str = "right_") -> DataFrame:
    """Join on equal columns. Columns of the right side that the left has too get a prefix, but for shared key names."""
    how = {"semi": "left_semi", "anti": "left_anti", "outer": "full"}.get(how, how)
    keys = [a for a, _ in pairs] if not null_safe and all(a == b for a, b in pairs) else []
    names = renames(left.columns, right.columns, keys, clash)
    renamed = right.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    if how == "cross":
        return left.crossJoin(renamed)
    if keys:
        return left.join(renamed, keys, how)
    same = (lambda a, b: left[a].eqNullSafe(renamed[names[b]])) if null_safe else (lambda a, b: left[a] == renamed[names[b]])
    return left.join(renamed, reduce(and_, [same(a, b) for a, b in pairs]), how)


def renames(left: list[str], right: list[str], keys: list[str], clash: str = "right_") -> dict[str, str]:
    """What the right side's columns are called after a join: those that the left has too get the prefix, as often as it
    takes; shared keys keep their name."""
    names, taken = {}, set(left) | {c for c in right if c not in left}
    for c in right:
        n = c
        while c not in keys and c in left and n in taken:
            n = clash + n
        names[c] = n
        taken.add(n)
    return names


def not_in(df: DataFrame, value, sub: DataFrame) -> DataFrame:
    """value NOT IN (sub) by three-valued logic: a null in sub excludes every row, a null value every row unless sub is
    empty. An equi anti join and one row of counts, so that no side has to fit in memory."""
    sub = sub.select(F.col(f"`{sub.columns[0]}`").alias("_in"))
    counts = sub.agg(F.count(F.lit(1)).alias("n"), F.count("_in").alias("m"))
    all_of, known = counts.select("n").scalar(), counts.select("m").scalar()
    df = df.withColumn("_value", value)
    out = df.join(sub, F.col("_value") == F.col("_in"), "left_anti").filter((all_of == 0) | (F.col("_value").isNotNull() & (all_of == known)))
    return out.drop("_value")


def prefixed(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on one shared key with every column named left_* or right_*."""
    a = left.select(*[F.col(c).alias(f"left_{c}") for c in left.columns])
    b = right.select(*[F.col(c).alias(f"right_{c}") for c in right.columns])
    return a.join(b, F.col(f"left_{key}") == F.col(f"right_{key}"), how)


def lookup(left: DataFrame, right: DataFrame, local: str, foreign: str, name: str) -> DataFrame:
    """Each left row with an array of its matches; a missing local value matches missing foreign ones. The right side is
    nested before the join, so a row is never repeated."""
    nested = right.groupBy(F.col(foreign).alias("_f")).agg(F.sort_array(F.collect_list(F.struct(*right.columns))).alias(name))
    out = left.join(nested, left[local].eqNullSafe(nested["_f"]), "left").drop("_f")
    return out.withColumn(name, F.coalesce(name, F.array()))


def time_join(left: DataFrame, right: DataFrame, by: list[tuple[str, str]], left_ts: str, right_ts: str, kind: str = "asof", prefix: str = "right_") -> DataFrame:
    """For each left row the last right row at or before it (asof) or before it (lt), by one ordered pass over both.

    splice also gives each right row its last left row. Rows of equal time and side are ordered by their content.
    """
    if not by:
        left, right, by = left.withColumn("_by", F.lit(0)), right.withColumn("_by", F.lit(0)), [("_by", "_by")]
    keys = [a for a, _ in by]
    pack = lambda df: F.struct(*[c for c in df.columns if c != "_by"])
    l_rows = left.select(*[F.col(a).alias(f"_k{n}") for n, (a, _) in enumerate(by)], F.col(left_ts).alias("_t"), F.lit(1 if kind == "asof" else 0).alias("_r"), pack(left).alias("_l"), F.lit(None).cast(right.select(pack(right)).schema[0].dataType).alias("_rr"))
    r_rows = right.select(*[F.col(b).alias(f"_k{n}") for n, (_, b) in enumerate(by)], F.col(right_ts).alias("_t"), F.lit(0 if kind == "asof" else 1).alias("_r"), F.lit(None).cast(left.select(pack(left)).schema[0].dataType).alias("_l"), pack(right).alias("_rr"))
    both = l_rows.unionByName(r_rows)
    part = Window.partitionBy(*[f"_k{n}" for n in range(len(keys))])
    w = part.orderBy("_t", "_r", "_l", "_rr").rowsBetween(Window.unboundedPreceding, 0)
    if kind == "splice":
        out = both.withColumn("_x", F.last("_l", True).over(w)).withColumn("_y", F.last("_rr", True).over(w))
    else:
        out = both.withColumn("_y", F.last("_rr", True).over(w)).filter(F.col("_l").isNotNull()).withColumn("_x", F.col("_l"))
    return out.select(*[F.col(f"_x.{c}").alias(c) for c in left.columns if c != "_by"], *[F.col(f"_y.{c}").alias(prefix + c) for c in right.columns if c != "_by"])
