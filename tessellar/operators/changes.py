"""Changes to a table as new versions of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(old: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows may lack columns (null) and bring new ones."""
    known = dict(old.dtypes)
    rows = rows.select(*[F.col(c).cast(known[c]).alias(c) if c in known else F.col(c) for c in rows.columns])
    return old.unionByName(rows, allowMissingColumns=True)


def update(old: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    known = dict(old.dtypes)
    return old.withColumns({c: F.when(hit, v.cast(known[c]) if c in known else v).otherwise(F.col(c) if c in known else F.lit(None)) for c, v in values.items()})


def delete(old: DataFrame, where: Column) -> DataFrame:
    return old.filter(~F.coalesce(where, F.lit(False)))


def soft_delete(old: DataFrame, where: Column, flag: str = "_deleted") -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return old.withColumn(flag, hit | F.col(flag) if flag in old.columns else hit)


def upsert(old: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """New rows take the place of old ones with their keys."""
    return old.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def difference(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Change events between two versions: keys, op (insert, update, delete), and the rows before and after."""
    rest = [c for c in new.columns if c not in keys]
    a = old.select(*keys, F.struct(*rest).alias("before"))
    b = new.select(*keys, F.struct(*rest).alias("after"))
    both = a.join(b, keys, "full")
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").when(~F.col("before").eqNullSafe(F.col("after")), "update")
    return both.withColumn("op", op).filter("op is not null").select(*keys, "op", "before", "after")
