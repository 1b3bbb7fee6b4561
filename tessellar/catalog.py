"""Names of tables, and what the engine knows of each: its time column, tags and value column."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Table:
    frame: DataFrame
    time: str = ""
    tags: tuple[str, ...] = ()
    value: str = ""
    deleted: str = ""
    key: tuple[str, ...] = ()  # what a newer version of a row replaces
    version: str = ""


class Catalog:
    """Tables by name, opened when first asked for. Changes never touch data: they put a new version under the name."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}
        self.streams, self.databases = {}, set()  # stream -> (target, plan, options)

    def add(self, name: str, frame: DataFrame, **known) -> Catalog:
        self.tables[name] = Table(frame, **known)
        return self

    def folder(self, path: str, names: list[str] | None = None) -> Catalog:
        """Register name.parquet for each name."""
        known = {"events": {"time": "ts", "tags": ("event_type", "user_id"), "value": "value"}}
        for name in names or ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages"):
            self.tables[name] = lambda name=name: Table(self.spark.read.parquet(f"{path}/{name}.parquet"), **known.get(name, {}))
        return self

    def __getitem__(self, name: str) -> Table:
        if name not in self.tables:
            raise KeyError(f"no table {name!r}; known: {', '.join(sorted(self.tables))}")
        if callable(self.tables[name]):
            self.tables[name] = self.tables[name]()
        return self.tables[name]

    def frame(self, name: str) -> DataFrame:
        """The rows of a table, without those marked as deleted."""
        t = self[name]
        return t.frame.filter(~F.coalesce(t.deleted, F.lit(False))) if t.deleted else t.frame

    def replace(self, name: str, frame: DataFrame) -> None:
        self.tables[name] = replace(self[name], frame=frame) if name in self.tables else Table(frame)

    def drop(self, name: str, kind: str = "table", lenient: bool = False) -> None:
        """Forget a name. Dropping a stream leaves its target; an index was never kept."""
        if kind == "index":
            return
        if kind == "database":
            if name not in self.databases and not lenient:
                raise KeyError(f"no database {name!r}")
            return self.databases.discard(name)
        names = self.streams if kind == "stream" else self.tables
        if name not in names and not lenient:
            raise KeyError(f"no {kind} {name!r}")
        names.pop(name, None)

    def describe(self, name: str) -> DataFrame:
        t = self[name]
        rows = [(c, k, "time" if c == t.time else "tag" if c in t.tags else "field") for c, k in t.frame.dtypes]
        return self.spark.createDataFrame(rows, "name string, type string, role string")

    def show(self, kind: str, name: str = "") -> DataFrame:
        """tables, measurements, tag keys, field keys, or the values of a tag ('tag values', 'table.tag')."""
        if kind in ("databases", "streams"):
            return self.spark.createDataFrame([(n,) for n in sorted(self.databases if kind == "databases" else self.streams)], "name string")
        if kind in ("tables", "measurements", "collections", "topics", "stables"):
            rows = [(n,) for n in sorted(self.tables) if kind != "measurements" or self[n].time]
            return self.spark.createDataFrame(rows, "name string")
        if kind == "tag keys":
            return self.spark.createDataFrame([(n, k) for n in sorted(self.tables) if name in ("", n) for k in self[n].tags], "name string, key string")
        if kind == "field keys":
            rows = [(n, c, k) for n in sorted(self.tables) if name in ("", n) and (t := self[n]).time for c, k in t.frame.dtypes if c != t.time and c not in t.tags]
            return self.spark.createDataFrame(rows, "name string, key string, type string")
        if kind == "tag values":
            table, _, tag = name.partition(".")
            return self.frame(table).select(F.lit(tag).alias("key"), F.col(tag).cast("string").alias("value")).distinct()
        raise ValueError(f"cannot show {kind}")

    def apply_retention(self, name: str, cutoff) -> None:
        """Keep rows at or after the cutoff; the cutoff is the caller's, never the wall clock."""
        t = self[name]
        self.replace(name, t.frame.filter(F.col(t.time) >= F.lit(cutoff)))
