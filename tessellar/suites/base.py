"""The register of queries: name -> (function of session and folder, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..engine import Engine

REGISTER: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(Catalog(spark).folder(sf_dir), now="2024-01-31 00:00:00", now_us=1_706_659_200_000_000)


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Times as microseconds and doubles rounded, so that results compare across engines."""
    out = []
    for c, kind in df.dtypes:
        name = f"`{c}`"
        if kind.startswith("timestamp"):
            out.append(F.unix_micros(F.col(name).cast("timestamp")).alias(c))
        elif kind in ("double", "float"):
            out.append(F.round(F.col(name).cast("double"), digits).alias(c))
        else:
            out.append(F.col(name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register a function of (engine, folder)."""

    def add(f: Callable[[Engine, str], DataFrame]):
        REGISTER[name] = (lambda spark, sf_dir: plain(f(engine(spark, sf_dir), sf_dir)), sql)
        return f

    return add


def text(name: str, dialect: str, body: str, sql: str, **options) -> None:
    """Register a query in some dialect, as its text."""
    REGISTER[name] = (lambda spark, sf_dir: plain(engine(spark, sf_dir).query(body, dialect, **options)), sql)
