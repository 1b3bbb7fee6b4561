"""User-defined functions: scalar, aggregate and table ones, all on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scalars import register


def scalar(name: str, function: Callable[[pd.Series], pd.Series], returns: str):
    """Register a function of pandas Series for every dialect; returns the column function."""
    wrapped = F.pandas_udf(function, returns)
    register(name, wrapped)
    return wrapped


def aggregate(name: str, function: Callable[[pd.Series], float], returns: str):
    """Register an aggregate. The function gets all values of a group at once; what can be merged is better built from
    built-in aggregates, which combine before the shuffle."""
    function.__annotations__ = {"v": pd.Series, "return": float}
    wrapped = F.pandas_udf(function, returns)
    register(name, wrapped)
    return wrapped


def mergeable(df: DataFrame, keys: list[str], partial: dict, final: dict) -> DataFrame:
    """An aggregate with accumulators: `partial` columns are aggregated, `final` ones are made of them."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in partial.items()]).select(*keys, *[c.alias(n) for n, c in final.items()])


def table(spark, name: str, function: type, returns: str):
    """Register a table function (a class with eval) for SQL."""
    made = F.udtf(function, returnType=returns)
    spark.udtf.register(name, made)
    return made


def on_batch(actions: list[Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that runs procedures or triggers on each micro-batch, in order."""

    def run(batch: DataFrame, epoch: int) -> None:
        for act in actions:
            act(batch, epoch)

    return run
