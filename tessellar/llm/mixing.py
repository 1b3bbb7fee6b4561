"""Mixing sources to target weights over a tree of levels (operator 2), in DataFrame operations only.

A budget runs down the tree by the weights of siblings. A node never gets more than its subtree can give (its tokens
times the epochs allowed); what it cannot use goes to its siblings first and reaches other branches only when a whole
subtree falls short. Each leaf then takes whole epochs and a token-prefix of one more, in an order seeded for each epoch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage_table, text_or_empty

BUCKETS = 4096


def token_count(text: Column) -> Column:
    """Words, as the unit of budgets."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share each parent's `budget` among its rows by `w`, none above `cap`: adds `share`."""
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(1))
    rising = group.orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))), name).rowsBetween(Window.unboundedPreceding, -1)
    before_cap, before_w = F.coalesce(F.sum("cap").over(rising), F.lit(0.0)), F.coalesce(F.sum("w").over(rising), F.lit(0.0))
    full = (F.col("w") > 0) & ((F.col("budget") - before_cap) * F.col("w") >= F.col("cap") * (F.sum("w").over(group) - before_w))
    nodes = nodes.withColumn("full", full)
    taken, used = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(group), F.sum(F.when(F.col("full"), F.col("w")).otherwise(0.0)).over(group)
    rest = F.sum("w").over(group) - used
    share = F.when(F.col("full"), F.col("cap")).when(rest > 0, F.col("w") * F.greatest(F.col("budget") - taken, F.lit(0.0)) / rest).otherwise(0.0)
    return nodes.withColumn("share", F.least("cap", share)).drop("full")


def order_key(seed: int, epoch: Column, id_col: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_col.cast("string"), F.lit("null"))))


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[tuple[str, ...], float], *, fraction: float = 0.5, epochs: int = 4, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the column copies: how often the mixture takes each row (0: not at all).

    levels names the tree's levels from the top, as columns over docs; null is a node of its own, named '(none)'.
    weights has the weight of a node by its path; nodes not in it weigh 1, and a weight of 0 shuts a branch out. The
    budget is `fraction` of all tokens, before epochs. A leaf takes rows in the order of md5(seed|epoch|id), and of
    its last, partial epoch those whose running sum stays within the budget; rows of one id are taken together.
    Null texts have 0 tokens. A column of docs named copies or n_tokens is replaced; others stay. No rows give no rows.
    """
    names = [f"_l{k}" for k in range(len(levels))]
    own = [c for c in docs.columns if c not in ("copies", "n_tokens")]
    node = [F.coalesce(c.cast("string"), F.lit("(none)")).alias(n) for n, c in zip(names, levels.values())]
    sized = stage_table(docs.select(F.col(id_col).alias("id"), *node, token_count(text_or_empty(text_col)).alias("tokens")), "mix-sizes")
    leaves = stage_table(sized.groupBy(*names).agg(F.sum("tokens").cast("double").alias("size")), "mix-leaves")  # as many rows as the tree has leaves
    at = lambda key: reduce(lambda a, b: a & b, [F.col(n) == v for n, v in zip(names, key)])
    shut = reduce(lambda a, b: a | b, [at(key) for key, w in weights.items() if 0 < len(key) <= len(names) and w == 0], F.lit(False))
    tree = leaves.withColumn("cap", F.when(shut, F.lit(0.0)).otherwise(F.col("size") * epochs))  # below a weight of 0 a leaf gives nothing
    budget = None
    for depth in range(1, len(names) + 1):
        path = names[:depth]
        rows = tree.groupBy(*path).agg(F.sum("cap").alias("cap"))
        weight = F.lit(1.0)
        for key, w in weights.items():
            if len(key) == depth:
                weight = F.when(at(key), F.lit(float(w))).otherwise(weight)
        rows = rows.withColumn("w", weight)
        if budget is None:
            rows = rows.crossJoin(F.broadcast(leaves.agg((F.coalesce(F.sum("size"), F.lit(0.0)) * fraction).alias("budget"))))  # one row
        else:
            rows = rows.join(budget, path[:-1])
        budget = fill(rows, path[:-1], path[-1]).select(*path, F.col("share").alias("budget"))
    whole = F.when(F.col("size") > 0, F.least(F.floor((F.col("budget") + 1e-6) / F.col("size")), F.lit(epochs))).otherwise(0).cast("long")
    part = leaves.join(budget, names).withColumn("whole", whole).withColumn("rest", F.floor(F.col("budget") + 1e-6 - F.col("whole") * F.col("size")).cast("long"))
    part = stage_table(part.select(*names, "whole", "rest"), "mix-shares")
    small = part.count() <= 100_000  # broadcast only below this many leaves
    shares = F.broadcast(part) if small else part

    # The running sum of a leaf goes over buckets of its order first, so that only one bucket of it is ever sorted.
    key = order_key(seed, F.col("whole"), F.col("id"))
    keyed = sized.join(shares, names).withColumn("h", key).withColumn("bucket", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    sums = keyed.groupBy(*names, "rest", "bucket").agg(F.sum("tokens").alias("n"))
    running = F.sum("n").over(Window.partitionBy(*names).orderBy("bucket"))
    cut = sums.withColumn("upto", running).filter(F.col("upto") > F.col("rest")).groupBy(*names).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("base"))).alias("c"))
    cut = cut.select(*names, F.col("c.bucket").alias("cut"), F.col("c.base").alias("base"))
    at_cut = keyed.join(F.broadcast(cut) if small else cut, names).filter(F.col("bucket") == F.col("cut"))
    within = at_cut.withColumn("cum", F.col("base") + F.sum("tokens").over(Window.partitionBy(*names).orderBy("h").rangeBetween(Window.unboundedPreceding, 0)))
    last = within.filter(F.col("cum") <= F.col("rest")).groupBy(*names).agg(F.max("h").alias("last"))
    decided = stage_table(part.join(cut, names, "left").join(last, names, "left").select(*names, "whole", "cut", "last"), "mix-cuts")
    table = F.broadcast(decided) if small else decided

    h = order_key(seed, F.col("whole"), F.col(f"_row.{id_col}"))
    in_bucket = F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")
    chosen = F.col("cut").isNull() | (in_bucket < F.col("cut")) | ((in_bucket == F.col("cut")) & F.coalesce(F.col("_h") <= F.col("last"), F.lit(False)))
    rows = docs.select(F.struct(*own).alias("_row"), *node, token_count(text_or_empty(text_col)).alias("n_tokens"))
    extra = F.when(F.col("whole") < epochs, chosen.cast("long")).otherwise(0)
    return rows.join(table, names).withColumn("_h", h).select("_row.*", "n_tokens", (F.col("whole") + extra).cast("long").alias("copies"))


def mixture(docs: DataFrame, levels: dict[str, Column], weights: dict[tuple[str, ...], float], **options) -> DataFrame:
    """The rows that mix() takes, each as often as it takes them, with the columns of docs."""
    taken = mix(docs, levels, weights, **options).filter("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)
