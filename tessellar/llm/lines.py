"""Removal of boilerplate lines by their spread over sites (operator 4).

The sites of each line are counted by HyperLogLog sketches that merge in map-side aggregation. Lines whose estimate is
near the threshold are counted exactly; far ones are decided by the sketch. All in DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_table, text_or_empty


def _key(line: Column) -> list[Column]:
    """128 bits of a line, from two independent hashes."""
    return [F.xxhash64(line).alias("a"), F.xxhash64(F.lit("tessellar"), line).alias("b")]


def line_spread(docs: DataFrame, *, site_col: str = "source", text_col: str = "text", threshold: int = 3, lg_k: int = 12, band: float = 0.25) -> DataFrame:
    """Keys of lines that stand on `threshold` or more sites: columns a, b, sites.

    Lines are compared without the spaces around them; empty ones take no part. A null site is a site of its own.
    sites is exact for estimates within `band` of the threshold, and an estimate beyond; with 2**lg_k registers the
    band is over 15 standard errors wide, so the decision is that of exact counts.
    """
    site = F.coalesce(F.concat(F.lit("s"), F.col(site_col).cast("string")), F.lit("-"))
    lines = docs.select(site.alias("site"), F.explode(F.split(text_or_empty(text_col), "\n")).alias("line")).select("site", F.trim("line").alias("line")).filter("line != ''").select("site", *_key(F.col("line")))
    sketched = lines.groupBy("a", "b").agg(F.min("site").alias("lo"), F.max("site").alias("hi"), F.hll_sketch_agg("site", lg_k).alias("sketch"))
    if threshold > 1:
        sketched = sketched.filter("lo < hi")
    estimated = stage_table(sketched.select("a", "b", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= (1 - band) * threshold), "line-spread")
    far = F.col("sites") > (1 + band) * threshold
    near = estimated.filter(~far).select("a", "b")
    exact = lines.join(near, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.count_distinct("site").alias("sites")).filter(F.col("sites") >= threshold)
    return estimated.filter(far).unionByName(exact)


def drop_boilerplate(docs: DataFrame, *, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text", threshold: int = 3, chars_col: str | None = "n_chars", **sketch) -> DataFrame:
    """docs without the lines that stand on `threshold` or more sites; the other lines stay as they are, in order.

    All columns stay, with n_lines and n_removed added (columns of docs so named are replaced); chars_col, where docs
    has it, is set to the new length in code points. Null texts stay null and have no lines; a text that loses all its
    lines becomes empty; rows that share an id, or have none, are each treated by their own text.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    spread = stage_table(line_spread(docs, site_col=site_col, text_col=text_col, threshold=threshold, **sketch).select("a", "b"), "boilerplate")
    body = F.xxhash64(text_or_empty(text_col)), F.xxhash64(F.lit("body"), text_or_empty(text_col))
    # Lines are looked up by text, not by id: copies share one lookup.
    lines = docs.select(body[0].alias("x"), body[1].alias("y"), F.explode(F.array_distinct(F.split(text_or_empty(text_col), "\n"))).alias("line")).select("x", "y", F.trim("line").alias("line")).filter("line != ''").select("x", "y", *_key(F.col("line")))
    # Written first, so that the join below has plain exchanges on both sides and a text with very many copies is split.
    found = stage_table(lines.join(spread, ["a", "b"]).groupBy("x", "y").agg(F.collect_set(F.struct("a", "b")).alias("bad")), "lines-of-texts")
    rows = docs.select(F.struct(*own).alias("_row"), body[0].alias("x"), body[1].alias("y")).join(found, ["x", "y"], "left")
    parts = F.when(F.col(f"_row.{text_col}").isNotNull(), F.split(F.col(f"_row.{text_col}"), "\n"))
    kept = F.when(F.col("bad").isNull(), parts).otherwise(F.filter(parts, lambda x: ~F.coalesce(F.array_contains("bad", F.struct(*_key(F.trim(x)))), F.lit(False))))
    done = rows.select("_row", parts.alias("_all"), kept.alias("_kept"))
    text = F.array_join("_kept", "\n")
    new = {text_col: text} | ({chars_col: F.coalesce(F.length(text), F.lit(0)).cast("long")} if chars_col in own else {})
    return done.select(*[(new[c] if c in new else F.col("_row")[c]).alias(c) for c in own], F.coalesce(F.size("_all"), F.lit(0)).cast("long").alias("n_lines"), (F.coalesce(F.size("_all") - F.size("_kept"), F.lit(0))).cast("long").alias("n_removed"))
