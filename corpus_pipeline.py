"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm import lines, mixing, near_dups, packing, quality, settings
from tessellar.llm.common import stage_table


def _own_columns(docs: DataFrame, added: set[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """step(docs) with the columns of docs. Those named like one that the step adds, in any case, pass it by as they are."""
    aside = {c: f"_aside{k}" for k, c in enumerate(docs.columns) if c.lower() in added}
    done = step(docs.withColumnsRenamed(aside))
    return done.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on the labelled ones, does not reject.

    Null and empty texts are scored as empty ones, very long texts whole; a score equal to the threshold stays. Rows
    with a null or repeated id are each scored by their own text. Nulls elsewhere decide nothing. Without usable
    labels every score is one half, so all stay; no documents give none. Columns named score or predicted pass.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _own_columns(docs, {"score", "predicted"}, lambda d: quality.score(d, model, threshold=settings.QUALITY).filter("predicted = 1"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on several sources; n_chars follows.

    No row goes: null texts stay null, with n_chars 0; a text that loses all its lines, and an empty one, is empty.
    Long texts are cut into lines whole. A null source is a source of its own; a line on exactly the threshold's number
    of sources goes. Rows with a null or repeated id are each treated by their own text, and repeated rows of one
    source count once. No documents give none. Columns named n_lines or n_removed pass.
    """
    return _own_columns(docs, {"n_lines", "n_removed"}, lambda d: lines.drop_boilerplate(d, threshold=settings.BOILERPLATE_SITES))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8), the one with the smallest id.

    Null and empty texts, and rows with a null id, are in no group and stay. A likeness of exactly 0.8 links. Texts of
    fewer than five words are alike only if equal; long ones are compared whole. Rows that share an id are one document:
    all of them stay or go. No documents give none. All columns pass as they are.
    """
    return near_dups.keep_first(docs, size=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents up to each source's share of four fifths of all tokens, each at most once.

    A null domain, language or source is a node of its own. Null and empty texts have no tokens, so they never exceed a
    budget, but stay only if their leaf's order reaches them; a long text that does not fit in what is left of its leaf
    ends the leaf. Rows of one id, or of null ids, in one leaf are taken or left together. No documents give none.
    Columns named copies, n_tokens or _copy pass.
    """
    return _own_columns(docs, {"copies", "n_tokens", "_copy"}, lambda d: mixing.mixture(d, settings.levels(), settings.WEIGHTS, fraction=0.8, epochs=1, seed=17))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 4096: a row for each piece, as packing.pack() returns them.

    A null or empty text is a piece of one token, a text over 4096 tokens several pieces; repeated rows are packed each;
    a null id stays null. No documents give none. Other columns, whatever their names, are left out.
    """
    # Workers also hold the word hashes of the stages before, so they remember fewer pre-tokens than packing alone may.
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), room=4096, end_id=1, cache=200_000)


STAGES = [("quality", good_quality), ("line_dedup", without_boilerplate), ("near_dedup", without_near_copies), ("mixing", mixed), ("packing", packed)]

#: SQL cannot express the fitted classifier; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
