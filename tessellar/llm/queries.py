"""The queries of this subpackage, each over its whole table, and their SQL oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, lines, mixing, near_dups, neighbours, oracles, packing, quality, repeats, settings, tokens, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), window=50)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), settings.levels(), settings.WEIGHTS, fraction=0.5, epochs=4, seed=17)
    return mixed.select("doc_id", "n_tokens", "copies")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_boilerplate(_table(spark, sf_dir, "documents"), threshold=settings.BOILERPLATE_SITES)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model, threshold=settings.QUALITY).select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), room=4096, end_id=1)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return warc.lookup(warc.write_archive(pages, least=0), pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(_table(spark, sf_dir, "documents"), size=2, percent=80)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_substring_dedup, op2_source_mixing, op3_nearest_neighbours, op4_line_dedup, op5_quality, op6_fingerprints, op7_token_counts, op8_best_fit_packing, op9_warc, op10_minhash_near_dedup]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """The others are held against brute force in tests/llm."""
    return {
        "op1_substring_dedup": oracles.SUBSTRING_DEDUP, "op2_source_mixing": oracles.source_mixing(0.5, 4, 17), "op4_line_dedup": oracles.LINE_DEDUP, "op9_warc": oracles.WARC, "op10_minhash_near_dedup": oracles.NEAR_DEDUP,
    } | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
