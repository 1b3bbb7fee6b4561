"""Vector collections in the JSON shapes of vector stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed JSON names of each store: (id, vector, metadata).
SHAPES = {"qdrant": ("id", "vector", "payload"), "pinecone": ("id", "values", "metadata"), "weaviate": ("id", "vector", "properties"), "milvus": ("id", "vector", "fields"), "mongodb": ("_id", "embedding", "metadata")}


def export(df: DataFrame, store: str, id_col: str, vector_col: str, meta: list[str]) -> DataFrame:
    """One JSON object a row."""
    i, v, m = SHAPES[store]
    return df.select(F.to_json(F.struct(F.col(id_col).alias(i), F.col(vector_col).alias(v), F.struct(*meta).alias(m))).alias("value"))


def load(lines: DataFrame, store: str, meta: str, id_type: str = "bigint", text_col: str = "value") -> DataFrame:
    """id, vector, and the metadata columns of the DDL `meta`."""
    i, v, m = SHAPES[store]
    row = F.from_json(text_col, f"{i} {id_type}, {v} array<float>, {m} struct<{meta}>")
    return lines.select(row.alias("r")).select(F.col(f"r.{i}").alias("id"), F.col(f"r.{v}").alias("vector"), f"r.{m}.*")
