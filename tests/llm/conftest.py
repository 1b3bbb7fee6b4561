from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) or full rows."""

    def build(rows, schema: str = SCHEMA, parts: int = 3):
        rows = [(r[0], r[1], "en", f"s{(r[0] or 0) % 3}", len(r[1] or "")) if len(r) == 2 else tuple(r) for r in rows]
        return spark.createDataFrame(rows, schema).repartition(parts)

    return build


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
