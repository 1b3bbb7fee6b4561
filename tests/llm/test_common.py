from __future__ import annotations

import os

import pytest

from tessellar.llm import common


def test_tables_go_to_the_shared_folder_and_can_be_released(spark):
    common.release(spark)
    df = common.stage_table(spark.range(5).selectExpr("id", "'x' AS s"), "check")
    (path,) = common._WRITTEN[spark.sparkContext.applicationId]
    assert path.startswith(spark.conf.get("spark.checkpoint.dir")) and df.count() == 5
    assert common.release(spark) == 1 and not os.path.exists(path.removeprefix("file://"))


def test_empty_tables_keep_their_columns(spark):
    df = common.stage_table(spark.createDataFrame([], "a long, b array<string>"), "empty")
    assert df.columns == ["a", "b"] and df.count() == 0


@pytest.mark.parametrize(("text", "n"), [(None, 0), ("", 0), (" \t\n\x0b\x0c\r", 0), ("a\xa0b c\x1cd\u2003e", 2), ("é\tü", 2)])
def test_words_part_at_ascii_white_space_only(text, n):
    assert len(common.words(text)) == n == len((text or "").encode().split())
