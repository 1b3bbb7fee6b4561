from __future__ import annotations

import __spark_entry__ as entry_point


def test_entry_runs(spark):
    rows = entry_point.entry(spark).collect()
    assert [r.l_returnflag for r in rows] == sorted(r.l_returnflag for r in rows) and len(rows) == 3


def test_names_agree():
    queries, oracles = entry_point.queries(), entry_point.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150


def test_filters_and_columns_reach_the_scan(spark):
    from tessellar.suites.base import engine

    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = engine(spark, "/root/testdata/sf0.001").explain("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'O'", "lql")
    pushed = plan[plan.rindex("PushedFilters:") :]
    assert "GreaterThan(o_totalprice,1000.0)" in pushed and "EqualTo(o_orderstatus,O)" in pushed
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan
