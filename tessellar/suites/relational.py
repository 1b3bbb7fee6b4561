"""Filters, joins, groups, order, sets, changes and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates, changes, documents, joins, search
from .base import query, text

text("lql_group_having", "lql",
     "SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem WHERE l_shipdate >= '1998-01-01' AND l_discount BETWEEN 0.02 AND 0.06 GROUP BY l_returnflag HAVING n > 10 ORDER BY l_returnflag",
     "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 6) AS q FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.02 AND 0.06 GROUP BY 1 HAVING count(*) > 10")
text("lql_predicates", "lql",
     "SELECT c_custkey, c_name FROM customer WHERE (c_mktsegment LIKE 'build%' OR c_mktsegment IN ('MACHINERY', 'HOUSEHOLD')) AND c_name CONTAINS '1' AND NOT c_name ENDS WITH '9' AND c_acctbal BETWEEN 0 AND 8000 AND c_name MATCHES '[0-4]$'",
     "SELECT c_custkey, c_name FROM customer WHERE (c_mktsegment ILIKE 'build%' OR c_mktsegment IN ('MACHINERY', 'HOUSEHOLD')) AND contains(c_name, '1') AND NOT suffix(c_name, '9') AND c_acctbal BETWEEN 0 AND 8000 AND regexp_matches(c_name, '[0-4]$')")
text("lql_order_limit", "lql", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5",
     "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
text("lql_distinct", "lql", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
text("lql_join", "lql", "SELECT n_name, COUNT(*) AS n, AVG(c_acctbal) AS avg_bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
     "SELECT n_name, count(*) AS n, round(avg(c_acctbal), 6) AS avg_bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
text("lql_subquery_semi", "lql", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AND c_acctbal > 0",
     "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AND c_acctbal > 0")
text("sql_case_arithmetic", "sql", "SELECT p_brand, SUM(CASE WHEN p_size > 25 THEN p_retailprice * (1 - 0.1) ELSE p_retailprice END) AS v, SUM(p_size % 7) AS m, MAX(p_size & 12) AS b FROM part GROUP BY p_brand",
     "SELECT p_brand, round(sum(CASE WHEN p_size > 25 THEN p_retailprice * (1 - 0.1) ELSE p_retailprice END), 6) AS v, cast(sum(p_size % 7) AS BIGINT) AS m, max(p_size & 12) AS b FROM part GROUP BY p_brand")
text("nql_top", "nql", "get first 10 part where p_size is greater than 20 and p_brand is not equal to \"Brand#11\" sorted by p_retailprice descending, p_partkey",
     "SELECT p_partkey, p_name, p_brand, p_type, p_size, round(p_retailprice, 6) AS p_retailprice FROM part WHERE p_size > 20 AND p_brand IS DISTINCT FROM 'Brand#11' ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
text("nql_count", "nql", "count orders where o_orderstatus equals \"F\" and o_totalprice between 1000 and 200000", "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 200000")
text("nql_measure", "nql", "average value of events by event_type where value more than 10", "SELECT event_type, round(avg(value), 6) AS avg_value FROM events WHERE value > 10 GROUP BY event_type")
text("jql_find", "jql", '{"find": "orders", "filter": {"$or": [{"o_orderstatus": "P"}, {"o_totalprice": {"$gt": 300000, "$lt": 400000}}], "o_orderpriority": {"$nin": ["5-LOW"]}}, "projection": {"o_orderkey": 1, "o_totalprice": 1}, "sort": {"o_totalprice": -1, "o_orderkey": 1}, "limit": 25, "skip": 3}',
     "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders WHERE (o_orderstatus = 'P' OR (o_totalprice > 300000 AND o_totalprice < 400000)) AND o_orderpriority IS DISTINCT FROM '5-LOW' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 3")
text("jql_pipeline", "jql", '{"aggregate": "orders", "pipeline": [{"$match": {"o_totalprice": {"$gte": 1000}}}, {"$group": {"_id": {"status": "$o_orderstatus", "priority": "$o_orderpriority"}, "total": {"$sum": "$o_totalprice"}, "n": {"$sum": 1}, "most": {"$max": "$o_totalprice"}}}, {"$match": {"n": {"$gt": 5}}}]}',
     "SELECT o_orderstatus AS status, o_orderpriority AS priority, round(sum(o_totalprice), 6) AS total, cast(count(*) AS BIGINT) AS n, round(max(o_totalprice), 6) AS most FROM orders WHERE o_totalprice >= 1000 GROUP BY 1, 2 HAVING count(*) > 5")
text("jql_count", "jql", '{"count": "customer", "filter": {"c_mktsegment": {"$regex": "^AUTO"}, "c_acctbal": {"$not": {"$lt": 0}}}}', "SELECT count(*) AS count FROM customer WHERE regexp_matches(c_mktsegment, '^AUTO') AND NOT c_acctbal < 0")


@query("lql_null_semantics", "WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS k, CASE WHEN event_type = 'click' THEN NULL ELSE value END AS v FROM events) SELECT count(*) FILTER (WHERE k IS DISTINCT FROM 'view') AS ne, count(*) FILTER (WHERE NOT coalesce(k IN ('view', 'click'), false)) AS nin, count(*) FILTER (WHERE v IS NULL) AS nulls, count(v) AS n, round(coalesce(sum(v), 0), 6) AS s FROM e")
def _(e, sf):
    df = e.catalog.frame("events").select("event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("k"), F.when(F.col("event_type") != "click", F.col("value")).alias("v"))
    e.catalog.add("derived", df)
    run = lambda w: e.query(f"SELECT COUNT(*) AS n FROM derived WHERE {w}", "lql")
    total = e.query("SELECT COUNT(v) AS n, SUM(v) AS s FROM derived", "lql")
    return run("k != 'view'").select(F.col("n").alias("ne")).crossJoin(run("k NOT IN ('view', 'click')").select(F.col("n").alias("nin"))).crossJoin(run("v IS NULL").select(F.col("n").alias("nulls"))).crossJoin(total)


for how, sql in {"left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN", "inner": "JOIN"}.items():

    @query(f"join_{how}", f"WITH a AS (SELECT c_custkey AS k, c_name FROM customer), b AS (SELECT o_custkey + 3 AS k, count(*) AS n FROM orders GROUP BY 1) SELECT k, c_name, n FROM a {sql} b USING (k)")
    def _(e, sf, how=how):
        a = e.catalog.frame("customer").select(F.col("c_custkey").alias("k"), "c_name")
        b = e.catalog.frame("orders").groupBy((F.col("o_custkey") + 3).alias("k")).agg(F.count("*").alias("n"))
        return joins.equi(a, b, how, [("k", "k")])


for how, sql in {"semi": "EXISTS", "anti": "NOT EXISTS"}.items():

    @query(f"join_{how}", f"SELECT c_custkey FROM customer WHERE {sql} (SELECT 1 FROM orders WHERE o_custkey + 3 = c_custkey)")
    def _(e, sf, how=how):
        later = e.catalog.frame("orders").withColumn("o_custkey", F.col("o_custkey") + 3)
        return joins.equi(e.catalog.frame("customer"), later, how, [("c_custkey", "o_custkey")]).select("c_custkey")


text("join_cross", "sql", "SELECT n_name, r_name FROM nation CROSS JOIN region", "SELECT n_name, r_name FROM nation CROSS JOIN region")


@query("join_prefixed", "SELECT c.c_custkey AS left_k, c.c_name AS left_c_name, o.o_custkey AS right_k, o.o_orderkey AS right_o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey")
def _(e, sf):
    return joins.prefixed(e.catalog.frame("customer").select(F.col("c_custkey").alias("k"), "c_name"), e.catalog.frame("orders").select(F.col("o_custkey").alias("k"), "o_orderkey"), "k")


@query("join_null_safe", "WITH a AS (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer), b AS (SELECT n_name, nullif(n_nationkey, 3) AS k FROM nation) SELECT c_custkey, n_name FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k")
def _(e, sf):
    a = e.catalog.frame("customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k"))
    return joins.equi(a, e.catalog.frame("nation").select("n_name", F.nullif("n_nationkey", F.lit(3)).alias("k")), "inner", [("k", "k")], null_safe=True).select("c_custkey", "n_name")


@query("mongo_lookup_unwind", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey")
def _(e, sf):
    e.catalog.add("big", e.catalog.frame("orders").select("o_orderkey", "o_custkey"))
    df = documents.pipeline(e.catalog.frame("customer"), [{"$lookup": {"from": "big", "localField": "c_custkey", "foreignField": "o_custkey", "as": "found"}}, {"$unwind": "$found"}], e.catalog.frame)
    return df.select("c_custkey", F.col("found.o_orderkey").alias("o_orderkey"))


@query("mongo_lookup_empty", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(e, sf):
    e.catalog.add("big", e.catalog.frame("orders").select("o_orderkey", "o_custkey"))
    df = documents.pipeline(e.catalog.frame("customer"), [{"$lookup": {"from": "big", "localField": "c_custkey", "foreignField": "o_custkey", "as": "found"}}], e.catalog.frame)
    return df.select("c_custkey", F.size("found").cast("long").alias("n"))


@query("mongo_group", "SELECT c_mktsegment AS _id, round(sum(c_acctbal), 6) AS total, round(avg(c_acctbal), 6) AS mean, count(*) AS n, round(stddev_pop(c_acctbal), 6) AS sd FROM customer GROUP BY 1")
def _(e, sf):
    return documents.pipeline(e.catalog.frame("customer"), [{"$group": {"_id": "$c_mktsegment", "total": {"$sum": "$c_acctbal"}, "mean": {"$avg": "$c_acctbal"}, "n": {"$count": {}}, "sd": {"$stdDevPop": "$c_acctbal"}}}])


@query("mongo_project_compute", "SELECT p_partkey, upper(p_name) AS name, round(p_retailprice * p_size, 6) AS worth, CASE WHEN p_size >= 25 THEN 'big' ELSE 'small' END AS class FROM part WHERE p_size IN (5, 15, 25, 35)")
def _(e, sf):
    return documents.pipeline(e.catalog.frame("part"), [{"$match": {"p_size": {"$in": [5, 15, 25, 35]}}}, {"$project": {"p_partkey": 1, "name": {"$toUpper": "$p_name"}, "worth": {"$multiply": ["$p_retailprice", "$p_size"]}, "class": {"$cond": [{"$gte": ["$p_size", 25]}, "big", "small"]}}}])


@query("mongo_update", "SELECT o_orderstatus, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice + 10 ELSE o_totalprice END), 2) AS total FROM orders GROUP BY 1")
def _(e, sf):
    df = documents.update(e.catalog.frame("orders"), {"o_orderstatus": "O"}, {"$inc": {"o_totalprice": 10}})
    return df.groupBy("o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("array_updates", "SELECT o_custkey, list_sort(list_distinct(list_append(list_filter(list(o_orderpriority), lambda x: x <> '5-LOW'), 'new'))) AS tags FROM orders GROUP BY o_custkey")
def _(e, sf):
    df = e.catalog.frame("orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("tags"))
    df = documents.update(documents.update(df, {}, {"$pull": {"tags": "5-LOW"}}), {}, {"$addToSet": {"tags": "new"}})
    return df.select("o_custkey", F.sort_array(F.array_distinct("tags")).alias("tags"))


text("union_intersect_except", "sql", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey AS k FROM supplier WHERE s_acctbal < 0", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
text("set_intersect", "sql", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey AS k FROM supplier", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
text("set_except_all", "sql", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
text("set_union_all", "sql", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
text("rollup_totals", "sql", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS q, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 6) AS q, count(*) AS n FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)")
text("cube_sets", "sql", "SELECT o_orderstatus, o_orderpriority, SUM(o_totalprice) AS t FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 6) AS t FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)")
text("clickhouse_totals", "clickhouse", "SELECT event_type, count(*) AS n, uniqExact(user_id) AS users, sumIf(value, value > 50) AS big FROM events PREWHERE value > 1 GROUP BY event_type WITH TOTALS",
     "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(CASE WHEN value > 50 THEN value END), 6) AS big FROM events WHERE value > 1 GROUP BY GROUPING SETS ((event_type), ())")
text("clickhouse_limit_by", "clickhouse", "SELECT user_id, event_id, value FROM events ORDER BY value DESC, event_id LIMIT 2 BY user_id",
     "SELECT user_id, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 2")
text("clickhouse_time", "clickhouse", "SELECT toStartOfHour(ts) AS h, quantile(0.9)(value) AS q, argMax(event_id, ts) AS last_id FROM events GROUP BY h",
     "SELECT epoch_us(ts) // 3600000000 * 3600000000 AS h, round(quantile_cont(value, 0.9), 6) AS q, arg_max(event_id, ts) AS last_id FROM events GROUP BY 1")


@query("approx_distinct")
def _(e, sf):
    return e.query("SELECT event_type, uniq(user_id) AS users FROM events GROUP BY event_type", "clickhouse")


@query("count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(value) AS n FROM events GROUP BY 1")
def _(e, sf):
    return e.query("SELECT event_type, COUNT(DISTINCT user_id) AS users, COUNT(value) AS n FROM events GROUP BY event_type", "lql")


@query("string_array_agg", "SELECT n_regionkey, list_sort(list(n_name)) AS names, string_agg(n_name, ', ' ORDER BY n_name) AS line FROM nation GROUP BY 1")
def _(e, sf):
    return e.query("SELECT n_regionkey, ARRAY_AGG(n_name) AS names, STRING_AGG(n_name) AS line FROM nation GROUP BY n_regionkey", "lql")


@query("ranking_windows", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, ntile(3) OVER w AS nt, lead(o_orderkey) OVER w AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)")
def _(e, sf):
    w, p = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return e.catalog.frame("orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(p).cast("long").alias("rk"), F.dense_rank().over(p).cast("long").alias("dr"), F.ntile(3).over(w).cast("long").alias("nt"), F.lead("o_orderkey").over(w).alias("nxt"))


@query("top_per_group", "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3")
def _(e, sf):
    return aggregates.first_rows(e.catalog.frame("part"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3).select("p_brand", "p_partkey")


@query("sample_evenly", "WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, event_id FROM r WHERE r % greatest(n // 10, 1) = 0 AND r // greatest(n // 10, 1) < 10")
def _(e, sf):
    return aggregates.sample_evenly(e.catalog.frame("events"), ["event_type"], ["ts", "event_id"], 10).select("event_type", "event_id")


@query("histogram_equal", "WITH s AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) SELECT event_type, cast(least(floor((value - lo) / ((hi - lo) / 10)), 9) AS BIGINT) AS bucket, count(*) AS n FROM events JOIN s USING (event_type) GROUP BY 1, 2")
def _(e, sf):
    return aggregates.histogram(e.catalog.frame("events"), ["event_type"], "value")


@query("histogram_fixed", "SELECT event_type, cast(floor((value - 10) / 8.0) AS BIGINT) AS bucket, count(*) AS n FROM events WHERE value >= 10 AND value < 90 GROUP BY 1, 2")
def _(e, sf):
    return aggregates.fixed_histogram(e.catalog.frame("events"), ["event_type"], "value", 10, 90, 10)


@query("column_profile", "SELECT 'c_custkey' AS \"column\", count(c_custkey) AS n, cast(0 AS BIGINT) AS nulls, count(DISTINCT c_custkey) AS kinds, cast(min(c_custkey) AS VARCHAR) AS low, cast(max(c_custkey) AS VARCHAR) AS high FROM customer UNION ALL SELECT 'c_mktsegment', count(c_mktsegment), 0, count(DISTINCT c_mktsegment), min(c_mktsegment), max(c_mktsegment) FROM customer")
def _(e, sf):
    return aggregates.profile(e.catalog.frame("customer"), ["c_custkey", "c_mktsegment"])


@query("relationship_overlap", "SELECT 'o_custkey' AS left_column, 'c_custkey' AS right_column, round(count(*) FILTER (WHERE o_custkey IN (SELECT c_custkey FROM customer)) / count(*)::DOUBLE, 6) AS overlap FROM (SELECT DISTINCT o_custkey FROM orders)")
def _(e, sf):
    return aggregates.relationships(e.catalog.frame("orders"), e.catalog.frame("customer"), [("o_custkey", "c_custkey")])


@query("semantic_types", "SELECT 'ts' AS \"column\", 'date' AS kind UNION ALL SELECT 'user_id', 'integer' UNION ALL SELECT 'event_type', 'text'")
def _(e, sf):
    return aggregates.semantic_types(e.catalog.frame("events"), ["ts", "user_id", "event_type"])


@query("dml_versions", "WITH n AS (SELECT r_regionkey, CASE WHEN r_name = 'ASIA' THEN 'East' ELSE r_name END AS r_name FROM region WHERE r_name <> 'AFRICA') SELECT r_regionkey, r_name FROM n UNION ALL SELECT 99, 'Moon'")
def _(e, sf):
    e.query("UPDATE region SET r_name = 'East' WHERE r_name = 'ASIA'", "lql")
    e.query("DELETE FROM region WHERE r_name = 'AFRICA'", "lql")
    e.query("INSERT INTO region (r_regionkey, r_name) VALUES (99, 'Moon')", "lql")
    return e.query("SELECT * FROM region", "lql")


@query("upsert", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey NOT IN (1) UNION ALL SELECT 1, 'One' UNION ALL SELECT 77, 'New'")
def _(e, sf):
    new = e.catalog.spark.createDataFrame([(1, "One"), (77, "New")], "r_regionkey int, r_name string")
    return changes.upsert(e.catalog.frame("region"), new, ["r_regionkey"])


@query("soft_delete_scan", "SELECT count(*) AS n FROM supplier WHERE s_acctbal >= 0")
def _(e, sf):
    e.catalog.add("kept", changes.soft_delete(e.catalog.frame("supplier"), F.col("s_acctbal") < 0), deleted="_deleted")
    return e.query("SELECT COUNT(*) AS n FROM kept", "lql")


@query("point_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def _(e, sf):
    return e.query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42", "lql")


@query("prefix_scan", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'small ')")
def _(e, sf):
    return e.query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'small %'", "sql")  # pushed to the scan as a prefix


@query("key_condition", "SELECT o_orderkey FROM orders WHERE o_custkey = 37 AND o_orderkey BETWEEN 100 AND 14000 ORDER BY o_orderkey DESC LIMIT 5")
def _(e, sf):
    return search.key_condition(e.catalog.frame("orders"), "o_custkey", 37, "o_orderkey", "between", (100, 14000), forward=False, limit=5).select("o_orderkey")


@query("rest_query", "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 AND NOT o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
def _(e, sf):
    return search.rest(e.catalog.frame("orders"), "o_orderstatus=eq.F&o_totalprice=gte.100000&o_orderpriority=not.in.(1-URGENT,2-HIGH)&order=o_totalprice.desc.nullslast,o_orderkey&limit=10&offset=20&select=o_orderkey,o_totalprice")


@query("rest_embedded", "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000")
def _(e, sf):
    n = e.catalog.frame("nation").select("n_nationkey", F.struct("n_name").alias("nation"))
    return e.catalog.frame("customer").filter("c_acctbal > 9000").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.col("nation.n_name").alias("nation"))


@query("row_level_security", "SELECT count(*) AS n, round(sum(o_totalprice), 6) AS total FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P'")
def _(e, sf):
    e.catalog.add("mine", e.catalog.frame("orders").filter("o_orderpriority = '1-URGENT'"))  # the policy is part of the view
    return e.query("SELECT COUNT(*) AS n, SUM(o_totalprice) AS total FROM mine WHERE o_orderstatus <> 'P'", "sql")


@query("fluent_builder", "SELECT o_orderstatus, count(*) AS n, round(max(o_totalprice), 6) AS top FROM orders WHERE o_totalprice > 50000 GROUP BY 1 HAVING count(*) > 100 ORDER BY n DESC LIMIT 2")
def _(e, sf):
    return e.table("orders").where("o_totalprice > 50000").group("o_orderstatus", n="count(*)", top="max(o_totalprice)").having("n > 100").order("n desc").limit(2).run()


@query("full_sql", "WITH r AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1) SELECT c_mktsegment, round(avg(t), 6) AS mean FROM r JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def _(e, sf):
    return e.sql("WITH r AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1) SELECT c_mktsegment, avg(t) AS mean FROM r JOIN customer ON c_custkey = o_custkey GROUP BY 1")


@query("scalar_functions", "SELECT s_suppkey, upper(s_name) AS u, lower(s_name) AS l, cast(strlen(s_name) AS BIGINT) AS n, round(abs(s_acctbal), 6) AS a, round(sqrt(abs(s_acctbal)), 6) AS q, coalesce(nullif(s_nationkey, 3), -1) AS k, levenshtein(s_name, 'Supplier') AS d FROM supplier")
def _(e, sf):
    return e.query("SELECT s_suppkey, upper(s_name) AS u, lower(s_name) AS l, length(s_name) AS n, abs(s_acctbal) AS a, sqrt(abs(s_acctbal)) AS q, coalesce(nullif(s_nationkey, 3), -1) AS k, levenshtein(s_name, 'Supplier') AS d FROM supplier", "sql")


@query("json_access", "SELECT event_id, cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE cast(json_extract_string(props, '$.k') AS BIGINT) > 50")
def _(e, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return e.catalog.frame("events").filter(k > 50).select("event_id", k.alias("k"))


@query("tpch_q1", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def _(e, sf):
    df = e.query("SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, SUM(l_extendedprice) AS sum_base, SUM(l_extendedprice * (1 - l_discount)) AS sum_disc, AVG(l_discount) AS avg_disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus", "lql")
    return df.withColumns({c: F.round(c, 2) for c in ("sum_qty", "sum_base", "sum_disc")})


@query("tpch_q3", "SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1 ORDER BY revenue DESC, o_orderkey LIMIT 10")
def _(e, sf):
    df = e.query("SELECT o_orderkey, SUM(l_extendedprice * (1 - l_discount)) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey", "sql")
    return df.withColumn("revenue", F.round("revenue", 2)).orderBy(F.desc("revenue"), "o_orderkey").limit(10)
