"""Names, subqueries, windows of rows, statements, and the rules that dialects must not drop."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import documents, search, vector
from ..sources import text as lines
from ..sources import vectors
from .base import query, text

H, D = 3_600_000_000, 86_400_000_000
T = "epoch_us(ts)"
START, END = 1_704_153_600_000_000, 1_706_572_800_000_000  # 2024-01-02 to 2024-01-30

# SQL names, subqueries, OVER
text("sql_self_join", "sql", "SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON b.n_regionkey = a.n_regionkey AND a.n_nationkey < b.n_nationkey ORDER BY a.n_name, b.n_name",
     "SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON b.n_regionkey = a.n_regionkey AND a.n_nationkey < b.n_nationkey ORDER BY 1, 2")
text("sql_qualified", "sql", "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region AS r ON n.n_regionkey = r.r_regionkey WHERE r.r_name != 'ASIA'",
     "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region AS r ON n.n_regionkey = r.r_regionkey WHERE r.r_name <> 'ASIA'")
text("sql_from_subquery", "sql", "SELECT t.o_custkey, t.total FROM (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey) t WHERE t.total > 1000000",
     "SELECT o_custkey, round(sum(o_totalprice), 6) AS total FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 1000000")
text("sql_scalar_subquery", "sql", "SELECT o_orderkey, o_totalprice - (SELECT AVG(o_totalprice) FROM orders) AS above FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)",
     "SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 6) AS above FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
text("sql_in_or", "sql", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') OR c_acctbal < 0",
     "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') OR c_acctbal < 0")
text("sql_exists", "sql", "SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')",
     "SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
text("sql_over", "sql", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3, LEAD(o_orderkey, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders",
     "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS last3, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders")
text("sql_over_groups", "sql", "SELECT p_brand, COUNT(*) AS n, RANK() OVER (ORDER BY SUM(p_retailprice) DESC) AS place FROM part GROUP BY p_brand",
     "SELECT p_brand, count(*) AS n, rank() OVER (ORDER BY sum(p_retailprice) DESC) AS place FROM part GROUP BY p_brand")
text("sql_order_by_agg", "sql", "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY SUM(o_totalprice) DESC, o_custkey LIMIT 12",
     "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 12")
text("union_order_limit", "sql", "SELECT c_custkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT s_suppkey AS k, s_acctbal AS v FROM supplier ORDER BY v DESC, k LIMIT 9",
     "SELECT c_custkey AS k, round(c_acctbal, 6) AS v FROM customer UNION ALL SELECT s_suppkey, round(s_acctbal, 6) FROM supplier ORDER BY v DESC, k LIMIT 9")
text("union_intersect_precedence", "sql", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 4 UNION SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000",
     "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 4 UNION SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")


@query("not_in_null", "WITH s AS (SELECT nullif(s_nationkey, 3) AS k FROM supplier) SELECT (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT k FROM s)) AS strict, (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT k FROM s WHERE k IS NOT NULL)) AS loose")
def _(e, sf):
    """A null in the subquery: no row by three-valued logic; the loose dialects leave it out."""
    e.catalog.add("s", e.catalog.frame("supplier").select(F.nullif("s_nationkey", F.lit(3)).alias("k")))
    count = lambda d, name: e.query("SELECT COUNT(*) AS n FROM (SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT k FROM s)) t", d).select(F.col("n").alias(name))
    return count("sql", "strict").crossJoin(count("lql", "loose"))  # one row each


# Rules of the time-series dialects
text("having_window", "tdengine", "SELECT COUNT(*) AS n, AVG(value) AS v FROM events PARTITION BY event_type INTERVAL(2d) HAVING COUNT(*) > 20 AND AVG(value) < 60",
     f"SELECT event_type, {T} // {2 * D} * {2 * D} AS _wstart, {T} // {2 * D} * {2 * D} + {2 * D} AS _wend, count(*) AS n, round(avg(value), 6) AS v FROM events GROUP BY 1, 2, 3 HAVING count(*) > 20 AND avg(value) < 60")
text("sample_by_symbols", "questdb", "SELECT ts, event_type, count(*) AS n FROM events SAMPLE BY 1d", f"SELECT event_type, {T} // {D} * {D} AS _wstart, {T} // {D} * {D} + {D} AS _wend, count(*) AS n FROM events GROUP BY 1, 2, 3")
_GRID = f"r AS (SELECT {T} // {5 * D} * {5 * D} AS w, avg(value) AS a, min(value) AS m, count(*) AS n FROM events WHERE event_type = 'view' AND ts < TIMESTAMP '2024-01-09' OR event_type = 'view' AND ts >= TIMESTAMP '2024-01-22' GROUP BY 1)"
_FILLED = f"j AS (SELECT g.w, r.a, r.m, r.n, last_value(r.a IGNORE NULLS) OVER b AS pa, last_value(r.m IGNORE NULLS) OVER b AS pm, first_value(r.m IGNORE NULLS) OVER f AS nm, last_value(r.w IGNORE NULLS) OVER b AS pw, first_value(r.w IGNORE NULLS) OVER f AS nw FROM g LEFT JOIN r ON g.w = r.w WINDOW b AS (ORDER BY g.w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (ORDER BY g.w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT w AS bucket, round(pa, 6) AS carried, round(CASE WHEN m IS NOT NULL THEN m ELSE pm + (nm - pm) * (w - pw) / (nw - pw) END, 6) AS between_, n FROM j"
_GAP = "locf(avg(value)) AS carried, interpolate(min(value)) AS between_, count(*) AS n FROM events WHERE event_type = 'view' AND (ts < '2024-01-09' OR ts >= '2024-01-22') GROUP BY bucket"
text("gapfill_mixed", "timescale", f"SELECT time_bucket_gapfill('5 days', ts) AS bucket, {_GAP}", f"WITH {_GRID}, g AS (SELECT unnest(range(min(w), max(w) + 1, {5 * D})) AS w FROM r), {_FILLED}")
text("gapfill_bounds", "timescale", f"SELECT time_bucket_gapfill('5 days', ts, '2023-12-10', '2024-02-20') AS bucket, {_GAP}",
     f"WITH {_GRID}, g AS (SELECT unnest(range(epoch_us(TIMESTAMP '2023-12-10') // {5 * D} * {5 * D}, epoch_us(TIMESTAMP '2024-02-20'), {5 * D})) AS w), {_FILLED}")
text("influx_two_series", "influxql", "SELECT difference(sum(value)) AS d, cumulative_sum(sum(value)) AS c, count(value) AS n FROM events GROUP BY time(2d), event_type",
     f"WITH r AS (SELECT event_type, {T} // {2 * D} * {2 * D} AS _wstart, sum(value) AS s, count(value) AS n FROM events GROUP BY 1, 2) SELECT event_type, _wstart, _wstart + {2 * D} AS _wend, round(s - lag(s) OVER w, 6) AS d, round(sum(s) OVER (PARTITION BY event_type ORDER BY _wstart ROWS UNBOUNDED PRECEDING), 6) AS c, n FROM r WINDOW w AS (PARTITION BY event_type ORDER BY _wstart)")
_NEAR = f"WITH a AS (SELECT event_type, value AS v, {T} AS t, event_id, lag(value) OVER w AS q, ({T} - lag({T}) OVER w) / 1e6 AS dt FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))"
text("tdengine_neighbours", "tdengine", "SELECT event_type, TWA(value) AS twa, INTEGRAL(value, 1h) AS area, IRATE(value) AS irate, RESETS(value) AS resets FROM events GROUP BY event_type",
     f"{_NEAR} SELECT event_type, round(sum((v + q) / 2 * dt) / sum(dt), 6) AS twa, round(sum((v + q) / 2 * dt) / 3600, 6) AS area, round(arg_max(CASE WHEN v < q THEN v ELSE v - q END / dt, t), 6) AS irate, count(*) FILTER (WHERE v < q) AS resets FROM a GROUP BY 1")
text("tdengine_tail", "tdengine", "SELECT event_id, TAIL(value, 3) AS v FROM events PARTITION BY event_type", "SELECT event_type, event_id, round(value, 6) AS v FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 3")
text("tdengine_histogram", "tdengine", "SELECT HISTOGRAM(value) FROM events PARTITION BY event_type", "WITH s AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) SELECT event_type, cast(least(floor((value - lo) / ((hi - lo) / 10)), 9) AS BIGINT) AS bucket, count(*) AS n FROM events JOIN s USING (event_type) GROUP BY 1, 2")
_HOLD = f"WITH a AS (SELECT *, {T} AS t, coalesce(value > 40, false) AS h, sum((NOT coalesce(value > 40, false))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)"
text("tdengine_statecount", "tdengine", "SELECT event_id, STATECOUNT(value, 'GT', 40) AS n FROM events PARTITION BY user_id", f"{_HOLD} SELECT user_id, event_id, CASE WHEN h THEN row_number() OVER (PARTITION BY user_id, g, h ORDER BY ts, event_id) ELSE -1 END AS n FROM a")
text("tdengine_stateduration", "tdengine", "SELECT event_id, STATEDURATION(value, 'GT', 40, 1m) AS n FROM events PARTITION BY user_id", f"{_HOLD} SELECT user_id, event_id, CASE WHEN h THEN (t - min(t) OVER (PARTITION BY user_id, g, h)) // 60000000 ELSE -1 END AS n FROM a")
text("tdengine_interp", "tdengine", "SELECT INTERP(value, 12h, 'linear') AS v FROM events PARTITION BY event_type",
     f"""WITH e AS (SELECT event_type, {T} AS t, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2), g AS (SELECT event_type, unnest(range((min(t) + {12 * H - 1}) // {12 * H} * {12 * H}, max(t) + 1, {12 * H})) AS t FROM e GROUP BY 1), u AS (SELECT event_type, t, max(v) AS v, max(k) AS k FROM (SELECT event_type, t, v, 0 AS k FROM e UNION ALL SELECT event_type, t, NULL, 1 FROM g) GROUP BY 1, 2),
     f AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS p, first_value(v IGNORE NULLS) OVER a AS n, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS pt, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER a AS nt FROM u WINDOW b AS (PARTITION BY event_type ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY event_type ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
     SELECT event_type, t AS ts, round(CASE WHEN v IS NOT NULL THEN v ELSE p + (n - p) * (t - pt) / (nt - pt) END, 6) AS v FROM f WHERE k = 1""")


@query("clickhouse_final", "SELECT user_id, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(e, sf):
    e.catalog.add("versions", e.catalog.frame("events").select("user_id", "ts", "event_id", "value"), time="ts", key=("user_id",), version="ts")
    return e.query("SELECT user_id, event_id, value FROM versions FINAL", "clickhouse")


@query("promql_vector_match", f"WITH g AS (SELECT unnest(range({START}, {END} + 1, {D})) AS t), a AS (SELECT event_type, user_id, t, sum(value) AS v FROM g JOIN events ON {T} <= t AND {T} > t - {5 * D} WHERE event_type IN ('view', 'click') GROUP BY 1, 2, 3) SELECT x.user_id, x.t, round(x.v / y.v, 6) AS v FROM a x JOIN a y ON x.user_id = y.user_id AND x.t = y.t WHERE x.event_type = 'view' AND y.event_type = 'click'")
def _(e, sf):
    return e.metrics("sum_over_time(view[5d]) / on (user_id) sum_over_time(click[5d])", start=START, end=END, step=D)


@query("promql_group_left", f"WITH g AS (SELECT unnest(range({START}, {END} + 1, {D})) AS t), a AS (SELECT event_type, user_id, t, sum(value) AS v FROM g JOIN events ON {T} <= t AND {T} > t - {5 * D} GROUP BY 1, 2, 3), b AS (SELECT user_id, t, sum(v) AS s FROM a GROUP BY 1, 2) SELECT event_type, a.user_id, a.t, round(v / s, 6) AS v FROM a JOIN b ON a.user_id = b.user_id AND a.t = b.t")
def _(e, sf):
    return e.metrics('sum_over_time({__name__=~".+"}[5d]) / on (user_id) group_left sum by (user_id) (sum_over_time({__name__=~".+"}[5d]))', start=START, end=END, step=D)


_SPANS = "(ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-06' OR ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-25')"
text("druid_intervals", "druid_native", json.dumps({"queryType": "timeseries", "dataSource": "events", "granularity": "week", "intervals": ["2024-01-03/2024-01-06", "2024-01-20/2024-01-25"], "aggregations": [{"type": "count", "name": "n"}]}),
     f"SELECT epoch_us(date_trunc('week', ts)::TIMESTAMP) AS t, count(*) AS n FROM events WHERE {_SPANS} GROUP BY 1")


# Documents and search
@query("mongo_first_last_desc", "SELECT o_orderstatus AS _id, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS most, arg_min(o_orderkey, (o_totalprice, -o_orderkey)) AS least FROM orders GROUP BY 1")
def _(e, sf):
    return documents.pipeline(e.catalog.frame("orders"), [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$group": {"_id": "$o_orderstatus", "most": {"$first": "$o_orderkey"}, "least": {"$last": "$o_orderkey"}}}])


@query("es_sibling_aggs", "SELECT 'kinds' AS agg, event_type AS key, count(*) AS doc_count, round(max(value), 6) AS top, NULL::DOUBLE AS mean, NULL::BIGINT AS users FROM events GROUP BY event_type UNION ALL SELECT '_metrics', NULL, NULL, NULL, round(avg(value), 6), count(DISTINCT user_id) FROM events")
def _(e, sf):
    return search.aggregate(e.catalog.frame("events"), {"kinds": {"terms": {"field": "event_type"}, "aggs": {"top": {"max": {"field": "value"}}}}, "mean": {"avg": {"field": "value"}}, "users": {"cardinality": {"field": "user_id"}}})


_V = "list_transform(embedding, lambda x: x::DOUBLE)"
_QUERY = [0.1, -0.2, 0.05, 0.3] * 16
_Q = "[" + ", ".join(f"{x}::DOUBLE" for x in _QUERY) + "]"


@query("mongo_vector_search", f"SELECT vec_id, round(1 - list_cosine_similarity({_V}, {_Q}), 6) AS distance FROM embeddings WHERE label >= 3 ORDER BY 2, vec_id LIMIT 8")
def _(e, sf):
    return documents.pipeline(e.catalog.frame("embeddings"), [{"$vectorSearch": {"path": "embedding", "queryVector": _QUERY, "limit": 8, "filter": {"label": {"$gte": 3}}}}]).select("vec_id", "distance")


@query("points_geo", "SELECT event_id FROM events WHERE 2 * 6371008.8 * asin(sqrt(pow(sin(radians((value / 2) - 10) / 2), 2) + cos(radians(value / 2)) * cos(radians(10.0)) * pow(sin(radians(user_id * 1.0 - 20) / 2), 2))) <= 900000 AND NOT event_type IN ('error')")
def _(e, sf):
    df = e.catalog.frame("events").withColumn("place", F.struct((F.col("value") / 2).alias("lat"), F.col("user_id").cast("double").alias("lon")))
    where = {"must": [{"key": "place", "geo_radius": {"center": {"lat": 10.0, "lon": 20.0}, "radius": 900000}}], "must_not": [{"key": "event_type", "match": {"any": ["error"]}}]}
    return df.filter(search.points_filter(where)).select("event_id")


@query("metadata_filter", "SELECT vec_id FROM embeddings WHERE label IN (1, 2) OR label > 6")
def _(e, sf):
    return e.catalog.frame("embeddings").filter(documents.where({"$or": [{"label": {"$in": [1, 2]}}, {"label": {"$gt": 6}}]})).select("vec_id")


@query("vector_arithmetic", f"SELECT vec_id, round(list_sum(list_transform(list_zip({_V}, {_Q}), lambda z: z[1] + z[2])), 4) AS plus, round(list_sum(list_transform(list_zip({_V}, {_Q}), lambda z: z[1] * z[2])), 4) AS times FROM embeddings")
def _(e, sf):
    q = F.array(*[F.lit(x) for x in _QUERY])
    total = lambda f: F.round(F.aggregate(F.zip_with(vector.doubles("embedding"), q, f), F.lit(0.0), lambda a, x: a + x), 4)
    return e.catalog.frame("embeddings").select("vec_id", total(lambda a, b: a + b).alias("plus"), total(lambda a, b: a * b).alias("times"))


for _shape in ("qdrant", "pinecone", "weaviate", "milvus"):

    @query(f"vectors_{_shape}", f"SELECT vec_id AS id, label, round(list_sum({_V}), 4) AS total, len(embedding) AS n FROM embeddings")
    def _(e, sf, shape=_shape):
        back = vectors.load(vectors.export(e.catalog.frame("embeddings"), shape, "vec_id", "embedding", ["label"]), shape, "label int")
        return back.select(F.col("id").cast("long").alias("id"), "label", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"), F.size("vector").cast("long").alias("n"))


# Sources and statements
@query("put_json", f"SELECT 'm.' || event_type AS metric, {T} // 1000 * 1000 AS ts_us, round(value, 6) AS value, user_id::VARCHAR AS u FROM events")
def _(e, sf):
    ev = e.catalog.frame("events")
    body = F.struct(F.concat(F.lit("m."), "event_type").alias("metric"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), "value", F.create_map(F.lit("u"), F.col("user_id").cast("string")).alias("tags"))
    return lines.put_json(ev.select(F.to_json(body).alias("value"))).select("metric", "ts_us", "value", F.col("tags")["u"].alias("u"))


@query("create_stream", f"SELECT event_type, {T} // {D} * {D} AS _wstart, count(*) AS n FROM events WHERE value > 10 GROUP BY 1, 2 HAVING count(*) > 3")
def _(e, sf):
    e.query("CREATE STREAM daily TRIGGER WINDOW_CLOSE WATERMARK 10s INTO per_day AS SELECT COUNT(*) AS n FROM events WHERE value > 10 PARTITION BY event_type INTERVAL(1d)", "tdengine")
    return e.query("SELECT event_type, _wstart, n FROM per_day WHERE n > 3", "tdengine")


@query("stream_from_topic", "SELECT event_id, round(value, 6) AS value FROM events WHERE event_type = 'purchase' AND value > 30")
def _(e, sf):
    e.query("CREATE TOPIC purchases AS SELECT event_id, value FROM events WHERE event_type = 'purchase'", "tdengine")
    return e.query("STREAM FROM purchases WHERE value > 30", "lql")


@query("create_tables", "SELECT 'a' AS place, 2 AS n, 1.75::DOUBLE AS mean UNION ALL SELECT 'b', 1, 4.0")
def _(e, sf):
    e.query("CREATE STABLE meters (ts TIMESTAMP, v DOUBLE) TAGS (place NCHAR(8))", "tdengine")
    e.query("INSERT INTO meters VALUES ('2024-01-01 00:00:00', 1.5, 'a'), ('2024-01-01 00:00:05', 2.0, 'a'), ('2024-01-01 00:00:07', 4, 'b')", "tdengine")
    e.query("CREATE TABLE d1 USING meters TAGS ('a')", "tdengine")
    one = e.query("SELECT place, COUNT(*) AS n, AVG(v) AS mean FROM d1 GROUP BY place", "tdengine")
    return one.unionByName(e.query("SELECT place, COUNT(*) AS n, AVG(v) AS mean FROM meters WHERE place = 'b' GROUP BY place", "tdengine")).withColumn("n", F.col("n").cast("int"))
