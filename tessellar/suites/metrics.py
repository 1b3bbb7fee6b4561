"""Metric, pipe, target and JSON dialects over events; search and vectors; streams; sources and user functions."""

from __future__ import annotations

import json
import tempfile
import uuid

import pandas as pd
from pyspark.sql import functions as F


from ..functions import udfs
from ..functions.scalars import micros
from ..operators import aggregates, changes, search, text, vector
from ..sources import text as lines
from ..sources import vectors
from ..streaming import views
from .base import query
from .base import text as registered

H, D = 3_600_000_000, 86_400_000_000
T = "epoch_us(ts)"
START, END = 1_704_153_600_000_000, 1_706_572_800_000_000  # 2024-01-02 to 2024-01-30


def prom(name: str, body: str, sql: str, step: int = D, **options) -> None:
    registered(name, "promql", body, sql, table="events", start=START, end=END, step=step, **options)


_STEPS = f"WITH g AS (SELECT unnest(range({START}, {END} + 1, {D})) AS t)"
_PAIRS = f", p AS (SELECT event_type, user_id, value AS v, {T} AS ts, lag(value) OVER w AS q, lag({T}) OVER w AS pt FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, event_id)), r AS (SELECT *, v - q AS d, CASE WHEN v < q THEN v ELSE v - q END AS rise FROM p WHERE pt IS NOT NULL)"
prom("promql_sum_by_rate", "sum by (event_type) (rate(view[3d])) or sum by (event_type) (rate(click[3d]))",
     f"{_STEPS}{_PAIRS} SELECT event_type, t, round(sum(rise) / {3 * D / 1e6}, 6) AS v FROM g JOIN r ON ts <= t AND pt > t - {3 * D} WHERE event_type IN ('view', 'click') GROUP BY 1, 2")
prom("promql_increase_resets", 'increase({__name__=~"view|error",user_id=~"1.?"}[5d])', f"{_STEPS}{_PAIRS} SELECT event_type, user_id, t, round(sum(rise), 6) AS v FROM g JOIN r ON ts <= t AND pt > t - {5 * D} WHERE event_type IN ('view', 'error') AND regexp_full_match(user_id::VARCHAR, '1.?') GROUP BY 1, 2, 3")
prom("promql_avg_over_time", "avg by (event_type) (avg_over_time(purchase[2d]))", f"{_STEPS}, a AS (SELECT event_type, user_id, t, avg(value) AS v FROM g JOIN events ON {T} <= t AND {T} > t - {2 * D} WHERE event_type = 'purchase' GROUP BY 1, 2, 3) SELECT event_type, t, round(avg(v), 6) AS v FROM a GROUP BY 1, 2")
prom("promql_topk", "topk(3, sum_over_time(view[7d]))", f"{_STEPS}, a AS (SELECT event_type, user_id, t, sum(value) AS v FROM g JOIN events ON {T} <= t AND {T} > t - {7 * D} WHERE event_type = 'view' GROUP BY 1, 2, 3) SELECT event_type, user_id, t, round(v, 6) AS v FROM a QUALIFY row_number() OVER (PARTITION BY t ORDER BY v DESC, event_type, user_id) <= 3")
prom("promql_instant", "max by (event_type) (last_over_time(signup[1d])) + 1 > 50", f"{_STEPS}, a AS (SELECT user_id, t, arg_max(value, ts) AS v FROM g JOIN events ON {T} <= t AND {T} > t - {D} WHERE event_type = 'signup' GROUP BY 1, 2) SELECT 'signup' AS event_type, t, round(max(v) + 1, 6) AS v FROM a GROUP BY t HAVING max(v) + 1 > 50")
prom("promql_lookback", "count by (event_type) (click)", f"{_STEPS}, a AS (SELECT user_id, t, max({T}) AS m FROM g JOIN events ON {T} <= t AND {T} > t - 86400000000 WHERE event_type = 'click' GROUP BY 1, 2) SELECT 'click' AS event_type, t, count(*)::DOUBLE AS v FROM a GROUP BY t", lookback=D)
prom("promql_quantile_stddev", "quantile by (event_type) (0.5, max_over_time(view[2d])) / stddev by (event_type) (max_over_time(view[2d]))", f"{_STEPS}, a AS (SELECT user_id, t, max(value) AS v FROM g JOIN events ON {T} <= t AND {T} > t - {2 * D} WHERE event_type = 'view' GROUP BY 1, 2) SELECT 'view' AS event_type, t, round(quantile_cont(v, 0.5) / stddev_pop(v), 6) AS v FROM a GROUP BY t")
prom("metricsql_range_max", "range_max(sum by (event_type) (count_over_time(error[1d])))", f"{_STEPS}, a AS (SELECT t, count(*)::DOUBLE AS v FROM g JOIN events ON {T} <= t AND {T} > t - {D} WHERE event_type = 'error' GROUP BY 1) SELECT 'error' AS event_type, t, max(v) OVER () AS v FROM a")
prom("promql_label_functions", 'sum by (kind) (label_replace(sum_over_time(view[4d]), "kind", "u$1", "user_id", "(.).*"))', f"{_STEPS} SELECT 'u' || substr(user_id::VARCHAR, 1, 1) AS kind, t, round(sum(value), 6) AS v FROM g JOIN events ON {T} <= t AND {T} > t - {4 * D} WHERE event_type = 'view' GROUP BY 1, 2")
prom("promql_offset_delta", "sum by (event_type) (delta(click[3d] offset 1d))", f"{_STEPS}{_PAIRS} SELECT event_type, t, round(sum(d), 6) AS v FROM g JOIN r ON ts + {D} <= t AND pt + {D} > t - {3 * D} WHERE event_type = 'click' GROUP BY 1, 2")


@query("promql_hist_quantile", f"WITH b AS (SELECT event_type, unnest([10, 25, 50, 75, 1e9]) AS le FROM (SELECT DISTINCT event_type FROM events)), c AS (SELECT b.event_type, le, count(*) FILTER (WHERE value <= le)::DOUBLE AS v FROM b JOIN events e ON e.event_type = b.event_type GROUP BY 1, 2), x AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(v) OVER w, 0) AS pv, max(v) OVER (PARTITION BY event_type) * 0.6 AS rk FROM c WINDOW w AS (PARTITION BY event_type ORDER BY le)) SELECT event_type, round(min(CASE WHEN le = 1e9 THEN lo ELSE lo + (le - lo) * (rk - pv) / (v - pv) END), 6) AS v FROM x WHERE v >= rk AND pv < rk GROUP BY 1")
def _(e, sf):
    ev = e.catalog.frame("events")
    b = F.explode(F.array(*[F.struct(F.lit(x).alias("le"), F.lit(y).alias("top")) for x, y in (("10", 10.0), ("25", 25.0), ("50", 50.0), ("75", 75.0), ("+Inf", 1e300))]))
    h = ev.select("event_type", "value", b.alias("b")).groupBy(F.lit("h").alias("metric"), "event_type", "b.le").agg(F.sum((F.col("value") <= F.col("b.top")).cast("double")).alias("value")).withColumn("ts", F.timestamp_micros(F.lit(START)))
    e.catalog.add("hist", h, time="ts", tags=("metric", "event_type", "le"), value="value")
    return e.metrics("histogram_quantile(0.6, sum by (event_type, le) (h))", "hist", start=START, end=START, step=D).select("event_type", "v")


registered("flux_agg_window", "flux", 'from(bucket: "db") |> range(start: 2024-01-03T00:00:00Z, stop: 2024-01-25T00:00:00Z) |> filter(fn: (r) => r._measurement == "events" and r._value > 5.0 and r["event_type"] != "error") |> group(columns: ["event_type"]) |> aggregateWindow(every: 12h, fn: mean, createEmpty: false)',
           f"SELECT event_type, {T} // {12 * H} * {12 * H} AS _time, round(avg(value), 6) AS _value FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-25' AND value > 5 AND event_type <> 'error' GROUP BY 1, 2")
registered("flux_difference", "flux", 'from(bucket: "events") |> range(start: -20d) |> group(columns: ["event_type"]) |> aggregateWindow(every: 1d, fn: sum) |> difference() |> map(fn: (r) => ({_value: r._value * 2.0}))',
           f"WITH a AS (SELECT event_type, {T} // {D} * {D} AS _time, sum(value) AS v FROM events WHERE {T} >= 1706659200000000 - {20 * D} GROUP BY 1, 2), b AS (SELECT event_type, _time, round((v - lag(v) OVER (PARTITION BY event_type ORDER BY _time)) * 2, 6) AS _value FROM a) SELECT * FROM b WHERE _value IS NOT NULL")
registered("graphite_summarize", "graphite", "summarize(sumSeries(events.{view,click}.*), '6h', 'max')", f"WITH a AS (SELECT {T} AS t, sum(value) AS v FROM events WHERE event_type IN ('view', 'click') GROUP BY 1) SELECT 'sumseries' AS series, t // {6 * H} * {6 * H} AS t, round(max(v), 6) AS v FROM a GROUP BY 2")
registered("graphite_highest", "graphite", "scale(highestMax(summarize(events.purchase.*, '1d', 'sum'), 3), 10)",
           f"WITH a AS (SELECT concat_ws('.', 'events', event_type, user_id::VARCHAR) AS series, {T} // {D} * {D} AS t, sum(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), k AS (SELECT series FROM a GROUP BY 1 ORDER BY max(v) DESC, series LIMIT 3) SELECT series, t, round(v * 10, 6) AS v FROM a WHERE series IN (SELECT series FROM k)")
registered("opentsdb_downsample", "opentsdb", json.dumps({"start": "2024-01-05", "queries": [{"metric": "events", "aggregator": "sum", "tags": {"event_type": "view|click"}, "downsample": "12h-avg"}]}),
           f"WITH a AS (SELECT event_type, user_id, {T} // {12 * H} * {12 * H} AS t, avg(value) AS v FROM events WHERE event_type IN ('view', 'click') AND ts >= TIMESTAMP '2024-01-05' GROUP BY 1, 2, 3) SELECT 'events' AS metric, event_type, t, round(sum(v), 6) AS v FROM a GROUP BY event_type, t")
_DRUID = {"dataSource": "events", "intervals": ["2024-01-03/2024-01-20"], "aggregations": [{"type": "count", "name": "n"}, {"type": "doubleSum", "name": "s", "fieldName": "value"}]}
_WHERE = "ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20'"
registered("druid_timeseries", "druid_native", json.dumps({"queryType": "timeseries", "granularity": "hour", "filter": {"type": "not", "field": {"type": "selector", "dimension": "event_type", "value": "error"}}, "postAggregations": [{"type": "arithmetic", "name": "mean", "fn": "/", "fields": [{"type": "fieldAccess", "fieldName": "s"}, {"type": "fieldAccess", "fieldName": "n"}]}]} | _DRUID),
           f"SELECT {T} // {H} * {H} AS t, count(*) AS n, round(sum(value), 6) AS s, round(sum(value) / count(*), 6) AS mean FROM events WHERE {_WHERE} AND event_type <> 'error' GROUP BY 1")
registered("druid_topn", "druid_native", json.dumps({"queryType": "topN", "granularity": "all", "dimension": "user_id", "metric": "s", "threshold": 7} | _DRUID), f"SELECT user_id, count(*) AS n, round(sum(value), 6) AS s FROM events WHERE {_WHERE} GROUP BY 1 ORDER BY sum(value) DESC, user_id LIMIT 7")
registered("druid_groupby", "druid_native", json.dumps({"queryType": "groupBy", "granularity": "day", "dimensions": ["event_type"], "having": {"type": "greaterThan", "aggregation": "n", "value": 5}, "filter": {"type": "bound", "dimension": "value", "lower": "10", "upper": "90", "ordering": "numeric"}} | _DRUID), f"SELECT {T} // {D} * {D} AS t, event_type, count(*) AS n, round(sum(value), 6) AS s FROM events WHERE {_WHERE} AND value BETWEEN 10 AND 90 GROUP BY 1, 2 HAVING count(*) > 5")
registered("druid_time_boundary", "druid_native", json.dumps({"queryType": "timeBoundary", "dataSource": "events"}), f"SELECT min({T}) AS \"minTime\", max({T}) AS \"maxTime\" FROM events")
registered("druid_search", "druid_native", json.dumps({"queryType": "search", "dataSource": "events", "searchDimensions": ["event_type"], "query": {"type": "insensitive_contains", "value": "I"}}), "SELECT 'event_type' AS dimension, event_type AS value, count(*) AS count FROM events WHERE contains(event_type, 'i') GROUP BY event_type")


@query("translate_roundtrip", f"SELECT event_type, {T} // {6 * H} * {6 * H} AS _wstart, {T} // {6 * H} * {6 * H} + {6 * H} AS _wend, round(avg(value), 6) AS v FROM events WHERE event_type <> 'error' GROUP BY 1, 2, 3")
def _(e, sf):
    """A query printed in another dialect and run there."""
    body = e.translate("SELECT MEAN(value) AS v FROM events WHERE event_type != 'error' GROUP BY time(6h), event_type FILL(none)", "tdengine", "influxql")
    return e.query(body.replace("mean(", "avg("), "tdengine")


@query("influx_metadata", "SELECT 'events' AS name, 'event_type' AS key UNION ALL SELECT 'events', 'user_id'")
def _(e, sf):
    return e.query("SHOW TAG KEYS FROM events", "influxql")


@query("influx_tag_values", "SELECT DISTINCT 'event_type' AS key, event_type AS value FROM events")
def _(e, sf):
    return e.query('SHOW TAG VALUES FROM events WITH KEY = "event_type"', "influxql")


# Search and vectors
_TOK = r"WITH w AS (SELECT doc_id AS doc, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+', ' ', 'g')), ' ') AS l FROM documents), t AS (SELECT doc, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS pos FROM w), k AS (SELECT * FROM t WHERE token <> '')"


def _tokens(e):
    return text.tokens(e.catalog.frame("documents"), "doc_id", "text", stemmed=False, stops=False)


def _lists(e):
    return text.word_lists(e.catalog.frame("documents"), "doc_id", "text", stemmed=False, stops=False)


@query("fts_tfidf", _TOK + ", c AS (SELECT doc, count(*) AS len, count(*) FILTER (token = 'inthe') AS a, count(*) FILTER (token = 'thou') AS b FROM k GROUP BY 1), s AS (SELECT count(*) AS n, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c) SELECT doc, round(CASE WHEN a > 0 THEN a / len * ln(n / da) ELSE 0 END + CASE WHEN b > 0 THEN b / len * ln(n / db) ELSE 0 END, 6) AS score FROM c, s WHERE a > 0 OR b > 0")
def _(e, sf):
    return text.tf_idf(_lists(e), ["inthe", "thou"])


@query("fts_bm25", _TOK + ", c AS (SELECT doc, count(*) AS len, count(*) FILTER (token = 'ention') AS a, count(*) FILTER (token = 'thou') AS b FROM k GROUP BY 1), s AS (SELECT count(*) AS n, avg(len) AS al, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c) SELECT doc, round(CASE WHEN a > 0 THEN ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / al)) ELSE 0 END + CASE WHEN b > 0 THEN ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / al)) ELSE 0 END, 6) AS score FROM c, s WHERE a > 0 OR b > 0")
def _(e, sf):
    return text.bm25(_lists(e), ["ention", "thou"])


@query("fts_phrase", _TOK + " SELECT a.doc, count(*) AS hits FROM k a JOIN k b ON a.doc = b.doc AND b.pos = a.pos + 1 WHERE a.token = 'of' AND b.token = 'the' GROUP BY 1")
def _(e, sf):
    return text.phrase(_tokens(e), ["of", "the"])


@query("fts_prefix", _TOK + " SELECT doc, count(*) AS hits FROM k WHERE starts_with(token, 'inth') GROUP BY 1")
def _(e, sf):
    return text.prefix(_tokens(e), "inth")


@query("fts_regex", _TOK + " SELECT doc, count(*) AS hits FROM k WHERE regexp_matches(token, '^on.*ing$') GROUP BY 1")
def _(e, sf):
    return text.regex(_tokens(e), "^on.*ing$")


@query("fts_fuzzy", _TOK + ", a AS (SELECT doc, regexp_replace(token, '[^\\x00-\\x7F]', '#', 'g') AS token FROM k) SELECT doc, round(max(1 - levenshtein(token, 'nation') / greatest(length(token), 6)::DOUBLE), 6) AS score FROM a WHERE levenshtein(token, 'nation') <= 2 GROUP BY 1")
def _(e, sf):
    return text.fuzzy(_tokens(e), "nation")


@query("fts_boolean", _TOK + " SELECT doc FROM k GROUP BY doc HAVING bool_or(token = 'the') AND NOT bool_or(token = 'idiot') AND (bool_or(token = 'er') OR bool_or(token = 'sh'))")
def _(e, sf):
    return text.boolean(_tokens(e), ["the"], ["er", "sh"], ["idiot"])


@query("fts_exact_hits", _TOK + " SELECT doc, count(*)::DOUBLE AS score FROM k WHERE token IN ('of', 'is') GROUP BY 1")
def _(e, sf):
    return text.exact_hits(_tokens(e), ["of", "is"])


_STEM = """CASE WHEN suffix(token, 'ies') AND length(token) > 4 THEN left(token, -3) || 'y' WHEN suffix(token, 'es') AND length(token) > 3 THEN left(token, -2) WHEN suffix(token, 's') AND NOT suffix(token, 'ss') AND length(token) > 3 THEN left(token, -1)
     WHEN suffix(token, 'ing') AND length(token) > 5 THEN left(token, -3) WHEN suffix(token, 'ed') AND length(token) > 4 THEN left(token, -2) WHEN suffix(token, 'ly') AND length(token) > 4 THEN left(token, -2) ELSE token END"""
_STOPS = "('a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'has', 'have', 'he', 'in', 'is', 'it', 'its', 'of', 'on', 'or', 'she', 'that', 'the', 'they', 'this', 'to', 'was', 'were', 'will', 'with', 'you', 'your')"


@query("fts_stemmed", f"{_TOK}, q AS (SELECT doc, {_STEM} AS token FROM k WHERE token NOT IN {_STOPS}) SELECT token, count(*) AS n, count(DISTINCT doc) AS docs FROM q GROUP BY 1 HAVING count(DISTINCT doc) > 20")
def _(e, sf):
    return text.tokens(e.catalog.frame("documents"), "doc_id", "text").groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("docs")).filter("docs > 20")


_V = "list_transform(embedding, lambda x: x::DOUBLE)"
_QUERY = [0.1, -0.2, 0.05, 0.3] * 16
_Q = "[" + ", ".join(f"{x}::DOUBLE" for x in _QUERY) + "]"
_DIST = {
    "l2": f"list_distance({_V}, {_Q})", "cosine": f"1 - list_cosine_similarity({_V}, {_Q})", "dot": f"-list_inner_product({_V}, {_Q})",
    "manhattan": f"list_sum(list_transform(list_zip({_V}, {_Q}), lambda z: abs(z[1] - z[2])))",
}
for metric, sql in _DIST.items():

    @query(f"knn_{metric}", f"SELECT vec_id, round({sql}, 6) AS distance FROM embeddings ORDER BY {sql}, vec_id LIMIT 10")
    def _(e, sf, metric=metric):
        return vector.knn(e.catalog.frame("embeddings"), "embedding", _QUERY, 10, metric).select("vec_id", "distance")


@query("knn_filtered", f"SELECT vec_id, round({_DIST['l2']}, 6) AS distance FROM embeddings WHERE label IN (1, 3, 5) AND NOT label >= 5 ORDER BY {_DIST['l2']}, vec_id LIMIT 5")
def _(e, sf):
    where = search.points_filter({"must": [{"key": "label", "match": {"any": [1, 3, 5]}}], "must_not": [{"key": "label", "range": {"gte": 5}}]})
    return vector.knn(e.catalog.frame("embeddings"), "embedding", _QUERY, 5, "l2", where).select("vec_id", "distance")


@query("knn_batch", f"WITH q AS (SELECT vec_id AS query_id, {_V} AS q FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT query_id, vec_id, list_distance({_V}, q) AS d FROM embeddings, q WHERE vec_id <> query_id) SELECT query_id, vec_id, round(d, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM d QUALIFY rank <= 3")
def _(e, sf):
    df = e.catalog.frame("embeddings")
    return vector.knn_batch(df, df.filter("vec_id % 100 = 0"), "embedding", "vec_id", 3)


@query("vector_normalise", f"SELECT label, round(avg(sqrt(list_inner_product(n, n))), 6) AS len FROM (SELECT label, list_transform({_V}, lambda x: x / sqrt(list_inner_product({_V}, {_V}))) AS n FROM embeddings) GROUP BY 1")
def _(e, sf):
    n = vector.normalise(vector.doubles("embedding"))
    return e.catalog.frame("embeddings").select("label", vector.norm(n).alias("len")).groupBy("label").agg(F.avg("len").alias("len"))


@query("hybrid_search", f"""{_TOK}, l AS (SELECT doc AS id, count(*)::DOUBLE AS score FROM k WHERE token = 'of' GROUP BY 1), s AS (SELECT vec_id AS id, list_cosine_similarity({_V}, {_Q}) AS score FROM embeddings) SELECT coalesce(s.id, l.id) AS id, round(0.7 * coalesce(s.score, 0) + 0.3 * coalesce(l.score, 0), 6) AS score FROM s FULL JOIN l ON s.id = l.id""")
def _(e, sf):
    q = F.array(*[F.lit(x) for x in _QUERY])
    semantic = e.catalog.frame("embeddings").select(F.col("vec_id").alias("id"), vector.cosine(vector.doubles("embedding"), q).alias("score"))
    return vector.hybrid(semantic, text.exact_hits(_tokens(e), ["of"]).withColumnRenamed("doc", "id"), "id", 0.7)


@query("es_bool_query", "SELECT p_partkey, round(p_retailprice, 6) AS p_retailprice FROM part WHERE p_size BETWEEN 5 AND 30 AND starts_with(p_brand, 'Brand#') AND (p_type ILIKE '%steel%' OR p_size = 7) AND NOT regexp_matches(p_brand, '^Brand#.3$') ORDER BY p_retailprice DESC, p_partkey LIMIT 15")
def _(e, sf):
    q = {"query": {"bool": {"must": [{"range": {"p_size": {"gte": 5, "lte": 30}}}, {"prefix": {"p_brand": "Brand#"}}], "should": [{"match": {"p_type": "steel"}}, {"term": {"p_size": 7}}], "minimum_should_match": 1, "must_not": [{"wildcard": {"p_brand": "Brand#?3"}}]}}, "sort": [{"p_retailprice": "desc"}, "p_partkey"], "size": 15, "_source": ["p_partkey", "p_retailprice"]}
    return e.query(q, "search", table="part")


@query("es_aggs", "SELECT event_type AS key, count(*) AS doc_count, round(avg(value), 6) AS mean, count(DISTINCT user_id) AS users FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def _(e, sf):
    return search.aggregate(e.catalog.frame("events"), {"kinds": {"terms": {"field": "event_type", "size": 3}, "aggs": {"mean": {"avg": {"field": "value"}}, "users": {"cardinality": {"field": "user_id"}}}}})


@query("es_histogram_stats", "SELECT floor(value / 5) * 5 AS key, count(*) AS doc_count, round(sum(value), 6) AS s FROM events GROUP BY 1")
def _(e, sf):
    return search.aggregate(e.catalog.frame("events"), {"h": {"histogram": {"field": "value", "interval": 5}, "aggs": {"s": {"sum": {"field": "value"}}}}})


@query("es_stats", "SELECT count(value) AS v_value_count, round(min(value), 6) AS v_min, round(max(value), 6) AS v_max, round(avg(value), 6) AS v_avg, round(sum(value), 6) AS v_sum FROM events")
def _(e, sf):
    return search.aggregate(e.catalog.frame("events"), {"v": {"stats": {"field": "value"}}})


# Streams: the same results as in a batch
def _stream(e, sf):
    return views.read(e.catalog.spark, sf, e.catalog.frame("events").schema, pattern="events.parquet")


def _once(e, sf, df, mode: str):
    name = f"stream_{abs(hash((sf, mode, tuple(df.columns)))) % 10**9}"
    spark = e.catalog.spark
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all of it shares")
        base = "file://" + tempfile.mkdtemp()
    return views.run_once(df, name, mode, f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}")


@query("stream_tumbling", f"SELECT {T} // {D} * {D} AS _wstart_us, {T} // {D} * {D} + {D} AS _wend_us, event_type, count(*) AS n, round(sum(value), 6) AS s FROM events GROUP BY 1, 2, 3")
def _(e, sf):
    return _once(e, sf, views.tumbling(_stream(e, sf), "ts", "1 day", ["event_type"], [F.count("*").alias("n"), F.sum("value").alias("s")]), "complete")


@query("stream_sliding", f"WITH w AS (SELECT *, unnest([{T} // {6 * H} * {6 * H}, {T} // {6 * H} * {6 * H} - {6 * H}]) AS s FROM events) SELECT s AS _wstart_us, s + {12 * H} AS _wend_us, count(*) AS n FROM w GROUP BY 1, 2")
def _(e, sf):
    return _once(e, sf, views.sliding(_stream(e, sf), "ts", "12 hours", "6 hours", [], [F.count("*").alias("n")]), "complete")


@query("stream_session", f"WITH a AS (SELECT *, {T} AS t, coalesce({T} - lag({T}) OVER (PARTITION BY user_id ORDER BY ts) > {8 * H}, false) AS b FROM events), g AS (SELECT *, sum(b::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM a) SELECT min(t) AS _wstart_us, user_id, count(*) AS n, max(t) AS _wend FROM g GROUP BY user_id, k")
def _(e, sf):
    return _once(e, sf, views.session(_stream(e, sf), "ts", "8 hours", ["user_id"], [F.count("*").alias("n")]), "complete")


@query("stream_view", "SELECT event_type, count(*) AS n, round(sum(value), 6) AS s, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(avg(value), 6) AS mean FROM events WHERE value > 20 GROUP BY 1")
def _(e, sf):
    aggs = [F.count("*").alias("n"), F.sum("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean")]
    return _once(e, sf, views.view(_stream(e, sf), ["event_type"], aggs, F.col("value") > 20), "complete")


@query("stream_join", "SELECT a.event_id AS click, b.event_id AS buy FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def _(e, sf):
    s = _stream(e, sf)
    a = s.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click"))
    b = _stream(e, sf).filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"), F.col("event_id").alias("buy"))
    return _once(e, sf, views.interval_join(a, b, ["user_id"], "ts", "bought", "6 hours").select("click", "buy"), "append")


# Sources and user functions
@query("line_protocol_roundtrip", f"SELECT event_type, user_id::VARCHAR AS user_id, event_id, round(value, 6) AS value, {T} AS ts_us FROM events")
def _(e, sf):
    out = lines.to_line_protocol(e.catalog.frame("events"), "events", ["event_type", "user_id"], ["event_id", "value"], micros("ts"))
    back = lines.line_protocol(out)
    return back.select(F.col("tags")["event_type"].alias("event_type"), F.col("tags")["user_id"].alias("user_id"), lines.field_value(F.col("fields"), "event_id", "long").alias("event_id"), lines.field_value(F.col("fields"), "value").alias("value"), "ts_us")


@query("put_lines", f"SELECT 'm.' || event_type AS metric, {T} // 1000000 * 1000000 AS ts_us, round(value, 6) AS value, user_id::VARCHAR AS u FROM events")
def _(e, sf):
    ev = e.catalog.frame("events")
    raw = ev.select(F.concat(F.lit("put m."), "event_type", F.lit(" "), F.floor(micros("ts") / 1_000_000).cast("string"), F.lit(" "), F.col("value").cast("string"), F.lit(" u="), F.col("user_id").cast("string")).alias("value"))
    return lines.put_lines(raw).select("metric", "ts_us", "value", F.col("tags")["u"].alias("u"))


@query("exposition_lines", "SELECT 'm_' || event_type AS name, user_id::VARCHAR AS u, round(value, 6) AS value FROM events")
def _(e, sf):
    raw = e.catalog.frame("events").select(F.concat(F.lit("m_"), "event_type", F.lit('{u="'), F.col("user_id").cast("string"), F.lit('",x="a\\"b"} '), F.col("value").cast("string")).alias("value"))
    return lines.exposition(raw).select("name", F.col("labels")["u"].alias("u"), "value")


@query("vector_export_import", "SELECT vec_id AS id, label, len(embedding) AS n FROM embeddings")
def _(e, sf):
    out = vectors.export(e.catalog.frame("embeddings"), "qdrant", "vec_id", "embedding", ["label"])
    return vectors.load(out, "qdrant", "label int").select("id", "label", F.size("vector").cast("long").alias("n"))


@query("format_rows", "SELECT concat_ws(chr(9), r_regionkey::VARCHAR, r_name) AS value FROM region")
def _(e, sf):
    return lines.formatted(e.catalog.frame("region"), "tsv")


@query("udf_scalar", "SELECT event_id, round(value * value + 1, 6) AS v FROM events WHERE event_type = 'click'")
def _(e, sf):
    udfs.scalar("square_plus", lambda s: s * s + 1, "double")
    return e.query("SELECT event_id, square_plus(value) AS v FROM events WHERE event_type = 'click'", "lql")


@query("udaf_spread", "SELECT event_type, round(max(value) - min(value), 6) AS v FROM events GROUP BY 1")
def _(e, sf):
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    f = udfs.aggregate("spread_of", spread, "double")
    return e.catalog.frame("events").groupBy("event_type").agg(f("value").alias("v"))


@query("udaf_mergeable", "SELECT event_type, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY 1")
def _(e, sf):
    return udfs.mergeable(e.catalog.frame("events"), ["event_type"], {"n": F.count("value"), "q": F.sum(F.col("value") * F.col("value"))}, {"rms": F.sqrt(F.col("q") / F.col("n"))})


@query("udtf", "SELECT n_nationkey, unnest(range(0, n_nationkey % 3)) AS k FROM nation")
def _(e, sf):
    class Counter:
        def eval(self, n: int):
            for k in range(n):
                yield (k,)

    udfs.table(e.catalog.spark, "count_up", Counter, "k bigint")
    return e.sql("SELECT n_nationkey, c.k FROM nation, LATERAL count_up(n_nationkey % 3) AS c")


@query("trace_durations", "SELECT user_id, count(*) AS spans, round(sum(value), 6) AS busy FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def _(e, sf):
    """Spans (trace, start, end in nanoseconds, attributes) and the time that each trace is busy."""
    spans = e.catalog.frame("events").select(F.col("user_id").alias("trace_id"), (micros("ts") * 1000).alias("start"), F.col("value"), F.create_map(F.lit("kind"), "event_type").alias("attributes"))
    spans = spans.withColumn("end", F.col("start") + (F.col("value") * 1e9).cast("decimal(28,0)").cast("long")).filter(F.col("attributes")["kind"].isin("view", "click"))
    return spans.groupBy(F.col("trace_id").alias("user_id")).agg(F.count("*").alias("spans"), F.round(F.sum((F.col("end") - F.col("start")) / 1e9), 6).alias("busy"))


registered("nql_last_days", "nql", "count events in the last 7 days where value is above 10", "SELECT count(*) AS count FROM events WHERE ts >= TIMESTAMP '2024-01-24' AND value > 10")
registered("nql_measure_window", "nql", "average value of events every 6 hours by event_type", f"SELECT event_type, {T} // {6 * H} * {6 * H} AS _wstart, {T} // {6 * H} * {6 * H} + {6 * H} AS _wend, round(avg(value), 6) AS avg_value FROM events GROUP BY 1, 2, 3")
registered("cql_query", "cql", "SELECT event_id, value FROM events WHERE user_id = 7 AND value >= 20 ORDER BY event_id DESC LIMIT 9 ALLOW FILTERING", "SELECT event_id, round(value, 6) AS value FROM events WHERE user_id = 7 AND value >= 20 ORDER BY event_id DESC LIMIT 9")
registered("mysql_query", "mysql", "SELECT `o_orderstatus`, COUNT(*) AS n FROM `orders` GROUP BY `o_orderstatus` ORDER BY n DESC, `o_orderstatus` LIMIT 1, 2", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_orderstatus LIMIT 2 OFFSET 1")
registered("postgres_query", "postgres", "SELECT \"o_orderkey\", o_totalprice::bigint AS p FROM orders WHERE o_orderpriority ILIKE '%urgent' AND o_totalprice > 250000", "SELECT o_orderkey, cast(trunc(o_totalprice) AS BIGINT) AS p FROM orders WHERE o_orderpriority ILIKE '%urgent' AND o_totalprice > 250000")
registered("graphite_moving_median", "graphite", "movingMedian(summarize(events.view.*, '1d', 'sum'), 3)",
           f"WITH a AS (SELECT concat_ws('.', 'events', event_type, user_id::VARCHAR) AS series, {T} // {D} * {D} AS t, sum(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1, 2), b AS (SELECT series, t, median(v) OVER (PARTITION BY series ORDER BY t ROWS 2 PRECEDING) AS v, row_number() OVER (PARTITION BY series ORDER BY t) AS r FROM a) SELECT series, t, round(v, 6) AS v FROM b WHERE r >= 3")


@query("hll_sketch_merge", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def _(e, sf):
    """Parts of each day, merged. The SQL counts exactly, which a sketch of 2**14 registers does for a few thousand users at
    most: the parts are the distinct users themselves."""
    ev = e.catalog.frame("events").withColumn("day", F.to_date("ts"))
    merged = aggregates.merge_distinct(aggregates.distinct_parts(ev, ["event_type", "day"], "user_id"), ["event_type"], "user_id")
    return merged.withColumnRenamed("n", "users")


@query("cdc_difference", "SELECT r_regionkey, CASE WHEN r_regionkey = 99 THEN 'insert' WHEN r_name = 'ASIA' THEN 'update' ELSE 'delete' END AS op FROM (SELECT * FROM region UNION ALL SELECT 99, 'Moon') WHERE r_regionkey = 99 OR r_name IN ('ASIA', 'AFRICA')")
def _(e, sf):
    old = e.catalog.frame("region")
    e.query("UPDATE region SET r_name = 'East' WHERE r_name = 'ASIA'", "lql")
    e.query("DELETE FROM region WHERE r_name = 'AFRICA'", "lql")
    e.query("INSERT INTO region (r_regionkey, r_name) VALUES (99, 'Moon')", "lql")
    return changes.difference(old, e.catalog.frame("region"), ["r_regionkey"]).select("r_regionkey", "op")


@query("text_chunks", "WITH w AS (SELECT doc_id AS doc, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS l FROM documents), c AS (SELECT doc, l, unnest(range(0, greatest(1, cast(ceil((len(l) - 20) / 80.0) AS BIGINT)))) AS chunk FROM w WHERE len(l) > 0) SELECT doc, chunk, array_to_string(l[chunk * 80 + 1:chunk * 80 + 100], ' ') AS text FROM c")
def _(e, sf):
    return text.chunks(e.catalog.frame("documents"), "doc_id", "text", 100, 20)


@query("trace_tree", "SELECT a.event_id AS span_id, b.event_id AS parent_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id = (a.event_id - a.event_id % 50) AND a.event_id <> b.event_id")
def _(e, sf):
    """Spans with their parents, by a self-join within the trace."""
    spans = e.catalog.frame("events").select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"), (F.col("event_id") - F.col("event_id") % 50).alias("parent_span_id"))
    parents = spans.select("trace_id", F.col("span_id").alias("parent_id"))
    return spans.join(parents, [spans.trace_id == parents.trace_id, spans.parent_span_id == parents.parent_id]).filter("span_id != parent_id").select("span_id", "parent_id")
