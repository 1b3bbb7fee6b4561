"""Literal expectations on small fixtures, dialect by dialect."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tessellar import catalogue
from tessellar.catalog import Catalog
from tessellar.dialects import detect, english, flux, printers, promql, requests, sql, targets
from tessellar.engine import Engine
from tessellar.operators import aggregates, changes, documents, joins, search, series, text, vector, windows
from tessellar.plans import ir
from tessellar.plans.durations import micros
from tessellar.plans.grammar import ParseError
from tessellar.sources import text as lines
from tessellar.streaming import views

EPOCH = datetime.datetime(1970, 1, 1)


def at(ms: int) -> datetime.datetime:
    return EPOCH + datetime.timedelta(milliseconds=ms)


@pytest.fixture
def users(spark):
    rows = [("Alice", 28, "alice@example.com", "active"), ("Bob", 32, "bob@test.com", "active"), ("Charlie", 25, "charlie@example.com", "inactive"), ("Diana", 30, "diana@test.com", None)]
    return Engine(Catalog(spark).add("users", spark.createDataFrame(rows, "name string, age int, email string, status string")))


@pytest.mark.parametrize(
    ("where", "n"),
    [
        ("email LIKE '%example.com'", 2), ("email LIKE '%EXAMPLE.com'", 2), ("age IN (28, 30)", 2), ("age BETWEEN 26 AND 31", 2), ("email CONTAINS 'example'", 2), ("age > 25", 3), ("age = 28 OR age = 30 AND name = 'Diana'", 2),
        ("(age = 28 OR age = 30) AND name = 'Diana'", 1), ("status != 'active'", 2), ("status NOT IN ('active')", 2), ("status IS NULL", 1), ("name STARTS WITH 'A'", 1), ("email ENDS WITH 'test.com'", 2), ("name MATCHES '^[AB]'", 2),
        ("NOT age > 28", 2), ("age % 2 = 0 AND age / 2 >= 15", 2), ("name NOT LIKE 'a%'", 3), ("status NOT LIKE 'x%'", 4),
    ],
)
def test_predicates(users, where, n):
    assert users.query(f"SELECT name FROM users WHERE {where}", "lql").count() == n


def test_order_limit_star(users):
    rows = users.query("SELECT * FROM users ORDER BY age", "lql").collect()
    assert [r.name for r in rows] == ["Charlie", "Alice", "Diana", "Bob"] and len(rows[0]) == 4
    assert [r.name for r in users.query("SELECT name FROM users ORDER BY age DESC LIMIT 2 OFFSET 1", "lql").collect()] == ["Diana", "Alice"]


def test_changes_are_new_versions(users):
    users.query("INSERT INTO users (name, age) VALUES ('Eve', 41), ('Zed', 19)", "lql")
    users.query("UPDATE users SET status = 'old' WHERE age > 30", "lql")
    users.query("DELETE FROM users WHERE age < 26", "lql")
    assert {(r.name, r.status) for r in users.query("SELECT * FROM users", "lql").collect()} == {("Alice", "active"), ("Bob", "old"), ("Diana", None), ("Eve", "old")}
    with pytest.raises(ParseError):
        users.query("UPDATE users SET age = 1", "lql")


def test_plain_english(users):
    q = lambda s: users.query(s, "nql")
    assert q("find all users where age is greater than 25").count() == 3
    assert [r.name for r in q("get first 2 users sorted by age descending").collect()] == ["Bob", "Diana"]
    assert q('count users where status equals "active"').first()[0] == 2
    assert q("show users where age is between 26 and 31 and email contains test").count() == 1
    assert q("list users where name is one of Alice, Bob or age at least 30").count() == 3
    assert q("get usres where status is missing").count() == 1  # a misspelt name
    q('add to users name "Alan", age 50')
    q('update users set status to "gone" where age over 45')
    q("remove users where age is under 26")
    assert {r.name: r.status for r in q("find users").collect()} == {"Alice": "active", "Bob": "active", "Diana": None, "Alan": "gone"}
    with pytest.raises(ParseError):
        q("remove users")


def test_json_queries(spark):
    rows = [("Widget", 29.99, "tools"), ("Gadget", 49.99, "electronics"), ("Gizmo", 99.99, "electronics")]
    e = Engine(Catalog(spark).add("products", spark.createDataFrame(rows, "name string, price double, category string")))
    got = e.query('{"find": "products", "filter": {"$and": [{"category": "electronics"}, {"price": {"$lt": 60}}]}}').collect()
    assert [r.name for r in got] == ["Gadget"]
    e.query('{"update": "products", "filter": {"name": "Gizmo"}, "set": {"price": 10.0}}')
    e.query('{"insert": "products", "documents": [{"name": "Doodad", "price": 5.0}]}')
    e.query('{"delete": "products", "filter": {"category": {"$exists": false}}}')
    assert e.query('{"count": "products", "filter": {"price": {"$lte": 30}}}').first()[0] == 2
    got = e.query('{"aggregate": "products", "pipeline": [{"$group": {"_id": "$category", "names": {"$push": "$name"}, "top": {"$max": "$price"}}}, {"$sort": {"_id": 1}}, {"$match": {"top": {"$gt": 1}}}]}').collect()
    assert [(r._id, r.names) for r in got] == [("electronics", ["Gadget", "Gizmo"]), ("tools", ["Widget"])]
    with pytest.raises(ValueError):
        e.query('{"aggregate": "products", "pipeline": [{"$frobnicate": 1}]}')


def test_joins(spark):
    a = spark.createDataFrame([(1, "Alice"), (2, "Bob"), (None, "Nil")], "id int, name string")
    b = spark.createDataFrame([(1, "login"), (1, "logout"), (3, "view"), (None, "none")], "id int, action string")
    got = joins.prefixed(a, b, "id")
    assert got.columns == ["left_id", "left_name", "right_id", "right_action"] and got.count() == 2
    assert joins.equi(a, b, "inner", [("id", "id")], null_safe=True).count() == 3
    assert joins.equi(a, b, "left", [("id", "id")]).count() == 4 and joins.equi(a, b, "anti", [("id", "id")]).count() == 2
    found = {r.name: [x.action for x in r.acts] for r in joins.lookup(a, b, "id", "id", "acts").collect()}
    assert found == {"Alice": ["login", "logout"], "Bob": [], "Nil": ["none"]}


def test_time_joins(spark):
    a = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "k int, t int")
    b = spark.createDataFrame([(1, 10, "x"), (1, 15, "y"), (2, 9, "z")], "k int, t int, v string")
    pick = lambda kind: sorted((r.k, r.t, r.right_v) for r in joins.time_join(a, b, [("k", "k")], "t", "t", kind).collect())
    assert pick("asof") == [(1, 10, "x"), (1, 20, "y"), (2, 5, None)]
    assert sorted(pick("lt"), key=str) == [(1, 10, None), (1, 20, "y"), (2, 5, None)]


def meters(spark, rows):
    return Engine(Catalog(spark).add("m", spark.createDataFrame([(at(t), float(v), s) for t, v, s in rows], "ts timestamp_ntz, value double, tag string"), time="ts", tags=("tag",), value="value"))


def test_windows(spark):
    e = meters(spark, [(0, 1, "a"), (30_000, 2, "a"), (60_000, 3, "a")])
    assert [r.v for r in e.query("SELECT AVG(value) AS v FROM m INTERVAL(1m)", "tdengine").orderBy("_wstart").collect()] == [1.5, 3.0]
    e = meters(spark, [(0, 1, "a"), (10_000, 1, "a"), (100_000, 1, "b")])
    assert sorted(r.n for r in e.query("SELECT COUNT(*) AS n FROM m SESSION(ts, 30s)", "tdengine").collect()) == [1, 2]
    assert sorted(r.n for r in e.query("SELECT COUNT(*) AS n FROM m STATE_WINDOW(tag)", "tdengine").collect()) == [1, 2]
    e = meters(spark, [(k * 1000, k, "a") for k in range(5)])
    assert sorted(r.n for r in e.query("SELECT COUNT(*) AS n FROM m COUNT_WINDOW(2)", "tdengine").collect()) == [1, 2, 2]
    assert [(r.n, r.s) for r in e.query("SELECT COUNT(*) AS n, SUM(value) AS s FROM m EVENT_WINDOW START WITH value >= 1 END WITH value = 3", "tdengine").collect()] == [(3, 6.0)]
    e = meters(spark, [(-1500, 1, "a"), (-500, 2, "a"), (500, 3, "a")])  # before 1970
    assert [r.s for r in e.query("SELECT SUM(value) AS s FROM m INTERVAL(1s)", "tdengine").orderBy("_wstart").collect()] == [1, 2, 3]


def test_fills(spark):
    rows = [(0, 1, "a"), (3000, 4, "a")]
    got = lambda mode: [r.v for r in meters(spark, rows).query(f"SELECT AVG(value) AS v FROM m INTERVAL(1s) FILL({mode})", "tdengine").orderBy("_wstart").collect()]
    assert got("NONE") == [1, 4] and got("NULL") == [1, None, None, 4] and got("PREV") == [1, 1, 1, 4] and got("NEXT") == [1, 4, 4, 4]
    assert got("LINEAR") == [1, 2, 3, 4] and got("NEAREST") == [1, 1, 4, 4] and got("VALUE, 7") == [1, 7, 7, 4]


def test_aggregates(spark):
    def one(fn, values):
        return meters(spark, [(k * 1000, v, "a") for k, v in enumerate(values)]).query(f"SELECT {fn} AS v FROM m", "tdengine").first().v

    assert one("AVG(value)", [1, 2, 3, 4, 5]) == 3 and one("STDDEV(value)", [2, 4, 4, 4, 5, 5, 7, 9]) == 2 and one("PERCENTILE(value, 50)", range(1, 11)) == 5 and one("SPREAD(value)", [1, 5, 3, 9, 2]) == 8
    assert one("TOP(value, 2)", [1, 9, 3]) == [9, 3] and one("FIRST(value)", [4, 2]) == 4 and one("LAST(value)", [4, 2]) == 2 and one("DIFF(value)", [4, 7]) == 3 and one("MODE(value)", [1, 2, 2, 1]) == 1
    assert one("ELAPSED(value)", [0, 0, 0]) == 2000 and one("DERIVATIVE(value)", [0, 1, 4]) == 2


def test_merged_days_count_every_user_once(spark, tmp_path):
    rows = spark.range(24_000).select(F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(id % 3)").alias("ts"), F.expr("if(id % 4000 = 7, NULL, id % 12000)").alias("user_id"), F.expr("if(id % 4000 = 7, 'none', if(id % 2 = 0, 'view', 'click'))").alias("event_type"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_type: r.users for r in catalogue.queries()["hll_sketch_merge"](spark, str(tmp_path)).collect()}
    assert got == {"view": 6000, "click": 5997, "none": 0}
    estimates = aggregates.merge_sketches(aggregates.sketch(rows, ["event_type", "ts"], "user_id"), ["event_type"])
    assert all(abs(r.estimate - got[r.event_type]) <= 0.05 * got[r.event_type] for r in estimates.collect())


def test_time_weighted_mean_and_rates(spark):
    df = spark.createDataFrame([(at(0), 0.0), (at(1000), 10.0)], "ts timestamp_ntz, v double")
    r = series.counter_stats(df, [], "ts", "v").first()
    assert (r.twa, r.rate, r.increase, r.resets) == (5.0, 10.0, 10.0, 0)
    reset = spark.createDataFrame([(at(0), 5.0), (at(1000), 2.0), (at(2000), 6.0)], "ts timestamp_ntz, v double")
    r = series.counter_stats(reset, [], "ts", "v").first()
    assert (r.increase, r.resets, r.changes, r.irate) == (6.0, 1, 2, 4.0)
    single = series.counter_stats(df.limit(1), [], "ts", "v").first()
    assert single.twa is not None and single.rate is None


def test_counters_of_rows_at_one_time_and_whole_milliseconds(spark):
    rows = [(0, 1.0, 0), (1000, 3.0, 1), (3000, 7.0, 2), (3000, 9.0, 3), (1_056_733_711, None, 4)]
    df = spark.createDataFrame([(at(ms), v, k) for ms, v, k in rows], "ts timestamp_ntz, v double, k int")
    r = series.counter_stats(df, [], "ts", "v", ["k"]).first()
    assert (r.irate, r.idelta, r.delta, r.elapsed_ms) == (2.0, 2.0, 8.0, 1_056_733_711)


def test_rolling_and_smoothing(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(1, 6)], "t int, v double")
    w = series.series([], "t")
    assert [r[0] for r in df.select(series.rolling(F.avg, "v", w, 3).alias("r")).collect()] == [None, None, 2.0, 3.0, 4.0]
    assert [round(r.ema, 4) for r in series.ema(df, [], "t", "v", 3).orderBy("t").collect()] == [1.0, 1.5, 2.25, 3.125, 4.0625]
    f = series.forecast(df, [], "t", "v", 2, alpha=0.5).collect()
    assert [r.step for r in f] == [1, 2] and f[0].forecast == f[1].forecast == 4.0625
    zero = spark.createDataFrame([(1, 0.0), (2, 5.0)], "t int, v double").select(series.pct_change("v", w).alias("p")).collect()
    assert zero[0].p is None and zero[1].p != zero[1].p


def test_durations():
    for s, ms in {"1s": 1000, "5m": 300_000, "1h": 3_600_000, "1d": 86_400_000, "100ms": 100, "1000a": 1000, "PT1H30M": 5_400_000, "2 hours": 7_200_000, "1h30m": 5_400_000}.items():
        assert micros(s) == ms * 1000
    for bad in ("", "abc", "5 parsecs", "P"):
        with pytest.raises(ValueError):
            micros(bad)


@pytest.mark.parametrize(
    ("query", "dialect"),
    [
        ("rate(http_requests_total[5m])", "promql"), ("sum by (job) (rate(errors_total[1h]))", "promql"), ('http_requests_total{job="api"}', "promql"), ("histogram_quantile(0.95, rate(request_duration_seconds_bucket[5m]))", "promql"), ("range_median(cpu[5m])", "metricsql"),
        ('SELECT MEAN("usage") FROM "cpu" WHERE time > now() - 1h GROUP BY time(5m)', "influxql"), ('from(bucket: "db") |> range(start: -1h)', "flux"), ("SELECT avg(v) FROM meters INTERVAL(10m)", "tdengine"), ("SELECT time_bucket('5 minutes', ts), avg(v) FROM c GROUP BY 1", "timescale"),
        ("SELECT avg(p) FROM trades SAMPLE BY 1h", "questdb"), ("SELECT toStartOfHour(ts), count() FROM hits GROUP BY 1", "clickhouse"), ("SELECT TIME_FLOOR(__time, 'PT1H'), COUNT(*) FROM w GROUP BY 1", "druid"), ('{"queryType": "timeseries", "dataSource": "w"}', "druid_native"),
        ('{"queries": [{"metric": "m", "aggregator": "sum"}]}', "opentsdb"), ("summarize(servers.*.cpu, '1h', 'avg')", "graphite"), ('{"find": "users"}', "jql"), ("find all users where age is greater than 3", "nql"), ("SELECT a FROM b", "sql"),
        ("SELECT sum(x), median(y) FROM t GROUP BY z", "sql"), ("alias(foo, 'x')", "graphite"), ("sum(rate(x[5m])) / 2", "promql"), ("rate(x[5m]) keep_metric_names", "metricsql"), ("SELECT * FROM users WHERE name CONTAINS 'a'", "lql"),
        ("SHOW MEASUREMENTS", "influxql"), ("how many orders", "nql"), ("SELECT a FROM t LATEST ON ts PARTITION BY b", "questdb"), ("SELECT a FROM t LIMIT 2 BY b", "clickhouse"), ('{"aggregate": "t", "pipeline": []}', "jql"),
    ],
)
def test_detection(query, dialect):
    found, sure = detect.detect(query)
    assert found == dialect and (sure >= 0.5 or dialect == "sql")


def test_translations():
    plan = sql.parse("SELECT MEAN(value) AS v FROM cpu WHERE host = 'a' GROUP BY time(5m), region FILL(previous)", "influxql")
    assert printers.to(plan, "tdengine") == "SELECT region, mean(value) AS v FROM cpu WHERE host = 'a' PARTITION BY region INTERVAL(5m) FILL(prev)"
    assert "aggregateWindow(every: 5m, fn: mean" in printers.to(plan, "flux") and 'r.host == "a"' in printers.to(plan, "flux")
    assert printers.to(plan, "promql") == 'avg by (region) (mean_over_time(cpu{host="a"}[5m]))'
    assert "SAMPLE BY 5m" in printers.to(plan, "questdb") and "toStartOfInterval" in printers.to(plan, "clickhouse") and "time_bucket" in printers.to(plan, "sql") and "TIME_FLOOR" in printers.to(plan, "druid")
    with pytest.raises(ValueError):
        printers.to(sql.parse("SELECT COUNT(*) AS n FROM m SESSION(ts, 1m)", "tdengine"), "promql")


@pytest.mark.parametrize("bad", ["SELECT", "SELECT a FROM", "SELECT a FROM b WHERE", "SELECT a FROM b GROUP", "FROM b", "SELECT a b c FROM d", "SELECT a, COUNT(*) AS n FROM b", "SELECT a FROM b; DROP TABLE b"])
def test_bad_sql_is_an_error(bad):
    with pytest.raises(ParseError):
        sql.parse(bad, "lql")


def test_metric_query_grammar():
    e = promql.parse('sum by (a) (rate(m{x="1",y=~"b.*"}[5m] offset 1h)) / 2 ^ 3 > bool 4')
    assert isinstance(e, promql.Binary) and e.op == ">" and e.bool and e.left.op == "/" and e.left.right.op == "^"
    s = e.left.left.expr.args[0]
    assert (s.range, s.offset, s.matchers) == (micros("5m"), micros("1h"), (("x", "=", "1"), ("y", "=~", "b.*")))
    for bad in ("sum(", "rate(m[5q])", "m{a}", "1 +", "m[5m", ")"):
        with pytest.raises(ValueError):
            promql.parse(bad)


def test_pipe_query_grammar():
    assert [n for n, _ in flux.calls('from(bucket: "a") |> range(start: -1h) |> yield(name: "x")')] == ["from", "range", "yield"]
    for bad in ('range(start: -1h', 'from(bucket: "a") |> |> x()', 'from(bucket: "a") garbage'):
        with pytest.raises(ParseError):
            flux.calls(bad)


def test_instant_vectors_and_binary_matching(spark):
    rows = [(at(0), "up", "a", 1.0), (at(60_000), "up", "a", 3.0), (at(0), "up", "b", 10.0), (at(0), "down", "a", 2.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, metric string, host string, value double")
    m = promql.Metrics(df, "metric", ("host",), "ts", "value")
    ev = promql.Evaluator(m, 0, 120_000_000, 60_000_000)
    got = lambda q: sorted((r.host, r.t // 60_000_000, r.v) for r in ev(q).collect())
    assert got("up") == [("a", 0, 1.0), ("a", 1, 3.0), ("a", 2, 3.0), ("b", 0, 10.0), ("b", 1, 10.0), ("b", 2, 10.0)]
    assert got("up / down") == [("a", 0, 0.5), ("a", 1, 1.5), ("a", 2, 1.5)]
    assert got("up > 5")[0] == ("b", 0, 10.0) and len(got("up unless down")) == 3 and len(got("up and down")) == 3


def test_text_search(spark):
    docs = spark.createDataFrame([(1, "The cats are running quickly"), (2, "A dog runs; cats run"), (3, None), (4, "")], "id long, body string")
    toks = text.tokens(docs, "id", "body")
    assert {(r.doc, r.token) for r in toks.collect()} >= {(1, "cat"), (1, "quick"), (2, "dog"), (2, "run"), (2, "cat")}
    plain = text.tokens(docs, "id", "body", stemmed=False, stops=False)
    assert [r.doc for r in text.phrase(plain, ["cats", "run"]).collect()] == [2]
    assert {r.doc for r in text.boolean(plain, ["cats"], none_of=["dog"]).collect()} == {1}
    assert {r.doc for r in text.fuzzy(plain, "catz").collect()} == {1, 2} and {r.doc for r in text.prefix(plain, "quick").collect()} == {1}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id long, v array<double>")
    assert [r.id for r in vector.knn(df, "v", [1.0, 0.1], 2, "cosine").collect()] == [1, 2]
    assert df.select(vector.cosine(F.col("v"), F.array(F.lit(1.0), F.lit(0.0))).alias("c")).collect()[2].c == 0.0
    assert [r[0] for r in df.select(vector.elementwise(F.col("v"), F.col("v"), "add")).collect()][0] == [2.0, 0.0]


def test_search_requests(spark):
    df = spark.createDataFrame([(1, "Red Car", 10, ["a", "b"]), (2, "blue car", 20, []), (3, None, 30, None)], "id long, name string, price int, tags array<string>")
    n = lambda q: df.filter(search.query(q)).count()
    assert n({"match": {"name": "CAR"}}) == 2 and n({"bool": {"must_not": [{"exists": {"field": "name"}}]}}) == 1 and n({"wildcard": {"name": "*car"}}) == 1 and n({"bool": {"should": [{"term": {"price": 10}}, {"range": {"price": {"gt": 25}}}]}}) == 2
    f = lambda c: df.filter(search.points_filter(c)).count()
    assert f({"must": [{"is_empty": {"key": "tags"}}]}) == 2 and f({"must_not": [{"is_null": {"key": "name"}}], "must": [{"key": "price", "range": {"gte": 20}}]}) == 1 and f({"must": [{"has_id": [1, 3]}]}) == 2 and f({"must": [{"key": "tags", "values_count": {"gt": 1}}]}) == 1
    assert search.rest(df, "name=ilike.*car*&order=price.desc&limit=1").first().id == 2 and search.rest(df, "name=not.is.null").count() == 2 and search.rest(df, "tags=cs.{a}").count() == 1
    geo = spark.createDataFrame([((52.52, 13.40),), ((48.85, 2.35),)], "p struct<lat: double, lon: double>")
    near = {"must": [{"key": "p", "geo_radius": {"center": {"lat": 52.5, "lon": 13.4}, "radius": 5000.0}}]}
    assert geo.filter(search.points_filter(near)).count() == 1


def test_line_protocol(spark):
    raw = spark.createDataFrame([('cpu,host=server01,region=us-west usage=0.64,idle=0.36 1609459200000000000',), ('m\\ x,t\\,g=a\\ b s="q, \\"r\\" =",n=5i,ok=t',), ("# comment",), ("",), ("broken",)], "value string")
    rows = lines.line_protocol(raw).collect()
    a, b, bad = rows
    assert (a.measurement, a.tags, a.fields, a.ts_us) == ("cpu", {"host": "server01", "region": "us-west"}, {"usage": "0.64", "idle": "0.36"}, 1609459200000000)
    assert b.measurement == "m x" and b.tags == {"t,g": "a b"} and b.fields["n"] == "5i" and b.ts_us is None and bad.bad == "broken"
    got = lines.line_protocol(raw).select(lines.field_value(F.col("fields"), "s", "string").alias("s"), lines.field_value(F.col("fields"), "n", "long").alias("n"), lines.field_value(F.col("fields"), "ok", "boolean").alias("ok")).collect()[1]
    assert (got.s, got.n, got.ok) == ('q, "r" =', 5, True)


def test_other_sources_and_formats(spark):
    raw = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    (p,) = lines.put_lines(raw("put sys.cpu 1356998400 42.5 host=a cpu=0", "version")).collect()
    assert (p.metric, p.ts_us, p.value, p.tags) == ("sys.cpu", 1356998400000000, 42.5, {"host": "a", "cpu": "0"})
    assert lines.put_json(raw('[{"metric":"m","timestamp":1,"value":2,"tags":{"a":"b"}},{"metric":"n","timestamp":1500000000000,"value":3}]')).count() == 2
    (x,) = lines.exposition(raw("# HELP x", 'http_total{code="200",path="/a"} 1027 1395066363000')).collect()
    assert (x.name, x.labels["path"], x.value, x.ts_us) == ("http_total", "/a", 1027.0, 1395066363000000)
    df = spark.createDataFrame([(1, "a\tb"), (2, None)], "n int, s string")
    assert [r.value for r in lines.formatted(df, "tsv").collect()] == ["1\ta\\tb", "2\t\\N"] and lines.header(df, "csv") == "n,s"
    assert lines.show(df, "markdown").splitlines()[1] == "| --- | --- |" and lines.show(df, "json").startswith('[{"n": 1')


def test_catalog_and_errors(users):
    assert users.query("SHOW TABLES", "sql").collect()[0].name == "users"
    assert users.query("DESCRIBE users", "sql").count() == 4
    with pytest.raises(KeyError):
        users.query("SELECT a FROM nowhere", "sql")
    users.query("DROP TABLE users", "sql")
    assert users.query("SHOW TABLES", "sql").count() == 0


def test_stages_and_profiles(spark):
    df = spark.createDataFrame([(1, [1, 2], "x@y.zz"), (2, [], "u@v.ww"), (3, None, "a@b.cc")], "id long, a array<int>, mail string")
    assert documents.unwind(df, "a").count() == 2 and documents.unwind(df, "id").count() == 3
    assert {r["column"]: r.kind for r in aggregates.semantic_types(df, ["id", "mail"]).collect()} == {"id": "integer", "mail": "email"}
    assert changes.upsert(df, spark.createDataFrame([(3, "new@n.ew")], "id long, mail string"), ["id"]).filter("mail like 'new%'").count() == 1


def test_english_grammar_without_a_catalog():
    plan = english.parse("get top 3 items where price is at most 5.5 or name is not red sorted by price desc skip 2")
    assert isinstance(plan, ir.Limit) and plan.count == 3 and plan.offset == 2 and plan.child.child.where.name == "or"
    assert english.closest("custmer", ["customer", "orders"]) == "customer"


def test_sliding_grid_matches_a_simulation(spark):
    import random

    rng = random.Random(5)
    for size, slide in ((20, 5), (20, 7), (7, 20)):
        times = sorted(rng.sample(range(300), 40))
        df = spark.createDataFrame([(t,) for t in times], "_t long")
        got = {(r._w, r.n) for r in windows.assign_interval(df, [], size, slide).groupBy("_w").agg(F.count("*").alias("n")).collect()}
        start, want = times[0] // size * size, set()
        while start <= times[-1]:
            n = sum(start <= t < start + size for t in times)
            want |= {(start, n)} if n else set()
            start += slide
        assert got == want


@pytest.mark.parametrize("most", [1, 7, 24, 10_000])
def test_knn_batch_answers_every_query(spark, most):
    points = {i: [float(i * 37 % 101), float(i * i % 53)] for i in range(120)}
    df = spark.createDataFrame(list(points.items()), "vec_id long, embedding array<double>").repartition(3)
    got = {(r.query_id, r["rank"]): r.vec_id for r in vector.knn_batch(df, df.filter("vec_id % 5 = 0"), "embedding", "vec_id", 2, most=most).collect()}
    near = {q: sorted((i for i in points if i != q), key=lambda i: (sum((a - b) ** 2 for a, b in zip(points[q], points[i])), i)) for q in points if q % 5 == 0}
    assert got == {(q, k + 1): ids[k] for q, ids in near.items() for k in range(2)}


@pytest.mark.parametrize(("metric", "most"), [("l2", 10_000), ("l2", 30), ("l2_squared", 30), ("cosine", 10_000), ("dot", 30), ("inner_product", 10_000), ("manhattan", 30)])
def test_knn_batch_is_exact_to_the_last_digit(spark, metric, most):
    import random

    rng = random.Random(7)
    rows = [(i, [round(rng.gauss(0, 1), 1) for _ in range(3)] if i % 3 else [rng.gauss(5, 1e-7) for _ in range(3)]) for i in range(400)]  # ties, and near ties
    rows += [(i, list(rows[i % 400][1])) for i in range(400, 440)] + [(-1, None), (-2, [1.0, None, 2.0]), (440, None), (441, [0.0, 0.0, 0.0]), (442, [1e200, -1e200, 0.0]), (443, [1e200, -1e200, 0.0]), (444, [1e-25, 1e-25, 0.0]), (445, [2e-25, 1e-25, 0.0]), (446, [3.0]), (447, [4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    ask = df.filter("vec_id % 5 = 0 OR vec_id > 438")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.distance) for r in vector.knn_batch(df, ask, "embedding", "vec_id", 3, metric, most).collect())
    pairs = df.crossJoin(ask.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))).filter("vec_id != query_id").withColumn("d", vector.METRICS[metric](F.col("embedding"), F.col("q")))
    order = F.sort_array(F.collect_list(F.struct(F.col("d").isNull().alias("none"), "d", "vec_id")))
    want = sorted((r.query_id, k + 1, x.vec_id, x.d) for r in pairs.groupBy("query_id").agg(F.slice(order, 1, 3).alias("a")).collect() for k, x in enumerate(r.a))
    assert str(got) == str(want)


def test_druid_reads_every_interval(spark):
    rows = [(at(h * 3_600_000), "ab"[h % 2], float(h)) for h in range(10)]
    c = Catalog(spark).add("w", spark.createDataFrame(rows, "ts timestamp, k string, value double"), time="ts", value="value", tags=("k",))
    q = {"dataSource": "w", "intervals": ["1970-01-01T00:00:00/1970-01-01T02:00:00", "1970-01-01T05:00:00/1970-01-01T07:00:00", "1970-01-01T06:00:00/1970-01-01T08:00:00"]}
    sums = {"aggregations": [{"type": "count", "name": "n"}, {"type": "doubleSum", "name": "s", "fieldName": "value"}]}
    ask = lambda kind, **more: [tuple(r) for r in requests.native(c, {"queryType": kind} | q | more).collect()]
    assert ask("timeseries", **sums) == [(5, 19.0)]
    assert ask("topN", dimension="k", metric="s", threshold=2, **sums) == [("b", 3, 13.0), ("a", 2, 6.0)]
    assert sorted(ask("groupBy", dimensions=["k"], **sums)) == [("a", 2, 6.0), ("b", 3, 13.0)]
    assert sorted(ask("scan", columns=["value"])) == [(0.0,), (1.0,), (5.0,), (6.0,), (7.0,)]
    assert ask("search", searchDimensions=["k"], query={"value": "B"}) == [("k", "b", 3)]
    assert ask("timeBoundary") == [(0, 7 * 3_600_000_000)]


def test_graphite_combines_every_path(spark):
    rows = [(at(k * 60_000), kind, user, v) for k in range(2) for kind, user, v in (("view", "a", 1.0), ("view", "b", 2.0), ("click", "a", 10.0), ("buy", "a", 100.0))]
    c = Catalog(spark).add("events", spark.createDataFrame(rows, "ts timestamp, kind string, user string, value double"), time="ts", value="value", tags=("kind", "user"))
    ask = lambda target: [r.v for r in targets.run(c, target).orderBy("t").collect()]
    assert ask("sumSeries(events.view.*, events.click.*)") == ask("sumSeries(events.{view,click}.*)") == [13.0, 13.0]
    assert ask("maxSeries(events.view.*, scale(events.click.*, 5), events.click.*)") == [50.0, 50.0]
    assert ask("minSeries(events.click.*, events.view.b)") == [2.0, 2.0] and ask("averageSeries(events.buy.*,events.click.*)") == [55.0, 55.0]
    assert ask("summarize(sumSeries(events.view.*, events.buy.*), '1h', 'sum')") == [206.0]
    for target in ("scale(events.view.*, events.click.*)", "summarize(events.view.*, events.buy.*, '1h')", "sumSeries(events.view.*, 3)", "sumSeries()"):
        with pytest.raises(ParseError):
            ask(target)


def test_flux_window_parts_groups(spark):
    rows = [(at(m * 60_000), "ab"[m % 2], float(m)) for m in range(0, 180, 15)]
    c = Catalog(spark).add("cpu", spark.createDataFrame(rows, "ts timestamp, host string, value double"), time="ts", value="value", tags=("host",))
    ask = lambda pipe: sorted(tuple(r)[:-2] + (r._value,) for r in flux.run(c, 'from(bucket: "cpu") |> ' + pipe).collect())
    h = 3_600_000_000
    assert ask("window(every: 1h) |> mean()") == [("a", 0, 15.0), ("a", h, 75.0), ("a", 2 * h, 135.0), ("b", 0, 30.0), ("b", h, 90.0), ("b", 2 * h, 150.0)]
    assert ask("group() |> window(every: 1h) |> count()") == [(0, 4.0), (h, 4.0), (2 * h, 4.0)]
    assert ask("window(every: 1h) |> mean() |> window(every: inf) |> max()") == [("a", 135.0), ("b", 150.0)]
    assert ask("window(every: 1h) |> window(every: 2h) |> sum()") == [("a", 0, 180.0), ("a", 2 * h, 270.0), ("b", 0, 240.0), ("b", 2 * h, 300.0)]
    with pytest.raises(ParseError):
        ask("window(every: 1h, period: 2h) |> mean()")


def test_show_prints_all_rows(spark):
    df = spark.range(250)
    assert [len(lines.show(df, kind).splitlines()) for kind in ("table", "markdown", "csv")] == [252, 252, 251]
    assert lines.show(df, "json").count("{") == 250 and lines.show(df, "json", 3).count("{") == 3


def test_promql_fixed_times_steps_and_rollups(spark):
    rows = [(at(k * 30_000), "m", "a", float(k * k)) for k in range(11)]
    m = promql.Metrics(spark.createDataFrame(rows, "ts timestamp, metric string, host string, value double"), "metric", ("host",), "ts", "value", ("value",))
    ev = promql.Evaluator(m, 120_000_000, 300_000_000, 90_000_000)
    ask = lambda q: [r.v for r in ev(q).orderBy("t").collect()]
    assert ask("m") == [16.0, 49.0, 100.0]
    assert ask("m @ 60") == [4.0] * 3 and ask("m @ 60 offset 30s") == ask("m offset 30s @ 60") == [1.0] * 3
    assert ask("m @ start()") == [16.0] * 3 and ask("m - m @ end()") == [-84.0, -51.0, 0.0] and ask("sum_over_time(m[1m] @ 90)") == [13.0] * 3
    # (t - 2m, t] at whole minutes: 60, 120 | 120, 180 | 240, 300 seconds
    assert ask("sum_over_time(m[2m:1m])") == ask("sum_over_time(m[2m: 1m])") == [20.0, 52.0, 164.0]
    assert ask("sum_over_time(m[2m:1m] @ 120)") == [20.0] * 3 and ask("sum_over_time(m[2m:1m] offset 1m)") == [4.0, 20.0, 100.0]
    assert ask("count_over_time(m[3m:])") == [2.0, 2.0, 2.0]
    for name in ("rate", "deriv", "increase", "delta"):
        assert ask(f"rollup_{name}(m[2m])") == ask(f"{name}(m[2m])") != []
    for bad in ("m @", "m @ x", "sum(m) @ 60"):
        with pytest.raises(ParseError):
            promql.parse(bad)


def test_streams_write_their_results_by_tasks(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).selectExpr("id", "id % 4 AS g").coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
    stream = lambda: views.read(spark, str(tmp_path / "rows"), "id long, g long", files_per_trigger=1)
    whole = views.run_once(views.view(stream(), ["g"], [F.count("*").alias("n")]), "whole", "complete", f"file://{tmp_path}/a")
    assert {(r.g, r.n) for r in whole.collect()} == {(0, 8), (1, 8), (2, 7), (3, 7)} and whole.inputFiles() and spark.table("whole").count() == 4
    for more in (0, 5):  # the second run goes on where the first one ended
        if more:
            spark.range(30, 30 + more).selectExpr("id", "id % 4 AS g").coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
        rows = views.run_once(stream().filter("g < 2"), "rows", "append", f"file://{tmp_path}/b")
        assert sorted(r.id for r in rows.collect()) == [k for k in range(30 + more) if k % 4 < 2] and rows.inputFiles()
    (tmp_path / "none").mkdir()
    none = views.run_once(views.read(spark, str(tmp_path / "none"), "id long"), "none", "append", f"file://{tmp_path}/c")
    assert none.columns == ["id"] and none.count() == 0
