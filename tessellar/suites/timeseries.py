"""Windows, fills, rates, rolling functions and joins of time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import floor_to, micros
from ..operators import aggregates, joins, series, windows
from .base import query, text

M10, H, D = 600_000_000, 3_600_000_000, 86_400_000_000
T = "epoch_us(ts)"

text("interval_window", "tdengine", "SELECT COUNT(*) AS n, AVG(value) AS mean, SPREAD(value) AS spread FROM events PARTITION BY event_type INTERVAL(6h)",
     f"SELECT event_type, {T} // {6 * H} * {6 * H} AS _wstart, {T} // {6 * H} * {6 * H} + {6 * H} AS _wend, count(*) AS n, round(avg(value), 6) AS mean, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1, 2, 3")
text("interval_offset", "tdengine", "SELECT COUNT(*) AS n, FIRST(value) AS f, LAST(value) AS l FROM events INTERVAL(1d, 5h)",
     f"SELECT ({T} - {5 * H}) // {D} * {D} + {5 * H} AS _wstart, ({T} - {5 * H}) // {D} * {D} + {5 * H + D} AS _wend, count(*) AS n, round(arg_min(value, ts), 6) AS f, round(arg_max(value, ts), 6) AS l FROM events GROUP BY 1, 2")


def _grid(size: int, slide: int) -> str:
    return f"WITH b AS (SELECT min({T}) // {size} * {size} AS a, max({T}) AS z FROM events), g AS (SELECT unnest(range(a, z + 1, {slide})) AS w FROM b) SELECT w AS _wstart, w + {size} AS _wend, count(*) AS n, round(sum(value), 6) AS s FROM g JOIN events ON {T} >= w AND {T} < w + {size} GROUP BY 1, 2"


text("interval_sliding", "tdengine", "SELECT COUNT(*) AS n, SUM(value) AS s FROM events INTERVAL(12h) SLIDING(4h)", _grid(12 * H, 4 * H))
text("interval_sliding_ragged", "tdengine", "SELECT COUNT(*) AS n, SUM(value) AS s FROM events INTERVAL(20h) SLIDING(7h)", _grid(20 * H, 7 * H))
text("session_window", "tdengine", "SELECT COUNT(*) AS n, SUM(value) AS s FROM events PARTITION BY user_id SESSION(ts, 8h)",
     f"WITH a AS (SELECT *, {T} AS t, coalesce({T} - lag({T}) OVER (PARTITION BY user_id ORDER BY ts, event_id) > {8 * H}, false) AS b FROM events), g AS (SELECT *, sum(b::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM a) SELECT user_id, min(t) AS _wstart, max(t) AS _wend, count(*) AS n, round(sum(value), 6) AS s FROM g GROUP BY user_id, k")
text("state_window", "tdengine", "SELECT COUNT(*) AS n, MAX(value) AS m FROM events PARTITION BY user_id STATE_WINDOW(event_type)",
     f"WITH a AS (SELECT *, {T} AS t, (row_number() OVER w > 1 AND event_type IS DISTINCT FROM lag(event_type) OVER w) AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(b::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM a) SELECT user_id, min(t) AS _wstart, max(t) AS _wend, count(*) AS n, round(max(value), 6) AS m FROM g GROUP BY user_id, k")
_EVENT = f"""WITH a AS (SELECT *, {T} AS t, event_type = 'view' AS b, event_type = 'purchase' AS f FROM events), s AS (SELECT *, coalesce(sum(f::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM a),
    o AS (SELECT *, max(b::INT) OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS open, max(f::INT) OVER (PARTITION BY user_id, k) AS closed FROM s) SELECT user_id, min(t) AS _wstart, max(t) AS _wend, count(*) AS n FROM o WHERE open = 1 AND closed = 1 GROUP BY user_id, k"""
text("event_window", "tdengine", "SELECT COUNT(*) AS n FROM events PARTITION BY user_id EVENT_WINDOW START WITH event_type = 'view' END WITH event_type = 'purchase'", _EVENT)
text("event_window_true_for", "tdengine", "SELECT COUNT(*) AS n FROM events PARTITION BY user_id EVENT_WINDOW START WITH event_type = 'view' END WITH event_type = 'purchase' TRUE_FOR(12h)", f"{_EVENT} HAVING max(t) - min(t) >= {12 * H}")
text("count_window", "tdengine", "SELECT COUNT(*) AS n, SUM(value) AS s FROM events PARTITION BY user_id COUNT_WINDOW(7)",
     f"WITH a AS (SELECT *, {T} AS t, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 7 AS k FROM events) SELECT user_id, min(t) AS _wstart, max(t) AS _wend, count(*) AS n, round(sum(value), 6) AS s FROM a GROUP BY user_id, k")
text("count_window_sliding", "tdengine", "SELECT COUNT(*) AS n, SUM(value) AS s FROM events PARTITION BY user_id COUNT_WINDOW(7, 3)",
     f"WITH a AS (SELECT *, {T} AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS c FROM events), g AS (SELECT user_id, unnest(range(0, max(c), 3)) AS w FROM a GROUP BY user_id) SELECT a.user_id, min(t) AS _wstart, max(t) AS _wend, count(*) AS n, round(sum(value), 6) AS s FROM a JOIN g ON a.user_id = g.user_id AND i >= w AND i < w + 7 GROUP BY a.user_id, w")

_BASE = f"""WITH r AS (SELECT event_type, {T} // {M10} * {M10} AS w, avg(value) AS v FROM events GROUP BY 1, 2), g AS (SELECT event_type, unnest(range(min(w), max(w) + 1, {M10})) AS w FROM r GROUP BY 1),
    j AS (SELECT g.event_type, g.w, r.v FROM g LEFT JOIN r ON g.event_type = r.event_type AND g.w = r.w),
    f AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS p, first_value(v IGNORE NULLS) OVER a AS n, last_value(CASE WHEN v IS NOT NULL THEN w END IGNORE NULLS) OVER b AS pw, first_value(CASE WHEN v IS NOT NULL THEN w END IGNORE NULLS) OVER a AS nw FROM j
    WINDOW b AS (PARTITION BY event_type ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY event_type ORDER BY w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
_FILLS = {
    "null": "v", "value": "coalesce(v, -1)", "prev": "p", "next": "n", "linear": "CASE WHEN v IS NOT NULL THEN v ELSE p + (n - p) * (w - pw) / (nw - pw)::DOUBLE END",
    "nearest": "CASE WHEN p IS NULL OR nw - w < w - pw THEN coalesce(n, p) ELSE p END",
}
for mode, sql in _FILLS.items():
    text(f"fill_{mode}", "tdengine", f"SELECT AVG(value) AS v FROM events PARTITION BY event_type INTERVAL(10m) FILL({'VALUE, -1' if mode == 'value' else mode})",
         f"{_BASE} SELECT event_type, w AS _wstart, w + {M10} AS _wend, round({sql}, 6) AS v FROM f")
text("fill_none", "tdengine", "SELECT AVG(value) AS v FROM events PARTITION BY event_type INTERVAL(10m) FILL(NONE)", f"{_BASE} SELECT event_type, w AS _wstart, w + {M10} AS _wend, round(v, 6) AS v FROM f WHERE v IS NOT NULL")
text("timescale_gapfill", "timescale", "SELECT time_bucket_gapfill('10 minutes', ts) AS bucket, event_type, locf(avg(value)) AS v FROM events GROUP BY bucket, event_type", f"{_BASE} SELECT w AS bucket, event_type, round(p, 6) AS v FROM f")
text("timescale_interpolate", "timescale", "SELECT time_bucket_gapfill('10 minutes', ts) AS bucket, event_type, interpolate(avg(value)) AS v FROM events GROUP BY bucket, event_type", f"{_BASE} SELECT w AS bucket, event_type, round({_FILLS['linear']}, 6) AS v FROM f")
text("timescale_first_last", "timescale", "SELECT time_bucket('1 day', ts) AS bucket, first(value, ts) AS f, last(value, ts) AS l FROM events GROUP BY bucket", f"SELECT {T} // {D} * {D} AS bucket, round(arg_min(value, ts), 6) AS f, round(arg_max(value, ts), 6) AS l FROM events GROUP BY 1")
text("influx_mean_fill", "influxql", 'SELECT MEAN("value") AS v FROM "events" GROUP BY time(10m), "event_type" FILL(previous)', f"{_BASE} SELECT event_type, w AS _wstart, w + {M10} AS _wend, round(p, 6) AS v FROM f")
text("influx_difference", "influxql", 'SELECT difference(sum("value")) FROM "events" GROUP BY time(1d), "event_type"',
     f"WITH r AS (SELECT event_type, {T} // {D} * {D} AS _wstart, sum(value) AS s FROM events GROUP BY 1, 2), d AS (SELECT event_type, _wstart, _wstart + {D} AS _wend, round(s - lag(s) OVER (PARTITION BY event_type ORDER BY _wstart), 6) AS value FROM r) SELECT * FROM d WHERE value IS NOT NULL")
text("sample_by", "questdb", "SELECT event_type, count(*) AS n, avg(value) AS v FROM events PARTITION BY event_type SAMPLE BY 12h FILL(PREV)",
     f"WITH r AS (SELECT event_type, {T} // {12 * H} * {12 * H} AS w, count(*) AS n, avg(value) AS v FROM events GROUP BY 1, 2), g AS (SELECT event_type, unnest(range(min(w), max(w) + 1, {12 * H})) AS w FROM r GROUP BY 1) SELECT g.event_type, g.w AS _wstart, g.w + {12 * H} AS _wend, last_value(n IGNORE NULLS) OVER k AS n, round(last_value(v IGNORE NULLS) OVER k, 6) AS v FROM g LEFT JOIN r USING (event_type, w) WINDOW k AS (PARTITION BY event_type ORDER BY g.w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
text("sample_by_first_obs", "questdb", "SELECT count(*) AS n, sum(value) AS s FROM events PARTITION BY event_type SAMPLE BY 1d ALIGN TO FIRST OBSERVATION",
     f"WITH o AS (SELECT *, {T} AS t, min({T}) OVER (PARTITION BY event_type) AS o FROM events) SELECT event_type, (t - o) // {D} * {D} + o AS _wstart, (t - o) // {D} * {D} + o + {D} AS _wend, count(*) AS n, round(sum(value), 6) AS s FROM o GROUP BY 1, 2, 3")
text("latest_on", "questdb", "SELECT event_id, user_id, value FROM events LATEST ON ts PARTITION BY user_id", "SELECT event_id, user_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
text("series_limit", "tdengine", "SELECT COUNT(*) AS n FROM events PARTITION BY event_type INTERVAL(1d) SLIMIT 2 SOFFSET 1", f"SELECT event_type, {T} // {D} * {D} AS _wstart, {T} // {D} * {D} + {D} AS _wend, count(*) AS n FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2 OFFSET 1) GROUP BY 1, 2, 3")
text("druid_time_floor", "druid", "SELECT TIME_FLOOR(__time, 'PT6H') AS t, event_type, COUNT(*) AS n, SUM(value) AS s FROM events WHERE TIME_IN_INTERVAL(__time, '2024-01-05/2024-01-12') GROUP BY t, event_type",
     f"SELECT {T} // {6 * H} * {6 * H} AS t, event_type, count(*) AS n, round(sum(value), 6) AS s FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1, 2")
text("druid_floor_unit", "druid", "SELECT FLOOR(__time TO WEEK) AS t, COUNT(*) AS n FROM events GROUP BY t", "SELECT epoch_us(date_trunc('week', ts)::TIMESTAMP) AS t, count(*) AS n FROM events GROUP BY 1")
text("ts_stats", "tdengine", "SELECT event_type, SPREAD(value) AS spread, STDDEV(value) AS sd, PERCENTILE(value, 30) AS p30, MEDIAN(value) AS med, MODE(user_id) AS mode, ELAPSED(value) AS ms, DIFF(value) AS d, LAST_ROW(value) AS lr, HYPERLOGLOG(user_id) AS users, DERIVATIVE(value) AS slope FROM events GROUP BY event_type",
     f"""WITH m AS (SELECT event_type, user_id, count(*) AS c FROM events GROUP BY 1, 2), k AS (SELECT event_type, arg_min(user_id, (-c, user_id)) AS mode FROM m GROUP BY 1)
     SELECT event_type, round(max(value) - min(value), 6) AS spread, round(stddev_pop(value), 6) AS sd, round(list_sort(list(value))[1 + cast(floor(0.3 * (count(*) - 1)) AS BIGINT)], 6) AS p30, round(median(value), 6) AS med, any_value(mode) AS mode, (max({T}) - min({T})) // 1000 AS ms,
     round(arg_max(value, ts) - arg_min(value, ts), 6) AS d, round(arg_max(value, ts), 6) AS lr, count(DISTINCT user_id) AS users, round((arg_max(value, ts) - arg_min(value, ts)) / ((max({T}) - min({T})) / 1e6), 6) AS slope FROM events JOIN k USING (event_type) GROUP BY 1""")
text("top_bottom_unique", "tdengine", "SELECT event_type, TOP(value, 3) AS t, BOTTOM(value, 3) AS b, UNIQUE(user_id) AS u FROM events GROUP BY event_type",
     "SELECT event_type, list_slice(list_reverse_sort(list(value)), 1, 3) AS t, list_slice(list_sort(list(value)), 1, 3) AS b, list_sort(list_distinct(list(user_id))) AS u FROM events GROUP BY 1")


@query("ts_rates", f"""WITH a AS (SELECT user_id, ts, event_id, value AS v, {T} AS t, lag(value) OVER w AS p, {T} - lag({T}) OVER w AS dt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, v - p AS d, CASE WHEN v - p < 0 THEN v ELSE v - p END AS r FROM a)
    SELECT user_id, round(sum(r), 6) AS increase, round(sum(r) / nullif((max(t) - min(t)) / 1e6, 0), 6) AS rate, round(arg_max(CASE WHEN dt > 0 THEN r / (dt / 1e6) END, (t, event_id)), 6) AS irate, round(arg_max(v, (t, event_id)) - arg_min(v, (t, event_id)), 6) AS delta, round(arg_max(d, (t, event_id)), 6) AS idelta,
    cast(count(*) FILTER (WHERE d < 0) AS BIGINT) AS resets, cast(count(*) FILTER (WHERE d <> 0) AS BIGINT) AS changes, round(coalesce(sum((v + p) / 2 * dt) / nullif(sum(dt), 0), arg_max(v, (t, event_id))), 6) AS twa, (max(t) - min(t)) // 1000 AS elapsed_ms FROM b GROUP BY user_id""")
def _(e, sf):
    df = series.counter_stats(e.catalog.frame("events"), ["user_id"], "ts", "value", ["event_id"]).drop("deriv")
    return df.withColumns({"resets": F.coalesce("resets", F.lit(0)), "changes": F.coalesce("changes", F.lit(0))})


@query("ts_deriv", f"SELECT event_type, round(regr_slope(value, {T} / 1e6), 9) AS deriv FROM events GROUP BY 1")
def _(e, sf):
    return series.counter_stats(e.catalog.frame("events"), ["event_type"], "ts", "value", ["event_id"]).select("event_type", F.round("deriv", 9).alias("deriv"))


@query("integral", f"WITH a AS (SELECT event_type, (value + lag(value) OVER w) / 2 * ({T} - lag({T}) OVER w) / 3600000000.0 AS x FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) SELECT event_type, round(sum(x), 4) AS integral FROM a GROUP BY 1")
def _(e, sf):
    df = series.integral(e.catalog.frame("events"), ["event_type"], "ts", "value", H, ["event_id"])
    return df.withColumn("integral", F.round("integral", 4))


def _daily(e):
    return e.catalog.frame("events").groupBy("event_type", floor_to(micros("ts"), D).alias("day")).agg(F.round(F.sum("value"), 4).alias("v"))


_DAILY = f"WITH d AS (SELECT event_type, {T} // {D} * {D} AS day, round(sum(value), 4) AS v FROM events GROUP BY 1, 2)"


@query("rolling_stats", f"{_DAILY} SELECT event_type, day, " + ", ".join(f"round(CASE WHEN row_number() OVER w >= 4 THEN {f}(v) OVER r END, 5) AS {n}" for f, n in (("sum", "s"), ("avg", "a"), ("min", "lo"), ("max", "hi"), ("stddev_pop", "sd"))) + " FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day), r AS (PARTITION BY event_type ORDER BY day ROWS 3 PRECEDING)")
def _(e, sf):
    w = series.series(["event_type"], "day")
    return _daily(e).select("event_type", "day", *[F.round(series.rolling(f, "v", w, 4), 5).alias(n) for f, n in ((F.sum, "s"), (F.avg, "a"), (F.min, "lo"), (F.max, "hi"), (F.stddev_pop, "sd"))])


@query("diff_pct", f"{_DAILY} SELECT event_type, day, round(v - lag(v, 2) OVER w, 4) AS d, round((v - lag(v) OVER w) / lag(v) OVER w, 6) AS pct FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)")
def _(e, sf):
    w = series.series(["event_type"], "day")
    return _daily(e).select("event_type", "day", F.round(series.difference("v", w, 2), 4).alias("d"), series.pct_change("v", w).alias("pct"))


@query("ema", f"{_DAILY.replace('WITH d', 'WITH RECURSIVE d')}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM d), r AS (SELECT event_type, day, v, i, v AS ema FROM n WHERE i = 1 UNION ALL SELECT n.event_type, n.day, n.v, n.i, 2.0 / 6 * n.v + (1 - 2.0 / 6) * r.ema FROM r JOIN n ON n.event_type = r.event_type AND n.i = r.i + 1) SELECT event_type, day, round(v, 4) AS v, round(ema, 4) AS ema FROM r")
def _(e, sf):
    df = series.ema(_daily(e), ["event_type"], "day", "v", 5)
    return df.withColumns({"v": F.round("v", 4), "ema": F.round("ema", 4)})


@query("ses_forecast", f"{_DAILY.replace('WITH d', 'WITH RECURSIVE d')}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM d), r AS (SELECT event_type, i, v AS s FROM n WHERE i = 1 UNION ALL SELECT n.event_type, n.i, 0.3 * n.v + 0.7 * r.s FROM r JOIN n ON n.event_type = r.event_type AND n.i = r.i + 1), l AS (SELECT event_type, arg_max(s, i) AS s FROM r GROUP BY 1) SELECT event_type, unnest(range(1, 4)) AS step, round(s, 3) AS forecast, round(s * 0.9, 3) AS lower, round(s * 1.1, 3) AS upper FROM l")
def _(e, sf):
    df = series.forecast(_daily(e), ["event_type"], "day", "v", 3)
    return df.withColumns({c: F.round(c, 3) for c in ("forecast", "lower", "upper")})


@query("zscore_anomalies", "WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM events) SELECT event_id, round((value - m) / d, 6) AS z, CASE WHEN abs((value - m) / d) > 3 THEN 'high' ELSE 'medium' END AS severity FROM events, s WHERE abs((value - m) / d) > 2")
def _(e, sf):
    return series.zscores(e.catalog.frame("events").select("event_id", "value"), "value").select("event_id", "z", "severity")


@query("rolling_anomalies", "SELECT event_id, round(avg(value) OVER w, 6) AS m, round(stddev_samp(value) OVER w, 6) AS sd FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 100 PRECEDING AND CURRENT ROW)")
def _(e, sf):
    w = series.series(["user_id"], "ts", ["event_id"]).rowsBetween(-100, 0)
    return e.catalog.frame("events").select("event_id", F.avg("value").over(w).alias("m"), F.stddev_samp("value").over(w).alias("sd"))


@query("state_stats", f"WITH a AS (SELECT *, {T} AS t, (row_number() OVER w > 1 AND event_type IS DISTINCT FROM lag(event_type) OVER w) AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(b::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM a) SELECT user_id, any_value(event_type) AS state, count(*) AS statecount, (max(t) - min(t)) // 1000 AS stateduration_ms FROM g GROUP BY user_id, k")
def _(e, sf):
    return aggregates.state_stats(e.catalog.frame("events"), ["user_id"], "ts", "event_type", ["event_id"])


@query("downsample_month", "SELECT epoch_us(date_trunc('month', ts)::TIMESTAMP) AS m, count(*) AS n, round(var_pop(value), 6) AS v FROM events GROUP BY 1")
def _(e, sf):
    return e.query("SELECT toStartOfMonth(ts) AS m, count(*) AS n, var_pop(value) AS v FROM events GROUP BY m", "clickhouse")


@query("fill_mean_neighbours", f"{_BASE} SELECT event_type, w AS bucket, round(CASE WHEN v IS NOT NULL THEN v ELSE (coalesce(p, n) + coalesce(n, p)) / 2 END, 6) AS v FROM f")
def _(e, sf):
    df = e.catalog.frame("events").groupBy("event_type", floor_to(micros("ts"), M10).alias("_w")).agg(F.avg("value").alias("v"))
    return windows.gap_fill(df, ["event_type"], M10, ["v"], "mean").withColumnRenamed("_w", "bucket")


def _sides(e):
    ev = e.catalog.frame("events")
    return ev.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id")), ev.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("buy_id"))


_SIDES = "WITH a AS (SELECT user_id, ts, event_id AS click_id FROM events WHERE event_type = 'click'), b AS (SELECT user_id, ts, event_id AS buy_id FROM events WHERE event_type = 'purchase')"
for kind, op in {"asof": "<=", "lt": "<"}.items():

    @query(f"{kind}_join", f"{_SIDES} SELECT a.click_id, b.buy_id AS right_buy_id FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND b.ts {op} a.ts")
    def _(e, sf, kind=kind):
        a, b = _sides(e)
        return joins.time_join(a, b, [("user_id", "user_id")], "ts", "ts", kind).select("click_id", "right_buy_id")


@query("splice_join", f"{_SIDES}, u AS (SELECT user_id, ts, click_id, NULL AS buy_id, 0 AS r FROM a UNION ALL SELECT user_id, ts, NULL, buy_id, 1 FROM b) SELECT last_value(click_id IGNORE NULLS) OVER w AS click_id, last_value(buy_id IGNORE NULLS) OVER w AS right_buy_id FROM u WINDOW w AS (PARTITION BY user_id ORDER BY ts, r, click_id, buy_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def _(e, sf):
    a, b = _sides(e)
    return joins.time_join(a, b, [("user_id", "user_id")], "ts", "ts", "splice").select("click_id", "right_buy_id")


@query("asof_sql", f"{_SIDES} SELECT a.click_id, b.buy_id AS right_buy_id FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND b.ts <= a.ts")
def _(e, sf):
    a, b = _sides(e)
    e.catalog.add("clicks", a, time="ts").add("buys", b, time="ts")
    return e.query("SELECT click_id, right_buy_id FROM clicks ASOF JOIN buys ON user_id", "questdb")


@query("time_range_scan", "SELECT count(*) AS n, min(event_id) AS a FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def _(e, sf):
    return e.query("SELECT count(*) AS n, min(event_id) AS a FROM events WHERE ts >= now() - 7d", "influxql")


@query("retention", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def _(e, sf):
    import datetime

    e.catalog.apply_retention("events", datetime.datetime(2024, 1, 20))
    return e.query("SELECT COUNT(*) AS n FROM events", "lql")


@query("continuous_aggregate", f"SELECT {T} // {D} * {D} AS day, event_type, count(*) AS n, round(sum(value) / count(*), 6) AS mean FROM events GROUP BY 1, 2")
def _(e, sf):
    """Mergeable parts of two refreshes, added up: what an incremental refresh keeps."""
    ev = e.catalog.frame("events").withColumn("day", floor_to(micros("ts"), D))
    part = lambda df: df.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    both = part(ev.filter("ts < '2024-01-15 12:00:00'")).unionAll(part(ev.filter("ts >= '2024-01-15 12:00:00'")))
    return both.groupBy("day", "event_type").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"))
