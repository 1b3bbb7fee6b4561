"""Which dialect a query is written in: the languages whose parsers take the whole text, and within SQL the dialect whose
own functions, columns and clauses it uses."""

from __future__ import annotations

import json
from collections.abc import Callable

from ..plans.grammar import tokens
from . import english, flux, promql, sql, targets

#: Clauses of one SQL dialect only, as its tokens in lower case; # is a number and ' a text.
CLAUSES = {
    "questdb": ("sample by", "latest on", "asof join", "lt join", "splice join", "align to"),
    "clickhouse": ("prewhere", "final", "with totals", "global in", "global join", "array join", "limit # by", "uniq (", "uniqexact ("),
    "timescale": ("create hypertable",),
    "tdengine": ("interval ( #", "state_window (", "session (", "event_window start", "count_window (", "create stable", "by tbname", "last_row (", "spread (", "_wstart"),
    "influxql": ("by time (", "show measurements", "show tag", "show field", "show series", "show retention", "create retention", "create continuous", "mean ("),
    "lql": ("contains '", "starts with '", "ends with '", "matches '", "create collection"),
}
#: Function names that a dialect rewrites but that others have too, in their own sense.
COMMON = {"sum", "median", "first", "last", "floor", "distinct", "percentile", "rate", "derivative", "sample", "tail", "histogram", "changes", "increase", "earliest", "latest", "time"}
#: Calls that tell apart the languages of bare calls where their parsers agree.
METRICSQL, GRAPHITE = ("range_", "rollup", "label_set", "label_del", "label_keep"), ("alias", "sumSeries", "averageSeries", "summarize", "scale", "highest", "lowest", "moving", "nonNegative")


def _takes(parser: Callable, text: str, *options) -> bool:
    try:
        parser(text, *options)
    except (ValueError, LookupError, TypeError, AttributeError):  # a parser of another language may fail in any way
        return False
    return True


def _json(q: dict) -> str:
    return "druid_native" if "queryType" in q else "opentsdb" if "queries" in q else "search" if "query" in q or "aggs" in q else "jql"


def _sql(text: str) -> tuple[str, float]:
    """The SQL dialect with most signs of its own, and their part of all signs; plain SQL, 0 without any."""
    try:
        found = tokens(text)
    except ValueError:
        return "sql", 0.0
    words = [t.text.lower() if t.kind in ("name", "sign") else "#" if t.text[:1].isdigit() else "'" for t in found]
    line = f" {' '.join(words)} "
    called = {a for a, b in zip(words, words[1:]) if b == "("} - COMMON
    signs = {}
    for name, d in sql.DIALECTS.items():
        others = {c for o in sql.DIALECTS.values() if o is not d for c in o.calls}
        signs[name] = len(called & (set(d.calls) - others)) + sum(f" {c} " in line for c in CLAUSES.get(name, ())) + ("__time" in words if "__time" in d.fields else 0)
    best = max(signs, key=signs.get)
    return (best, signs[best] / sum(signs.values())) if signs[best] else ("sql", 0.0)


def detect(text: str) -> tuple[str, float]:
    """The dialect and how sure that is. JSON is told apart by its keys. A text that some SQL dialect takes is SQL. Of the
    other languages that take it the first of the pipe, metric, target and English ones is named, with one part in as
    many as take it. What nobody takes is SQL, so that the error comes from there."""
    s = text.strip()
    if s.startswith("{") and _takes(json.loads, s):
        return _json(json.loads(s)), 1.0
    known = _sql(s)
    if any(_takes(sql.parse, s, d) for d in dict.fromkeys((known[0], *sql.DIALECTS))):
        return known
    piped = s.startswith("from(") or "|>" in s
    found = [name for name, fits in (("flux", piped and _takes(flux.calls, s)), ("promql", _takes(promql.parse, s)), ("graphite", _takes(targets.parse, s)), ("nql", _takes(english.parse, s))) if fits]
    if not found:
        return known
    if "graphite" in found and s.startswith(GRAPHITE):
        return "graphite", 1.0
    if found[0] == "promql" and ("keep_metric_names" in s or any(m in s for m in METRICSQL)):
        return "metricsql", 1 / len(found)
    return found[0], 1 / len(found)
