"""The engine: one entry for queries in any dialect, and a fluent builder over the same plans."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import replace

from pyspark.sql import DataFrame

from .catalog import Catalog
from .dialects import detect, documents, english, flux, printers, promql, requests, sql, targets
from .operators import search
from .plans import ir
from .plans.compile import Compiler
from .plans.grammar import Dialect, Parser


class Engine:
    """Queries over a catalog. `now` (a timestamp as text, and in microseconds where a dialect needs it) is a parameter."""

    def __init__(self, catalog: Catalog, now: str | None = None, now_us: int | None = None, cached_plans: int = 1000):
        self.catalog, self.now, self.now_us = catalog, now, now_us
        self.compile, self._plans, self._most = Compiler(catalog), OrderedDict(), cached_plans
        self.translator = None  # a callable from plain English to (dialect, text), for sentences the grammar rejects

    def detect(self, text: str) -> tuple[str, float]:
        return detect.detect(text)

    def plan(self, text: str, dialect: str):
        """The plan of an SQL-like or plain-English query. Plans are cached by text."""
        key = (dialect, text)
        if key not in self._plans:
            if dialect == "nql":
                made = english.parse(text, list(self.catalog.tables), lambda t: self.catalog[t].frame.columns if t in self.catalog.tables else [], time=lambda t: self.catalog[t].time or "ts", now=self.now)
            else:
                made = sql.parse(text, dialect, self.now)
            self._plans[key] = made
            if len(self._plans) > self._most:
                self._plans.popitem(last=False)
        self._plans.move_to_end(key)
        return self._plans[key]

    def query(self, text, dialect: str | None = None, **options) -> DataFrame:
        dialect = dialect or detect.detect(text)[0]
        if dialect == "jql":
            return documents.run(self.catalog, text)
        if dialect == "flux":
            return flux.run(self.catalog, text, self.now_us)
        if dialect in ("promql", "metricsql"):
            return self.metrics(text, **options)
        if dialect == "graphite":
            return targets.run(self.catalog, text, **options)
        if dialect == "opentsdb":
            return requests.metrics(self.catalog, text, self.now_us)
        if dialect == "druid_native":
            return requests.native(self.catalog, text)
        if dialect == "search":
            return search.search(self.catalog.frame(options["table"]), text)
        if dialect == "nql" and self.translator:
            try:
                return self.compile(self.plan(text, "nql"))
            except ValueError:
                other, text = self.translator(text)
                return self.query(text, other)
        return self.compile(self.plan(text, dialect))

    def metrics(self, text: str, table: str = "events", name: str | None = None, start: int = 0, end: int = 0, step: int = 60_000_000, **options) -> DataFrame:
        """Range evaluation of a metric query over a table; its first tag names metrics unless `name` is given."""
        t = self.catalog[table]
        name = name or t.tags[0]
        labels = tuple(x for x in t.tags if x != name)
        ties = tuple(c for c in t.frame.columns if c.endswith("_id") and c not in t.tags)[:1]
        return promql.Evaluator(promql.Metrics(self.catalog.frame(table), name, (name, *labels), t.time, t.value, ties), start, end, step, **options)(text)

    def sql(self, text: str) -> DataFrame:
        """Full Spark SQL over the catalog's tables."""
        for n in self.catalog.tables:
            self.catalog.frame(n).createOrReplaceTempView(n)
        return self.catalog.spark.sql(text)

    def translate(self, text: str, target: str, dialect: str | None = None) -> str:
        return printers.to(self.plan(text, dialect or detect.detect(text)[0]), target)

    def explain(self, text: str, dialect: str | None = None) -> str:
        """The plan tree and Spark's physical plan."""
        dialect = dialect or detect.detect(text)[0]
        df = self.query(text, dialect)
        return df._jdf.queryExecution().toString()

    def table(self, name: str) -> Builder:
        return Builder(self, ir.Scan(name))


def _expr(text: str):
    p = Parser(text, Dialect("builder", loose=True, ilike=True))
    e = p.expression()
    p.done()
    return e


class Builder:
    """engine.table('orders').where("o_totalprice > 5").group('o_orderstatus', n='count()').order('n desc').limit(3).run()"""

    def __init__(self, engine: Engine, plan):
        self.engine, self.node = engine, plan

    def _with(self, plan) -> Builder:
        return Builder(self.engine, plan)

    def where(self, condition: str) -> Builder:
        return self._with(ir.Filter(self.node, _expr(condition)))

    def select(self, *columns: str, **named: str) -> Builder:
        return self._with(ir.Select(self.node, tuple(ir.Item(_expr(c), c.rsplit(".", 1)[-1]) for c in columns) + tuple(ir.Item(_expr(e), n) for n, e in named.items())))

    def group(self, *keys: str, **aggregates: str) -> Builder:
        return self._with(ir.Group(self.node, tuple(ir.Item(_expr(k), k) for k in keys), tuple(ir.Item(_expr(e), n) for n, e in aggregates.items())))

    def having(self, condition: str) -> Builder:
        return self._with(replace(self.node, having=_expr(condition)))

    def window(self, size: str, *keys: str, slide: str = "", fill: str = "none", **aggregates: str) -> Builder:
        from .plans.durations import micros

        w = ir.Window("interval", micros(size), micros(slide) if slide else 0, fill=ir.Fill(fill))
        return self._with(ir.Windowed(self.node, w, tuple(ir.Item(_expr(k), k) for k in keys), tuple(ir.Item(_expr(e), n) for n, e in aggregates.items())))

    def join(self, other: str, on: str, how: str = "inner") -> Builder:
        a, _, b = on.partition("=")
        return self._with(ir.Join(self.node, ir.Scan(other), how, ((a.strip(), (b or a).strip()),)))

    def order(self, *keys: str) -> Builder:
        out = []
        for k in keys:
            name, _, way = k.partition(" ")
            out.append(ir.Key(_expr(name), way.strip().lower() == "desc"))
        return self._with(ir.Sort(self.node, tuple(out)))

    def limit(self, n: int, offset: int = 0) -> Builder:
        return self._with(ir.Limit(self.node, n, offset))

    def distinct(self) -> Builder:
        return self._with(ir.Select(self.node, (ir.Star(),), True))

    def run(self) -> DataFrame:
        return self.engine.compile(self.node)
