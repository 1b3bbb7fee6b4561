"""Lowering of plan nodes to lazy DataFrames. Nothing here runs a job."""

from __future__ import annotations

from dataclasses import replace
from functools import singledispatchmethod

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions import aggregates
from ..functions.scalars import column, field, micros, sort_key, stamp
from ..operators import aggregates as rows
from ..operators import joins, series, windows
from . import ir
from .grammar import has_agg


class Compiler:
    def __init__(self, catalog: Catalog):
        self.catalog = catalog
        self._scopes, self._outer = {}, []  # what qualified names stand for, by plan node; scopes around a subquery

    def __call__(self, plan) -> DataFrame:
        return self.lower(plan)

    def time_of(self, plan) -> str:
        """The time column of what a plan scans; '' if it has none."""
        while not isinstance(plan, ir.Scan):
            plan = getattr(plan, "child", None) or getattr(plan, "left", None)
            if plan is None:
                return ""
        return self.catalog[plan.table].time if plan.table in self.catalog.tables else ""

    def series_of(self, plan) -> tuple[str, list[str], str]:
        while not isinstance(plan, ir.Scan):
            plan = plan.child
        t = self.catalog[plan.table]
        return t.time, list(t.tags), t.value

    def scope(self, plan) -> dict[str, dict[str, str]]:
        """For a lowered plan: table name or alias -> its columns -> their names in the frame."""
        while isinstance(plan, (ir.Filter, ir.Sort, ir.Limit, ir.Latest, ir.LimitBy)) or (isinstance(plan, ir.Series) and plan.name in ("hash_sample", "series_limit")):
            plan = plan.child
        return self._scopes.get(id(plan), {}) if isinstance(plan, (ir.Scan, ir.Alias, ir.Join, ir.TimeJoin)) else {}

    def resolve(self, e, scope: dict):
        """The expression with qualified names as the columns they stand for, and with subqueries as columns."""

        def change(x):
            if isinstance(x, ir.Field):
                name = self._name(x.path, scope)
                if name is None:
                    found = [(k, n) for k, s in enumerate(self._outer) if (n := self._name(x.path, s)) is not None]
                    return field(f"_around{found[-1][0]}.{found[-1][1]}").outer() if found else None
                return ir.Field(name)
            if isinstance(x, ir.Op) and x.name == "in" and _is_subquery(x.args[-1]):
                return column(self.resolve(x.args[0], scope)).isin(self.inner(x.args[1], scope))
            if isinstance(x, ir.Op) and x.name == "loose_not_in" and _is_subquery(x.args[-1]):
                return ~F.coalesce(column(self.resolve(x.args[0], scope)).isin(self.inner(x.args[1], scope)), F.lit(False))
            if isinstance(x, ir.Op) and x.name == "exists":
                return self.inner(x.args[0], scope).exists()
            return self.inner(x, scope).scalar() if _is_subquery(x) else None

        return ir.rewrite(e, change)

    def around(self, df: DataFrame, *exprs) -> DataFrame:
        """The frame under a name by which subqueries in the expressions can tell its columns from their own."""
        return df.alias(f"_around{len(self._outer)}") if any(_is_subquery(x) for e in exprs for x in ir.parts(e)) else df

    def inner(self, e, scope: dict) -> DataFrame:
        """The frame of a subquery, whose names may be those of the query around it."""
        self._outer.append(scope)
        try:
            return self.lower(e.args[0])
        finally:
            self._outer.pop()

    def _name(self, path: str, scope: dict) -> str | None:
        head, _, rest = path.partition(".")
        if not rest or head not in scope:
            return None
        name, dot, deeper = rest.partition(".")
        known = scope[head]
        if name not in known:
            name = next((c for c in known if c.lower() == name.lower()), name)
        if name not in known:
            raise ValueError(f"{head} has no column {name}; it has {', '.join(known)}")
        return known[name] + dot + deeper

    def aggregator(self, df: DataFrame, time: str):
        order = F.col(time) if time else F.lit(0)
        return lambda a: aggregates.lower(a.name, [column(x) for x in a.args], a.params, a.distinct, order)

    @singledispatchmethod
    def lower(self, plan) -> DataFrame:
        raise TypeError(f"not a plan: {plan!r}")

    @lower.register
    def _(self, p: ir.Scan) -> DataFrame:
        if not p.table:
            return self.catalog.spark.range(1).drop("id").select()
        df = self.catalog.frame(p.table)
        if p.final:
            t = self.catalog[p.table]
            if not t.key:
                raise ValueError(f"FINAL needs a table with a key; {p.table} has none")
            df = last_version(df, list(t.key), t.version)
        self._scopes[id(p)] = {p.alias or p.table: {c: c for c in df.columns}}
        return df

    @lower.register
    def _(self, p: ir.Alias) -> DataFrame:
        df = self.lower(p.child)
        self._scopes[id(p)] = {p.name: {c: c for c in df.columns}}
        return df

    @lower.register
    def _(self, p: ir.Filter) -> DataFrame:
        df = self.around(self.lower(p.child), p.where)
        scope = self.scope(p.child)
        for part in conjuncts(p.where):
            inner = part.args[0] if isinstance(part, ir.Op) and part.name == "not" else part
            loose = isinstance(inner, ir.Op) and inner.name == "loose_not_in"
            if loose and inner is part and _is_subquery(inner.args[-1]):
                sub = self.inner(inner.args[1], scope)
                df = df.join(sub.select(F.col(sub.columns[0]).alias("_in")), column(self.resolve(inner.args[0], scope)) == F.col("_in"), "left_anti")
            elif inner is not part and isinstance(inner, ir.Op) and inner.name == "in" and _is_subquery(inner.args[-1]):
                df = joins.not_in(df, column(self.resolve(inner.args[0], scope)), self.inner(inner.args[1], scope))
            else:
                df = df.filter(column(self.resolve(part, scope)))
        return df

    @lower.register
    def _(self, p: ir.Select) -> DataFrame:
        df, out = self.around(self.lower(p.child), *p.items), []
        scope = self.scope(p.child)
        for item in p.items:
            out += [F.col(f"`{c}`") for c in df.columns] if isinstance(item, ir.Star) else [column(self.resolve(item, scope))]
        df = df.select(*out)
        return df.distinct() if p.distinct else df

    @lower.register
    def _(self, p: ir.Group) -> DataFrame:
        df = self.lower(p.child)
        scope, time = self.scope(p.child), self.time_of(p.child)
        p = replace(p, keys=tuple(self.resolve(k, scope) for k in p.keys), items=tuple(self.resolve(i, scope) for i in p.items), having=self.resolve(p.having, scope))
        keys, names = [column(k) for k in p.keys], [k.alias for k in p.keys]
        made = [k for k, e in zip(keys, p.keys) if not (isinstance(e.expr, ir.Field) and e.expr.path == e.alias)]
        df = df.select("*", *made) if made else df
        df, p = self.with_neighbours(df, p, names, time)
        agg = self.aggregator(df, time)
        items = [column(i, agg) for i in p.items]
        hidden = p.having is not None and has_agg(p.having)
        if hidden:
            items.append(column(p.having, agg).alias("_having"))
        if not names:
            out = df.select(*items)  # aggregates alone; agg() would look up the names of a query around this one too early
        elif p.mode == "totals":
            out = df.groupingSets([[F.col(n) for n in names], []], *[F.col(n) for n in names]).agg(*items)
        elif p.mode in ("rollup", "cube"):
            out = getattr(df, p.mode)(*names).agg(F.grouping_id().cast("long").alias("grouping_id"), *items)
        else:
            out = df.groupBy(*names).agg(*items)
        if hidden:
            return out.filter("_having").drop("_having")
        return out.filter(column(p.having)) if p.having is not None else out

    @lower.register
    def _(self, p: ir.Windowed) -> DataFrame:
        df, w = self.lower(p.child), p.window
        time = self.time_of(p.child) or p.time
        scope = self.scope(p.child)
        p = replace(p, keys=tuple(self.resolve(k, scope) for k in p.keys), items=tuple(self.resolve(i, scope) for i in p.items), having=self.resolve(p.having, scope))
        names = [f"{k.alias}" for k in p.keys]
        df = df.select("*", *[column(k) for k in p.keys if not (isinstance(k.expr, ir.Field) and k.expr.path == k.alias)], micros(time).alias("_t"))
        agg, values = self.aggregator(df, time), [i.alias for i in p.items]
        ties = [c for c in df.columns if c.endswith("_id") and c not in names][:1]
        hidden = p.having is not None and has_agg(p.having)
        extra = (ir.Item(p.having, "_having"),) if hidden else ()

        def finish(out):
            if p.having is not None:  # a window that fails is as good as empty
                out = out.filter("_having").drop("_having") if hidden else out.filter(column(p.having))
            return out.select(*names, stamp(F.col("_w")).alias("_wstart"), stamp(F.col("_e")).alias("_wend"), *values)

        if w.kind == "interval":
            df = windows.assign_interval(df, names, w.size, w.slide, w.offset, w.align_first)
            df, p = self.with_neighbours(df, replace(p, items=p.items + extra), [*names, "_w", "_e"], time)
            out = df.groupBy(*names, "_w", "_e").agg(*[column(i, agg) for i in p.items])
            if w.fill.mode == "none":
                return finish(out)
            step, f = w.slide or w.size, w.fill
            lo = windows.floor_to(micros(column(f.start)), step, w.offset) if f.start is not None else None
            hi = windows.floor_to(micros(column(f.end)) - 1, step, w.offset) if f.end is not None else None
            kept = [*values, *(["_having"] if hidden else [])]
            out = windows.gap_fill(out.drop("_e"), names, step, kept, dict(f.modes) or f.mode, f.value, lo, hi)
            return finish(out.withColumn("_e", F.col("_w") + w.size))
        if w.kind == "session":
            df = windows.assign_session(df, names, w.size, ties)
        elif w.kind == "state":
            df = windows.assign_state(df, names, column(w.state), ties)
        elif w.kind == "event":
            df = windows.assign_event(df, names, column(w.start), column(w.end), ties, w.least)
        elif w.kind == "count":
            df = windows.assign_count(df, names, w.size, w.slide, ties)
        else:
            raise ValueError(f"unknown window {w.kind}")
        df, p = self.with_neighbours(df, replace(p, items=p.items + extra), [*names, "_g"], time)
        return finish(df.groupBy(*names, "_g").agg(F.min("_t").alias("_w"), F.max("_t").alias("_e"), *[column(i, agg) for i in p.items]))

    def with_neighbours(self, df: DataFrame, p, part: list[str], time: str):
        """For aggregates that need the row before (TWA, IRATE, ...): its value and the time since it, as columns."""
        found = {x for e in (*p.items, p.having) for x in ir.parts(e) if isinstance(x, ir.Agg) and x.name in aggregates.NEIGHBOURS}
        if not found:
            return df, p
        ties = [c for c in df.columns if c.endswith("_id") and c not in part][:1]
        w, t, known = series.series(part, time, ties), micros(time), {}
        for n, x in enumerate(sorted({x.args[0] for x in found}, key=repr)):
            df = df.withColumn(f"_v{n}", column(x).cast("double"))
            df = df.withColumns({f"_q{n}": F.lag(f"_v{n}").over(w), f"_dt{n}": (t - F.lag(t).over(w)) / 1e6})
            known[x] = (ir.Field(f"_v{n}"), ir.Field(f"_q{n}"), ir.Field(f"_dt{n}"))
        change = lambda x: replace(x, args=known[x.args[0]]) if isinstance(x, ir.Agg) and x in found else None
        return df, replace(p, items=tuple(ir.rewrite(i, change) for i in p.items), having=ir.rewrite(p.having, change))

    @lower.register
    def _(self, p: ir.Join) -> DataFrame:
        left, right = self.lower(p.left), self.lower(p.right)
        shared = [a for a, b in p.on if a == b] if p.on and all(a == b for a, b in p.on) else []
        names = joins.renames(left.columns, right.columns, shared)
        ours, theirs = self.scope(p.left), {q: {c: names[n] for c, n in m.items()} for q, m in self.scope(p.right).items()}
        self._scopes[id(p)] = ours if p.how in ("semi", "anti") else theirs | ours
        if p.where is None:
            return joins.equi(left, right, p.how, list(p.on))
        renamed = right.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
        how = {"semi": "left_semi", "anti": "left_anti"}.get(p.how, p.how)
        return left.join(renamed, column(self.resolve(p.where, theirs | ours)), how)

    @lower.register
    def _(self, p: ir.TimeJoin) -> DataFrame:
        left, right = self.lower(p.left), self.lower(p.right)
        self._scopes[id(p)] = {q: {c: f"right_{n}" for c, n in m.items()} for q, m in self.scope(p.right).items()} | self.scope(p.left)
        return joins.time_join(left, right, list(p.by), self.time_of(p.left) or "ts", self.time_of(p.right) or "ts", p.kind)

    @lower.register
    def _(self, p: ir.Sort) -> DataFrame:
        df = self.lower(p.child)
        below = p.child.child if isinstance(p.child, ir.Select) and not p.child.distinct else p.child
        scope = self.scope(below)
        return df.orderBy(*[sort_key(self.resolve(k, scope)) for k in p.keys])

    @lower.register
    def _(self, p: ir.Limit) -> DataFrame:
        df = self.lower(p.child)
        if p.offset:
            df = df.offset(p.offset)
        return df if p.count is None else df.limit(p.count)

    @lower.register
    def _(self, p: ir.LimitBy) -> DataFrame:
        df = self.lower(p.child)
        scope = self.scope(p.child.child if isinstance(p.child, ir.Select) else p.child)
        w = Window.partitionBy(*[column(self.resolve(b, scope)) for b in p.by]).orderBy(*[sort_key(self.resolve(k, scope)) for k in p.keys] or [F.col(c) for c in df.columns])
        return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= p.count).drop("_r")

    @lower.register
    def _(self, p: ir.SetOp) -> DataFrame:
        a, b = self.lower(p.left), self.lower(p.right)
        if p.kind == "union":
            return a.union(b) if p.all else a.union(b).distinct()
        if p.kind == "intersect":
            return a.intersectAll(b) if p.all else a.intersect(b)
        return a.exceptAll(b) if p.all else a.subtract(b)

    @lower.register
    def _(self, p: ir.Latest) -> DataFrame:
        df = self.lower(p.child)
        w = Window.partitionBy(*[field(k) for k in p.keys]).orderBy(F.col(p.time).desc(), *[F.col(c) for c in df.columns if c.endswith("_id")])
        return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")

    @lower.register
    def _(self, p: ir.Unwind) -> DataFrame:
        from ..operators.documents import unwind

        return unwind(self.lower(p.child), p.path)

    @lower.register
    def _(self, p: ir.Lookup) -> DataFrame:
        return joins.lookup(self.lower(p.child), self.catalog.frame(p.table), p.local, p.foreign, p.name)

    @lower.register
    def _(self, p: ir.Series) -> DataFrame:
        df = self.lower(p.child)
        if p.name == "hash_sample":
            return series.hash_sample(df, p.params[0], df.columns)
        if p.name == "series_limit":
            n, skip = p.params
            rank = F.dense_rank().over(Window.orderBy(*p.keys))
            chosen = df.select(*p.keys).distinct().withColumn("_r", rank).filter((F.col("_r") > (skip or 0)) & (F.col("_r") <= (skip or 0) + n if n is not None else F.lit(True))).drop("_r")
            return df.join(chosen, list(p.keys), "left_semi")
        time, keys, w, value = self.series_window(df, p)
        out = df.withColumn(value, self.over_series(p.name, value, time, w, p.params))
        return out.filter(F.col(value).isNotNull()) if p.name in series.FIRST_UNDEFINED else out

    @lower.register
    def _(self, p: ir.SeriesItems) -> DataFrame:
        df = self.lower(p.child)
        time, keys, w, _ = self.series_window(df, p)
        made, drops = [], []
        for i in p.items:
            if isinstance(i.expr, ir.Op) and i.expr.name == "series":
                name, of, *params = i.expr.args
                df = df.withColumn(f"_f{len(made)}", column(of))
                made.append(self.over_series(name.value, f"_f{len(made)}", time, w, tuple(a.args[0].value if isinstance(a, ir.Op) else a.value for a in params)).alias(i.alias))
                drops.append(i.alias if name.value in series.FIRST_UNDEFINED else None)
            else:
                made.append(column(i))
        names = [i.alias for i in p.items]
        shown = [c for c in dict.fromkeys([*keys, time, *(["_wend"] if "_wend" in df.columns else [])]) if c not in names]
        out = df.select(*shown, *made)
        return out.dropna("all", subset=drops) if drops and all(drops) else out

    def series_window(self, df: DataFrame, p):
        time, tags, value = self.series_of(p.child)
        keys = [k for k in (p.keys or tuple(tags)) if k in df.columns]
        value = next((c for c in (value, "value", "_value") if c in df.columns), value)
        time = next((c for c in (time, "_wstart") if c in df.columns), time)
        ties = [c for c in df.columns if c.endswith("_id") and c not in keys][:1]
        return time, keys, series.series(keys, time, ties), value

    def over_series(self, name: str, value: str, time: str, w, params: tuple):
        made = {
            "difference": lambda: series.difference(value, w), "non_negative_difference": lambda: F.when(series.difference(value, w) >= 0, series.difference(value, w)),
            "derivative": lambda: series.derivative(value, time, w, *(params or (1_000_000,))), "non_negative_derivative": lambda: series.derivative(value, time, w, *(params or (1_000_000,)), positive=True),
            "cumulative_sum": lambda: F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), "moving_average": lambda: series.rolling(F.avg, value, w, int(params[0])),
            "elapsed": lambda: (micros(time) - F.lag(micros(time)).over(w)) / (params[0] if params else 1_000_000), "pct_change": lambda: series.pct_change(value, w),
            "increase": lambda: series.rise(value, w), "abs": lambda: F.abs(value), "scale": lambda: F.col(value) * params[0], "offset": lambda: F.col(value) + params[0],
            "fill_prev": lambda: F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "fill_value": lambda: F.coalesce(value, F.lit(params[0])),
        }
        if name not in made:
            raise ValueError(f"unknown series function {name}")
        return made[name]()

    @lower.register
    def _(self, p: ir.Change) -> DataFrame:
        from ..operators import changes

        known = p.table in self.catalog.tables
        old = self.catalog.frame(p.table) if known else None
        if p.kind == "insert":
            new = self.values(p, old)
            new = new if old is None or set(old.columns) == {"_id"} != set(new.columns) else changes.insert(old, new)
        elif p.where is None:
            raise ValueError(f"{p.kind} needs WHERE")
        elif p.kind == "update":
            new = changes.update(old, column(p.where), {c: column(e) for c, e in p.rows})
        else:
            new = changes.delete(old, column(p.where))
        self.catalog.replace(p.table, new)
        return new

    def values(self, p: ir.Change, old: DataFrame | None) -> DataFrame:
        """The rows of an INSERT: named columns, else all of the table's in order; in the table's types."""
        names = list(p.columns) or (old.columns[: len(p.rows[0])] if old is not None else [f"field{k}" for k in range(len(p.rows[0]))])
        if any(len(r) != len(names) for r in p.rows):
            raise ValueError(f"INSERT needs {len(names)} values a row")
        kinds = dict(old.dtypes) if old is not None else {}
        if not all(n in kinds for n in names):
            return self.catalog.spark.createDataFrame([tuple(r) for r in p.rows], names)
        raw = self.catalog.spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in p.rows], ", ".join(f"`{n}` string" for n in names))
        return raw.select(*[F.col(f"`{n}`").cast(kinds[n]).alias(n) for n in names])

    @lower.register
    def _(self, p: ir.Rows) -> DataFrame:
        df, scope = self.lower(p.child), self.scope(p.child)
        time = self.time_of(p.child) or "ts"
        keys, names = [self.resolve(k, scope) for k in p.keys], [k.alias for k in p.keys]
        df = df.select("*", *[column(k) for k in keys if not (isinstance(k.expr, ir.Field) and k.expr.path == k.alias)])
        df = df.withColumn("_of", column(self.resolve(p.of, scope)))
        ties = [c for c in df.columns if c.endswith("_id") and c not in names][:1]
        shown = [column(self.resolve(i, scope)) for i in p.items if i.alias not in names]
        named = lambda d: d.select(*names, *shown, F.col("_of").alias(p.alias))
        if p.name == "tail":
            return named(rows.first_rows(df.filter("_of is not null"), names, [F.col(c).desc() for c in (time, *ties)], int(p.params[0])))
        if p.name == "sample":
            return named(rows.sample_evenly(df.filter("_of is not null"), names, [time, *ties], int(p.params[0])))
        if p.name == "histogram":
            return rows.histogram(df, names, "_of", int(p.params[0]) if p.params else 10)
        if p.name in ("statecount", "stateduration"):
            sign, limit, *unit = p.params
            ops = {"LT": "<", "GT": ">", "LE": "<=", "GE": ">=", "NE": "!=", "EQ": "="}
            if sign.upper() not in ops:
                raise ValueError(f"{p.name}: unknown operator {sign}")
            return named(rows.state_runs(df, names, time, ties, column(ir.Op(ops[sign.upper()], (ir.Field("_of"), ir.Lit(limit)))), p.name == "statecount", unit[0] if unit else 1_000_000))
        step, mode = p.params[0], (p.params[1].lower() if len(p.params) > 1 else "linear")  # interp(value, step, mode)
        df = df.filter("_of is not null").withColumn("_t", micros(time))
        return windows.interpolate(df, names, "_of", int(step), {"previous": "prev"}.get(mode, mode), ties).select(*names, stamp(F.col("_w")).alias(time), F.col("_of").alias(p.alias))

    @lower.register
    def _(self, p: ir.Create) -> DataFrame:
        c = self.catalog
        if p.kind == "index":
            self.lower(p.source)  # the table must be there; an index changes no result
        elif p.kind == "database":
            c.databases.add(p.name)
        elif p.name in c.tables or p.name in c.streams:
            if not p.lenient:
                raise ValueError(f"{p.name} exists")
        elif p.kind == "collection":
            c.add(p.name, c.spark.createDataFrame([], "_id string"))
        elif p.kind == "child":
            parent = c[p.source.table]
            tags = p.columns or parent.tags
            if len(tags) != len(p.options):
                raise ValueError(f"{p.source.table} has the tags {', '.join(tags)}")
            frame = c.frame(p.source.table)
            for t, v in zip(tags, p.options):
                frame = frame.filter(F.col(t).eqNullSafe(F.lit(v)))
            c.add(p.name, frame, time=parent.time, tags=parent.tags, value=parent.value)
        elif p.source is not None:
            frame = self.lower(p.source)
            if p.kind == "stream":
                c.streams[p.name] = (p.target, p.source, dict(p.options))
            time = next((n for n, k in frame.dtypes if k.startswith("timestamp")), "")
            if p.target and p.target in c.tables:
                raise ValueError(f"{p.target} exists")
            c.add(p.target or p.name, frame, time=time)
        else:
            schema = ", ".join(f"`{n}` {k}" for n, k in p.columns)
            time = p.target or next((n for n, k in p.columns if k.startswith("timestamp")), "")
            value = next((n for n, k in p.columns if k in ("double", "float", "int", "bigint") and n not in p.options), "")
            c.add(p.name, c.spark.createDataFrame([], schema), time=time, tags=tuple(p.options), value=value)
        return c.show("databases" if p.kind == "database" else "tables")

    @lower.register
    def _(self, p: ir.Catalogue) -> DataFrame:
        if p.verb == "describe":
            return self.catalog.describe(p.name)
        if p.verb == "show":
            return self.catalog.show(p.kind, p.name)
        self.catalog.drop(p.name, p.kind, p.verb == "drop_known")
        return self.catalog.show("tables")


def last_version(df: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row of each key with the greatest version; of equal ones, the greatest row."""
    order = [F.col(version).desc()] if version else []
    w = Window.partitionBy(*key).orderBy(*order, *[F.col(c).desc() for c, kind in df.dtypes if c not in key and not kind.startswith("map")])
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def _is_subquery(e) -> bool:
    return isinstance(e, ir.Op) and e.name == "subquery"


def conjuncts(e) -> list:
    return [x for a in e.args for x in conjuncts(a)] if isinstance(e, ir.Op) and e.name == "and" else [e]

