"""Windowed aggregates printed in other dialects: one plan, eight texts."""

from __future__ import annotations

from dataclasses import dataclass

from ..plans import ir

_UNITS = (("w", 604_800_000_000), ("d", 86_400_000_000), ("h", 3_600_000_000), ("m", 60_000_000), ("s", 1_000_000), ("ms", 1_000), ("us", 1))


def duration(us: int) -> str:
    for unit, size in _UNITS:
        if us % size == 0:
            return f"{us // size}{unit}"
    return f"{us}us"


@dataclass(frozen=True)
class Shape:
    """What the printers need of a plan: source, filter, window, keys, aggregates, limit."""

    table: str
    where: object
    size: int
    fill: ir.Fill
    keys: tuple[str, ...]
    aggs: tuple[tuple[str, str, str], ...]
    limit: int | None


def shape(plan) -> Shape:
    limit, size, fill, keys, aggs, where = None, 0, ir.Fill(), (), (), None
    while not isinstance(plan, ir.Scan):
        if isinstance(plan, ir.Limit):
            limit = plan.count
        elif isinstance(plan, ir.Filter):
            where = plan.where if where is None else ir.Op("and", (plan.where, where))
        elif isinstance(plan, (ir.Windowed, ir.Group)):
            if isinstance(plan, ir.Windowed):
                if plan.window.kind != "interval":
                    raise ValueError(f"a {plan.window.kind} window has no form in other dialects")
                size, fill = plan.window.size, plan.window.fill
            names = []
            for k in plan.keys:
                if isinstance(k.expr, ir.Op) and k.expr.name in ("bucket", "gapfill"):
                    size = k.expr.args[0].value
                elif isinstance(k.expr, ir.Field):
                    names.append(k.expr.path)
                else:
                    raise ValueError("a computed key has no form in other dialects")
            keys = tuple(names)
            aggs = tuple((i.expr.name, i.expr.args[0].path if i.expr.args else "*", i.alias) for i in plan.items)
        elif not isinstance(plan, (ir.Select, ir.Sort)):
            raise ValueError(f"{type(plan).__name__} has no form in other dialects")
        plan = plan.child
    return Shape(plan.table, where, size, fill, keys, aggs, limit)


def _lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return {True: "TRUE", False: "FALSE", None: "NULL"}.get(v, str(v)) if isinstance(v, bool) or v is None else str(v)


def expression(e, field=lambda p: p) -> str:
    """A predicate as SQL text."""
    if isinstance(e, ir.Field):
        return field(e.path)
    if isinstance(e, ir.Lit):
        return _lit(e.value)
    a = [expression(x, field) for x in e.args]
    if e.name in ("and", "or"):
        return "(" + f" {e.name.upper()} ".join(a) + ")"
    if e.name == "not":
        return f"NOT ({a[0]})"
    if e.name == "between":
        return f"{a[0]} BETWEEN {a[1]} AND {a[2]}"
    if e.name in ("in", "loose_not_in"):
        return f"{a[0]} {'NOT IN' if e.name != 'in' else 'IN'} ({', '.join(a[1:])})"
    if e.name in ("is_null", "is_not_null"):
        return f"{a[0]} IS {'NOT ' if e.name == 'is_not_null' else ''}NULL"
    if e.name == "cast":
        return a[0]
    if e.name in ("like", "ilike"):
        return f"{a[0]} {e.name.upper()} {a[1]}"
    return f"{a[0]} {e.name.replace('loose_', '')} {a[1]}"


def conjuncts(e) -> list:
    return [] if e is None else [x for a in e.args for x in conjuncts(a)] if isinstance(e, ir.Op) and e.name == "and" else [e]


def _sql(s: Shape, bucket: str | None, fns=lambda f, c: f"{f}({c})", tail: str = "", keys_first: bool = True) -> str:
    items = ([bucket] if bucket else []) + list(s.keys) + [f"{fns(f, c)} AS {a}" for f, c, a in s.aggs]
    text = f"SELECT {', '.join(items) or '*'} FROM {s.table}"
    if s.where is not None:
        text += f" WHERE {expression(s.where)}"
    group = ([bucket.split(" AS ")[1]] if bucket and " AS " in bucket else []) + list(s.keys)
    if group and keys_first:
        text += f" GROUP BY {', '.join(group)}"
    return text + tail + (f" LIMIT {s.limit}" if s.limit is not None else "")


def to(plan, dialect: str) -> str:
    s = shape(plan)
    d = duration(s.size) if s.size else ""
    if dialect in ("sql", "timescale"):
        return _sql(s, f"time_bucket('{s.size // 1_000_000} seconds', ts) AS bucket" if s.size else None)
    if dialect == "clickhouse":
        return _sql(s, f"toStartOfInterval(ts, INTERVAL {s.size // 1_000_000} SECOND) AS bucket" if s.size else None)
    if dialect == "druid":
        return _sql(s, f"TIME_FLOOR(__time, 'PT{s.size // 1_000_000}S') AS bucket" if s.size else None)
    if dialect == "tdengine":
        parts = (f" PARTITION BY {', '.join(s.keys)}" if s.keys else "") + (f" INTERVAL({d})" if d else "") + (f" FILL({s.fill.mode})" if d and s.fill.mode != "none" else "")
        return _sql(s, None, tail=parts, keys_first=not d)
    if dialect == "questdb":
        return _sql(s, None, tail=(f" SAMPLE BY {d}" if d else "") + (f" FILL({s.fill.mode})" if d and s.fill.mode != "none" else ""), keys_first=not d)
    if dialect == "influxql":
        names = {"avg": "mean", "stddev_pop": "stddev"}
        group = ([f"time({d})"] if d else []) + [f'"{k}"' for k in s.keys]
        text = f"SELECT {', '.join(f'{names.get(f, f)}("{c}") AS {a}' for f, c, a in s.aggs) or '*'} FROM \"{s.table}\""
        text += f" WHERE {expression(s.where)}" if s.where is not None else ""
        text += f" GROUP BY {', '.join(group)}" if group else ""
        text += f" FILL({ {'prev': 'previous'}.get(s.fill.mode, s.fill.mode)})" if d else ""
        return text + (f" LIMIT {s.limit}" if s.limit is not None else "")
    if len(s.aggs) > 1:
        raise ValueError(f"{dialect} has one aggregate for each query")
    fn = s.aggs[0][0] if s.aggs else "last"
    if dialect == "flux":
        lines = [f'from(bucket: "{s.table}")', "|> range(start: 0)"]
        for c in conjuncts(s.where):
            op = {"=": "=="}.get(c.name, c.name.replace("loose_", ""))
            v = c.args[1].value
            lines.append(f"|> filter(fn: (r) => r.{c.args[0].path} {op} " + (f'"{v}"' if isinstance(v, str) else str(v)) + ")")
        lines.append("|> group(columns: [" + ", ".join(f'"{k}"' for k in s.keys) + "])")
        if d:
            lines.append(f"|> aggregateWindow(every: {d}, fn: {({'avg': 'mean'}.get(fn, fn))}, createEmpty: false)")
        if s.limit is not None:
            lines.append(f"|> limit(n: {s.limit})")
        return "\n  ".join(lines)
    if dialect == "promql":
        ops = {"=": "=", "!=": "!=", "loose_!=": "!=", "matches": "=~"}
        found = []
        for c in conjuncts(s.where):
            if c.name not in ops:
                raise ValueError(f"promql cannot compare labels with {c.name}")
            found.append(f'{c.args[0].path}{ops[c.name]}"{c.args[1].value}"')
        inner = s.table + ("{" + ",".join(found) + "}" if found else "")
        outer = fn if fn in ("sum", "avg", "min", "max", "count") else "avg"
        body = f"{fn}_over_time({inner}[{d}])" if d else inner
        return f"{outer} by ({', '.join(s.keys)}) ({body})" if s.keys else f"{outer}({body})"
    raise ValueError(f"no printer for {dialect}")
