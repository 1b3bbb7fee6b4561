"""The SQL-like dialects: what their functions and names mean, and their statements."""

from __future__ import annotations

from dataclasses import replace

from ..plans import ir
from ..plans.durations import micros
from ..plans.grammar import Dialect, ParseError, Parser

HOUR, DAY = micros("1h"), micros("1d")


def _size(e) -> int:
    """Microseconds of a duration argument, however it is written."""
    if isinstance(e, ir.Op) and e.name == "duration":
        return e.args[0].value
    if isinstance(e, ir.Lit):
        return micros(e.value) if isinstance(e.value, str) else int(e.value) * 1_000_000
    raise ParseError(f"not a duration: {e!r}")


def bucket(size, time, offset=None) -> ir.Op:
    return ir.Op("bucket", (ir.Lit(_size(size)), time, ir.Lit(_size(offset) if offset is not None else 0)))


def _start_of(unit: str):
    return lambda t: ir.Op("trunc", (ir.Lit(unit), t))


def _fixed(size: int):
    return lambda t, *_: ir.Op("bucket", (ir.Lit(size), t, ir.Lit(0)))


def _floor(e, *rest):
    if isinstance(e, ir.Op) and e.name == "unit":
        return ir.Op("trunc", (ir.Lit(e.args[1].value.lower()), e.args[0]))
    return ir.Op("floor", (e, *rest))


def _within(time, interval):
    lo, _, hi = interval.value.partition("/")
    stamp = lambda s: ir.Op("cast", (ir.Lit(s.replace("T", " ").rstrip("Z")), ir.Lit("timestamp_ntz")))
    return ir.Op("and", (ir.Op(">=", (time, stamp(lo))), ir.Op("<", (time, stamp(hi)))))


def _if(name: str):
    def make(*args):
        *values, cond = args
        value = values[0] if values else ir.Lit(1)
        return ir.Agg(name, (ir.Op("case", (cond, value)),))

    return make


def _sum0(e):
    return ir.Agg("sum0", (e,))


CLICKHOUSE = {
    "tostartofminute": _fixed(micros("1m")), "tostartofhour": _fixed(HOUR), "tostartofday": _fixed(DAY), "tostartofweek": _start_of("week"), "tostartofmonth": _start_of("month"), "tostartofyear": _start_of("year"),
    "tostartoffiveminutes": _fixed(micros("5m")), "tostartofinterval": lambda t, d: bucket(d, t), "todate": _start_of("day"), "countif": _if("count"), "sumif": _if("sum"), "avgif": _if("avg"),
    "argmin": lambda a, b: ir.Agg("arg_min", (a, b)), "argmax": lambda a, b: ir.Agg("arg_max", (a, b)), "arrayjoin": lambda a: ir.Op("explode", (a,)), "multiif": lambda *a: ir.Op("case", a),
    "median": lambda e: ir.Agg("median", (e,)), "tointervalhour": lambda n: ir.Op("duration", (ir.Lit(n.value * HOUR),)), "tointervalday": lambda n: ir.Op("duration", (ir.Lit(n.value * DAY),)), "toyear": lambda t: ir.Op("cast", (ir.Op("year", (t,)), ir.Lit("long"))), "stddevpop": lambda e: ir.Agg("stddev_pop", (e,)),
}
TIMESCALE = {
    "time_bucket": bucket, "time_bucket_gapfill": lambda d, t, *ends: ir.Op("gapfill", (*bucket(d, t).args, *ends)), "locf": lambda e: ir.Op("locf", (e,)), "interpolate": lambda e: ir.Op("interpolate", (e,)),
    "first": lambda v, t: ir.Agg("arg_min", (v, t)), "last": lambda v, t: ir.Agg("arg_max", (v, t)), "approximate_row_count": lambda *_: ir.Agg("count"),
}
DRUID = {
    "time_floor": lambda t, p, *_: ir.Op("bucket", (ir.Lit(micros(p.value)), t, ir.Lit(0))), "floor": _floor, "time_in_interval": _within, "ds_hll": lambda e, *_: ir.Agg("approx_count_distinct", (e,)), "earliest": lambda v, *_: ir.Agg("first", (v,)), "latest": lambda v, *_: ir.Agg("last", (v,)),
    "time_shift": lambda t, p, n, *_: ir.Op("+", (t, ir.Op("duration", (ir.Lit(micros(p.value) * n.value),)))), "millis_to_timestamp": lambda e: ir.Op("timestamp_millis", (e,)),
}
TDENGINE = {
    "apercentile": lambda e, p, *_: ir.Agg("percentile", (e,), (p.value,)), "derivative": lambda e, *_: ir.Agg("derivative", (e,)), "rate": lambda e: ir.Agg("derivative", (e,)),
    "integral": lambda e, unit=None: ir.Agg("integral", (e,), () if unit is None else (_size(unit),)), "csum": lambda e: ir.Op("series", (ir.Lit("cumulative_sum"), e)), "mavg": lambda e, n: ir.Op("series", (ir.Lit("moving_average"), e, n)),
} | {name: (lambda name: lambda e: ir.Agg(name, (e,)))(name) for name in ("irate", "increase", "idelta", "resets", "changes", "twa")} | {name: (lambda name: lambda *a: ir.Op("rows", (ir.Lit(name), *a)))(name) for name in ("sample", "tail", "histogram", "statecount", "stateduration", "interp")}
INFLUX_SERIES = {"derivative", "non_negative_derivative", "difference", "non_negative_difference", "moving_average", "cumulative_sum", "elapsed"}

DIALECTS = {
    "lql": Dialect("lql", loose=True, ilike=True, calls={"sum": _sum0}),
    "sql": Dialect("sql"),
    "tdengine": Dialect("tdengine", calls=TDENGINE),
    "timescale": Dialect("timescale", calls=TIMESCALE),
    "questdb": Dialect("questdb", calls={"stddev": lambda e: ir.Agg("stddev_samp", (e,))}, fields={"timestamp": "ts"}),
    "clickhouse": Dialect("clickhouse", calls=CLICKHOUSE),
    "druid": Dialect("druid", calls=DRUID, fields={"__time": "ts"}),
    "influxql": Dialect("influxql", fields={"time": "ts"}, calls={"stddev": lambda e: ir.Agg("stddev_samp", (e,)), "percentile": lambda e, p: ir.Agg("percentile", (e,), (p.value,)), "distinct": lambda e: ir.Agg("unique", (e,))}
                        | {n: (lambda name: lambda e, *a: ir.Op("series", (ir.Lit(name), e, *a)))(n) for n in INFLUX_SERIES}),
}


for _name in ("postgres", "mysql", "cql"):
    DIALECTS[_name] = Dialect(_name)


def parse(text: str, dialect: str = "sql", now: str | None = None):
    d = DIALECTS[dialect]
    if now is not None:
        d = replace(d, calls=d.calls | {"now": lambda: ir.Op("cast", (ir.Lit(now), ir.Lit("timestamp_ntz")))})
    p = Parser(text, d)
    plan = statement(p)
    p.take("allow", "filtering")
    p.done()
    plan = _series(plan) if dialect in ("influxql", "tdengine") else plan
    plan = _rows(plan) if dialect == "tdengine" else plan
    return _gapfill(plan) if dialect == "timescale" else plan


def statement(p: Parser):
    word = p.peek()
    if word in ("select", "("):
        return p.select()
    if word == "with" and p.kind(1) == "name":
        p.fail("common table expressions are for the sql() entry")
    if p.take("insert", "into"):
        return _insert(p)
    if p.take("update"):
        table = p.path()
        p.need("set")
        changes = [_assignment(p)]
        while p.take(","):
            changes.append(_assignment(p))
        p.need("where")
        return ir.Change(table, "update", rows=tuple(changes), where=p.expression())
    if p.take("delete", "from"):
        table = p.path()
        p.need("where")
        return ir.Change(table, "delete", where=p.expression())
    if p.take("create"):
        return _create(p)
    if p.take("drop"):
        kind = p.name().lower()
        if kind not in ("table", "collection", "view", "stream", "topic", "database", "index"):
            p.fail(f"cannot drop a {kind}")
        lenient = p.take("if", "exists")
        name = p.path()
        if kind == "index" and p.take("on"):
            p.path()
        return ir.Catalogue("drop" if not lenient else "drop_known", kind, name)
    if p.take("stream", "from"):
        return _stream_from(p)
    if p.take("describe") or p.take("desc"):
        p.take("table")
        return ir.Catalogue("describe", "table", p.path())
    if p.take("show"):
        kind = p.name().lower()
        if kind in ("tag", "field"):
            kind += f" {p.name().lower()}"
        table = p.path() if p.take("from") else ""
        if p.take("with"):
            p.need("key", "=")
            t = p.next()
            table = f"{table}.{t.text.strip(chr(34) + chr(39))}"
        return ir.Catalogue("show", kind, table)
    p.fail("unknown statement")


def _assignment(p: Parser) -> tuple:
    name = p.path()
    p.need("=")
    return name, p.expression()


def _insert(p: Parser):
    table = p.path()
    columns = tuple(p.list_of(p.name)) if p.take("(") else ()
    p.need("values")
    rows = []
    while p.take("("):
        rows.append(tuple(e.value for e in p.list_of(p.expression)))
        p.take(",")
    return ir.Change(table, "insert", columns, tuple(rows))


#: Column types of CREATE TABLE as Spark's (lower-case names; lengths are dropped).
_TYPES = {
    "bool": "boolean", "nchar": "string", "varchar": "string", "text": "string", "char": "string", "symbol": "string", "string": "string", "uuid": "string", "json": "string", "integer": "int", "int4": "int", "int8": "bigint", "long": "bigint",
    "int32": "int", "int64": "bigint", "float4": "float", "float64": "double", "real": "float", "timestamptz": "timestamp_ntz", "timestamp": "timestamp_ntz", "datetime": "timestamp_ntz", "numeric": "double", "binary": "string", "serial": "int",
}


def _columns(p: Parser) -> list[tuple[str, str]]:
    out = []
    p.need("(")
    while True:
        name, kind = p.name(), p.name().lower()
        if kind == "double":
            p.take("precision")
        if p.take("("):
            p.integer()
            p.need(")")
        out.append((name, _TYPES.get(kind, kind)))
        while p.peek() in ("primary", "key", "not", "null", "unique"):
            p.next()
        if not p.take(","):
            break
    p.need(")")
    return out


def _create(p: Parser):
    """Tables, collections, streams and topics become names in the catalog; databases and indexes change no result.
    What cannot be kept is an error."""
    p.take("or", "replace")
    kind = p.name().lower()
    if kind == "unique":
        kind = p.name().lower()
    lenient = p.take("if", "not", "exists")
    if kind == "index":
        name = p.path() if p.peek() != "on" else ""
        p.need("on")
        table = p.path()
        p.need("(")
        p.list_of(p.path)
        return ir.Create("index", name, source=ir.Scan(table))
    name = p.path()
    if kind in ("database", "collection"):
        return ir.Create(kind, name, lenient=lenient)
    if kind in ("view", "topic"):
        p.need("as")
        return ir.Create(kind, name, source=p.select(), lenient=lenient)
    if kind == "stream":
        options = []
        while p.peek() not in ("into", "as", ""):
            option = p.name().lower()
            if option not in ("trigger", "watermark", "ignore_expired", "ignore_update", "fill_history", "delete_mark"):
                p.fail(f"unknown option {option}")
            t = p.next()
            options.append((option, " ".join([t.text, *([p.next().text] if t.text.lower() == "max_delay" else [])])))
        target = p.path() if p.take("into") else name
        p.need("as")
        return ir.Create("stream", name, target=target, options=tuple(options), source=p.select(), lenient=lenient)
    if kind not in ("table", "stable"):
        p.fail(f"cannot create a {kind}")
    if p.take("using"):  # a child of a super table: the rows with these tag values
        parent = p.path()
        names = p.list_of(p.name) if p.take("(") else []
        p.need("tags", "(")
        return ir.Create("child", name, source=ir.Scan(parent), columns=tuple(names), options=tuple(e.value for e in p.list_of(p.expression)), lenient=lenient)
    if p.take("as"):
        return ir.Create("table", name, source=p.select(), lenient=lenient)
    columns = _columns(p)
    tags = _columns(p) if p.take("tags") else []
    time = ""
    if p.take("timestamp", "("):  # the designated time column
        time = p.name()
        p.need(")")
    return ir.Create("table", name, columns=tuple(columns + tags), options=tuple(n for n, _ in tags), target=time, lenient=lenient)


def _stream_from(p: Parser):
    """STREAM FROM topic [WHERE ...] [WINDOW ...]: the rows of a topic that pass the filter."""
    plan = ir.Scan(p.path())
    return ir.Filter(plan, p.expression()) if p.take("where") else plan


def _is(e, name: str) -> bool:
    return isinstance(e, ir.Op) and e.name == name


def _named(item: ir.Item) -> str:
    """The alias of an item, or the name of its function where none was written."""
    return item.expr.args[0].value if "(" in item.alias else item.alias


def _series(plan):
    """SELECT difference(value), ... or of aggregates in windows: the windows first, then the functions over their rows."""
    if isinstance(plan, (ir.Limit, ir.Sort)):
        return replace(plan, child=_series(plan.child))
    items = [i for i in getattr(plan, "items", ()) if isinstance(i, ir.Item)]
    if not any(_is(i.expr, "series") for i in items):
        return plan
    windows = isinstance(plan, ir.Windowed)
    keys = tuple(k.alias for k in plan.keys) if windows else ()
    if len(plan.items) == 1 and "(" in items[0].alias:  # in the place of the value
        name, inner, *args = items[0].expr.args
        params = tuple(a.args[0].value if isinstance(a, ir.Op) else a.value for a in args)
        return ir.Series(replace(plan, items=(ir.Item(inner, "value"),)) if windows else plan.child, name.value, params, keys)
    if len(items) < len(plan.items):
        raise ParseError("* cannot stand beside a function of a series")
    below, shown = [], []
    for n, i in enumerate(items):
        if _is(i.expr, "series"):
            name, inner, *args = i.expr.args
            if windows:
                below.append(ir.Item(inner, f"_s{n}"))
                inner = ir.Field(f"_s{n}")
            shown.append(ir.Item(ir.Op("series", (name, inner, *args)), _named(i)))
        else:
            below.append(i)
            shown.append(ir.Item(ir.Field(i.alias), i.alias) if windows else i)
    return ir.SeriesItems(replace(plan, items=tuple(below)) if windows else plan.child, tuple(shown), keys)


def _rows(plan):
    """SAMPLE, TAIL, HISTOGRAM, STATECOUNT, STATEDURATION and INTERP give rows, not one value: one of them, alone."""
    if isinstance(plan, (ir.Limit, ir.Sort)):
        return replace(plan, child=_rows(plan.child))
    items = [i for i in getattr(plan, "items", ()) if isinstance(i, ir.Item)]
    found = [i for i in items if _is(i.expr, "rows")]
    if not found:
        return plan
    plain = [i for i in items if i not in found]
    group = plan.child if isinstance(plan, ir.Select) and isinstance(plan.child, ir.Group) else None
    if len(found) > 1 or isinstance(plan, ir.Windowed) or (group and group.items):
        raise ParseError(f"{found[0].alias} must be the only function of its SELECT")
    keys = tuple(group.keys) if group else ()
    name, of, *args = found[0].expr.args
    return ir.Rows(group.child if group else plan.child, name.value, of, tuple(a.args[0].value if isinstance(a, ir.Op) else a.value for a in args), keys, _named(found[0]), tuple(plain))


def _gapfill(plan):
    """GROUP BY time_bucket_gapfill(...): an interval window whose empty buckets are filled, each column in its way."""
    if isinstance(plan, (ir.Limit, ir.Sort)):
        return replace(plan, child=_gapfill(plan.child))
    if not (isinstance(plan, ir.Select) and isinstance(plan.child, ir.Group)):
        return plan
    group = plan.child
    found = [k for k in group.keys if _is(k.expr, "gapfill")]
    if not found:
        return plan
    size, _, _, *ends = found[0].expr.args
    ends = [e if isinstance(e, ir.Op) else ir.Op("cast", (e, ir.Lit("timestamp_ntz"))) if e.value is not None else None for e in ends] + [None, None]
    modes, items = [], []
    for i in group.items:
        if _is(i.expr, "locf") or _is(i.expr, "interpolate"):
            modes.append((i.alias, {"locf": "prev", "interpolate": "linear"}[i.expr.name]))
            i = ir.Item(i.expr.args[0], i.alias)
        items.append(i)
    rest = tuple(k for k in group.keys if k is not found[0])
    fill = ir.Fill("columns" if modes else "null", modes=tuple(modes), start=ends[0], end=ends[1])
    windowed = ir.Windowed(group.child, ir.Window("interval", size.value, fill=fill), rest, tuple(items), "ts", group.having)
    shown = [ir.Item(ir.Field("_wstart") if i.alias == found[0].alias else i.expr, i.alias) for i in plan.items]
    return ir.Select(windowed, tuple(shown), plan.distinct)
