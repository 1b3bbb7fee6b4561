"""A tokenizer and a recursive-descent parser for the SQL-like dialects.

One grammar covers them: the clauses that only one dialect has (SAMPLE BY, PREWHERE, STATE_WINDOW, ...) are distinct
enough to be read wherever they stand, and `Dialect` says what a name means.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from . import ir
from .durations import micros

_TOKEN = re.compile(
    r"""\s+|--[^\n]*|/\*.*?\*/
    |(?P<string>'(?:[^'\\]|''|\\.)*')|(?P<quoted>"(?:[^"]|"")*"|`[^`]*`)
    |(?P<duration>\d+(?:ns|us|ms|mo|[uµasmhdwy])(?:\d+(?:ns|us|ms|[uµasmhdw]))*\b)
    |(?P<number>\d+\.\d+(?:[eE][-+]?\d+)?|\d+(?:[eE][-+]?\d+)?|\.\d+)
    |(?P<name>[A-Za-z_][A-Za-z_0-9$]*)|(?P<sign>=~|!~|<>|!=|<=|>=|==|\|\||::|[-+*/%(),.;=<>\[\]&|^~])""",
    re.X | re.S,
)

#: Words that end an expression or item, so that they are never taken as an alias.
STOPS = set(
    """from where group having order limit offset as and or not in like ilike between is contains starts ends matches union intersect except join inner left right full outer
    cross semi anti on using asc desc nulls interval sliding session state_window event_window count_window fill partition slimit soffset sample latest align prewhere final with
    asof lt splice into values set when then else end tz settings by rlike regexp over allow""".split()
)

AGGREGATES = set(
    """count sum avg mean min max first last last_row array_agg string_agg median stddev stddev_pop stddev_samp variance var_pop var_samp spread percentile apercentile quantile
    percentile_cont top bottom diff mode hyperloglog approx_count_distinct count_distinct uniq uniqexact elapsed unique histogram tail any arg_min arg_max twa groupuniqarray grouparray""".split()
)


class ParseError(ValueError):
    pass


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup:
            out.append(Token(m.lastgroup, m.group(), at))
        at = m.end()
    return out


@dataclass(frozen=True)
class Dialect:
    """calls: rewrites of function calls by name. loose: a missing value satisfies != and NOT IN."""

    name: str
    loose: bool = False
    ilike: bool = False
    time: str = "ts"
    calls: dict[str, Callable] = field(default_factory=dict)
    fields: dict[str, str] = field(default_factory=dict)


class Parser:
    def __init__(self, text: str, dialect: Dialect):
        self.tokens, self.at, self.dialect, self.text = tokens(text), 0, dialect, text

    # tokens
    def peek(self, k: int = 0) -> str:
        i = self.at + k
        return self.tokens[i].text.lower() if i < len(self.tokens) and self.tokens[i].kind in ("name", "sign") else ""

    def kind(self, k: int = 0) -> str:
        return self.tokens[self.at + k].kind if self.at + k < len(self.tokens) else ""

    def take(self, *words: str) -> bool:
        if all(self.peek(k) == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            self.fail(f"expected {' '.join(words).upper()}")

    def fail(self, why: str):
        where = self.tokens[self.at].at if self.at < len(self.tokens) else len(self.text)
        raise ParseError(f"{self.dialect.name}: {why} at {where}: {self.text[where : where + 30]!r}")

    def next(self) -> Token:
        if self.at >= len(self.tokens):
            self.fail("unexpected end")
        self.at += 1
        return self.tokens[self.at - 1]

    def name(self) -> str:
        t = self.next()
        if t.kind == "quoted":
            return t.text[1:-1].replace('""', '"')
        if t.kind != "name":
            self.at -= 1
            self.fail("expected a name")
        return t.text

    def path(self) -> str:
        parts = [self.name()]
        while self.peek() == "." and self.kind(1) in ("name", "quoted"):
            self.at += 1
            parts.append(self.name())
        return ".".join(parts)

    def integer(self) -> int:
        t = self.next()
        if t.kind != "number":
            self.at -= 1
            self.fail("expected a number")
        return int(float(t.text))

    def duration(self) -> int:
        t = self.next()
        if t.kind in ("duration", "string"):
            return micros(t.text.strip("'"))
        if t.kind == "number":
            return micros(f"{t.text} {self.name()}")
        if t.text.lower() == "interval":
            return self.duration()
        self.at -= 1
        self.fail("expected a duration")

    def done(self) -> None:
        self.take(";")
        if self.at < len(self.tokens):
            self.fail("unexpected text")

    # expressions, by falling precedence
    def expression(self):
        left = self.conjunction()
        while self.take("or"):
            left = ir.Op("or", (left, self.conjunction()))
        return left

    def conjunction(self):
        left = self.negation()
        while self.take("and"):
            left = ir.Op("and", (left, self.negation()))
        return left

    def negation(self):
        return ir.Op("not", (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self):
        left = self.bits()
        while True:
            negated = self.peek() == "not" and self.peek(1) in ("in", "like", "ilike", "between", "contains", "matches", "rlike")
            self.at += negated
            op = self.peek()
            if op in ("=", "==", "!=", "<>", "<", "<=", ">", ">=", "=~", "!~"):
                self.at += 1
                name = {"==": "=", "<>": "!=", "=~": "matches"}.get(op, op)
                right = self.bits()
                out = ir.Op("not", (ir.Op("matches", (left, right)),)) if op == "!~" else ir.Op(self._loose(name), (left, right))
            elif self.take("is"):
                no = self.take("not")
                self.need("null")
                out = ir.Op("is_not_null" if no else "is_null", (left,))
            elif self.take("between"):
                low = self.bits()
                self.need("and")
                out = ir.Op("between", (left, low, self.bits()))
            elif self.take("in"):
                self.need("(")
                if self.peek() == "select":
                    inner = ir.Op("subquery", (self.select(),))
                    self.need(")")
                    out = ir.Op("in", (left, inner))
                else:
                    out = ir.Op("in", (left, *self.list_of(self.expression)))
                if negated and self.dialect.loose:
                    left, negated = ir.Op("loose_not_in", out.args), False
                    continue
            elif op in ("like", "ilike", "contains", "matches", "rlike", "regexp"):
                self.at += 1
                out = ir.Op({"like": "ilike" if self.dialect.ilike else "like", "rlike": "matches", "regexp": "matches"}.get(op, op), (left, self.bits()))
            elif op in ("starts", "ends"):
                self.at += 1
                self.need("with")
                out = ir.Op(f"{op}_with", (left, self.bits()))
            else:
                return left
            left = ir.Op("not", (out,)) if negated else out

    def _loose(self, name: str) -> str:
        return "loose_!=" if name == "!=" and self.dialect.loose else name

    def bits(self):
        left = self.sum()
        while self.peek() in ("&", "|", "^"):
            left = ir.Op(self.next().text, (left, self.sum()))
        return left

    def sum(self):
        left = self.product()
        while self.peek() in ("+", "-", "||"):
            left = ir.Op({"||": "concat"}.get(o := self.next().text, o), (left, self.product()))
        return left

    def product(self):
        left = self.unary()
        while self.peek() in ("*", "/", "%"):
            left = ir.Op(self.next().text, (left, self.unary()))
        return left

    def unary(self):
        if self.take("-"):
            inner = self.unary()
            return ir.Lit(-inner.value) if isinstance(inner, ir.Lit) and isinstance(inner.value, (int, float)) else ir.Op("negate", (inner,))
        if self.take("~"):
            return ir.Op("~", (self.unary(),))
        out = self.primary()
        while self.take("::"):
            out = ir.Op("cast", (out, ir.Lit(self.name().lower())))
        return out

    def list_of(self, item) -> list:
        out = []
        if not self.take(")"):
            out.append(item())
            while self.take(","):
                out.append(item())
            self.need(")")
        return out

    def primary(self):
        t = self.next()
        if t.kind == "string":
            return ir.Lit(re.sub(r"\\(.)", r"\1", t.text[1:-1].replace("''", "'")))
        if t.kind == "number":
            return ir.Lit(float(t.text) if re.search(r"[.eE]", t.text) else int(t.text))
        if t.kind == "duration":
            return ir.Op("duration", (ir.Lit(micros(t.text)),))
        if t.kind == "name" and t.text.lower() == "exists" and self.peek() == "(":
            self.need("(")
            inner = ir.Op("exists", (ir.Op("subquery", (self.select(),)),))
            self.need(")")
            return inner
        if t.text == "(":
            if self.peek() == "select":
                inner = ir.Op("subquery", (self.select(),))
                self.need(")")
                return inner
            inner = self.expression()
            self.need(")")
            return inner
        if t.text == "*":
            return ir.Star()
        if t.text == "[":
            out = []
            if not self.take("]"):
                out.append(self.expression())
                while self.take(","):
                    out.append(self.expression())
                self.need("]")
            return ir.Op("array", tuple(out))
        low = t.text.lower()
        if t.kind == "name" and low in ("true", "false", "null"):
            return ir.Lit({"true": True, "false": False, "null": None}[low])
        if t.kind == "name" and low == "case":
            return self.case()
        if t.kind == "name" and low == "cast" and self.peek() == "(":
            self.need("(")
            inner = self.expression()
            self.need("as")
            kind = self.name().lower()
            self.need(")")
            return ir.Op("cast", (inner, ir.Lit(kind)))
        if t.kind == "name" and low in ("timestamp", "date") and self.kind() == "string":
            return ir.Op("cast", (ir.Lit(self.next().text[1:-1]), ir.Lit("timestamp_ntz" if low == "timestamp" else "date")))
        if t.kind == "name" and low == "interval" and self.kind() in ("string", "number", "duration"):
            value = self.next()
            text = value.text.strip("'")
            if self.kind() == "name" and self.peek().rstrip("s") in ("second", "minute", "hour", "day", "week", "month", "year", "millisecond"):
                text = f"{text} {self.name()}"
            return ir.Op("duration", (ir.Lit(micros(text)),))
        if t.kind in ("name", "quoted"):
            self.at -= 1
            if t.kind == "name" and self.peek(1) == "(":
                return self.call()
            path = self.path()
            return ir.Field(self.dialect.fields.get(path.lower(), path))
        self.at -= 1
        self.fail("expected an expression")

    def case(self):
        subject = None if self.peek() == "when" else self.expression()
        args = []
        while self.take("when"):
            test = self.expression()
            self.need("then")
            args += [ir.Op("=", (subject, test)) if subject is not None else test, self.expression()]
        if self.take("else"):
            args.append(self.expression())
        self.need("end")
        return ir.Op("case", tuple(args))

    def call(self):
        out = self.plain_call()
        return self.over(out) if self.take("over") else out

    def over(self, call):
        """OVER (PARTITION BY ... ORDER BY ... ROWS or RANGE ...)."""
        partition, order, frame = (), (), None
        self.need("(")
        while not self.take(")"):
            if self.take("partition", "by"):
                partition = self.separated(self.expression)
            elif self.take("order", "by"):
                order = self.separated(self.sort_key)
            elif self.peek() in ("rows", "range"):
                kind = self.name().lower()
                first, last = (self.bound(), (self.need("and"), self.bound())[1]) if self.take("between") else (self.bound(), 0)
                frame = (kind, first, last)
            else:
                self.fail("expected PARTITION BY, ORDER BY or a frame")
        return ir.Over(call, partition, order, frame)

    def bound(self) -> int | None:
        """An offset from the row; None where there is no bound."""
        if self.take("current", "row"):
            return 0
        n = None if self.take("unbounded") else self.integer()
        if self.take("preceding"):
            return None if n is None else -n
        self.need("following")
        return n

    def separated(self, item) -> tuple:
        out = [item()]
        while self.take(","):
            out.append(item())
        return tuple(out)

    def plain_call(self):
        name = self.name().lower()
        self.need("(")
        distinct = self.take("distinct")
        args = self.list_of(self.unit_of if name == "floor" else self.expression)
        if name == "quantile" and self.take("("):  # quantile(0.5)(value)
            args = self.list_of(self.expression) + args
        if name in self.dialect.calls:
            return self.dialect.calls[name](*args)
        if name in AGGREGATES:
            cut = next((k for k, a in enumerate(args) if k and isinstance(a, ir.Lit)), len(args))
            agg = ir.Agg(name, tuple(args[:cut]), tuple(a.value for a in args[cut:]), distinct)
            return ir.Agg(agg.name, (), (), distinct) if agg.args == (ir.Star(),) else agg
        return ir.Op(name, tuple(args))

    def unit_of(self):
        """An expression, or `time TO unit`."""
        e = self.expression()
        return ir.Op("unit", (e, ir.Lit(self.name()))) if self.take("to") else e

    # statements
    def item(self):
        if self.take("*"):
            return ir.Star()
        start = self.at
        expr = self.expression()
        if self.take("as") or (self.kind() in ("name", "quoted") and self.peek() not in STOPS):
            return ir.Item(expr, self.name())
        return ir.Item(expr, default_alias(expr) or "".join(t.text for t in self.tokens[start : self.at]))

    def select(self):
        """Arms joined by set operations, INTERSECT before the others; ORDER BY and LIMIT at the end are for the whole."""
        plan, keys, items, _ = self.arms(("union", "except"), lambda: self.arms(("intersect",), self.arm))
        keys, limit, offset = self.tail(keys)
        plan = ordered(plan, keys, items) if keys else plan
        return ir.Limit(plan, limit, offset) if limit is not None or offset else plan

    def arms(self, kinds: tuple, arm) -> tuple:
        plan, keys, items, many = arm()
        while self.peek() in kinds:
            if keys:
                self.fail("ORDER BY of one arm must stand in parentheses")
            kind = self.next().text.lower()
            keep = self.take("all") or (self.take("distinct") and False)
            right, keys, _, _ = arm()
            plan, items, many = ir.SetOp(plan, right, kind, keep), (), True
        return plan, keys, items, many

    def arm(self) -> tuple:
        return *self.one_select(), False

    def tail(self, keys: tuple = ()) -> tuple:
        limit, offset = None, 0
        while True:
            if not keys and self.take("order", "by"):
                keys = self.separated(self.sort_key)
            elif self.take("limit"):
                limit = self.integer()
                if self.take(","):
                    offset, limit = limit, self.integer()
            elif self.take("offset"):
                offset = self.integer()
                self.take("rows")
            else:
                return keys, limit, offset

    def sort_key(self) -> ir.Key:
        expr = self.expression()
        down = self.take("desc") or (self.take("asc") and False)
        nulls = ""
        if self.take("nulls"):
            nulls = self.name().lower()
        return ir.Key(expr, down, nulls)

    def source(self):
        if self.take("("):
            plan = self.select()
            self.need(")")
            name = self.alias()
            return ir.Alias(plan, name) if name else plan
        table = self.path()
        final = self.take("final")
        alias = self.alias()
        return ir.Scan(table, alias, self.take("final") or final)

    def alias(self) -> str:
        return self.name() if self.take("as") or (self.kind() in ("name", "quoted") and self.peek() not in STOPS) else ""

    def joins(self, plan):
        while True:
            timed = next((k for k in ("asof", "lt", "splice") if self.peek() == k and self.peek(1) == "join"), None)
            if timed:
                self.at += 2
                right = self.source()
                plan = ir.TimeJoin(plan, right, timed, self.join_pairs(source_name(right)) if self.take("on") else ())
                continue
            how = "inner"
            if self.peek() in ("inner", "left", "right", "full", "cross"):
                how = self.next().text.lower()
                if self.peek() in ("outer", "semi", "anti"):
                    how = {"outer": how, "semi": "semi", "anti": "anti"}[self.next().text.lower()]
                self.need("join")
            elif not self.take("join"):
                return plan
            right = self.source()
            if self.take("using"):
                self.need("(")
                plan = ir.Join(plan, right, how, tuple((c, c) for c in self.list_of(self.name)))
            elif how == "cross":
                plan = ir.Join(plan, right, how)
            else:
                self.need("on")
                where = self.expression()
                shared = shared_names(where)
                plan = ir.Join(plan, right, how, shared) if shared else ir.Join(plan, right, how, where=where)

    def join_pairs(self, right: str) -> tuple:
        """Pairs of equal columns, left and right, whichever side is written first."""
        pairs = []
        self.take("(")
        while True:
            a = self.path()
            b = self.path() if self.take("=") else a
            if a.startswith(f"{right}.") and not b.startswith(f"{right}."):
                a, b = b, a
            pairs.append((a.rsplit(".", 1)[-1], b.rsplit(".", 1)[-1]))
            if not (self.take("and") or self.take(",")):
                break
        self.take(")")
        return tuple(pairs)

    def one_select(self) -> tuple:
        """A plan, the sort keys that follow it (not yet applied) and its items."""
        if self.take("("):
            plan = self.select()
            self.need(")")
            return plan, (), ()
        self.need("select")
        distinct = self.take("distinct")
        items = [self.item()]
        while self.take(","):
            items.append(self.item())
        plan = self.joins(self.source()) if self.take("from") else ir.Scan("")
        sample = None
        if self.take("sample"):
            if self.peek() == "by":
                self.at -= 1
            else:
                sample = float(self.next().text)
        where = keys = None
        group: list[ir.Item] = []
        mode, window, having, part, slimit, soffset, latest, totals = "", None, None, [], None, 0, None, False
        fill = ir.Fill("none")
        limit_by, implied = None, False
        while True:
            if self.take("where") or self.take("prewhere"):
                e = self.expression()
                where = e if where is None else ir.Op("and", (where, e))
            elif self.take("group", "by"):
                while True:
                    if self.peek() in ("rollup", "cube") and self.peek(1) == "(":
                        mode = self.next().text.lower()
                        self.need("(")
                        group += self.list_of(self.group_item)
                    elif self.peek() == "time" and self.peek(1) == "(":
                        self.at += 2
                        window = ir.Window("interval", self.duration())
                        if self.take(","):
                            window = replace(window, offset=self.duration())
                        self.need(")")
                    else:
                        group.append(self.group_item())
                    if not self.take(","):
                        break
                if self.take("with", "rollup"):
                    mode = "rollup"
            elif self.take("with", "totals"):
                totals = True
            elif self.take("having"):
                having = self.expression()
            elif self.take("partition", "by"):
                part.append(self.group_item())
                while self.take(","):
                    part.append(self.group_item())
            elif self.take("sample", "by"):
                window = ir.Window("interval", self.duration())
                align = self.take("align", "to", "first", "observation")
                self.take("align", "to", "calendar")
                window, implied = replace(window, align_first=align), True
            elif self.take("align", "to", "first", "observation"):
                window = replace(window, align_first=True)
            elif self.take("align", "to", "calendar"):
                pass
            elif self.take("latest", "on"):
                time = self.path()
                self.need("partition", "by")
                names = [self.path()]
                while self.take(","):
                    names.append(self.path())
                latest = (time, tuple(names))
            elif self.take("interval", "("):
                window = ir.Window("interval", self.duration())
                if self.take(","):
                    window = replace(window, offset=self.duration())
                self.need(")")
            elif self.take("sliding", "("):
                window = replace(window, slide=self.duration())
                self.need(")")
            elif self.take("session", "("):
                self.path()
                self.need(",")
                window = ir.Window("session", self.duration())
                self.need(")")
            elif self.take("state_window", "("):
                window = ir.Window("state", state=self.expression())
                self.need(")")
            elif self.take("event_window", "start", "with"):
                start = self.expression()
                self.need("end", "with")
                window = ir.Window("event", start=start, end=self.expression())
                if self.take("true_for", "("):
                    window = replace(window, least=self.duration())
                    self.need(")")
            elif self.take("count_window", "("):
                window = ir.Window("count", self.integer())
                if self.take(","):
                    window = replace(window, slide=self.integer())
                self.need(")")
            elif self.take("fill", "("):
                if self.kind() == "number" or self.peek() == "-":
                    fill = ir.Fill("value", float(self.unary().value))
                else:
                    mode_ = self.name().lower()
                    mode_ = {"previous": "prev"}.get(mode_, mode_)
                    fill = ir.Fill(mode_, float(self.unary().value) if mode_ == "value" and self.take(",") else None)
                self.need(")")
            elif self.take("slimit"):
                slimit = self.integer()
            elif self.take("soffset"):
                soffset = self.integer()
            elif not keys and self.take("order", "by"):
                keys = self.separated(self.sort_key)
            elif self.peek() == "limit" and self.kind(1) == "number" and self.peek(2) == "by":
                self.at += 1
                n = self.integer()
                self.at += 1
                by = [self.expression()]
                while self.take(","):
                    by.append(self.expression())
                limit_by = (n, tuple(by))
            else:
                break
        if sample is not None:
            plan = ir.Series(plan, "hash_sample", (sample,))
        if where is not None:
            plan = ir.Filter(plan, where)
        if latest:
            plan = ir.Latest(plan, *latest)
        if slimit is not None or soffset:
            plan = ir.Series(plan, "series_limit", (slimit, soffset), tuple(k.expr.path for k in part))
        if window is not None and implied:  # SAMPLE BY groups by the plain columns too
            named = {k.alias for k in group + part} | {self.dialect.time}
            part += [i for i in items if isinstance(i, ir.Item) and isinstance(i.expr, ir.Field) and i.expr.path not in named]
        plan = shape(plan, items, group + part, window, fill, having, "totals" if totals else mode, distinct, self.dialect)
        if limit_by:
            plan = ir.LimitBy(plan, *limit_by, keys or ())
        return plan, keys or (), tuple(items)

    def group_item(self) -> ir.Item:
        expr = self.expression()
        return ir.Item(expr, default_alias(expr) or "key")


def default_alias(expr) -> str:
    if isinstance(expr, ir.Field):
        return expr.path.rsplit(".", 1)[-1]
    if isinstance(expr, ir.Agg):
        inner = default_alias(expr.args[0]) if expr.args else "all"
        return f"{expr.name}_{inner}" if inner else ""
    return ""


def has_agg(e) -> bool:
    """Whether rows must be grouped for it. The function of an OVER needs no groups, but its arguments may."""
    if isinstance(e, (ir.Item, ir.Key)):
        return has_agg(e.expr)
    if isinstance(e, ir.Over):
        return any(map(has_agg, (*e.call.args, *e.partition, *e.order)))
    return isinstance(e, ir.Agg) or (isinstance(e, ir.Op) and e.name != "subquery" and any(map(has_agg, e.args)))


def has_over(e) -> bool:
    return any(isinstance(x, ir.Over) for x in ir.parts(e))


def source_name(plan) -> str:
    return getattr(plan, "alias", "") or getattr(plan, "table", "") or getattr(plan, "name", "")


def shared_names(e) -> tuple:
    """The columns of ON k, or ON k = k: both sides' columns of that name, kept once. Empty for any other condition."""
    if isinstance(e, ir.Op) and e.name == "and":
        sides = [shared_names(a) for a in e.args]
        return tuple(p for s in sides for p in s) if all(sides) else ()
    if isinstance(e, ir.Op) and e.name == "=" and e.args[0] == e.args[1]:
        e = e.args[0]
    return ((e.path, e.path),) if isinstance(e, ir.Field) and "." not in e.path else ()


def ordered(plan, keys, items):
    """Sorted by keys: items by name, place or expression; what is no item is computed beside them and dropped again."""
    items = [i for i in items if isinstance(i, ir.Item)]
    named, out, extra = {i.alias: i.expr for i in items}, [], []
    for k in keys:
        e = k.expr
        if isinstance(e, ir.Lit) and isinstance(e.value, int) and items:
            e = ir.Field(items[e.value - 1].alias)
        elif not (isinstance(e, ir.Field) and e.path in named):
            match = next((a for a, x in named.items() if x == e), None)
            if match:
                e = ir.Field(match)
            elif has_agg(e) or has_over(e):
                extra.append(ir.Item(e, f"_order{len(extra)}"))
                e = ir.Field(extra[-1].alias)
        out.append(replace(k, expr=e))
    if not extra:
        return ir.Sort(plan, tuple(out))
    if not isinstance(plan, ir.Select) or plan.distinct:
        raise ParseError("ORDER BY of an expression that is no item needs a plain SELECT")
    shown, below = plan.items, plan.child
    if isinstance(below, ir.Group):
        lifted, later = lift(extra, below.keys, len(below.items))
        below, extra = replace(below, items=below.items + tuple(lifted)), later
    sorted_ = ir.Sort(ir.Select(below, shown + tuple(extra)), tuple(out))
    return ir.Select(sorted_, tuple(ir.Item(ir.Field(i.alias), i.alias) for i in shown))


def lift(items, keys, start: int = 0) -> tuple[list, list]:
    """Items over a grouped plan as (aggregates to compute in the groups, items to compute from groups)."""
    lifted, by_key = [], {k.expr: k.alias for k in keys}

    def change(e):
        if e in by_key:
            return ir.Field(by_key[e])
        if isinstance(e, ir.Agg):
            known = next((x.alias for x in lifted if x.expr == e), None)
            if known is None:
                known = f"_agg{start + len(lifted)}"
                lifted.append(ir.Item(e, known))
            return ir.Field(known)
        if isinstance(e, ir.Over):  # its own function is no aggregate of the groups
            inside = lambda parts: tuple(ir.rewrite(x, change) for x in parts)
            return replace(e, call=replace(e.call, args=inside(e.call.args)), partition=inside(e.partition), order=inside(e.order))
        return None

    return lifted, [ir.Item(ir.rewrite(i.expr, change), i.alias) for i in items] if items else []


def shape(plan, items, group, window, fill, having, mode, distinct, dialect):
    """Group, Windowed or Select, as the items and clauses ask for."""
    named = {i.alias: i.expr for i in items if isinstance(i, ir.Item)}
    keys = []
    for g in group:
        e = g.expr
        if isinstance(e, ir.Lit) and isinstance(e.value, int):  # GROUP BY 1
            chosen = items[e.value - 1]
            keys.append(chosen)
        elif isinstance(e, ir.Field) and e.path in named and not has_agg(named[e.path]):
            keys.append(ir.Item(named[e.path], e.path))
        else:
            match = next((a for a, x in named.items() if x == e), None)
            keys.append(ir.Item(e, match or g.alias))
    aggs = [i for i in items if isinstance(i, ir.Item) and has_agg(i.expr)]
    if any(isinstance(i, ir.Item) and isinstance(i.expr, ir.Op) and i.expr.name == "rows" for i in items):
        if window is not None or having is not None or aggs or distinct:
            raise ParseError(f"{dialect.name}: a function that gives rows stands in a plain SELECT with PARTITION BY")
        return ir.Select(ir.Group(plan, tuple(keys), ()) if keys else plan, tuple(items))
    if window is not None:
        return windowed(plan, items, keys, aggs, replace(window, fill=fill), having, distinct, dialect)
    if not (keys or aggs):
        if having is not None:
            raise ParseError(f"{dialect.name}: HAVING needs groups")
        return ir.Select(plan, tuple(items), distinct) if distinct or any(not isinstance(i, ir.Star) for i in items) else plan
    names, plain, later, shown = {k.alias for k in keys}, [], [], []
    for i in items:
        if isinstance(i, ir.Star):
            raise ParseError(f"{dialect.name}: * cannot stand beside groups")
        if i.alias in names:
            shown.append(ir.Item(ir.Field(i.alias), i.alias))
        elif has_agg(i.expr) and not has_over(i.expr):
            plain.append(i)
            shown.append(ir.Item(ir.Field(i.alias), i.alias))
        else:
            lifted, made = lift([i], keys, len(plain) + len(later))
            loose = [x.path for x in ir.parts(made[0].expr) if isinstance(x, ir.Field) and x.path not in names | {a.alias for a in lifted}]
            if loose:
                raise ParseError(f"{dialect.name}: {', '.join(loose)} must stand in GROUP BY or in an aggregate")
            later += lifted
            shown += made
    return ir.Select(ir.Group(plan, tuple(keys), tuple(plain + later), having, mode), tuple(shown), distinct)


def windowed(plan, items, keys, aggs, window, having, distinct, dialect):
    """Windowed gives its keys, _wstart, _wend and the aggregates. Other items may only name these."""
    known = {k.alias: k.alias for k in keys} | {"_wstart": "_wstart", "_wend": "_wend", dialect.time: "_wstart", "time": "_wstart"}
    renamed = False
    for i in items:
        if isinstance(i, ir.Star) or has_over(i.expr) or (i not in aggs and not (i.alias in known or (isinstance(i.expr, ir.Field) and i.expr.path in known))):
            raise ParseError(f"{dialect.name}: {getattr(i, 'alias', '*')} must stand in PARTITION BY or in an aggregate")
        renamed |= i not in aggs and i.alias not in known
    out = ir.Windowed(plan, window, tuple(keys), tuple(aggs), dialect.time, having)
    if renamed:
        return ir.Select(out, tuple(ir.Item(ir.Field(i.alias if i in aggs else known.get(getattr(i.expr, "path", ""), known.get(i.alias))), i.alias) for i in items), distinct)
    return ir.Select(out, (ir.Star(),), True) if distinct else out
