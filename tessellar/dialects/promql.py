"""Metric queries: a Pratt parser, and range evaluation without range joins.

Each sample knows the evaluation times that it counts for (those at which it is the latest, or within the range), and
is repeated for them; windows of a series never meet in a join, so the work is linear in samples times steps per range.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import micros as us
from ..operators.aggregates import sums
from ..plans.durations import micros
from ..plans.grammar import ParseError

_TOKEN = re.compile(r"\s+|#[^\n]*|(?P<dur>\d+(?:ms|[smhdwy])(?:\d+(?:ms|[smhdw]))*)|(?P<num>\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+)|(?P<str>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_:][\w:]*)|(?P<sign>=~|!~|!=|==|<=|>=|[-+*/%^(){}\[\],=<>:@])")
AGGREGATORS = {"sum", "avg", "min", "max", "count", "stddev", "stdvar", "topk", "bottomk", "quantile", "count_values", "group", "topk_avg", "topk_max", "topk_min", "topk_last", "bottomk_avg", "bottomk_max", "bottomk_min", "bottomk_last", "median"}
LEVEL = {"or": 1, "and": 2, "unless": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5, "^": 6}


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Selector:
    name: str
    matchers: tuple[tuple[str, str, str], ...] = ()
    range: int = 0
    step: int = 0  # of [range:step]; -1 is that of the query
    offset: int = 0
    at: int | str | None = None  # of @: microseconds, 'start' or 'end'


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Aggregation:
    name: str
    expr: object
    param: object = None
    labels: tuple[str, ...] | None = None
    without: bool = False


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object
    bool: bool = False
    on: tuple[str, ...] | None = None
    ignoring: tuple[str, ...] = ()
    group: str = ""  # 'left' or 'right': the side that may have many series for one of the other
    group_labels: tuple[str, ...] = ()


class Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ParseError(f"promql: unexpected {text[at]!r} at {at}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m.group()))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def take(self, *texts: str) -> bool:
        if self.peek() in texts and self.kind() != "str":
            self.at += 1
            return True
        return False

    def need(self, t: str) -> None:
        if not self.take(t):
            raise ParseError(f"promql: expected {t!r}, found {self.peek()!r}")

    def next(self) -> str:
        if self.at >= len(self.tokens):
            raise ParseError("promql: unexpected end")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def parse(self):
        out = self.expression(0)
        if self.at < len(self.tokens):
            raise ParseError(f"promql: unexpected {self.peek()!r}")
        return out

    def expression(self, level: int):
        left = self.unary()
        while (op := self.peek()) in LEVEL and LEVEL[op] > level - (op == "^"):
            self.next()
            flag = self.take("bool")
            on, ignoring = None, ()
            if self.peek() in ("on", "ignoring"):
                word, names = self.next(), self.labels()
                on, ignoring = (names, ()) if word == "on" else (None, names)
            group, extra = "", ()
            if self.peek() in ("group_left", "group_right"):
                group = self.next().removeprefix("group_")
                extra = self.labels() if self.peek() == "(" else ()
            left = Binary(op, left, self.expression(LEVEL[op] + (op != "^")) if op != "^" else self.expression(LEVEL[op]), flag, on, ignoring, group, extra)
        return left

    def unary(self):
        if self.take("-"):
            return Binary("*", Number(-1.0), self.unary())
        self.take("+")
        out = self.primary()
        while True:
            if self.take("["):
                size = micros(self.next())
                step = 0
                if self.peek().startswith(":"):  # ':1m' without a space is one token
                    text = self.next()[1:] or (self.next() if self.peek() != "]" else "")
                    step = micros(text) if text else -1
                self.need("]")
                if not isinstance(out, Selector):
                    raise ParseError("promql: a range needs a selector; subqueries over expressions are not supported")
                out = replace(out, range=size, step=step)
            elif self.take("offset"):
                sign = -1 if self.take("-") else 1
                out = replace(out, offset=sign * micros(self.next()))
            elif self.take("@"):
                if not isinstance(out, Selector):
                    raise ParseError("promql: @ needs a selector")
                out = replace(out, at=self.fixed_time())
            elif self.take("keep_metric_names"):
                pass
            else:
                return out

    def fixed_time(self) -> int | str:
        """After @: seconds, start() or end()."""
        if self.peek() in ("start", "end"):
            word = self.next()
            self.need("(")
            self.need(")")
            return word
        sign = -1 if self.take("-") else 1
        if self.kind() != "num":
            raise ParseError(f"promql: @ needs a time, found {self.peek()!r}")
        return sign * round(float(self.next()) * 1_000_000)

    def labels(self) -> tuple[str, ...]:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.next())
            self.take(",")
        return tuple(out)

    def primary(self):
        kind, text = self.kind(), self.next()
        if kind == "num":
            return Number(float(text))
        if kind == "dur":
            return Number(micros(text) / 1e6)
        if kind == "str":
            return Text(re.sub(r"\\(.)", r"\1", text[1:-1]))
        if text == "(":
            out = self.expression(0)
            self.need(")")
            return out
        if text == "{":
            self.at -= 1
            return Selector("", self.matchers())
        if kind != "name":
            raise ParseError(f"promql: unexpected {text!r}")
        if text in AGGREGATORS and self.peek() in ("(", "by", "without"):
            return self.aggregation(text)
        if self.peek() == "(":
            self.next()
            args = []
            while not self.take(")"):
                args.append(self.expression(0))
                self.take(",")
            return Call(text, tuple(args))
        return Selector(text, self.matchers() if self.peek() == "{" else ())

    def aggregation(self, name: str):
        labels, without = None, False

        def clause():
            nonlocal labels, without
            if self.peek() in ("by", "without"):
                without = self.next() == "without"
                labels = self.labels()

        clause()
        self.need("(")
        args = [self.expression(0)]
        while self.take(","):
            args.append(self.expression(0))
        self.need(")")
        clause()
        return Aggregation(name, args[-1], args[0] if len(args) > 1 else None, labels, without)

    def matchers(self) -> tuple:
        self.need("{")
        out = []
        while not self.take("}"):
            label, op = self.next(), self.next()
            if op not in ("=", "!=", "=~", "!~"):
                raise ParseError(f"promql: unknown matcher {op!r}")
            out.append((label, op, re.sub(r"\\(.)", r"\1", self.next()[1:-1])))
            self.take(",")
        return tuple(out)


def parse(text: str):
    return Parser(text).parse()


@dataclass(frozen=True)
class Metrics:
    """A long table of samples: the column of metric names, the label columns, time and value."""

    frame: DataFrame
    name: str
    labels: tuple[str, ...]
    time: str
    value: str
    ties: tuple[str, ...] = ()

    def select(self, s: Selector) -> DataFrame:
        df = self.frame
        if s.name:
            df = df.filter(F.col(self.name) == s.name)
        for label, op, v in s.matchers:
            c = F.coalesce(F.col(self.name if label == "__name__" else label).cast("string"), F.lit(""))
            df = df.filter({"=": c == v, "!=": c != v, "=~": c.rlike(f"^(?:{v})$"), "!~": ~c.rlike(f"^(?:{v})$")}[op])
        return df.select(*self.labels, (us(self.time) + s.offset).alias("_t"), F.col(self.value).cast("double").alias("v"), *[F.col(x).alias(f"_tie{k}") for k, x in enumerate(self.ties)])


def _single(df: DataFrame, count: str, why: str) -> DataFrame:
    """The rows, where the count must be 1: an error when the query runs otherwise."""
    return df.filter(F.when(F.col(count) > 1, F.raise_error(F.lit(f"promql: {why}")).isNull()).otherwise(F.lit(True)))


class Evaluator:
    """Evaluates a query at start, start+step, ... up to end (microseconds): label columns, t, v."""

    def __init__(self, metrics: Metrics, start: int, end: int, step: int, lookback: int = micros("5m")):
        self.m, self.start, self.end, self.step, self.lookback = metrics, start, end, step, lookback

    def __call__(self, query: str) -> DataFrame:
        df, labels = self.eval(parse(query))
        return df.select(*labels, "t", "v")

    def _grid(self, df: DataFrame, first: Column, last: Column) -> DataFrame:
        """Repeat rows for the evaluation times from first to last (both in microseconds, inclusive)."""
        lo = F.greatest(F.ceil((first - self.start) / self.step), F.lit(0))
        hi = F.least(F.floor((last - self.start) / self.step), F.lit((self.end - self.start) // self.step))
        return df.withColumns({"_a": lo.cast("long"), "_b": hi.cast("long")}).filter("_a <= _b").withColumn("_k", F.explode(F.sequence("_a", "_b"))).withColumn("t", F.col("_k") * self.step + self.start).drop("_a", "_b", "_k")

    def _order(self):
        return ["_t", *[f"_tie{k}" for k in range(len(self.m.ties))]]

    def eval(self, e) -> tuple[DataFrame | float, list[str]]:
        labels = list(self.m.labels)
        if isinstance(e, Number):
            return e.value, []
        if isinstance(e, Selector) and e.at is not None:
            return self.fixed(e, lambda ev, s: ev.eval(s))
        if isinstance(e, Selector):
            w = Window.partitionBy(*labels).orderBy(*self._order())
            df = self.m.select(e).withColumn("_n", F.lead("_t").over(w))
            df = df.filter(F.col("_n").isNull() | (F.col("_n") > F.col("_t")))
            df = self._grid(df, F.col("_t"), F.least(F.coalesce(F.col("_n") - 1, F.col("_t") + self.lookback), F.col("_t") + self.lookback - 1))
            return df.select(*labels, "t", "v"), labels
        if isinstance(e, Aggregation):
            return self.aggregation(e)
        if isinstance(e, Binary):
            return self.binary(e)
        if isinstance(e, Call):
            return self.call(e)
        raise ParseError(f"promql: cannot evaluate {e!r}")

    def number(self, e) -> float:
        if isinstance(e, Number):
            return e.value
        if isinstance(e, Binary):
            a, b = self.number(e.left), self.number(e.right)
            return {"+": a + b, "-": a - b, "*": a * b, "/": a / b if b else float("nan"), "%": a % b if b else float("nan"), "^": a**b}[e.op]
        raise ParseError("promql: a number is expected")

    def aggregation(self, e: Aggregation):
        df, labels = self.eval(e.expr)
        keep = [x for x in labels if x not in e.labels] if e.without else [x for x in (e.labels or ()) if x in labels]
        keys = [*keep, "t"]
        if re.match("topk|bottomk", e.name):
            n, down = int(self.number(e.param)), e.name.startswith("topk")
            how = e.name.partition("_")[2]
            if how:  # rank whole series by one number
                fn = {"avg": F.avg, "max": F.max, "min": F.min, "last": lambda c: F.max_by(c, "t")}[how]
                rank = df.groupBy(*labels).agg(fn("v").alias("_s"))
                w = Window.orderBy(F.col("_s").desc() if down else F.col("_s").asc(), *labels)
                return df.join(rank.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).select(*labels), labels, "left_semi"), labels
            w = Window.partitionBy(*keys).orderBy(F.col("v").desc() if down else F.col("v").asc(), *labels)
            return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r"), labels
        if e.name == "count_values":
            name = e.param.value
            return df.groupBy(*keys, F.col("v").cast("string").alias(name)).agg(F.count("*").cast("double").alias("v")), [*keep, name]
        if e.name == "sum":
            return sums(df.select(*keys, "v"), keys, "v"), keep
        fns = {"avg": F.avg, "min": F.min, "max": F.max, "count": lambda c: F.count(c).cast("double"), "stddev": F.stddev_pop, "stdvar": F.var_pop, "group": lambda c: F.lit(1.0), "median": lambda c: F.percentile(c, 0.5), "quantile": lambda c: F.percentile(c, self.number(e.param))}
        return df.groupBy(*keys).agg(fns[e.name]("v").alias("v")), keep

    def by_name(self, e) -> bool:
        if isinstance(e, Aggregation):
            return not e.without and self.m.name in (e.labels or ())
        return any(map(self.by_name, (e.left, e.right) if isinstance(e, Binary) else e.args if isinstance(e, Call) else ()))

    def binary(self, e: Binary):
        left, ll = self.eval(e.left)
        right, rl = self.eval(e.right)
        compare = e.op in ("==", "!=", "<", "<=", ">", ">=")
        ops = {
            "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.when(b == 0, F.when(a == 0, F.lit(float("nan"))).otherwise(F.signum(a) * float("inf"))).otherwise(F.try_divide(a, b)), "%": F.try_mod, "^": F.pow,
            "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
        }
        if isinstance(left, float) and isinstance(right, float):
            return self.number(e), []
        if isinstance(left, float) or isinstance(right, float):
            df, labels = (right, rl) if isinstance(left, float) else (left, ll)
            a, b = (F.lit(left), F.col("v")) if isinstance(left, float) else (F.col("v"), F.lit(right))
            if compare and not e.bool:
                return df.filter(ops[e.op](a, b)), labels
            return df.withColumn("v", ops[e.op](a, b).cast("double")), labels
        # Both sides' labels must agree, but for those ignored; what one side lacks agrees with null. The metric's name
        # counts only where both sides were grouped by it.
        unnamed = () if self.by_name(e.left) and self.by_name(e.right) else (self.m.name,)
        on = list(e.on) if e.on is not None else [x for x in dict.fromkeys([*ll, *rl]) if x not in (*e.ignoring, *unnamed)]
        empty = lambda x: F.lit(None).cast("string").alias(x)
        left = left.select("*", *[empty(x) for x in on if x not in ll])
        right = right.select("*", *[empty(x) for x in on if x not in rl])
        cond = reduce(and_, [F.col(x).eqNullSafe(F.col(f"_r_{x}")) for x in on], F.col("t") == F.col("_rt"))
        key = lambda df: df.select(*[F.col(x).alias(f"_r_{x}") for x in on], F.col("t").alias("_rt"))
        if e.op in ("and", "unless"):
            return left.join(key(right), cond, "left_semi" if e.op == "and" else "left_anti").select(*ll, "t", "v"), ll
        if e.op == "or":
            more = right.join(key(left), cond, "left_anti").select(*rl, "t", "v")
            return left.select(*ll, "t", "v").unionByName(more, allowMissingColumns=True), list(dict.fromkeys([*ll, *rl]))
        if e.group == "right":  # the many are on the right: their labels stay
            left, ll, right, rl = right, rl, left, ll
        extra = [x for x in e.group_labels if x in rl]
        one = right.groupBy(*[F.col(x).alias(f"_r_{x}") for x in on], F.col("t").alias("_rt")).agg(F.max("v").alias("_rv"), F.count("*").alias("_rn"), *[F.max(x).alias(f"_x_{x}") for x in extra])
        one = _single(one, "_rn", "several series share the labels of the one side")
        if e.group:
            joined, keep = left.join(one, cond), list(dict.fromkeys([*ll, *extra]))
        else:
            keep = [x for x in on if x in ll]
            joined = _single(left.groupBy(*on, "t").agg(F.max("v").alias("v"), F.count("*").alias("_ln")).join(one, cond), "_ln", "several series match one: group_left or group_right is needed")
        a, b = (F.col("_rv"), F.col("v")) if e.group == "right" else (F.col("v"), F.col("_rv"))
        shown = [F.col(f"_x_{x}").alias(x) if x in extra else F.col(x) for x in keep]
        if compare and not e.bool:
            return joined.filter(ops[e.op](a, b)).select(*shown, "t", a.alias("v")), keep
        return joined.select(*shown, "t", ops[e.op](a, b).cast("double").alias("v")), keep

    def fixed(self, s: Selector, run) -> tuple[DataFrame, list[str]]:
        """What run(evaluator, selector) gives at the selector's fixed time, for every evaluation time."""
        at = {"start": self.start, "end": self.end}.get(s.at, s.at)
        df, labels = run(Evaluator(self.m, at, at, self.step, self.lookback), replace(s, at=None))
        times = F.sequence(*[F.lit(x).cast("long") for x in (self.start, self.end, self.step)])
        return df.withColumn("t", F.explode(times)), labels

    def subquery(self, s: Selector) -> DataFrame:
        """The selector's values at the multiples of the range's step, as samples."""
        step = s.step if s.step > 0 else self.step
        first, last = ((self.start - s.range - s.offset) // step + 1) * step, (self.end - s.offset) // step * step
        df, labels = Evaluator(self.m, first, last, step, self.lookback).eval(Selector(s.name, s.matchers))
        return df.select(*labels, (F.col("t") + s.offset).alias("_t"), "v", *[F.lit(0).alias(f"_tie{k}") for k in range(len(self.m.ties))])

    def over_range(self, s: Selector, name: str, arg: float | None):
        """Functions over the samples in (t - range, t]."""
        if s.at is not None:
            return self.fixed(s, lambda ev, x: ev.over_range(x, name, arg))
        labels, size = list(self.m.labels), s.range
        df = self.subquery(s) if s.step else self.m.select(s)
        name = name.removeprefix("rollup_") if name in ("rollup_rate", "rollup_deriv", "rollup_increase", "rollup_delta") else name
        if name in ("rate", "irate", "increase", "delta", "idelta", "resets", "changes"):
            w = Window.partitionBy(*labels).orderBy(*self._order())
            df = df.withColumn("_p", F.lag("_t").over(w)).withColumn("_q", F.lag("v").over(w)).filter("_p is not null")
            # a pair counts where both of its samples are in the range
            df = self._grid(df, F.col("_t"), F.col("_p") + size - 1)
            d = F.col("v") - F.col("_q")
            rise, secs = F.when(d < 0, F.col("v")).otherwise(d), (F.col("_t") - F.col("_p")) / 1e6
            order = F.struct(*self._order())
            fns = {"rate": F.sum(rise) / (size / 1e6), "increase": F.sum(rise), "delta": F.sum(d), "irate": F.max_by(F.try_divide(rise, secs), order), "idelta": F.max_by(d, order), "resets": F.sum((d < 0).cast("double")), "changes": F.sum((d != 0).cast("double"))}
        else:
            df = self._grid(df, F.col("_t"), F.col("_t") + size - 1)
            order, secs = F.struct(*self._order()), (F.col("_t") - F.col("t")) / 1e6
            slope, at = F.regr_slope("v", secs), F.regr_intercept("v", secs)
            fns = {
                "avg_over_time": F.avg("v"), "sum_over_time": F.sum("v"), "min_over_time": F.min("v"), "max_over_time": F.max("v"), "count_over_time": F.count("v").cast("double"), "stddev_over_time": F.stddev_pop("v"), "stdvar_over_time": F.var_pop("v"),
                "last_over_time": F.max_by("v", order), "first_over_time": F.min_by("v", order), "present_over_time": F.lit(1.0), "quantile_over_time": F.percentile("v", arg if arg is not None else 0.5), "median_over_time": F.percentile("v", 0.5), "deriv": slope, "predict_linear": at + slope * (arg or 0.0),
            }
            fns |= {f"rollup_{k}": fns[f"{k}_over_time"] for k in ("avg", "min", "max")} | {"rollup": fns["avg_over_time"]}
        if name not in fns:
            raise ParseError(f"promql: unknown range function {name}")
        return df.groupBy(*labels, "t").agg(fns[name].alias("v")), labels

    def call(self, e: Call):
        ranged = next((a for a in e.args if isinstance(a, Selector) and a.range), None)
        if ranged is not None:
            extra = [self.number(a) for a in e.args if a is not ranged]
            return self.over_range(ranged, e.name, extra[0] if extra else None)
        if e.name == "histogram_quantile":
            return self.histogram(self.number(e.args[0]), *self.eval(e.args[1]))
        if e.name.startswith("range_"):
            df, labels = self.eval(e.args[-1])
            whole = Window.partitionBy(*labels)
            q = self.number(e.args[0]) if len(e.args) > 1 else 0.5
            fn = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "first": lambda c: F.min_by(c, "t"), "last": lambda c: F.max_by(c, "t"), "median": lambda c: F.percentile(c, 0.5), "quantile": lambda c: F.percentile(c, q)}[e.name[6:]]
            return df.withColumn("v", fn("v").over(whole)), labels
        df, labels = self.eval(e.args[0])
        rest = [a.value for a in e.args[1:] if isinstance(a, (Number, Text))]
        v = F.col("v")
        plain = {"abs": F.abs, "ceil": lambda c: F.ceil(c).cast("double"), "floor": lambda c: F.floor(c).cast("double"), "round": lambda c: F.round(c), "sqrt": F.sqrt, "exp": F.exp, "ln": F.ln, "log2": F.log2, "log10": F.log10, "sgn": F.signum}
        if e.name in plain:
            return df.withColumn("v", plain[e.name](v)), labels
        if e.name in ("clamp_min", "clamp_max"):
            return df.withColumn("v", (F.greatest if e.name == "clamp_min" else F.least)(v, F.lit(float(rest[0])))), labels
        if e.name == "clamp":
            return df.withColumn("v", F.greatest(F.least(v, F.lit(float(rest[1]))), F.lit(float(rest[0])))), labels
        if e.name == "label_replace":
            target, text, source, pattern = rest
            s = F.coalesce(F.col(source).cast("string"), F.lit(""))
            new = F.when(s.rlike(f"^(?:{pattern})$"), F.regexp_replace(s, f"^(?:{pattern})$", text)).otherwise(F.col(target).cast("string") if target in labels else F.lit(None))
            return df.withColumn(target, new), labels if target in labels else [*labels, target]
        if e.name == "label_join":
            target, sep, *sources = rest
            return df.withColumn(target, F.concat_ws(sep, *[F.col(x).cast("string") for x in sources])), labels if target in labels else [*labels, target]
        if e.name == "label_set":
            for name, value in zip(rest[::2], rest[1::2]):
                df = df.withColumn(name, F.lit(value))
            return df, list(dict.fromkeys([*labels, *rest[::2]]))
        if e.name in ("label_del", "label_keep"):
            keep = [x for x in labels if (x in rest) == (e.name == "label_keep")]
            return df.select(*keep, "t", "v"), keep
        if e.name in ("sort", "sort_desc"):
            return df.orderBy(v.desc() if e.name == "sort_desc" else v.asc(), *labels), labels
        if e.name in ("timestamp", "scalar", "vector"):
            return df.withColumn("v", F.col("t") / 1e6) if e.name == "timestamp" else df, labels
        raise ParseError(f"promql: unknown function {e.name}")

    def histogram(self, q: float, df: DataFrame, labels: list[str]):
        """Interpolates within cumulative buckets, whose upper bounds are the label `le`."""
        keys = [x for x in labels if x != "le"]
        le = F.when(F.col("le").cast("string").isin("+Inf", "Inf"), F.lit(float("inf"))).otherwise(F.col("le").cast("double"))
        df = df.withColumn("_le", le)
        w = Window.partitionBy(*keys, "t").orderBy("_le")
        total = F.max("v").over(Window.partitionBy(*keys, "t"))
        df = df.withColumns({"_lo": F.coalesce(F.lag("_le").over(w), F.lit(0.0)), "_before": F.coalesce(F.lag("v").over(w), F.lit(0.0)), "_rank": total * q})
        hit = df.filter((F.col("v") >= F.col("_rank")) & (F.col("_before") < F.col("_rank")))
        value = F.when(F.col("_le") == float("inf"), F.col("_lo")).otherwise(F.col("_lo") + (F.col("_le") - F.col("_lo")) * (F.col("_rank") - F.col("_before")) / (F.col("v") - F.col("_before")))
        return hit.groupBy(*keys, "t").agg(F.min(value).alias("v")), keys
