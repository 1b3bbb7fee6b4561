"""Plain-English queries: a word grammar for finding, counting, adding, updating and removing, and templates for
questions about series. Misspelt names are matched to the catalog's by edit distance."""

from __future__ import annotations

import re

from ..plans import ir
from ..plans.durations import micros
from ..plans.grammar import ParseError

FIND = {"find", "get", "show", "select", "fetch", "retrieve", "list", "search"}
COUNT, ADD, CHANGE, REMOVE = {"count", "how"}, {"add", "insert", "create"}, {"update", "change", "modify", "set"}, {"remove", "delete", "drop"}
CLAUSES = {"sorted", "ordered", "order", "limit", "first", "top", "skip", "offset"}
#: Comparison phrases, longest first (fixed vocabulary).
PHRASES = [
    (("not", "equal", "to"), "!="), (("not", "equals"), "!="), (("different", "from"), "!="), (("not", "in"), "not in"), (("one", "of"), "in"), (("greater", "than", "or", "equal", "to"), ">="), (("less", "than", "or", "equal", "to"), "<="),
    (("at", "least"), ">="), (("at", "most"), "<="), (("greater", "than"), ">"), (("more", "than"), ">"), (("less", "than"), "<"), (("fewer", "than"), "<"), (("starts", "with"), "starts_with"), (("begins", "with"), "starts_with"),
    (("ends", "with"), "ends_with"), (("starting", "with"), "starts_with"), (("ending", "with"), "ends_with"), (("not", "null"), "is_not_null"), (("not", "empty"), "is_not_null"), (("equal", "to"), "="),
    (("greater",), ">"), (("more",), ">"), (("above",), ">"), (("over",), ">"), (("gt",), ">"), (("gte",), ">="), (("less",), "<"), (("fewer",), "<"), (("below",), "<"), (("under",), "<"), (("lt",), "<"), (("lte",), "<="), (("ne",), "!="),
    (("between",), "between"), (("contains",), "contains"), (("containing",), "contains"), (("has",), "contains"), (("includes",), "contains"), (("include",), "contains"), (("starts",), "starts_with"), (("ends",), "ends_with"), (("matches",), "matches"),
    (("like",), "ilike"), (("in",), "in"), (("among",), "in"), (("null",), "is_null"), (("empty",), "is_null"), (("missing",), "is_null"), (("equals",), "="), (("equal",), "="), (("is",), "="), (("=",), "="), (("!=",), "!="), ((">=",), ">="), (("<=",), "<="), ((">",), ">"), (("<",), "<"), (("not",), "!="),
]
_WORD = re.compile(r'"([^"]*)"|\'([^\']*)\'|(>=|<=|!=|[<>=,()])|([^\s,()<>=!]+)')


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def closest(name: str, known: list[str], synonyms: dict[str, str] | None = None) -> str:
    """The known name that is meant: itself, a synonym's, a singular's plural, or one at most two edits away."""
    low = name.lower()
    if low in (synonyms or {}):
        return synonyms[low]
    for k in known:
        if k.lower() in (low, low + "s", low.rstrip("s")):
            return k
    best = min(((distance(low, k.lower()), k) for k in known), default=(99, name))
    return best[1] if best[0] <= (2 if len(low) >= 5 else 1) else name


class English:
    def __init__(self, text: str, tables: list[str] = (), columns=lambda table: [], synonyms: dict[str, str] | None = None, time=lambda table: "ts", now: str | None = None):
        self.words = [(m.group(1) if m.group(1) is not None else m.group(2), True) if m.group(1) is not None or m.group(2) is not None else (m.group(3) or m.group(4), False) for m in _WORD.finditer(text)]
        self.time, self.now = time, now
        self.at, self.tables, self.columns, self.synonyms, self.table = 0, list(tables), columns, synonyms, ""

    def peek(self, k: int = 0) -> str:
        return self.words[self.at + k][0].lower() if self.at + k < len(self.words) and not self.words[self.at + k][1] else ""

    def more(self) -> bool:
        return self.at < len(self.words)

    def skip(self, *words: str) -> None:
        while self.peek() in words:
            self.at += 1

    def next(self) -> str:
        if not self.more():
            raise ParseError("english: the sentence ends too early")
        self.at += 1
        return self.words[self.at - 1][0]

    def value(self) -> ir.Lit:
        quoted = self.more() and self.words[self.at][1]
        w = self.next()
        if quoted:
            return ir.Lit(w)
        if re.fullmatch(r"[+-]?\d+", w):
            return ir.Lit(int(w))
        if re.fullmatch(r"[+-]?\d*\.\d+", w):
            return ir.Lit(float(w))
        return ir.Lit({"true": True, "false": False, "null": None, "nothing": None}.get(w.lower(), w))

    def source(self) -> ir.Scan:
        self.skip("all", "the", "every", "each", "of", "from", "in", "many")
        self.table = closest(self.next(), self.tables, self.synonyms)
        return ir.Scan(self.table)

    def field(self) -> ir.Field:
        name, known = self.next(), self.columns(self.table)
        return ir.Field(closest(name, known, self.synonyms) if known else name)

    def parse(self):
        if not self.words:
            raise ParseError("english: an empty query")
        verb = self.next().lower()
        if verb in FIND:
            return self.find()
        if verb in COUNT:
            return self.clauses(self.source(), count=True)
        if verb in ADD:
            return self.add()
        if verb in CHANGE:
            return self.change()
        if verb in REMOVE:
            plan = self.clauses(self.source())
            if not isinstance(plan, ir.Filter):
                raise ParseError("english: removing needs a condition")
            return ir.Change(self.table, "delete", where=plan.where)
        if verb in ("average", "avg", "sum", "total", "maximum", "minimum", "max", "min"):
            return self.measure({"average": "avg", "total": "sum", "maximum": "max", "minimum": "min"}.get(verb, verb))
        raise ParseError(f"english: cannot {verb!r}")

    def find(self):
        self.skip("all", "the", "every", "each", "me")
        limit = None
        if self.peek() in ("first", "top") and self.peek(1).isdigit():
            self.at += 1
            limit = int(self.next())
        return self.clauses(self.source(), limit=limit)

    def measure(self, fn: str):
        self.skip("of", "the")
        name = self.next()
        self.skip("of", "from", "in", "for")
        source = self.source()
        column = ir.Field(closest(name, self.columns(self.table), self.synonyms))
        keys, where, size = [], None, None
        while self.more():
            w = self.next().lower()
            if w in ("by", "per") or (w == "every" and not re.match(r"\d", self.peek())):
                word = self.peek()
                if word in ("second", "minute", "hour", "day", "week"):
                    size = micros(self.next())
                else:
                    keys.append(self.field())
            elif w == "every":
                size = micros(self.next() if re.fullmatch(r"\d+[a-z]+", self.peek()) else f"{self.next()} {self.next()}")
            elif w in ("where", "with", "when"):
                found = self.conditions()
                where = found if where is None else ir.Op("and", (where, found))
            elif (when := self.since(w)) is not None:
                where = when if where is None else ir.Op("and", (where, when))
        plan = ir.Filter(source, where) if where is not None else source
        item, named = (ir.Item(ir.Agg(fn, (column,)), f"{fn}_{column.path}"),), tuple(ir.Item(k, k.path) for k in keys)
        return ir.Windowed(plan, ir.Window("interval", size), named, item) if size else ir.Group(plan, named, item)

    def clauses(self, plan, limit: int | None = None, count: bool = False):
        keys, offset, where = [], 0, None
        while self.more():
            w = self.next().lower()
            if w in ("where", "with", "if", "when", "having", "whose"):
                found = self.conditions()
                where = found if where is None else ir.Op("and", (where, found))
            elif w in ("sorted", "ordered", "order", "sort"):
                self.skip("by")
                keys += self.order()
            elif w in ("limit", "first", "top") and self.peek().isdigit():
                limit = int(self.next())
            elif w in ("skip", "offset") and self.peek().isdigit():
                offset = int(self.next())
            elif (when := self.since(w)) is not None:
                where = when if where is None else ir.Op("and", (where, when))
            elif w not in (",", "and", "the", "of", "are", "there"):
                raise ParseError(f"english: {w!r} is not understood")
        if where is not None:
            plan = ir.Filter(plan, where)
        if count:
            return ir.Group(plan, (), (ir.Item(ir.Agg("count"), "count"),))
        if keys:
            plan = ir.Sort(plan, tuple(keys))
        return ir.Limit(plan, limit, offset) if limit is not None or offset else plan

    def since(self, word: str):
        """in the last 7 days, past 2 hours, last week, today, yesterday: a range of time that ends at `now`."""
        if word in ("in", "during", "over", "from", "the", "for") and self.peek() in ("the", "last", "past"):
            self.skip("the")
            word = self.next().lower()
        if word not in ("last", "past", "today", "yesterday"):
            return None
        if self.now is None:
            raise ParseError("english: a relative time needs `now`")
        field, now = ir.Field(self.time(self.table)), ir.Op("cast", (ir.Lit(self.now), ir.Lit("timestamp_ntz")))
        back = lambda n: ir.Op("-", (now, ir.Op("duration", (ir.Lit(n),))))
        if word in ("today", "yesterday"):
            midnight = ir.Op("trunc", (ir.Lit("day"), now))
            if word == "today":
                return ir.Op(">=", (field, midnight))
            return ir.Op("and", (ir.Op(">=", (field, ir.Op("-", (midnight, ir.Op("duration", (ir.Lit(micros("1d")),)))))), ir.Op("<", (field, midnight))))
        n = self.next() if self.peek().isdigit() else "1"
        return ir.Op(">=", (field, back(micros(f"{n} {self.next()}"))))

    def order(self) -> list[ir.Key]:
        out = []
        while self.more() and self.peek() not in CLAUSES:
            field = self.field()
            down = self.peek() in ("descending", "desc")
            self.skip("descending", "desc", "ascending", "asc")
            out.append(ir.Key(field, down))
            if self.peek() not in (",", "and", "then"):
                break
            self.skip(",", "and", "then", "by")
        return out

    def conditions(self):
        def both():
            left = self.condition()
            while self.peek() in ("and", ","):
                self.at += 1
                left = ir.Op("and", (left, self.condition()))
            return left

        left = both()
        while self.peek() == "or":
            self.at += 1
            left = ir.Op("or", (left, both()))
        return left

    def condition(self):
        field = self.field()
        self.skip("is", "are", "was") if self.peek(1) else None
        op = "="
        for words, name in PHRASES:
            if all(self.peek(k) == w for k, w in enumerate(words)):
                self.at += len(words)
                op = name
                break
        self.skip("than", "to")
        if op in ("is_null", "is_not_null"):
            return ir.Op(op, (field,))
        if op == "between":
            low = self.value()
            self.skip("and")
            return ir.Op("between", (field, low, self.value()))
        if op in ("in", "not in"):
            values, ends = [], CLAUSES | {"and"} | {c.lower() for c in self.columns(self.table)}
            while self.more() and self.peek() not in CLAUSES | {"and"}:
                before = self.at
                self.skip("(", ")", ",", "or")
                if self.more() and self.peek() in ends:  # the next condition begins
                    self.at = before if self.words[before][0].lower() == "or" else self.at
                    break
                if self.more():
                    values.append(self.value())
            return ir.Op("in" if op == "in" else "loose_not_in", (field, *values))
        v = self.value()
        return ir.Op("loose_!=" if op == "!=" else op, (field, v))

    def add(self):
        self.skip("to", "into")
        self.source()
        row: dict = {}
        while self.more():
            self.skip("with", "and", "having", ",")
            if not self.more():
                break
            name = self.next()
            self.skip("is", "=", ":")
            row[name] = self.value().value
        return ir.Change(self.table, "insert", tuple(row), (tuple(row.values()),))

    def change(self):
        self.source()
        self.skip("set")
        changes, where = [], None
        while self.more():
            if self.peek() in ("where", "if", "when"):
                self.at += 1
                where = self.conditions()
                break
            self.skip("and", ",")
            name = self.field().path
            self.skip("to", "=", ":")
            changes.append((name, self.value()))
        if where is None:
            raise ParseError("english: updating needs a condition")
        return ir.Change(self.table, "update", rows=tuple(changes), where=where)


def parse(text: str, tables: list[str] = (), columns=lambda table: [], synonyms: dict[str, str] | None = None, **time):
    return English(text, tables, columns, synonyms, **time).parse()
