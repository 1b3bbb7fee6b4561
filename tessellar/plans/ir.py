"""Expressions and plan nodes. Every dialect is parsed into these, and one compiler lowers them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any


# Expressions
@dataclass(frozen=True)
class Field:
    """A column or a dotted path into one."""

    path: str


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Op:
    """An operator or scalar function by its lower-case name."""

    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Agg:
    """An aggregate; params are constants such as a percentile."""

    name: str
    args: tuple = ()
    params: tuple = ()
    distinct: bool = False


@dataclass(frozen=True)
class Over:
    """A function over a window of rows. frame: (kind, first, last) with offsets from the row, None where unbounded."""

    call: Any
    partition: tuple = ()
    order: tuple = ()
    frame: tuple | None = None


@dataclass(frozen=True)
class Item:
    expr: Any
    alias: str


@dataclass(frozen=True)
class Key:
    """A sort key. nulls: 'first', 'last' or '' for the engine's default (first when rising)."""

    expr: Any
    descending: bool = False
    nulls: str = ""


def rewrite(e, change):
    """The expression with change(part) for each part that it isn't None for, outermost first."""
    new = change(e)
    if new is not None:
        return new
    inside = lambda parts: tuple(rewrite(x, change) for x in parts)
    if isinstance(e, (Op, Agg)):
        return replace(e, args=inside(e.args))
    if isinstance(e, (Item, Key)):
        return replace(e, expr=rewrite(e.expr, change))
    if isinstance(e, Over):
        return replace(e, call=rewrite(e.call, change), partition=inside(e.partition), order=inside(e.order))
    return e


def parts(e):
    """The expression and everything inside it."""
    found = []
    rewrite(e, found.append)
    return found


# Plans
@dataclass(frozen=True)
class Scan:
    """final: only the last version of each key."""

    table: str
    alias: str = ""
    final: bool = False


@dataclass(frozen=True)
class Alias:
    """A plan with a name for its columns."""

    child: Any
    name: str


@dataclass(frozen=True)
class Filter:
    child: Any
    where: Any


@dataclass(frozen=True)
class Select:
    """items may hold Star, which stands for all columns."""

    child: Any
    items: tuple
    distinct: bool = False


@dataclass(frozen=True)
class Group:
    """mode: '', 'rollup', 'cube' or 'totals' (a grand total beside the groups)."""

    child: Any
    keys: tuple[Item, ...]
    items: tuple[Item, ...]
    having: Any = None
    mode: str = ""


@dataclass(frozen=True)
class Fill:
    """mode: none, null, value, prev, next, linear, nearest."""

    mode: str = "none"
    value: float | None = None
    modes: tuple[tuple[str, str], ...] = ()  # by column, where they differ
    start: Any = None  # the grid reaches from here
    end: Any = None  # to here, exclusively


@dataclass(frozen=True)
class Window:
    """kind: interval, session, state, event or count. Durations are in microseconds."""

    kind: str
    size: int = 0
    slide: int = 0
    offset: int = 0
    state: Any = None
    start: Any = None
    end: Any = None
    least: int = 0
    align_first: bool = False
    fill: Fill = field(default_factory=Fill)


@dataclass(frozen=True)
class Windowed:
    child: Any
    window: Window
    keys: tuple[Item, ...]
    items: tuple[Item, ...]
    time: str = ""
    having: Any = None


@dataclass(frozen=True)
class Join:
    """By columns (on), or by any condition (where), in which names may be qualified."""

    left: Any
    right: Any
    how: str
    on: tuple[tuple[str, str], ...] = ()
    where: Any = None


@dataclass(frozen=True)
class TimeJoin:
    """kind: asof (at or before), lt (before) or splice (both ways)."""

    left: Any
    right: Any
    kind: str
    by: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Sort:
    child: Any
    keys: tuple[Key, ...]


@dataclass(frozen=True)
class Limit:
    child: Any
    count: int | None
    offset: int = 0


@dataclass(frozen=True)
class LimitBy:
    """The first rows of each group, in the order of keys."""

    child: Any
    count: int
    by: tuple
    keys: tuple[Key, ...]


@dataclass(frozen=True)
class SetOp:
    """kind: union, intersect or except; all keeps duplicates."""

    left: Any
    right: Any
    kind: str
    all: bool = False


@dataclass(frozen=True)
class Latest:
    child: Any
    time: str
    keys: tuple[str, ...]


@dataclass(frozen=True)
class Unwind:
    child: Any
    path: str


@dataclass(frozen=True)
class Lookup:
    child: Any
    table: str
    local: str
    foreign: str
    name: str


@dataclass(frozen=True)
class Series:
    """A function over each series in time order: rate, derivative, ... with its parameters."""

    child: Any
    name: str
    params: tuple = ()
    keys: tuple[str, ...] = ()


@dataclass(frozen=True)
class SeriesItems:
    """Several such functions side by side, as items whose expressions are Op('series', (name, column, parameters...))."""

    child: Any
    items: tuple[Item, ...]
    keys: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rows:
    """A function that gives rows for each group: sample, tail, histogram, statecount, stateduration or interp."""

    child: Any
    name: str
    of: Any
    params: tuple = ()
    keys: tuple[Item, ...] = ()
    alias: str = ""
    items: tuple[Item, ...] = ()


@dataclass(frozen=True)
class Create:
    """A new name: table (from columns or a query), child, view, collection, stream, topic, database or index."""

    kind: str
    name: str
    columns: tuple = ()
    source: Any = None
    target: str = ""
    options: tuple = ()
    lenient: bool = False


@dataclass(frozen=True)
class Change:
    """A new version of a table: insert, update, delete or upsert."""

    table: str
    kind: str
    columns: tuple[str, ...] = ()
    rows: tuple = ()
    where: Any = None


@dataclass(frozen=True)
class Catalogue:
    """A statement about names: create, drop, show, describe."""

    verb: str
    kind: str
    name: str = ""
