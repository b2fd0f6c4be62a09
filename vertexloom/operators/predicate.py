"""The predicate algebra: a tree in Python that compiles to one Column.

Leaves are two-valued (a comparison with something missing is false), so that
negation is sound.  String matching is on whole strings, ignores case and
diacritics, and takes ``*`` and ``?`` in names and values.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import like


class Predicate:
    """A boolean over a node.  ``&``, ``|`` and ``~`` combine predicates."""

    def __init__(self, build: Callable[[], Column]):
        self._build = build

    def column(self) -> Column:
        return F.coalesce(self._build(), F.lit(False))

    def __and__(self, other: Predicate) -> Predicate:
        return Predicate(lambda: self.column() & other.column())

    def __or__(self, other: Predicate) -> Predicate:
        return Predicate(lambda: self.column() | other.column())

    def __invert__(self) -> Predicate:
        return Predicate(lambda: ~self.column())


NOTHING = Predicate(lambda: F.lit(False))


def compound(parts: list[Predicate], kind: str = "and") -> Predicate:
    """All (``and``), any (``or``) or none (``not``) of ``parts``; no parts match nothing."""
    if not parts:
        return NOTHING
    joined = reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), parts)
    return ~joined if kind == "not" else joined


@dataclass(frozen=True)
class Text:
    """A tree of strings, each to be matched by what it is given to."""

    op: str = "none"
    parts: tuple = ()

    def __and__(self, other):
        return Text("and", (self, text(other)))

    def __or__(self, other):
        return Text("or", (self, text(other)))

    def __invert__(self):
        return Text("not", (self,))

    def apply(self, leaf: Callable[[str], Column]) -> Column:
        if self.op == "leaf":
            return F.coalesce(leaf(self.parts[0]), F.lit(False))
        if self.op == "none":
            return F.lit(False)
        inner = [p.apply(leaf) for p in self.parts]
        return ~inner[0] if self.op == "not" else inner[0] & inner[1] if self.op == "and" else inner[0] | inner[1]


def text(value: str | Text) -> Text:
    return value if isinstance(value, Text) else Text("leaf", (value,))


def _folded(values: tuple, using: Callable | None) -> Text:
    """One tree of ``values`` (strings, trees or one list), joined by ``using``
    (any of them, if it is not given)."""
    flat = [text(v) for x in values for v in (x if isinstance(x, (list, tuple)) else [x])]
    return reduce(using or (lambda a, b: a | b), flat) if flat else Text()


def type_(*types, using: Callable | None = None) -> Predicate:
    tree = _folded(types, using)
    # all types, without looking at the pattern
    return Predicate(lambda: tree.apply(lambda p: F.col("type_fold").isNotNull() if p == "*" else like(F.col("type_fold"), p)))


def has(*tags, using: Callable | None = None) -> Predicate:
    tree = _folded(tags, using)
    return Predicate(lambda: tree.apply(lambda p: F.exists("tags_fold", lambda t: like(t, p))))


def member_of(*groups, using: Callable | None = None) -> Predicate:
    tree = _folded(groups, using)
    return Predicate(lambda: tree.apply(lambda p: F.exists("groups_fold", lambda g: like(g, p))))


def exists(*names, using: Callable | None = None) -> Predicate:
    tree = _folded(names, using)
    return Predicate(lambda: tree.apply(lambda p: F.exists("props", lambda x: like(x["name_fold"], p))))


def _value(p: Column, value, compare: Callable) -> Column:
    if isinstance(value, bool):
        return compare(p["n"], F.lit(float(value)))
    if isinstance(value, int) and abs(value) > 1 << 53:
        return compare(p["l"], F.lit(value))
    if isinstance(value, (int, float)):
        return compare(p["n"], F.lit(float(value)))
    if isinstance(value, dt.datetime):
        return compare(p["d"], F.lit(value).cast("timestamp_ntz"))
    raise TypeError(f"no comparison with {type(value).__name__}")


class prop:
    """A property's comparisons: ``prop("score") >= 10``.

    With a string, ``!=`` means that no such property matches (true where it is
    missing); with a number, that some property differs (false where missing).
    """

    def __init__(self, name: str):
        self.name = name

    def _any(self, test: Callable[[Column], Column]) -> Predicate:
        return Predicate(lambda: F.exists("props", lambda p: F.coalesce(like(p["name_fold"], self.name) & test(p), F.lit(False))))

    def __eq__(self, value) -> Predicate:  # type: ignore[override]
        if isinstance(value, str):
            return self._any(lambda p: like(p["s_fold"], value))
        return self._any(lambda p: _value(p, value, lambda a, b: a == b))

    def __ne__(self, value) -> Predicate:  # type: ignore[override]
        if isinstance(value, str):
            return ~(self == value)
        return self._any(lambda p: _value(p, value, lambda a, b: a != b))

    def __gt__(self, value) -> Predicate:
        return self._any(lambda p: _value(p, value, lambda a, b: a > b))

    def __ge__(self, value) -> Predicate:
        return self._any(lambda p: _value(p, value, lambda a, b: a >= b))

    def __lt__(self, value) -> Predicate:
        return self._any(lambda p: _value(p, value, lambda a, b: a < b))

    def __le__(self, value) -> Predicate:
        return self._any(lambda p: _value(p, value, lambda a, b: a <= b))

    __hash__ = None  # type: ignore[assignment]


def exact_set(column: str, names: list[str], condition: str = "and") -> Column:
    """Object-level test, exact and case-sensitive: all of ``names`` are in the
    column (true for none), or any is (false for none)."""
    wanted = F.array(*map(F.lit, names)).cast("array<string>")
    return F.size(F.array_except(wanted, column)) == 0 if condition == "and" else F.arrays_overlap(column, wanted)
