"""Predicates of elements: comparison, containment, text and geo, as null-free boolean columns.

``P`` objects are applied to a property column by ``holds``: a property without a value is tested as null; of a
multi-valued property any value may satisfy the predicate.
"""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import geo
from .text import fuzzy_distance, query_tokens, tokens

Test = Callable[[Column, T.DataType], Column]


@dataclass(frozen=True)
class P:
    name: str
    test: Test
    opposite: Callable[[], "P"] | None = None
    #: What a comparison compares with (a step label, in where()).
    value: object = None

    def and_(self, other: "P") -> "P":
        return P(f"and({self.name}, {other.name})", lambda c, t: self.test(c, t) & other.test(c, t), lambda: self.negate().or_(other.negate()))

    def or_(self, other: "P") -> "P":
        return P(f"or({self.name}, {other.name})", lambda c, t: self.test(c, t) | other.test(c, t), lambda: self.negate().and_(other.negate()))

    def negate(self) -> "P":
        if self.opposite is None:
            raise ValueError(f"{self.name} has no negation")
        return self.opposite()

    __and__, __or__, __invert__ = and_, or_, negate


def holds(p: P, column: Column, kind: T.DataType) -> Column:
    """Whether a property satisfies ``p``: never null."""
    if isinstance(kind, T.ArrayType) and not p.name.startswith("whole:"):
        some = F.exists(column, lambda x: F.coalesce(p.test(x, kind.elementType), F.lit(False)))
        empty = column.isNull() | (F.size(column) == 0)
        return F.when(empty, F.coalesce(p.test(F.lit(None).cast(kind.elementType), kind.elementType), F.lit(False))).otherwise(F.coalesce(some, F.lit(False)))
    return F.coalesce(p.test(column, kind), F.lit(False))


def _fits(value, kind: T.DataType) -> bool:
    """Whether a value compares with a type at all; other pairs are unlike and never compare."""
    if value is None:
        return True
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float, decimal.Decimal)):
        return isinstance(kind, T.NumericType)
    if isinstance(value, str):
        return isinstance(kind, T.StringType)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))
    return True


def _equal(c: Column, v, kind: T.DataType) -> Column:
    return c.eqNullSafe(F.lit(v)) if _fits(v, kind) else F.lit(False)


def _ordered(c: Column, v, kind: T.DataType, compare: Callable[[Column, Column], Column], or_equal: bool) -> Column:
    if v is None:
        return c.isNull() if or_equal else F.lit(False)
    if not _fits(v, kind) or v != v:
        return F.lit(False) if v == v else (F.isnan(c) if or_equal and isinstance(kind, (T.DoubleType, T.FloatType)) else F.lit(False))
    hit = compare(c, F.lit(v))
    return hit & ~F.isnan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else hit


def eq(v) -> P:
    return P("eq", lambda c, t: _equal(c, v, t), lambda: neq(v), v)


def neq(v) -> P:
    """A property without a value never differs."""
    return P("neq", lambda c, t: c.isNotNull() & ~_equal(c, v, t), lambda: eq(v), v)


def lt(v) -> P:
    return P("lt", lambda c, t: _ordered(c, v, t, lambda a, b: a < b, False), lambda: gte(v), v)


def lte(v) -> P:
    return P("lte", lambda c, t: _ordered(c, v, t, lambda a, b: a <= b, True), lambda: gt(v), v)


def gt(v) -> P:
    return P("gt", lambda c, t: _ordered(c, v, t, lambda a, b: a > b, False), lambda: lte(v), v)


def gte(v) -> P:
    return P("gte", lambda c, t: _ordered(c, v, t, lambda a, b: a >= b, True), lambda: lt(v), v)


def between(low, high) -> P:
    """low <= x < high"""
    return gte(low).and_(lt(high))


def inside(low, high) -> P:
    """low < x < high"""
    return gt(low).and_(lt(high))


def outside(low, high) -> P:
    """x < low or x > high"""
    return lt(low).or_(gt(high))


def within(*values) -> P:
    values = tuple(values[0]) if len(values) == 1 and isinstance(values[0], (list, tuple, set, frozenset)) else values

    def test(c: Column, t: T.DataType) -> Column:
        fitting = [v for v in values if v is not None and _fits(v, t)]
        hit = c.isin(fitting) if fitting else F.lit(False)
        return F.coalesce(hit, F.lit(False)) | (c.isNull() if None in values else F.lit(False))

    return P("within", test, lambda: without(values))


def without(*values) -> P:
    """A missing value fails, but for the empty collection, which excludes nothing."""
    values = tuple(values[0]) if len(values) == 1 and isinstance(values[0], (list, tuple, set, frozenset)) else values
    if not values:
        return P("without", lambda c, t: F.lit(True), lambda: within(()))
    return P("without", lambda c, t: c.isNotNull() & ~within(values).test(c, t), lambda: within(values))


def _text(name: str, test: Callable[[Column], Column]) -> tuple[Callable[[], P], Callable[[], P]]:
    """A text predicate and its negation; both are false without a value."""
    yes = lambda: P(name, lambda c, t: c.isNotNull() & F.coalesce(test(c), F.lit(False)), lambda: no())
    no = lambda: P(f"not-{name}", lambda c, t: c.isNotNull() & ~F.coalesce(test(c), F.lit(False)), lambda: yes())
    return yes, no


def _full(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def _contains(query: str):
    wanted = query_tokens(query)
    if not wanted:
        return _text("textContains", lambda c: F.lit(query == ""))
    have = lambda: F.array(*[F.lit(t) for t in dict.fromkeys(wanted)])
    return _text("textContains", lambda c: F.size(F.array_except(have(), tokens(c))) == 0)


def _contains_phrase(query: str):
    wanted = " ".join(query_tokens(query))
    return _text("textContainsPhrase", lambda c: F.contains(F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" ")), F.lit(f" {wanted} ")) if wanted else F.lit(query == ""))


def _contains_prefix(query: str):
    start = query.strip().lower()
    return _text("textContainsPrefix", lambda c: F.exists(tokens(c), lambda t: t.startswith(start)))


def _contains_regex(query: str):
    return _text("textContainsRegex", lambda c: F.exists(tokens(c), lambda t: t.rlike(_full(query))))


def _contains_fuzzy(query: str):
    term = query.strip().lower()
    return _text("textContainsFuzzy", lambda c: F.exists(tokens(c), lambda t: F.levenshtein(t, F.lit(term), fuzzy_distance(term)) >= 0))


def _prefix(query: str):
    return _text("textPrefix", lambda c: c.startswith(query.strip()))


def _regex(query: str):
    return _text("textRegex", lambda c: c.rlike(_full(query)))


def _fuzzy(query: str):
    term = query.strip()
    return _text("textFuzzy", lambda c: F.levenshtein(F.trim(c), F.lit(term), fuzzy_distance(term)) >= 0)


def text_contains(q: str) -> P:
    return _contains(q)[0]()


def text_not_contains(q: str) -> P:
    return _contains(q)[1]()


def text_contains_prefix(q: str) -> P:
    return _contains_prefix(q)[0]()


def text_not_contains_prefix(q: str) -> P:
    return _contains_prefix(q)[1]()


def text_contains_regex(q: str) -> P:
    return _contains_regex(q)[0]()


def text_not_contains_regex(q: str) -> P:
    return _contains_regex(q)[1]()


def text_contains_fuzzy(q: str) -> P:
    return _contains_fuzzy(q)[0]()


def text_not_contains_fuzzy(q: str) -> P:
    return _contains_fuzzy(q)[1]()


def text_contains_phrase(q: str) -> P:
    return _contains_phrase(q)[0]()


def text_not_contains_phrase(q: str) -> P:
    return _contains_phrase(q)[1]()


def text_prefix(q: str) -> P:
    return _prefix(q)[0]()


def text_not_prefix(q: str) -> P:
    return _prefix(q)[1]()


def text_regex(q: str) -> P:
    return _regex(q)[0]()


def text_not_regex(q: str) -> P:
    return _regex(q)[1]()


def text_fuzzy(q: str) -> P:
    return _fuzzy(q)[0]()


def text_not_fuzzy(q: str) -> P:
    return _fuzzy(q)[1]()


def starting_with(q: str) -> P:
    return _text("startingWith", lambda c: c.startswith(q))[0]()


def ending_with(q: str) -> P:
    return _text("endingWith", lambda c: c.endswith(q))[0]()


def containing(q: str) -> P:
    return _text("containing", lambda c: c.contains(q))[0]()


def geo_intersect(shape: geo.Geoshape) -> P:
    return P("geoIntersect", lambda c, t: c.isNotNull() & F.coalesce(geo.intersects(c, shape), F.lit(False)), lambda: geo_disjoint(shape))


def geo_disjoint(shape: geo.Geoshape) -> P:
    return P("geoDisjoint", lambda c, t: c.isNotNull() & ~F.coalesce(geo.intersects(c, shape), F.lit(False)), lambda: geo_intersect(shape))


def geo_within(shape: geo.Geoshape) -> P:
    return P("geoWithin", lambda c, t: c.isNotNull() & F.coalesce(geo.within(c, shape), F.lit(False)))


def geo_contains(shape: geo.Geoshape) -> P:
    return P("geoContains", lambda c, t: c.isNotNull() & F.coalesce(geo.contains(c, shape), F.lit(False)))


def custom(name: str, test: Callable[[Column], Column]) -> P:
    """A predicate outside the library, from a function of a column (a pandas UDF call, for example)."""
    return P(name, lambda c, t: test(c))
