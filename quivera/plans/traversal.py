"""Traversals: a fluent builder whose every step is a lazily planned DataFrame.

A row is a traverser, so duplicates count. Columns: ``_id`` and, once loaded, ``_label`` and the properties of
an element; ``_src`` and ``_dst`` of an edge; ``_value`` of anything else. Along go ``_path`` (what was visited,
as strings), ``_prev`` (the vertex that an edge was reached from) and ``_as_x`` (what step label x names);
Catalyst drops those that nothing reads. A vertex reached by a hop is its id alone, and is joined with its
table only when a later step reads a label or property.

Sub-traversals start from the distinct states they depend on (``_key`` columns) and run for all of them at
once; ``scope`` names the columns that limits, orders and reducers of a sub-traversal work within.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates as Pr
from ..functions.predicates import P, holds
from .graph import Graph

#: Steps that look at several traversers at once: in a branch they must see those of one start only.
BARRIERS = frozenset("order limit range_ skip tail count sum_ max_ min_ mean fold dedup group groupCount sample aggregate store".split())
INTERNAL = ("_id", "_label", "_src", "_dst", "_value", "_path", "_prev", "_loops", "_sack")
ASC, DESC = "asc", "desc"
MAX_LOOPS = 64


class Anonymous:
    """A recorded sub-traversal: ``__.out('placed').has('x', gt(1))``."""

    def __init__(self, calls: tuple = ()):
        self._calls = calls

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return lambda *a, **k: Anonymous((*self._calls, (name, a, k)))

    @property
    def has_barrier(self) -> bool:
        return any(name in BARRIERS or any(isinstance(x, Anonymous) and x.has_barrier for x in a) for name, a, _ in self._calls)

    def apply(self, t: "Traversal") -> "Traversal":
        for name, a, k in self._calls:
            t = getattr(t, name)(*a, **k)
        return t


__ = Anonymous()


@dataclass(frozen=True)
class LastHop:
    """The hop that a traversal has just done, so that its traversers can be counted without being made.

    ``before``: ``_id`` and what was carried up to the hop; ``pairs``: the hop's edges as (``_id``, ``_next``);
    ``apart``: the column whose element the hop may not lead to, or ``_path``, if a filter names one; ``met``: whether the
    filter asks for those that the hop does lead to instead.
    """

    before: DataFrame
    pairs: DataFrame
    apart: str | None = None
    met: bool = False

    def ending_at(self, vertices: DataFrame) -> "LastHop":
        return replace(self, pairs=self.pairs.join(vertices.select(F.col("id").alias("_next")), "_next").select("_id", "_next"))

    def tally(self, *columns: str) -> DataFrame:
        """(columns, _bulk): how many traversers there are by what they carried before the hop.

        A traverser makes as many as its vertex has edges, less those edges that lead to what is ruled out, which an
        equi-join finds. So the work follows the traversers and edges, not the pairs of them. ``before`` is read once:
        of a path's elements, each a row, the first brings the vertex's edges. A path that is cyclic already stays so.
        """
        df, pairs, end, cyclic = self.before, self.pairs, F.col("_next"), F.lit(False)
        if self.apart == "_path":
            df = df.withColumn("_cyclic", F.size(F.array_distinct("_path")) < F.size("_path"))
            df = df if self.met else df.where(~F.col("_cyclic"))
            df = df.select("_id", "_cyclic", *columns, F.posexplode("_path").alias("_nth", "_member"))
            end, cyclic = end.cast("string"), F.col("_cyclic")
        else:
            df = df.select("_id", *columns, F.lit(0).alias("_nth"), F.col(self.apart).alias("_member")).where(F.col("_member").isNotNull())
            pairs = pairs.where(end.isNotNull())
        meetings = pairs.groupBy(F.col("_id").alias("_at"), end.alias("_end")).agg(F.count("*").alias("_met"))
        degree = pairs.groupBy("_id").agg(F.count("*").alias("_degree"))
        df = df.join(meetings, (F.col("_id") == F.col("_at")) & F.col("_member").eqNullSafe(F.col("_end")), "left").join(degree, "_id")
        every, met = F.when(F.col("_nth") == 0, F.col("_degree")).otherwise(F.lit(0)), F.coalesce("_met", F.lit(0))
        bulk = F.when(cyclic, every).otherwise(met) if self.met else every - met
        return df.groupBy(*columns).agg(F.sum(bulk).alias("_bulk")).where("_bulk > 0")


class GraphTraversalSource:
    def __init__(self, graph: Graph):
        self.graph = graph

    def V(self, *ids) -> "Traversal":
        def start(labels: tuple[str, ...]) -> DataFrame:
            df = self.graph.vertices(labels)
            df = df.where(F.col("id").isin(list(ids))) if ids else df
            return df.withColumnsRenamed({"id": "_id", "label": "_label"}).withColumn("_path", F.array(F.col("_id").cast("string")))

        return Traversal(self.graph, None, "vertex", tuple(self.graph.vertex_tables), True, unique=True, start=start)

    def E(self, *ids) -> "Traversal":
        def start(labels: tuple[str, ...]) -> DataFrame:
            df = self.graph.edges(labels) if labels else self.graph.edges().limit(0)
            df = df.where(F.col("id").isin([str(i) for i in ids])) if ids else df
            return df.withColumnsRenamed({"id": "_id", "label": "_label", "src": "_src", "dst": "_dst"}).withColumn("_path", F.array("_id"))

        return Traversal(self.graph, None, "edge", tuple(self.graph.edge_tables), True, start=start)

    def inject(self, *values) -> "Traversal":
        df = self.graph.spark.createDataFrame([(v,) for v in values], ["_value"]).withColumn("_path", F.array(F.col("_value").cast("string")))
        return Traversal(self.graph, df, "value", (), True)

    def addV(self, label: str, rows: DataFrame) -> Graph:
        """The graph with the rows (id, properties) as vertices of a label."""
        from ..operators.mutations import add_vertices

        return add_vertices(self.graph, label, rows)

    def addE(self, label: str, rows: DataFrame) -> Graph:
        """The graph with the rows (src, dst, properties) as edges of a label, under its multiplicity."""
        from ..operators.mutations import add_edges

        return add_edges(self.graph, label, rows)

    def mergeV(self, label: str, rows: DataFrame, on: list[str]) -> Graph:
        from ..operators.mutations import merge_vertices

        return merge_vertices(self.graph, label, rows, on)

    def mergeE(self, label: str, rows: DataFrame) -> Graph:
        from ..operators.mutations import merge_edges

        return merge_edges(self.graph, label, rows)

    def withComputer(self) -> "GraphTraversalSource":
        """Plans are always distributed."""
        return self

    def io(self, path: str):
        from ..sources.graphson import read_graphson

        return read_graphson(self.graph.spark, path)


class Traversal:
    def __init__(
        self,
        graph: Graph,
        df: DataFrame | None,
        kind: str,
        labels: tuple[str, ...] | None,
        loaded: bool,
        scope: tuple[str, ...] = (),
        order: tuple = (),
        starts: DataFrame | None = None,
        side: dict | None = None,
        unique: bool = False,
        start: Callable[[tuple[str, ...]], DataFrame] | None = None,
        last: LastHop | None = None,
        tallied: DataFrame | None = None,
    ):
        self.graph, self._df, self.kind, self.labels, self.loaded = graph, df, kind, labels, loaded
        #: A start that is not planned yet: labels that follow it narrow the tables it opens.
        self._start = start
        self.scope, self._order, self._starts, self.side = scope, order, starts, side if side is not None else {}
        #: Whether no element comes twice: true of a start, and kept by steps that only filter.
        self.unique = unique
        #: What counts need instead of ``df``: the hop before, while only steps that it knows followed, or the current
        #: column with ``_bulk``, the number of traversers.
        self._last, self._tallied = last, tallied

    # ---- state -------------------------------------------------------------------------------------------

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            self._df = self._start(self.labels)
        return self._df

    def _new(self, df: DataFrame | None = None, **changed) -> "Traversal":
        now = {"kind": self.kind, "labels": self.labels, "loaded": self.loaded, "scope": self.scope, "order": (), "starts": self._starts, "side": self.side, "unique": self.unique and "kind" not in changed} | changed
        return Traversal(self.graph, self.df if df is None else df, **now)

    @property
    def carried(self) -> list[str]:
        return [c for c in self.df.columns if c in ("_path", "_sack", "_loops") or c.startswith("_as_") or c in self.scope]

    @property
    def properties_here(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("_")]

    def _load(self) -> "Traversal":
        """Join vertices known by id with their tables."""
        if self.loaded or self.kind != "vertex":
            return self
        table = self.graph.vertices(self.labels).withColumnsRenamed({"id": "_id", "label": "_label"})
        return self._new(self.df.join(table, "_id"), loaded=True)

    def _walk(self, df: DataFrame, now: str) -> DataFrame:
        return df.withColumn("_path", F.array_append("_path", F.col(now).cast("string")))

    def _column(self, key: str) -> tuple[Column, T.DataType]:
        """A property, or id and label of an element."""
        name = {"id": "_id", "label": "_label", "T.id": "_id", "T.label": "_label", "value": "_value"}.get(key, key)
        if name in self.df.columns:
            return F.col(f"`{name}`"), self.df.schema[name].dataType
        return F.lit(None).cast("string"), T.StringType()

    @property
    def _current(self) -> str:
        return "_value" if self.kind in ("value", "map", "property") else "_id"

    # ---- moves -------------------------------------------------------------------------------------------

    def _hop(self, labels: tuple[str, ...], out: bool) -> "Traversal":
        edges = self.graph.edges(labels, properties=False)
        here, there = ("src", "dst") if out else ("dst", "src")
        last = LastHop(self.df.select("_id", *self.carried), edges.select(F.col(here).alias("_id"), F.col(there).alias("_next")))
        df = self._walk(last.before.join(last.pairs, "_id").drop("_id").withColumnRenamed("_next", "_id"), "_id")
        return self._new(df, kind="vertex", labels=self.graph.end_labels(labels, out), loaded=False, last=last)

    def out(self, *labels: str) -> "Traversal":
        return self._hop(labels, True)

    def in_(self, *labels: str) -> "Traversal":
        return self._hop(labels, False)

    def both(self, *labels: str) -> "Traversal":
        """A self-loop comes twice."""
        a, b = self._hop(labels, True), self._hop(labels, False)
        known = a.labels is not None and b.labels is not None
        return a._new(a.df.unionByName(b.df), unique=False, labels=tuple(dict.fromkeys(a.labels + b.labels)) if known else None)

    def _edges_at(self, labels: tuple[str, ...], out: bool) -> DataFrame:
        edges = self.graph.edges(labels).withColumnsRenamed({"id": "_edge", "label": "_label", "src": "_src", "dst": "_dst"})
        edges = edges.withColumn("_id", F.col("_src" if out else "_dst"))
        df = self.df.select("_id", *self.carried).join(edges, "_id")
        return self._walk(df.withColumnRenamed("_id", "_prev").withColumnRenamed("_edge", "_id"), "_id")

    def outE(self, *labels: str) -> "Traversal":
        return self._new(self._edges_at(labels, True), kind="edge", labels=labels or tuple(self.graph.edge_tables), loaded=True)

    def inE(self, *labels: str) -> "Traversal":
        return self._new(self._edges_at(labels, False), kind="edge", labels=labels or tuple(self.graph.edge_tables), loaded=True)

    def bothE(self, *labels: str) -> "Traversal":
        df = self._edges_at(labels, True).unionByName(self._edges_at(labels, False))
        return self._new(df, kind="edge", labels=labels or tuple(self.graph.edge_tables), loaded=True)

    def _end(self, end: Column, labels: tuple[str, ...] | None) -> "Traversal":
        df = self._walk(self.df.select(*self.carried, end.alias("_id")), "_id")
        return self._new(df, kind="vertex", labels=labels, loaded=False)

    def inV(self) -> "Traversal":
        return self._end(F.col("_dst"), self.graph.end_labels(self.labels, True))

    def outV(self) -> "Traversal":
        return self._end(F.col("_src"), self.graph.end_labels(self.labels, False))

    def otherV(self) -> "Traversal":
        return self._end(F.when(F.col("_src") == F.col("_prev"), F.col("_dst")).otherwise(F.col("_src")), None)

    def bothV(self) -> "Traversal":
        return self._end(F.explode(F.array("_src", "_dst")), None)

    # ---- filters -----------------------------------------------------------------------------------------

    @staticmethod
    def _predicate(value) -> P:
        return value if isinstance(value, P) else Pr.eq(value)

    def has(self, key: str, value=..., third=...) -> "Traversal":
        if third is not ...:  # has(label, key, value)
            return self.hasLabel(key).has(value, third)
        t = self._load()
        if isinstance(value, Anonymous):
            return t.where(Anonymous((("values", (key,), {}), *value._calls)))
        column, kind = t._column(key)
        if value is ...:
            present = F.size(column) > 0 if isinstance(kind, T.ArrayType) else column.isNotNull()
            return t._new(t.df.where(F.coalesce(present, F.lit(False))), order=t._order)
        return t._new(t.df.where(holds(t._predicate(value), column, kind)), order=t._order)

    def hasNot(self, key: str) -> "Traversal":
        t = self._load()
        column, kind = t._column(key)
        missing = column.isNull() | (F.size(column) == 0) if isinstance(kind, T.ArrayType) else column.isNull()
        return t._new(t.df.where(missing))

    def hasLabel(self, *labels: str) -> "Traversal":
        known = self.labels if self.labels is not None else tuple(self.graph.vertex_tables)
        kept = tuple(x for x in known if x in labels)
        if self._df is None:
            return Traversal(self.graph, None, self.kind, kept, True, unique=self.unique, start=self._start)
        if self.kind == "vertex" and not self.loaded:
            last = self._last.ending_at(self.graph.vertices(kept)) if self._last is not None else None
            return self._new(labels=kept)._load()._new(last=last)
        return self._new(self.df.where(F.col("_label").isin(list(labels))), labels=kept)

    def hasId(self, *ids) -> "Traversal":
        flat = [i for x in ids for i in (x if isinstance(x, (list, tuple, set)) else [x])]
        return self._new(self.df.where(F.col("_id").isin(flat)))

    def hasKey(self, *keys: str) -> "Traversal":
        return self._new(self.df.where(F.col("_key").isin(list(keys))))

    def hasValue(self, *values) -> "Traversal":
        return self._new(self.df.where(F.col("_value").isin([str(v) for v in values])))

    def is_(self, value) -> "Traversal":
        c = self._current
        return self._new(self.df.where(holds(self._predicate(value), F.col(c), self.df.schema[c].dataType)))

    def _keys(self) -> list[str]:
        """What a sub-traversal can depend on: where the traverser is, and what its labels name."""
        here = [c for c in ("_id", "_value", "_src", "_dst", "_prev", "_loops") if c in self.df.columns and (c != "_value" or self.kind != "map")]
        return here + [c for c in self.df.columns if c.startswith("_as_") or c in self.scope]

    def _sub(self, sub: Anonymous | Callable) -> tuple["Traversal", list[str]]:
        """Results of a sub-traversal with the columns ``_k0``... of the state that each began from."""
        keys = self._keys()
        named = [f"_k{len(self.scope)}_{i}" for i in range(len(keys))]
        extra = [] if self.kind == "vertex" and not self.loaded else [c for c in self.df.columns if c not in keys and (c == "_label" or not c.startswith("_"))]
        starts = self.df.select(*keys, *extra)
        starts = starts if self.unique and keys == ["_id"] else starts.dropDuplicates(keys)
        starts = starts.select("*", *[F.col(k).alias(n) for k, n in zip(keys, named)]).withColumn("_path", F.array(F.col(self._current).cast("string")))
        begun = Traversal(self.graph, starts, self.kind, self.labels, self.loaded, (*[c for c in self.scope if c in keys], *named), (), starts.select(*named), self.side, True)
        return (sub.apply(begun) if isinstance(sub, Anonymous) else sub(begun)), named

    def _match(self, df: DataFrame, named: list[str], how: str) -> DataFrame:
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(self._keys(), named)])
        return self.df.join(df, on, how)

    def where(self, first, second: P | None = None) -> "Traversal":
        """where(sub-traversal), where(P of a step label) or where(step label, P of another)."""
        if isinstance(first, (Anonymous,)) or callable(first) and not isinstance(first, P):
            found, named = self._sub(first)
            return self._new(self._match(found.df.select(*named).distinct(), named, "left_semi"), order=self._order)
        here = F.col(self._current) if second is None else F.col(f"_as_{first}")
        p = first if second is None else second
        plain = self._last is not None and second is None and p.name == "neq" and self.df.schema["_id"].dataType == self.df.schema[f"_as_{p.value}"].dataType
        return self._new(self.df.where(self._against_label(p, here)), last=self._apart_from(f"_as_{p.value}") if plain else None)

    def _against_label(self, p: P, here: Column) -> Column:
        """A comparison whose value is a step label."""
        other = F.col(f"_as_{p.value}")
        compare = {"eq": here == other, "neq": here != other, "lt": here < other, "lte": here <= other, "gt": here > other, "gte": here >= other}
        return F.coalesce(compare[p.name], F.lit(False))

    filter = where

    def not_(self, sub) -> "Traversal":
        found, named = self._sub(sub)
        return self._new(self._match(found.df.select(*named).distinct(), named, "left_anti"), order=self._order)

    def and_(self, *subs) -> "Traversal":
        return reduce(lambda t, s: t.where(s), subs, self)

    def or_(self, *subs) -> "Traversal":
        ends = []
        for s in subs:
            found, named = self._sub(s)
            ends.append(found.df.select(*named))
        return self._new(self._match(reduce(DataFrame.union, ends).distinct(), named, "left_semi"))

    def simplePath(self) -> "Traversal":
        return self._new(self.df.where(F.size(F.array_distinct("_path")) == F.size("_path")), last=self._apart_from("_path"))

    def cyclicPath(self) -> "Traversal":
        return self._new(self.df.where(F.size(F.array_distinct("_path")) < F.size("_path")), last=self._apart_from("_path", met=True))

    def _apart_from(self, column: str, met: bool = False) -> LastHop | None:
        """The last hop with a filter, if it has none yet."""
        return replace(self._last, apart=column, met=met) if self._last is not None and self._last.apart is None else None

    def coin(self, probability: float, seed: int = 42) -> "Traversal":
        return self._new(self.df.sample(probability, seed))

    def sample(self, n: int, seed: int = 42) -> "Traversal":
        return self._new(self.df.orderBy(F.rand(seed)).limit(n))

    def dedup(self, *labels: str, by: str | None = None) -> "Traversal":
        t = self._load() if by else self
        keys = [f"_as_{x}" for x in labels] or [t._column(by)[0] if by else F.col(t._current)]
        if by:
            return t._new(t.df.withColumn("_by", keys[0]).dropDuplicates([*t.scope, "_by"]).drop("_by"))
        names = keys if labels else [t._current]
        return t._new(t.df.dropDuplicates([*t.scope, *names]), order=self._order)

    # ---- order and ranges --------------------------------------------------------------------------------

    def order(self) -> "Traversal":
        return self._new(order=(None,))

    def by(self, key=None, direction: str = ASC) -> "Traversal":
        """A key of the order() before: a property, id, label, or nothing for the value itself. Missing keys come last."""
        if key in (ASC, DESC):
            key, direction = None, key
        t = self._load() if key is not None else self
        if isinstance(key, Anonymous):
            found, named = t._sub(key)
            value = found.df.groupBy(*named).agg(F.first(found._current).alias(f"_o{len(self._order)}"))
            t = t._new(t._match(value, named, "left").drop(*named))
            column = F.col(f"_o{len(self._order)}")
        else:
            column = F.col(t._current) if key is None else t._column(key)[0]
        keys = (*(x for x in self._order if x is not None), (column, direction))
        df = t.df if t.scope else t.df.orderBy(*map(_sort_key, keys))
        return t._new(df, order=keys)

    def range_(self, low: int, high: int) -> "Traversal":
        keys = tuple(x for x in self._order if x is not None)
        if self.scope:  # within each start of a sub-traversal
            w = Window.partitionBy(*self.scope).orderBy(*(map(_sort_key, keys) if keys else (F.col(self._current),)))
            df = self.df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") > low)
            return self._new((df.where(F.col("_rn") <= high) if high >= 0 else df).drop("_rn"))
        df = self.df.offset(low) if low else self.df
        return self._new(df.limit(high - low) if high >= 0 else df, order=self._order)

    def limit(self, n: int) -> "Traversal":
        return self.range_(0, n)

    def skip(self, n: int) -> "Traversal":
        return self.range_(n, -1)

    def tail(self, n: int = 1) -> "Traversal":
        """The last n of the order before (of the ids or values where there is none)."""
        keys = [x for x in self._order if x is not None] or [(F.col(self._current), ASC)]
        if self.scope:
            w = Window.partitionBy(*self.scope)
            df = self.df.withColumn("_rn", F.row_number().over(w.orderBy(*map(_sort_key, keys)))).withColumn("_n", F.count("*").over(w))
            return self._new(df.where(F.col("_rn") > F.col("_n") - n).drop("_rn", "_n"))
        return self._new(self.df.orderBy(*(c.asc_nulls_first() if d == DESC else c.desc_nulls_first() for c, d in keys)).limit(n))

    # ---- values ------------------------------------------------------------------------------------------

    def _single(self, value: Column, kind: str = "value") -> "Traversal":
        return self._new(self.df.select(*self.carried, value.alias("_value")), kind=kind, labels=(), loaded=True)

    def values(self, *keys: str) -> "Traversal":
        t = self._load()
        names = [k for k in (keys or t.properties_here) if k in t.df.columns]
        kinds = {k: t.df.schema[k].dataType for k in names}
        inner = {x.elementType if isinstance(x, T.ArrayType) else x for x in kinds.values()}
        one = next(iter(inner)) if len(inner) == 1 else T.StringType()
        if not names:
            return t._single(F.lit(None).cast("string"))._new(t.df.limit(0).select(*t.carried, F.lit(None).cast("string").alias("_value")), kind="value")
        lists = [F.coalesce(F.col(f"`{k}`").cast(T.ArrayType(one)), F.array().cast(T.ArrayType(one))) if isinstance(kinds[k], T.ArrayType) else F.array(F.col(f"`{k}`").cast(one)) for k in names]
        if len(names) == 1 and not isinstance(kinds[names[0]], T.ArrayType):
            df = t.df.where(F.col(f"`{names[0]}`").isNotNull()).select(*t.carried, F.col(f"`{names[0]}`").alias("_value"))
        else:
            df = t.df.select(*t.carried, F.explode(F.concat(*lists)).alias("_value")).where(F.col("_value").isNotNull())
        return t._new(t._walk(df, "_value"), kind="value", labels=(), loaded=True, order=self._order)

    def properties(self, *keys: str) -> "Traversal":
        t = self._load()
        names = [k for k in (keys or t.properties_here) if k in t.df.columns]
        pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"`{k}`").cast("string").alias("value")) for k in names])
        df = t.df.select(*t.carried, F.explode(pairs).alias("p")).where("p.value is not null")
        return t._new(df.select(*t.carried, F.col("p.key").alias("_key"), F.col("p.value").alias("_value")), kind="property", labels=(), loaded=True)

    def _map(self, keys: tuple[str, ...], tokens: bool) -> "Traversal":
        t = self._load()
        names = [k for k in (keys or t.properties_here) if k in t.df.columns]
        pairs = [F.struct(F.lit(k).alias("key"), F.col(f"`{k}`").cast("string").alias("value")) for k in names]
        if tokens:
            pairs = [F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for k, c in (("id", "_id"), ("label", "_label"))] + pairs
        value = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))
        return t._single(value, "map")

    def valueMap(self, *keys: str) -> "Traversal":
        return self._map(keys, False)

    def propertyMap(self, *keys: str) -> "Traversal":
        return self._map(keys, False)

    def elementMap(self, *keys: str) -> "Traversal":
        return self._map(keys, True)

    def id(self) -> "Traversal":
        return self._single(F.col("_id"))

    def label(self) -> "Traversal":
        t = self._load()
        return t._single(F.col("_label"))

    def key(self) -> "Traversal":
        return self._single(F.col("_key"))

    def value(self) -> "Traversal":
        return self._single(F.col("_value"))

    def constant(self, value) -> "Traversal":
        return self._single(F.lit(value))

    def map_(self, function: Callable[[Column], Column]) -> "Traversal":
        """A function of the current id or value, as a column expression (which may call a pandas UDF)."""
        return self._single(function(F.col(self._current)))

    def flatMap(self, sub) -> "Traversal":
        if isinstance(sub, Anonymous):
            return self.local(sub)
        return self._single(F.explode(sub(F.col(self._current))))

    def identity(self) -> "Traversal":
        return self

    def math(self, expression: str, **named: str) -> "Traversal":
        """An arithmetic expression; ``_`` is the current value and other names are step labels or properties."""
        t = self._load() if named else self
        known = {"_": t._current} | {c[4:]: c for c in t.df.columns if c.startswith("_as_")} | named
        out = re.sub(r"[A-Za-z_]\w*(?!\w*\s*\()", lambda m: f"`{known[m[0]]}`" if m[0] in known else m[0], expression)
        return t._single(F.expr(out).cast("double"))

    def inject(self, *values) -> "Traversal":
        more = self.graph.spark.createDataFrame([(v,) for v in values], ["_value"])
        return self._new(self.df.select(F.col(self._current).alias("_value")).unionByName(more), kind="value", labels=(), loaded=True)

    def withSack(self, value) -> "Traversal":
        return self._new(self.df.withColumn("_sack", F.lit(value)))

    def sack(self, function: Callable[[Column, Column], Column] | None = None, by: str | None = None) -> "Traversal":
        """Without arguments the sack's value; else update it from a property."""
        if function is None:
            return self._single(F.col("_sack"))
        t = self._load()
        return t._new(t.df.withColumn("_sack", function(F.col("_sack"), t._column(by)[0])))

    # ---- reducers ----------------------------------------------------------------------------------------

    def _reduce(self, aggregate: Column, empty_row: bool) -> "Traversal":
        if self.scope:
            got = self.df.groupBy(*self.scope).agg(aggregate.alias("_value"))
            if empty_row and self._starts is not None:
                own = self._starts.columns
                on = reduce(lambda a, b: a & b, [self._starts[c].eqNullSafe(got[c]) for c in own])
                got = self._starts.join(got, on, "left").select(*[self._starts[c] for c in own], F.coalesce("_value", F.lit(0)).alias("_value"))
            return self._new(got if empty_row else got.where(F.col("_value").isNotNull()), kind="value", labels=(), loaded=True)
        got = self.df.agg(aggregate.alias("_value"))
        return self._new(got if empty_row else got.where(F.col("_value").isNotNull()), kind="value", labels=(), loaded=True)

    def count(self) -> "Traversal":
        counted = self._counted()
        if counted is not None:
            return self._new(counted.agg(F.coalesce(F.sum("_bulk"), F.lit(0)).alias("_value")), kind="value", labels=(), loaded=True)
        return self._reduce(F.count("*"), True)

    def _counted(self, *columns: str) -> DataFrame | None:
        """Rows with ``_bulk`` that stand for the traversers, where they need not be made."""
        if self._tallied is not None or self.scope or self._last is None or self._last.apart is None:
            return self._tallied
        return self._last.tally(*columns)

    def sum_(self) -> "Traversal":
        return self._reduce(F.sum("_value"), False)

    def max_(self) -> "Traversal":
        return self._reduce(F.max("_value"), False)

    def min_(self) -> "Traversal":
        return self._reduce(F.min("_value"), False)

    def mean(self) -> "Traversal":
        return self._reduce(F.avg("_value"), False)

    def fold(self) -> "Traversal":
        return self._reduce(F.collect_list(F.col(self._current)), False)

    def unfold(self) -> "Traversal":
        return self._new(self.df.select(*self.carried, F.explode("_value").alias("_value")), kind="value")

    def _by(self, by, into: str) -> "Traversal":
        """``self`` with the value of a modulator: a property, id, label, a sub-traversal's first result, or the current value."""
        if isinstance(by, Anonymous):
            found, named = self._sub(by)
            value = found.df.groupBy(*named).agg(F.first(found._current).alias(into))
            return self._new(self._match(value, named, "left").drop(*named))
        t = self._load() if by is not None else self
        return t._new(t.df.withColumn(into, F.col(t._current) if by is None else t._column(by)[0]))

    def group(self, by=None, value: str | None = None, reduce_with: Callable[[Column], Column] | None = None) -> "Traversal":
        """One row per group: ``_key`` and ``_value`` (collected unless ``reduce_with`` aggregates it)."""
        t = self._by(by, "_key")
        t = t._by(value, "_member")
        made = (reduce_with or F.collect_list)(F.col("_member"))
        return t._new(t.df.groupBy(*t.scope, "_key").agg(made.alias("_value")), kind="value", labels=(), loaded=True)

    def groupCount(self, by=None) -> "Traversal":
        if by is None and self._tallied is not None:
            counted = self._tallied.groupBy(F.col(self._current).alias("_key")).agg(F.sum("_bulk").alias("_value"))
            return self._new(counted, kind="value", labels=(), loaded=True)
        t = self._by(by, "_key")
        return t._new(t.df.groupBy(*t.scope, "_key").agg(F.count("*").alias("_value")), kind="value", labels=(), loaded=True)

    # ---- memory ------------------------------------------------------------------------------------------

    def as_(self, label: str) -> "Traversal":
        return self._new(self.df.withColumn(f"_as_{label}", F.col(self._current)), order=self._order)

    def select(self, *labels: str, by=None) -> "Traversal":
        """What labels name: the element or value itself for one of them, else a column each; ``by``: a property each."""
        by = by if isinstance(by, (list, tuple)) else [by] * len(labels)
        t, tallied = self, self._counted(f"_as_{labels[0]}") if len(labels) == 1 and self._tallied is None else None
        for label, key in zip(labels, by):
            if key is not None:
                table = self._values_of(key, t.df.schema[f"_as_{label}"].dataType).withColumnsRenamed({"id": "_vid", "value": f"_by_{label}"})
                t = t._new(t.df.join(table, F.col(f"_as_{label}") == F.col("_vid"), "left").drop("_vid"))
                tallied = tallied.join(table, F.col(f"_as_{label}") == F.col("_vid"), "left") if tallied is not None else None
        columns = {x: F.col(f"_as_{x}" if k is None else f"_by_{x}") for x, k in zip(labels, by)}
        if len(labels) == 1:
            vertex = by[0] is None and self.kind == "vertex"
            tallied = tallied.select(columns[labels[0]].alias("_id" if vertex else "_value"), "_bulk") if tallied is not None else None
            if vertex:
                return t._new(t.df.select(*t.carried, columns[labels[0]].alias("_id")), kind="vertex", labels=None, loaded=False, tallied=tallied)
            t = t._single(columns[labels[0]])
            return t._new(kind="value", tallied=tallied)
        return t._single(F.struct(*[c.alias(x) for x, c in columns.items()]), "map")

    def _values_of(self, key: str, kind: T.DataType) -> DataFrame:
        """(id, value): a property of the elements whose ids are of this type, from the tables that have it."""
        g, own = self.graph, {"id": "id", "T.id": "id", "label": "label", "T.label": "label"}.get(key, key)
        if isinstance(kind, T.StringType) and any(own == "id" or own == "label" or own in g.edge_tables[x].columns for x in g.edge_tables):
            labels = tuple(x for x in g.edge_tables if own in ("id", "label") or own in g.edge_tables[x].columns)
            return g.edges(labels).select("id", F.col(f"`{own}`").alias("value"))
        labels = tuple(x for x in g.vertex_tables if own in ("id", "label") or own in g.vertex_tables[x].columns)
        return g.vertices(labels).select("id", (F.col(f"`{own}`") if labels else F.lit(None).cast("string")).alias("value"))

    def project(self, *names: str, by: list) -> "Traversal":
        t = self
        for name, key in zip(names, by):
            t = t._by(key, f"_by_{name}")
        return t._single(F.struct(*[F.col(f"_by_{n}").alias(n) for n in names]), "map")

    def path(self) -> "Traversal":
        return self._single(F.col("_path"))

    def tree(self) -> "Traversal":
        """Edges of the paths' tree: (prefix, child, number of paths)."""
        steps = self.df.select(F.expr("explode(transform(sequence(1, size(_path)), i -> struct(slice(_path, 1, i - 1) as prefix, _path[i - 1] as child)))").alias("s"))
        return self._new(steps.groupBy("s.prefix", "s.child").agg(F.count("*").alias("_value")), kind="value", scope=())

    def subgraph(self) -> Graph:
        """The graph of the current edges and their ends."""
        edges = {x: self.df.where(F.col("_label") == x).select(F.col("_id").alias("id"), F.col("_src").alias("src"), F.col("_dst").alias("dst"), *self.graph.edge_properties((x,))).dropDuplicates(["id"]) for x in self.labels}
        ids = self.df.select(F.explode(F.array("_src", "_dst")).alias("id")).distinct()
        vertices = {x: t.join(ids, "id", "left_semi") for x, t in self.graph.vertex_tables.items()}
        return Graph(vertices, edges, self.graph.ends, self.graph.schema)

    def aggregate(self, name: str) -> "Traversal":
        self.side[name] = self.df.select(F.col(self._current).alias("_value"))
        return self

    store = aggregate

    def cap(self, name: str) -> "Traversal":
        return Traversal(self.graph, self.side[name], "value", (), True, side=self.side)

    def sideEffect(self, function: Callable[["Traversal"], None]) -> "Traversal":
        function(self)
        return self

    # ---- branches ----------------------------------------------------------------------------------------

    def _together(self, parts: list["Traversal"]) -> "Traversal":
        kinds = {p.kind for p in parts}
        if kinds == {"vertex"}:
            parts = [p._load() for p in parts] if any(p.loaded for p in parts) else parts
            labels = None if any(p.labels is None for p in parts) else tuple(dict.fromkeys(x for p in parts for x in p.labels))
            df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.df for p in parts])
            return parts[0]._new(df, labels=labels, unique=False)
        if len(kinds) == 1:
            return parts[0]._new(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.df for p in parts]), unique=False)
        values = [p.df.select(*[c for c in p.carried if c in parts[0].carried], F.col(p._current).cast("string").alias("_value")) for p in parts]
        return parts[0]._new(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), values), kind="value", labels=(), loaded=True)

    def union(self, *subs) -> "Traversal":
        return self._together([s.apply(self) for s in subs])

    def _without_result(self, sub) -> "Traversal":
        return self.not_(sub)

    def _branch(self, sub: Anonymous) -> "Traversal":
        """A branch's results, traverser by traverser."""
        return self.local(sub) if sub.has_barrier else sub.apply(self)

    def optional(self, sub) -> "Traversal":
        return self._together([self._branch(sub), self._without_result(sub)])

    def coalesce(self, *subs) -> "Traversal":
        """The results of the first branch that has any, traverser by traverser."""
        left, parts = self, []
        for s in subs:
            parts.append(left._branch(s))
            left = left._without_result(s)
        return self._together(parts)

    def choose(self, condition, then=None, otherwise=None, options: dict | None = None) -> "Traversal":
        """choose(P or sub-traversal, then, otherwise), or choose(property, options={value: branch, None: default})."""
        if options is not None:
            t = self._load()
            named = {k: s for k, s in options.items() if k is not None}
            parts = [s.apply(t.has(condition, Pr.eq(k))) for k, s in named.items()]
            column, kind = t._column(condition)
            rest = t._new(t.df.where(~holds(Pr.within(list(named)), column, kind)))
            parts.append(options[None].apply(rest) if None in options else rest)
            return self._together(parts)
        yes = self.is_(condition) if isinstance(condition, P) else self.where(condition)
        if isinstance(condition, P):
            c = self._current
            no = self._new(self.df.where(~holds(condition, F.col(c), self.df.schema[c].dataType)))
        else:
            no = self.not_(condition)
        return self._together([then.apply(yes), otherwise.apply(no) if otherwise else no])

    def local(self, sub) -> "Traversal":
        """A sub-traversal for each traverser by itself; order, limits and reducers in it are its own."""
        found, named = self._sub(sub)
        keys = self._keys()
        kept = [c for c in self.carried if c != "_path" and c not in found.df.columns]
        mine = self.df.select(*[F.col(k).alias(f"_m{n}") for k, n in zip(keys, named)], *kept)
        on = reduce(lambda a, b: a & b, [F.col(f"_m{n}").eqNullSafe(F.col(n)) for n in named])
        df = mine.join(found.df, on).select(*kept, *[c for c in found.df.columns if c not in named])
        return found._new(df, scope=self.scope, starts=self._starts, unique=False)

    def repeat(self, sub, times: int | None = None, until=None, emit: bool | Anonymous | P | None = None, max_loops: int = MAX_LOOPS, checkpoint: Callable[[DataFrame], DataFrame] | None = None) -> "Traversal":
        """do-while: the body, then ``until`` takes traversers out; ``emit`` also gives those that go on.

        ``checkpoint``: how to cut the lineage of a loop's frontier (a function that writes and reads a table).
        """
        now, done = self, []
        now = now._new(now.df.withColumn("_loops", F.lit(0)))
        for k in range(times if times is not None else max_loops):
            now = sub.apply(now)
            if "_loops" in now.df.columns:
                now = now._new(now.df.withColumn("_loops", F.lit(k + 1)), order=now._order)
            if checkpoint is not None:
                now = now._new(checkpoint(now.df))
            if until is not None:
                done.append(now.where(until))
                now = now.not_(until)
            last = times is not None and k == times - 1
            if emit is not None and emit is not False and not last:
                done.append(now if emit is True else now.where(emit))
            if times is None and now.df.isEmpty():
                break
        else:
            if times is None:
                raise RuntimeError(f"traversers still loop after {max_loops} rounds; give a greater max_loops")
        if times is not None:
            done.append(now if emit in (None, False, True) else now.where(emit))
        out = self._together(done)
        return out._new(out.df.drop("_loops"))

    def loops(self) -> "Traversal":
        return self._single(F.col("_loops"))

    def match(self, *patterns: tuple[str, Anonymous, str]) -> "Traversal":
        """Patterns (from label, sub-traversal, to label), joined on their labels; the first one's start is here."""
        t = self.as_(patterns[0][0])
        bound = {patterns[0][0]}
        for start, sub, end in patterns:
            if start not in bound:
                raise ValueError(f"pattern begins from {start}, which no earlier pattern binds")
            at = t._new(t.df.select(*t.carried, F.col(f"_as_{start}").alias("_id")), kind="vertex", labels=None, loaded=False)
            moved = sub.apply(at)
            if end in bound:
                t = moved._new(moved.df.where(F.col(moved._current) == F.col(f"_as_{end}")))
            else:
                t = moved.as_(end)
                bound.add(end)
        return t

    # ---- graph algorithms and changes --------------------------------------------------------------------

    def drop(self) -> Graph:
        """The graph without the current elements; a vertex takes its edges along."""
        from ..operators.mutations import drop_edges, drop_vertices

        return (drop_vertices if self.kind == "vertex" else drop_edges)(self.graph, self.df.select("_id").distinct().withColumnRenamed("_id", "id"))

    def _with_result(self, result: DataFrame, name: str) -> "Traversal":
        t = self._load()
        return t._new(t.df.join(result.withColumnRenamed("id", "_id"), "_id", "left"))

    def pageRank(self, **options) -> "Traversal":
        from ..operators.olap import page_rank

        return self._with_result(page_rank(self.graph, **options), "rank")

    def connectedComponent(self, **options) -> "Traversal":
        from ..operators.olap import connected_components

        return self._with_result(connected_components(self.graph, **options), "component")

    def peerPressure(self, **options) -> "Traversal":
        from ..operators.olap import peer_pressure

        return self._with_result(peer_pressure(self.graph, **options), "cluster")

    def shortestPath(self, target=None, edge_labels: tuple[str, ...] = (), max_depth: int = 10) -> "Traversal":
        from ..operators.olap import shortest_paths

        ends = target.apply(self.graph.traversal().V()).df.select("_id").distinct() if target is not None else None
        found = shortest_paths(self.graph, self.df.select("_id").distinct(), edge_labels, max_depth, ends)
        return Traversal(self.graph, found.withColumn("_value", F.col("path")), "value", (), True)

    def barrier(self) -> "Traversal":
        return self

    def profile(self) -> str:
        return self.explain()

    def explain(self) -> str:
        return self.df._jdf.queryExecution().explainString(self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    # ---- ends --------------------------------------------------------------------------------------------

    def result(self, **names: str) -> DataFrame:
        """The current values as a DataFrame; ``names``: new name = column (properties, or 'id', 'label', 'value', 'key')."""
        t = self._load() if any(v not in self.df.columns and v not in ("id", "value", "key") for v in names.values()) else self
        at = {"id": "_id", "label": "_label", "value": "_value", "key": "_key", "src": "_src", "dst": "_dst", "path": "_path"}
        if not names:
            return t.df.select(F.col(t._current).alias("value"))
        return t.df.select(*[F.col(at.get(v, v) if at.get(v, v) in t.df.columns else f"_as_{v}").alias(k) for k, v in names.items()])

    def toList(self) -> list:
        return [r[0] for r in self.df.select(self._current).collect()]

    def next(self):
        row = self.df.select(self._current).first()
        if row is None:
            raise StopIteration
        return row[0]

    def tryNext(self):
        row = self.df.select(self._current).first()
        return None if row is None else row[0]

    def hasNext(self) -> bool:
        return not self.df.isEmpty()

    def iterate(self) -> "Traversal":
        self.df.write.format("noop").mode("overwrite").save()
        return self


def _sort_key(item: tuple[Column, str]) -> Column:
    """Missing keys come last in either direction."""
    column, direction = item
    return column.desc_nulls_last() if direction == DESC else column.asc_nulls_last()
