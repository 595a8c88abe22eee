"""Native queries: graph-centric (over all elements) and vertex-centric (incident relations of many vertices)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates as Pr
from ..functions.predicates import P, holds
from .graph import EDGE_COLUMNS, VERTEX_COLUMNS, Graph


class ScanNotAllowed(RuntimeError):
    """force-index: a query without a condition on an indexed key."""


def _value(value) -> P:
    return value if isinstance(value, P) else Pr.eq(value)


class GraphQuery:
    """``has`` conditions are ANDed, each ``or_`` is an OR of ANDs; results are sorted with missing keys last."""

    def __init__(self, graph: Graph, force_index: bool = False):
        self.graph, self.force_index = graph, force_index
        self.conditions: list[tuple[str, P]] = []
        self.any_of: list[tuple["GraphQuery", ...]] = []
        self.orders: list[tuple[str, str]] = []
        self.size: int | None = None

    def has(self, key: str, predicate=..., value=...) -> "GraphQuery":
        p = Pr.neq(None) if predicate is ... else _value(predicate) if value is ... else predicate(value)
        self.conditions.append((key, p))
        return self

    def hasNot(self, key: str, value=...) -> "GraphQuery":
        self.conditions.append((key, Pr.eq(None) if value is ... else Pr.neq(value)))
        return self

    def interval(self, key: str, start, end) -> "GraphQuery":
        """start <= value < end"""
        return self.has(key, Pr.between(start, end))

    def or_(self, *queries: "GraphQuery") -> "GraphQuery":
        self.any_of.append(queries)
        return self

    def orderBy(self, key: str, order: str = "asc") -> "GraphQuery":
        self.orders.append((key, order))
        return self

    def limit(self, n: int) -> "GraphQuery":
        self.size = n
        return self

    def _condition(self, df: DataFrame) -> Column:
        parts = [F.lit(True)]
        for key, p in self.conditions:
            if key in df.columns:
                parts.append(holds(p, F.col(f"`{key}`"), df.schema[key].dataType))
            else:  # a key that no element has: only a test for its absence holds
                parts.append(holds(p, F.lit(None).cast("string"), T.StringType()))
        parts += [reduce(lambda a, b: a | b, (q._condition(df) for q in queries)) for queries in self.any_of if queries]
        return reduce(lambda a, b: a & b, parts)

    def _run(self, df: DataFrame) -> DataFrame:
        if self.force_index:
            indexed = {k for i in self.graph.schema.indexes.values() if i.status == "ENABLED" for k in i.keys}
            if not indexed & {k for k, _ in self.conditions}:
                raise ScanNotAllowed("no enabled index fits the query")
        df = df.where(self._condition(df))
        if self.orders:
            df = df.orderBy(*[F.col(k).desc_nulls_last() if o == "desc" else F.col(k).asc_nulls_last() for k, o in self.orders])
        return df if self.size is None else df.limit(self.size)

    def vertices(self) -> DataFrame:
        return self._run(self.graph.vertices())

    def edges(self) -> DataFrame:
        return self._run(self.graph.edges())

    def properties(self) -> DataFrame:
        """(id, key, value) of the vertices found."""
        return explode_properties(self.vertices(), VERTEX_COLUMNS)

    def count(self) -> DataFrame:
        """One row: of those found, or of the limit if that is less."""
        return self.vertices().agg(F.count("*").alias("count"))

    def aggregate(self, kind: str, key: str) -> DataFrame:
        """COUNT, MIN, MAX, AVG or SUM of a key over those found."""
        call: Callable = {"COUNT": F.count, "MIN": F.min, "MAX": F.max, "AVG": F.avg, "SUM": F.sum}[kind]
        return self.vertices().agg(call(F.col(key)).alias(kind.lower()))

    def explain(self) -> None:
        self.vertices().explain("formatted")


def explode_properties(df: DataFrame, reserved: tuple[str, ...]) -> DataFrame:
    names = [c for c in df.columns if c not in reserved]
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"`{n}`").cast("string").alias("value")) for n in names])
    return df.select("id", F.explode(pairs).alias("p")).where("p.value is not null").select("id", "p.key", "p.value")


class VertexQuery:
    """Relations at a set of vertices (a DataFrame with a column id; all vertices if None), for each by itself."""

    def __init__(self, graph: Graph, vertices: DataFrame | None = None):
        self.graph = graph
        self.at = (vertices if vertices is not None else graph.vertices()).select(F.col("id").alias("vertex"))
        self.names: tuple[str, ...] = ()
        self.side = "both"
        self.conditions: list[tuple[str, P]] = []
        self.near: list | None = None
        self.orders: list[tuple[str, str]] = []
        self.size: int | None = None

    def labels(self, *names: str) -> "VertexQuery":
        self.names = names
        return self

    types = keys = labels

    def direction(self, side: str) -> "VertexQuery":
        self.side = side.lower()
        return self

    def adjacent(self, *ids) -> "VertexQuery":
        self.near = list(ids)
        return self

    def has(self, key: str, predicate=..., value=...) -> "VertexQuery":
        self.conditions.append((key, Pr.neq(None) if predicate is ... else _value(predicate) if value is ... else predicate(value)))
        return self

    def hasNot(self, key: str, value=...) -> "VertexQuery":
        self.conditions.append((key, Pr.eq(None) if value is ... else Pr.neq(value)))
        return self

    def interval(self, key: str, start, end) -> "VertexQuery":
        return self.has(key, Pr.between(start, end))

    def orderBy(self, key: str, order: str = "asc") -> "VertexQuery":
        """Orders the relations of each vertex; further keys decide between equals of the earlier ones."""
        if any(o != order for _, o in self.orders):
            raise ValueError("the orders of a vertex query have one direction")
        self.orders.append((key, order))
        return self

    def limit(self, n: int) -> "VertexQuery":
        """At most n for each vertex."""
        self.size = n
        return self

    def edges(self) -> DataFrame:
        """(vertex, other, id, label, src, dst, properties); a loop comes twice in direction both."""
        e = self.graph.edges(self.names)
        parts = []
        if self.side in ("out", "both"):
            parts.append(self.at.join(e, self.at.vertex == e.src).withColumn("other", F.col("dst")))
        if self.side in ("in", "both"):
            parts.append(self.at.join(e, self.at.vertex == e.dst).withColumn("other", F.col("src")))
        df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        for key, p in self.conditions:
            kind = df.schema[key].dataType if key in df.columns else T.StringType()
            df = df.where(holds(p, F.col(f"`{key}`") if key in df.columns else F.lit(None).cast("string"), kind))
        if self.near is not None:
            df = df.where(F.col("other").isin(self.near))
        keys = [F.col(k).desc_nulls_last() if o == "desc" else F.col(k).asc_nulls_last() for k, o in self.orders] + [F.col("id")]
        if self.size is not None:
            w = Window.partitionBy("vertex").orderBy(*keys)
            df = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= self.size).drop("_rn")
        return df.orderBy("vertex", *keys) if self.orders else df

    relations = edges

    def vertexIds(self) -> DataFrame:
        return self.edges().select("vertex", F.col("other").alias("id"))

    def vertices(self) -> DataFrame:
        table = self.graph.vertices()
        return self.vertexIds().join(table, "id")

    def count(self) -> DataFrame:
        """(vertex, count), zeros included."""
        counted = self.edges().groupBy("vertex").agg(F.count("*").alias("count"))
        return self.at.join(counted, "vertex", "left").fillna(0, ["count"])

    edgeCount = count

    def properties(self) -> DataFrame:
        """(id, key, value) of the vertices; in direction in there are none."""
        found = explode_properties(self.graph.vertices().join(self.at.withColumnRenamed("vertex", "id"), "id", "left_semi"), VERTEX_COLUMNS)
        if self.names:
            found = found.where(F.col("key").isin(list(self.names)))
        return found.limit(0) if self.side == "in" else found

    def propertyCount(self) -> DataFrame:
        return self.properties().groupBy("id").agg(F.count("*").alias("count"))


def multi_query(graph: Graph, vertices: DataFrame) -> VertexQuery:
    """One query for many vertices: a single join."""
    return VertexQuery(graph, vertices)


__all__ = ["EDGE_COLUMNS", "GraphQuery", "ScanNotAllowed", "VertexQuery", "explode_properties", "multi_query"]
