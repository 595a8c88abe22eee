"""The graph model: labelled vertex and edge tables seen as one property graph.

A vertex table has ``id`` and property columns; an edge table has ``src``, ``dst``, property columns and possibly
``id``. Tables stay apart by label until a plan needs several, so a filter by label prunes whole tables, and
Catalyst prunes columns and pushes filters into each scan.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import GraphSchema

VERTEX_COLUMNS = ("id", "label")
EDGE_COLUMNS = ("id", "label", "src", "dst")


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


@dataclass(frozen=True)
class Graph:
    vertex_tables: Mapping[str, DataFrame]
    edge_tables: Mapping[str, DataFrame]
    #: Edge label -> (labels of its sources, labels of its targets); all labels where it has no entry.
    ends: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = field(default_factory=dict)
    schema: GraphSchema = field(default_factory=GraphSchema)

    @property
    def spark(self):
        tables = self.vertex_tables or self.edge_tables
        return tables[next(iter(tables))].sparkSession

    def vertices(self, labels: tuple[str, ...] | None = None) -> DataFrame:
        """(id, label, properties) of the given labels, or of all."""
        chosen = [x for x in (labels if labels is not None else self.vertex_tables) if x in self.vertex_tables]
        if not chosen:
            return self.vertices().limit(0) if self.vertex_tables else self.spark.createDataFrame([], "id long, label string")
        return _union([self.vertex_tables[x].select("id", F.lit(x).alias("label"), *self._properties(self.vertex_tables[x], VERTEX_COLUMNS)) for x in chosen])

    def edges(self, labels: tuple[str, ...] | None = None, properties: bool = True) -> DataFrame:
        """(id, label, src, dst, properties); with ``properties`` false, src and dst alone."""
        chosen = [x for x in (labels or self.edge_tables) if x in self.edge_tables]
        if not self.edge_tables:
            return self.spark.createDataFrame([], "id string, label string, src long, dst long").select(*(["*"] if properties else ["src", "dst"]))
        if not chosen:
            return self.edges().limit(0).select(*([] if properties else ["src", "dst"]) or ["*"])
        if not properties:
            return _union([self.edge_tables[x].select("src", "dst") for x in chosen])
        return _union([self._edge_table(x) for x in chosen])

    def _edge_table(self, label: str) -> DataFrame:
        df = self.edge_tables[label]
        return df.select(self.edge_id(label).alias("id"), F.lit(label).alias("label"), "src", "dst", *self._properties(df, EDGE_COLUMNS))

    def edge_id(self, label: str) -> Column:
        """An edge's id: the table's own, else its label and ends, and where a label allows parallel edges also a hash of
        its properties (edges alike in all of them need ids of their own: ``mutations.with_edge_ids``)."""
        df = self.edge_tables[label]
        if "id" in df.columns:
            return F.col("id").cast("string")
        parts = [F.lit(label), F.col("src").cast("string"), F.col("dst").cast("string")]
        rule, properties = self.schema.edge_labels.get(label), self._properties(df, EDGE_COLUMNS)
        if properties and (rule is None or rule.multiplicity == "MULTI"):
            parts.append(F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in properties])))
        return F.concat_ws("-", *parts)

    @staticmethod
    def _properties(df: DataFrame, reserved: tuple[str, ...]) -> list[str]:
        return [c for c in df.columns if c not in reserved]

    def vertex_properties(self, labels: tuple[str, ...] | None = None) -> list[str]:
        tables = [self.vertex_tables[x] for x in (labels or self.vertex_tables) if x in self.vertex_tables]
        return list(dict.fromkeys(c for t in tables for c in self._properties(t, VERTEX_COLUMNS)))

    def edge_properties(self, labels: tuple[str, ...] | None = None) -> list[str]:
        tables = [self.edge_tables[x] for x in (labels or self.edge_tables) if x in self.edge_tables]
        return list(dict.fromkeys(c for t in tables for c in self._properties(t, EDGE_COLUMNS)))

    def end_labels(self, edge_labels: tuple[str, ...], out: bool) -> tuple[str, ...] | None:
        """Labels that the sources (``out`` false) or targets of these edges can have; None: any."""
        found: list[str] = []
        for x in edge_labels or tuple(self.edge_tables):
            if x not in self.ends:
                return None
            found += self.ends[x][1 if out else 0]
        return tuple(dict.fromkeys(found))

    def with_vertices(self, label: str, table: DataFrame) -> "Graph":
        return replace(self, vertex_tables={**self.vertex_tables, label: table})

    def with_edges(self, label: str, table: DataFrame, ends: tuple[tuple[str, ...], tuple[str, ...]] | None = None) -> "Graph":
        return replace(self, edge_tables={**self.edge_tables, label: table}, ends={**self.ends, **({label: ends} if ends else {})})

    def traversal(self):
        """The source of traversals: ``graph.traversal().V()``."""
        from .traversal import GraphTraversalSource

        return GraphTraversalSource(self)
