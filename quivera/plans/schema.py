"""Schema: property keys, labels, cardinality, multiplicity, constraints, index lifecycle, and checks of data."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Data types of property keys.
TYPES: dict[str, T.DataType] = {
    "Byte": T.ByteType(),
    "Short": T.ShortType(),
    "Integer": T.IntegerType(),
    "Long": T.LongType(),
    "Float": T.FloatType(),
    "Double": T.DoubleType(),
    "Boolean": T.BooleanType(),
    "Character": T.StringType(),
    "String": T.StringType(),
    "UUID": T.StringType(),
    "Date": T.TimestampType(),
    "Instant": T.TimestampType(),
    "Duration": T.DayTimeIntervalType(),
    "byte[]": T.BinaryType(),
    "Geoshape": T.StructType(
        [T.StructField("type", T.StringType()), T.StructField("coords", T.ArrayType(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))), T.StructField("radius_km", T.DoubleType())]
    ),
}
#: Cardinalities of keys and multiplicities of edge labels.
CARDINALITIES = ("SINGLE", "LIST", "SET")
MULTIPLICITIES = ("MULTI", "SIMPLE", "MANY2ONE", "ONE2MANY", "ONE2ONE")
#: Index action -> (states it may start from, state it leads to).
ACTIONS = {
    "REGISTER_INDEX": (("INSTALLED",), "REGISTERED"),
    "REINDEX": (("REGISTERED", "ENABLED", "DISABLED"), "ENABLED"),
    "ENABLE_INDEX": (("REGISTERED", "DISABLED", "ENABLED"), "ENABLED"),
    "DISABLE_INDEX": (("ENABLED", "REGISTERED", "DISABLED"), "DISABLED"),
    "DISCARD_INDEX": (("DISABLED", "DISCARDED", "REGISTERED"), "DISCARDED"),
    "MARK_DISCARDED": (("DISABLED", "DISCARDED", "REGISTERED"), "DISCARDED"),
    "DROP_INDEX": (("DISCARDED",), "DROPPED"),
}


class SchemaViolation(ValueError):
    pass


@dataclass(frozen=True)
class PropertyKey:
    name: str
    data_type: str = "String"
    cardinality: str = "SINGLE"
    ttl_seconds: int | None = None

    def spark_type(self) -> T.DataType:
        one = TYPES[self.data_type]
        return one if self.cardinality == "SINGLE" else T.ArrayType(one)

    def field(self) -> T.StructField:
        return T.StructField(self.name, self.spark_type(), True, {"cardinality": self.cardinality})


@dataclass(frozen=True)
class EdgeLabel:
    name: str
    multiplicity: str = "MULTI"
    directed: bool = True
    connections: tuple[tuple[str, str], ...] = ()
    properties: tuple[str, ...] = ()
    ttl_seconds: int | None = None


@dataclass(frozen=True)
class VertexLabel:
    name: str
    static: bool = False
    partitioned: bool = False
    properties: tuple[str, ...] = ()
    ttl_seconds: int | None = None


@dataclass(frozen=True)
class Index:
    """Metadata only: Parquet statistics and partitions do an index's work; uniqueness is checked on data."""

    name: str
    keys: tuple[str, ...]
    element: str = "vertex"
    kind: str = "composite"
    unique: bool = False
    only_label: str | None = None
    status: str = "INSTALLED"

    def apply(self, action: str) -> "Index":
        sources, target = ACTIONS[action]
        if self.status not in sources:
            raise SchemaViolation(f"{action} of index {self.name} is not allowed in state {self.status}")
        return replace(self, status=target)


@dataclass(frozen=True)
class GraphSchema:
    keys: dict[str, PropertyKey] = field(default_factory=dict)
    edge_labels: dict[str, EdgeLabel] = field(default_factory=dict)
    vertex_labels: dict[str, VertexLabel] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)
    #: 'default' makes types on first use, 'ignore-prop' does so but for keys, 'none' asks for them up front.
    maker: str = "default"
    constraints: bool = False

    def with_key(self, key: PropertyKey) -> "GraphSchema":
        if key.data_type not in TYPES or key.cardinality not in CARDINALITIES:
            raise SchemaViolation(f"unknown type or cardinality of key {key.name}")
        self._new(key.name)
        return replace(self, keys={**self.keys, key.name: key})

    def with_edge_label(self, label: EdgeLabel) -> "GraphSchema":
        if label.multiplicity not in MULTIPLICITIES:
            raise SchemaViolation(f"unknown multiplicity of label {label.name}")
        self._new(label.name)
        return replace(self, edge_labels={**self.edge_labels, label.name: label})

    def with_vertex_label(self, label: VertexLabel) -> "GraphSchema":
        if label.name in self.vertex_labels:
            raise SchemaViolation(f"vertex label {label.name} exists")
        return replace(self, vertex_labels={**self.vertex_labels, label.name: label})

    def with_index(self, index: Index) -> "GraphSchema":
        if missing := [k for k in index.keys if k not in self.keys and self.maker == "none"]:
            raise SchemaViolation(f"no such keys: {missing}")
        return replace(self, indexes={**self.indexes, index.name: index})

    def update_index(self, name: str, action: str) -> "GraphSchema":
        return replace(self, indexes={**self.indexes, name: self.indexes[name].apply(action)})

    def rename(self, old: str, new: str) -> "GraphSchema":
        self._new(new)
        for kind in ("keys", "edge_labels", "vertex_labels"):
            types = getattr(self, kind)
            if old in types:
                return replace(self, **{kind: {**{k: v for k, v in types.items() if k != old}, new: replace(types[old], name=new)}})
        raise SchemaViolation(f"no such type: {old}")

    def _new(self, name: str) -> None:
        if name in self.keys or name in self.edge_labels:
            raise SchemaViolation(f"type {name} exists")

    def vertex_type(self, label: str) -> T.StructType:
        names = self.vertex_labels[label].properties or tuple(self.keys)
        return T.StructType([T.StructField("id", T.LongType(), False), *(self.keys[k].field() for k in names)])

    def describe(self) -> str:
        """The schema in print, as tables of lines."""
        out = ["Vertex labels", *(f"  {v.name} | partitioned {v.partitioned} | static {v.static}" for v in self.vertex_labels.values())]
        out += ["Edge labels", *(f"  {e.name} | directed {e.directed} | {e.multiplicity}" for e in self.edge_labels.values())]
        out += ["Property keys", *(f"  {k.name} | {k.cardinality} | {k.data_type}" for k in self.keys.values())]
        out += ["Indexes", *(f"  {i.name} | {i.kind} | unique {i.unique} | {', '.join(i.keys)} | {i.status}" for i in self.indexes.values())]
        return "\n".join(out)

    @staticmethod
    def from_json(text: str) -> "GraphSchema":
        """A schema document with vertexLabels, edgeLabels, propertyKeys and compositeIndexes."""
        doc, schema = json.loads(text), GraphSchema()
        for v in doc.get("vertexLabels", []):
            schema = schema.with_vertex_label(VertexLabel(v["label"], bool(v.get("staticVertex")), bool(v.get("partition")), ttl_seconds=v.get("ttl")))
        for k in doc.get("propertyKeys", []):
            schema = schema.with_key(PropertyKey(k["key"], k.get("className", "String").rsplit(".", 1)[-1], k.get("cardinality", "SINGLE"), k.get("ttl")))
        for e in doc.get("edgeLabels", []):
            schema = schema.with_edge_label(EdgeLabel(e["label"], e.get("multiplicity", "MULTI"), not e.get("unidirected", False), ttl_seconds=e.get("ttl")))
        for i in doc.get("compositeIndexes", []):
            names = tuple(k["propertyKey"] if isinstance(k, dict) else k for k in i["keys"])
            schema = schema.with_index(Index(i["name"], names, "edge" if "Edge" in i.get("typeClass", "") else "vertex", unique=bool(i.get("unique"))))
        return schema


def multiplicity_violations(edges: DataFrame, multiplicity: str) -> DataFrame:
    """Groups of edges (src, dst, ...) that a multiplicity forbids: the keys and how many edges they have."""
    keys = {"MULTI": None, "SIMPLE": [["src", "dst"]], "MANY2ONE": [["src"]], "ONE2MANY": [["dst"]], "ONE2ONE": [["src"], ["dst"]]}[multiplicity]
    if keys is None:
        return edges.select(F.col("src"), F.col("dst"), F.lit(0).cast("long").alias("n")).limit(0)
    parts = []
    for k in keys:
        counted = edges.groupBy(*k).agg(F.count("*").alias("n")).where("n > 1")
        kind = {n: edges.schema[n].dataType for n in ("src", "dst")}
        parts.append(counted.select(*[(F.col(n) if n in k else F.lit(None).cast(kind[n])).alias(n) for n in ("src", "dst")], "n"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def unique_violations(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Values of a unique index that several elements share; elements that lack a key are not indexed."""
    present = elements.dropna(subset=keys)
    return present.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def connection_violations(graph, schema: GraphSchema) -> DataFrame:
    """Edges whose (source label, target label) no connection of their label allows."""
    allowed = [(e.name, a, b) for e in schema.edge_labels.values() for a, b in e.connections]
    labels = graph.vertices().select(F.col("id"), F.col("label"))
    ends = (
        graph.edges().select("label", "src", "dst")
        .join(labels.select(F.col("id").alias("src"), F.col("label").alias("out_label")), "src", "left")
        .join(labels.select(F.col("id").alias("dst"), F.col("label").alias("in_label")), "dst", "left")
    )
    rule = F.lit(False)
    for name, a, b in allowed:
        rule = rule | ((F.col("label") == name) & (F.col("out_label") == a) & (F.col("in_label") == b))
    return ends.where(~F.coalesce(rule, F.lit(False))).select("label", "src", "dst", "out_label", "in_label")


def property_violations(table: DataFrame, allowed: tuple[str, ...], reserved: tuple[str, ...] = ("id", "label", "src", "dst")) -> list[str]:
    """Property columns that a label's constraints do not name."""
    return [c for c in table.columns if c not in allowed and c not in reserved]


def latest_value(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """SINGLE cardinality: of several values of one element and key the last written stays."""
    columns = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(order)).alias("_last")).select(*keys, *[F.col("_last")[c].alias(c) for c in columns])


def distinct_values(column: str):
    """SET cardinality: equal values of an element are one."""
    return F.array_distinct(F.col(column))


def not_expired(created: str, ttl_seconds: int, now) -> object:
    """Whether an element's time to live has not run out."""
    return F.col(created) + F.make_dt_interval(secs=F.lit(ttl_seconds)) > F.lit(now)
