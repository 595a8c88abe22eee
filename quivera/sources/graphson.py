"""Graph files: adjacency lists as JSON lines, and GraphML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import Graph

#: Reserved fields of an adjacency line.
RESERVED = ("_id", "_outE", "_inE")


def read_graphson(spark: SparkSession, path: str, label_field: str = "type", id_field: str = "_id") -> Graph:
    """A graph from lines {_id, type, properties, _outE: [{_label, _id, _inV, properties}], _inE: [...]}. Edges are read
    from their source's line."""
    rows = spark.read.json(path)
    properties = [c for c in rows.columns if c not in RESERVED and c != label_field]
    labels = [r[0] for r in rows.select(label_field).distinct().orderBy(label_field).collect()]  # bounded by the schema
    vertex_tables = {x: rows.where(F.col(label_field) == x).select(F.col(id_field).alias("id"), *properties) for x in labels}
    edge_tables: dict[str, DataFrame] = {}
    if "_outE" in rows.columns:
        out = rows.select(F.col(id_field).alias("src"), F.explode("_outE").alias("e"))
        fields = [f.name for f in rows.schema["_outE"].dataType.elementType.fields]
        more = [F.col(f"e.{n}").alias(n) for n in fields if n not in ("_label", "_id", "_inV")]
        edges = out.select(F.col("e._id").alias("id"), "src", F.col("e._inV").alias("dst"), F.col("e._label").alias("_l"), *more)
        for x in [r[0] for r in edges.select("_l").distinct().orderBy("_l").collect()]:
            edge_tables[x] = edges.where(F.col("_l") == x).drop("_l")
    return Graph(vertex_tables, edge_tables)


def to_graphson(graph: Graph) -> DataFrame:
    """One JSON line per vertex with its out- and in-edges; write it with ``.write.text``."""
    e = graph.edges()
    bag = F.struct(*[F.col(c) for c in e.columns if c not in ("id", "label", "src", "dst")]) if len(e.columns) > 4 else None
    base = [F.col("label").alias("_label"), F.col("id").alias("_id")]
    more = [F.col(c) for c in e.columns if c not in ("id", "label", "src", "dst")] if bag is not None else []
    out = e.groupBy(F.col("src").alias("id")).agg(F.collect_list(F.struct(*base, F.col("dst").alias("_inV"), *more)).alias("_outE"))
    into = e.groupBy(F.col("dst").alias("id")).agg(F.collect_list(F.struct(*base, F.col("src").alias("_outV"), *more)).alias("_inE"))
    v = graph.vertices().withColumnRenamed("label", "type")
    joined = v.join(out, "id", "left").join(into, "id", "left").withColumnRenamed("id", "_id")
    return joined.select(F.to_json(F.struct(*joined.columns)).alias("value"))


def read_graphml(spark: SparkSession, path: str, label_key: str = "labelV", edge_label_key: str = "labelE") -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a GraphML file by the built-in XML source: ids and labels with a map of the data keys."""
    data = "data array<struct<_key: string, _VALUE: string>>"
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, {data}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_id string, _source string, _target string, {data}").load(path)
    bag = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda d: F.struct(d["_key"], d["_VALUE"])))
    v = nodes.select(F.col("_id").alias("id"), bag.alias("properties"))
    e = edges.select(F.col("_id").alias("id"), F.col("_source").alias("src"), F.col("_target").alias("dst"), bag.alias("properties"))
    return v.withColumn("label", F.col("properties")[label_key]), e.withColumn("label", F.col("properties")[edge_label_key])
