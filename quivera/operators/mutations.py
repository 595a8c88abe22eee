"""Changes of a graph as new immutable graphs: adding, merging and dropping elements, cleanup, id assignment."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import Graph
from ..plans.schema import EdgeLabel, SchemaViolation, multiplicity_violations


def assign_ids(rows: DataFrame, keys: list[str], bits: int = 62) -> DataFrame:
    """``rows`` with an ``id`` made from their natural keys, alike in every run."""
    return rows.withColumn("id", F.shiftrightunsigned(F.xxhash64(*keys), 64 - bits))


def with_edge_ids(label: str, rows: DataFrame) -> DataFrame:
    """Edge ``rows`` with an ``id`` that tells parallel edges apart, also those alike in all properties."""
    more = [F.col(f"`{c}`") for c in rows.columns if c not in ("src", "dst")]
    key = F.xxhash64(F.lit(0), *more)
    number = F.row_number().over(Window.partitionBy("src", "dst", "_h").orderBy("_h"))
    keyed = rows.withColumn("_h", key).withColumn("_n", number)
    return keyed.withColumn("id", F.concat_ws("-", F.lit(label), F.col("src").cast("string"), F.col("dst").cast("string"), F.hex("_h"), F.col("_n").cast("string"))).drop("_h", "_n")


def add_vertices(graph: Graph, label: str, rows: DataFrame) -> Graph:
    """Vertices whose id exists already are not added again."""
    old = graph.vertex_tables.get(label)
    if old is None:
        return graph.with_vertices(label, rows)
    fresh = rows.dropDuplicates(["id"]).join(old.select("id"), "id", "left_anti")
    return graph.with_vertices(label, old.unionByName(fresh, allowMissingColumns=True))


def merge_vertices(graph: Graph, label: str, rows: DataFrame, on: list[str]) -> Graph:
    """Upsert: rows that match existing vertices on ``on`` update the properties they give, others are added."""
    old = graph.vertex_tables[label]
    fresh = rows.dropDuplicates(on)
    given = [c for c in fresh.columns if c not in (*on, "id")]
    new = fresh.select(*[F.col(c).alias(f"_new_{c}") for c in fresh.columns], F.lit(True).alias("_hit"))
    match = old.join(new, [old[c].eqNullSafe(F.col(f"_new_{c}")) for c in on], "left")
    updated = match.select(*[(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(old[c]) if c in given else old[c]).alias(c) for c in old.columns])
    added = fresh.join(old.select(*on), on, "left_anti")
    return graph.with_vertices(label, updated.unionByName(added, allowMissingColumns=True))


def add_edges(graph: Graph, label: str, rows: DataFrame, rule: EdgeLabel | None = None, check: bool = True) -> Graph:
    """Edges whose ends exist; a label's multiplicity is checked over old and new edges together."""
    ids = graph.vertices().select("id")
    ends = rows.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    old = graph.edge_tables.get(label)
    table = ends if old is None else old.unionByName(ends, allowMissingColumns=True)
    rule = rule or graph.schema.edge_labels.get(label)
    if check and rule is not None and not multiplicity_violations(table, rule.multiplicity).isEmpty():
        raise SchemaViolation(f"edges break the multiplicity {rule.multiplicity} of {label}")
    return graph.with_edges(label, table)


def merge_edges(graph: Graph, label: str, rows: DataFrame) -> Graph:
    """Add the edges whose (src, dst) has none of this label yet."""
    old = graph.edge_tables[label]
    fresh = rows.dropDuplicates(["src", "dst"]).join(old.select("src", "dst"), ["src", "dst"], "left_anti")
    return graph.with_edges(label, old.unionByName(fresh, allowMissingColumns=True))


def set_property(graph: Graph, label: str, key: str, values: DataFrame, cardinality: str = "SINGLE", order: str | None = None) -> Graph:
    """Set ``key`` from (id, value): SINGLE replaces (of several values the one last in the column ``order``, else the
    greatest), LIST appends (in ``order``, else by value), SET appends what is new."""
    old = graph.vertex_tables[label]
    if cardinality == "SINGLE":
        last = values.groupBy("id").agg((F.max_by("value", order) if order else F.max("value")).alias("_values"))
        joined = old.join(last, "id", "left")
        column = F.coalesce(F.col("_values"), F.col(key)) if key in old.columns else F.col("_values")
    else:
        members = F.sort_array(F.collect_list(F.struct(F.col(order or "value").alias("o"), F.col("value").alias("v"))))
        joined = old.join(values.groupBy("id").agg(members.getField("v").alias("_values")), "id", "left")
        before = F.coalesce(F.col(key), F.array()) if key in old.columns else F.array()
        after = F.coalesce(F.col("_values"), F.array())
        column = F.concat(before, after) if cardinality == "LIST" else F.array_distinct(F.concat(before, after))
    return graph.with_vertices(label, joined.withColumn(key, column).drop("_values"))


def drop_property(graph: Graph, label: str, key: str) -> Graph:
    return graph.with_vertices(label, graph.vertex_tables[label].drop(key))


def drop_vertices(graph: Graph, ids: DataFrame) -> Graph:
    """Without the vertices of ``ids`` (a column id) and without their edges."""
    vertices = {x: t.join(ids, "id", "left_anti") for x, t in graph.vertex_tables.items()}
    edges = {
        x: t.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
        for x, t in graph.edge_tables.items()
    }
    return replace(graph, vertex_tables=vertices, edge_tables=edges)


def drop_edges(graph: Graph, ids: DataFrame) -> Graph:
    """Without the edges of ``ids`` (a column id as in ``graph.edges()``)."""
    gone = ids.withColumnRenamed("id", "_gone")
    tables = {}
    for x, t in graph.edge_tables.items():
        keyed = t.withColumn("_key", graph.edge_id(x))
        tables[x] = keyed.join(gone, F.col("_key") == F.col("_gone"), "left_anti").drop("_key")
    return replace(graph, edge_tables=tables)


def remove_ghosts(graph: Graph) -> Graph:
    """Edges of which an end does not exist are cleaned up."""
    ids = graph.vertices().select("id")
    tables = {
        x: t.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        for x, t in graph.edge_tables.items()
    }
    return replace(graph, edge_tables=tables)


def ghost_edges(graph: Graph) -> DataFrame:
    """(label, src, dst) of edges of which an end does not exist."""
    ids = graph.vertices().select(F.col("id").alias("_v"))
    e = graph.edges().select("label", "src", "dst")
    return e.join(ids, e.src == ids._v, "left_anti").unionByName(e.join(ids, e.src == ids._v, "left_semi").join(ids, e.dst == ids._v, "left_anti"))
