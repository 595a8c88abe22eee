"""Sources: a star schema seen as a graph, a graph of named files, and a Parquet store for graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import Graph
from ..plans.schema import EdgeLabel, GraphSchema, VertexLabel

#: Vertex labels of the star schema by their code in an id (key * CODES + code).
CODES = 16
LABELS = ("region", "nation", "customer", "supplier", "part", "order", "document", "user", "event")


class LazyTables(Mapping):
    """Tables by label, each planned when first asked for: a query opens the files that it reads and no others."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers, self._made = makers, {}

    def __getitem__(self, label: str) -> DataFrame:
        if label not in self._made:
            self._made[label] = self._makers[label]()
        return self._made[label]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def vertex_id(label: str, key: Column) -> Column:
    return key.cast("long") * CODES + LABELS.index(label)


def id_of(label: str, key: int) -> int:
    return key * CODES + LABELS.index(label)


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """customer -placed-> order -contains-> part -supplied_by-> supplier -in_nation-> nation -in_region-> region, and
    user -did-> event. Ids are numbers of key and label, so joins stay numeric."""
    opened: dict[str, DataFrame] = {}

    def t(name: str) -> DataFrame:
        if name not in opened:
            opened[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return opened[name]

    def vertices(label: str, table: str, key: str) -> Callable[[], DataFrame]:
        return lambda: t(table).select(vertex_id(label, F.col(key)).alias("id"), "*")

    def edges(table: str, a: str, ka: str, b: str, kb: str, *more: str) -> Callable[[], DataFrame]:
        return lambda: t(table).select(vertex_id(a, F.col(ka)).alias("src"), vertex_id(b, F.col(kb)).alias("dst"), *more)

    def line_edges(label: str, *rest: str) -> Callable[[], DataFrame]:
        """Edges of lines, which may be parallel: their ids are order, line number and a hash of the whole line."""
        def key() -> Column:
            whole = F.hex(F.xxhash64(*t("lineitem").columns))
            return F.concat_ws("-", F.lit(label), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), whole)

        return lambda: t("lineitem").select(key().alias("id"), *[vertex_id(x, F.col(k)).alias(end) for x, k, end in ((*rest[:2], "src"), (*rest[2:4], "dst"))], *rest[4:])

    from_customer = edges("customer", "customer", "c_custkey", "nation", "c_nationkey")
    from_supplier = edges("supplier", "supplier", "s_suppkey", "nation", "s_nationkey")
    vertex_tables = LazyTables(
        {
            "region": vertices("region", "region", "r_regionkey"),
            "nation": vertices("nation", "nation", "n_nationkey"),
            "customer": vertices("customer", "customer", "c_custkey"),
            "supplier": vertices("supplier", "supplier", "s_suppkey"),
            "part": vertices("part", "part", "p_partkey"),
            "order": vertices("order", "orders", "o_orderkey"),
            "document": vertices("document", "documents", "doc_id"),
            "user": lambda: t("events").select(vertex_id("user", F.col("user_id")).alias("id"), F.col("user_id")).distinct(),
            "event": vertices("event", "events", "event_id"),
        }
    )
    edge_tables = LazyTables(
        {
            "placed": edges("orders", "customer", "o_custkey", "order", "o_orderkey", "o_orderdate", "o_totalprice"),
            "contains": line_edges("contains", "order", "l_orderkey", "part", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag"),
            "supplied_by": line_edges("supplied_by", "part", "l_partkey", "supplier", "l_suppkey", "l_discount"),
            "in_nation": lambda: from_customer().unionByName(from_supplier()),
            "in_region": edges("nation", "nation", "n_nationkey", "region", "n_regionkey"),
            "did": edges("events", "user", "user_id", "event", "event_id", "event_type", "ts", "value"),
        }
    )
    ends = {
        "placed": (("customer",), ("order",)),
        "contains": (("order",), ("part",)),
        "supplied_by": (("part",), ("supplier",)),
        "in_nation": (("customer", "supplier"), ("nation",)),
        "in_region": (("nation",), ("region",)),
        "did": (("user",), ("event",)),
    }
    schema = GraphSchema()
    for label in LABELS:
        schema = schema.with_vertex_label(VertexLabel(label))
    for label, (a, b) in ends.items():
        schema = schema.with_edge_label(EdgeLabel(label, "ONE2MANY" if label in ("placed", "did") else "MANY2ONE" if label.startswith("in_") else "MULTI", connections=tuple((x, y) for x in a for y in b)))
    return Graph(vertex_tables, edge_tables, ends, schema)


def write_graph(graph: Graph, path: str, partitions_by: str | None = None) -> None:
    """A folder of Parquet tables, one per label."""
    for kind, tables in (("vertices", graph.vertex_tables), ("edges", graph.edge_tables)):
        for label, table in tables.items():
            writer = table.write.mode("overwrite")
            (writer.partitionBy(partitions_by) if partitions_by and partitions_by in table.columns else writer).parquet(f"{path}/{kind}/{label}")


def read_graph(spark: SparkSession, path: str, vertex_labels: list[str], edge_labels: list[str]) -> Graph:
    return Graph({x: spark.read.parquet(f"{path}/vertices/{x}") for x in vertex_labels}, {x: spark.read.parquet(f"{path}/edges/{x}") for x in edge_labels})
