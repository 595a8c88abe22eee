"""The gods graph: twelve vertices, seventeen edges, and its golden answers' data."""

from pyspark.sql import functions as F

from quivera.functions import geo
from quivera.plans.graph import Graph

VERTICES = [
    (1, "titan", "saturn", 10000), (2, "location", "sky", None), (3, "location", "sea", None), (4, "god", "jupiter", 5000), (5, "god", "neptune", 4500), (6, "demigod", "hercules", 30),
    (7, "human", "alcmene", 45), (8, "god", "pluto", 4000), (9, "monster", "nemean", None), (10, "monster", "hydra", None), (11, "monster", "cerberus", None), (12, "location", "tartarus", None),
]
EDGES = [
    ("jupiter", "father", "saturn"), ("jupiter", "lives", "sky", "loves fresh breezes"), ("jupiter", "brother", "neptune"), ("jupiter", "brother", "pluto"), ("neptune", "lives", "sea", "loves waves"),
    ("neptune", "brother", "jupiter"), ("neptune", "brother", "pluto"), ("hercules", "father", "jupiter"), ("hercules", "mother", "alcmene"), ("hercules", "battled", "nemean", 1, 38.1, 23.7),
    ("hercules", "battled", "hydra", 2, 37.7, 23.9), ("hercules", "battled", "cerberus", 12, 39.0, 22.0), ("pluto", "brother", "jupiter"), ("pluto", "brother", "neptune"),
    ("pluto", "lives", "tartarus", "no fear of death"), ("pluto", "pet", "cerberus"), ("cerberus", "lives", "tartarus"),
]


def gods(spark) -> Graph:
    ids = {name: i for i, _, name, _ in VERTICES}
    labels = sorted({v[1] for v in VERTICES})
    vertex_tables = {x: spark.createDataFrame([(i, n, a) for i, label, n, a in VERTICES if label == x], "id long, name string, age int") for x in labels}
    edge_tables = {}
    for label in sorted({e[1] for e in EDGES}):
        rows = [(k, ids[e[0]], ids[e[2]], *(e[3:4] if label == "lives" else e[3:])) for k, e in enumerate(EDGES) if e[1] == label]
        if label == "battled":
            df = spark.createDataFrame(rows, "id long, src long, dst long, time int, lat double, lon double")
            df = df.withColumn("place", geo.point_column(F.col("lat"), F.col("lon"))).drop("lat", "lon")
        elif label == "lives":
            df = spark.createDataFrame([(*r, None)[:4] for r in rows], "id long, src long, dst long, reason string")
        else:
            df = spark.createDataFrame(rows, "id long, src long, dst long")
        edge_tables[label] = df
    return Graph(vertex_tables, edge_tables)
