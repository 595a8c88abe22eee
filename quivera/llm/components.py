"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table

#: Every step lowers labels; the pairs of steps needed follow the logarithm of a component's size.
MAX_ROUNDS = 60


def _least(pairs: DataFrame) -> DataFrame:
    """(u, m): the least of each u and its neighbours."""
    return pairs.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m"))


def _step(pairs: DataFrame, keep) -> DataFrame:
    """Move the neighbours of u that ``keep`` accepts to u's least. The hot u are split by the join's skew rule."""
    least = write_table(_least(pairs), "star-least")
    return pairs.join(least, "u").where(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the ends of ``links`` (a, b): root is the least value of the component.

    ``links`` is a written table. Each step's table is written to the shared folder, so lineage stays short.
    """
    edges = links.where("a <> b").select("a", "b")
    before = None
    for _ in range(MAX_ROUNDS):
        both = edges.selectExpr("a as u", "b as v").unionByName(edges.selectExpr("b as u", "a as v"))
        large = write_table(_step(both, F.col("v") > F.col("u")).where("a <> b").distinct(), "star-large")
        down = large.selectExpr("greatest(a, b) as u", "least(a, b) as v")
        least = write_table(_least(down), "star-least")
        small = down.join(least, "u").where("v <> m").selectExpr("v as a", "m as b").unionByName(least.selectExpr("u as a", "m as b"))
        edges = write_table(small.where("a <> b").distinct(), "star-small")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.selectExpr("a as node", "b as root").unionByName(edges.selectExpr("b as node", "b as root").distinct())
        before = state
    raise RuntimeError("components did not settle")
