"""Shortest paths to given targets: those of a search of all vertices, without its rows."""

import random

import pytest

from quivera.operators import olap
from quivera.plans.graph import Graph
from quivera.plans.traversal import __
from quivera.queries import QUERIES


@pytest.fixture
def written(monkeypatch):
    """The numbers of rows of the tables that searches write."""
    rows, own = [], olap.checkpointed

    def counted(df):
        made = own(df)
        rows.append(made.count())
        return made

    monkeypatch.setattr(olap, "checkpointed", counted)
    return rows


def test_to_targets_as_to_all(spark):
    """From either side, with parallel edges, loops, parts that are not connected, sources among the targets and depths that cut off."""
    rng = random.Random(5)
    rows = [(rng.randrange(40), rng.randrange(40)) for _ in range(55)] + [(7, 7), (1, 2), (1, 2)]
    ids = spark.range(45)
    few, many = ids.where("id in (3, 17, 44)"), ids.where("id % 3 <> 1")
    g = Graph({"few": few, "rest": ids.where("id not in (3, 17, 44)")}, {"e": spark.createDataFrame(rows, "src long, dst long")})
    as_ids = lambda df: df.withColumnRenamed("id", "_id")
    for sources, targets in ((few, many), (many, few)):
        for depth in (0, 1, 3, 10):
            every = olap.shortest_paths(g, as_ids(sources), (), depth).join(targets.withColumnRenamed("id", "target"), "target", "left_semi")
            found = olap.shortest_paths(g, as_ids(sources), (), depth, as_ids(targets))
            assert found.columns == ["source", "target", "distance", "path"]
            assert sorted(map(tuple, found.collect())) == sorted(map(tuple, every.select(*found.columns).collect()))
    t = g.traversal().V(0, 3).shortestPath(target=__.hasLabel("few"))
    assert (3, 3, 0) in {(r["source"], r["target"], r["distance"]) for r in t.df.collect()}


def test_search_follows_targets(spark, written):
    """400 leaves of a hub were 160,000 pairs before."""
    a = spark.range(2, 402)
    edges = a.selectExpr("id as src", "1L as dst").unionByName(spark.range(1).selectExpr("1L as src", "0L as dst"))
    g = Graph({"a": a, "hub": spark.range(1, 2), "root": spark.range(1)}, {"at": edges})
    for one, other in (("a", "root"), ("root", "a")):
        t = g.traversal().V().hasLabel(one).shortestPath(target=__.hasLabel(other), max_depth=2)
        assert t.df.where("distance = 2 and size(path) = 3 and path[1] = '1'").count() == 400
    assert max(written) <= 2_000


def test_query_follows_targets(spark, written):
    """100 suppliers with some 64 neighbours by nation were 6,400 pairs before."""
    assert QUERIES["shortest_path"](spark, "/root/testdata/sf0.01").count() == 100
    assert max(written) <= 4_000
