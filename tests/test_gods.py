"""Golden answers on the gods graph."""

import pytest

from quivera.functions import predicates as P
from quivera.functions.geo import Geoshape
from quivera.operators import mutations, olap
from quivera.plans.native import GraphQuery, VertexQuery
from quivera.plans.traversal import DESC, __
from tests.gods import gods


@pytest.fixture(scope="module")
def graph(spark):
    return gods(spark)


@pytest.fixture(scope="module")
def g(graph):
    return graph.traversal()


def test_size(graph):
    assert graph.vertices().count() == 12 and graph.edges().count() == 17


def test_grandchild(g):
    assert g.V().has("name", "saturn").in_("father").in_("father").values("name").toList() == ["hercules"]


def test_places_within_circle(g):
    t = g.E().has("place", P.geo_within(Geoshape.circle(37.97, 23.72, 50))).inV().values("name")
    assert sorted(t.toList()) == ["hydra", "nemean"]


def test_parents(g):
    t = g.V().has("name", "hercules").out("father", "mother")
    assert sorted(t.values("name").toList()) == ["alcmene", "jupiter"] and sorted(t.label().toList()) == ["god", "human"]


def test_battles(g):
    t = g.V().has("name", "hercules").outE("battled").has("time", P.gt(1)).inV().values("name")
    assert sorted(t.toList()) == ["cerberus", "hydra"]


def test_cohabitants(g):
    pluto = g.V().has("name", "pluto")
    assert sorted(pluto.out("lives").in_("lives").values("name").toList()) == ["cerberus", "pluto"]
    t = pluto.as_("x").out("lives").in_("lives").where(P.neq("x")).values("name")
    assert t.toList() == ["cerberus"]


def test_brothers_places(g):
    assert sorted(g.V().has("name", "pluto").out("brother").out("lives").values("name").toList()) == ["sea", "sky"]


def test_reasons(g):
    t = g.E().has("reason", P.text_contains("loves")).as_("e").outV().values("name")
    assert sorted(t.toList()) == ["jupiter", "neptune"]


def test_missing_values(g):
    assert g.V().has("age", P.neq(30)).count().next() == 5
    assert g.V().hasNot("age").count().next() == 6
    assert g.V().has("age", P.without()).count().next() == 12
    assert g.V().has("age", P.without(30)).count().next() == 5


def test_loops_and_emit(g):
    t = g.V().has("name", "hercules").repeat(__.out("father"), emit=True, times=2).values("name")
    assert sorted(t.toList()) == ["jupiter", "saturn"]
    t = g.V().has("name", "hercules").repeat(__.out("father"), until=__.hasLabel("titan")).values("name")
    assert t.toList() == ["saturn"]


def test_branches(g):
    t = g.V().hasLabel("god").choose(__.has("age", P.gt(4400)), __.values("name"), __.constant("young"))
    assert sorted(t.toList()) == ["jupiter", "neptune", "young"]
    assert sorted(g.V().hasLabel("monster").optional(__.out("lives")).values("name").toList()) == ["hydra", "nemean", "tartarus"]
    assert sorted(g.V().hasLabel("god").coalesce(__.out("pet"), __.out("father")).values("name").toList()) == ["cerberus", "saturn"]


def test_local_limit(g):
    t = g.V().has("name", "hercules").local(__.outE("battled").order().by("time", DESC).limit(2)).values("time")
    assert sorted(t.toList()) == [2, 12]


def test_paths(g):
    t = g.V().has("name", "jupiter").out("brother").out("brother")
    assert t.count().next() == 4
    assert t.simplePath().count().next() == 2 and t.cyclicPath().count().next() == 2
    assert sorted(len(p) for p in t.path().toList()) == [3, 3, 3, 3]


def test_reducers(g):
    assert g.V().hasLabel("god").values("age").sum_().next() == 13500
    assert g.V().hasLabel("location").values("age").sum_().toList() == []
    assert g.V().hasLabel("location").values("age").count().next() == 0


def test_ends(g):
    assert g.V().hasLabel("nothing").tryNext() is None and not g.V().hasLabel("nothing").hasNext()
    with pytest.raises(StopIteration):
        g.V().hasLabel("nothing").next()
    assert "Scan" in g.V().hasLabel("god").explain()


def test_native(graph):
    q = GraphQuery(graph).has("age", P.gte, 4000).orderBy("age", "desc").limit(3)
    assert [r["name"] for r in q.vertices().collect()] == ["saturn", "jupiter", "neptune"]
    q = GraphQuery(graph).or_(GraphQuery(graph).has("name", "sky"), GraphQuery(graph).has("age", 30))
    assert q.vertices().count() == 2
    assert GraphQuery(graph).limit(0).vertices().count() == 0
    assert GraphQuery(graph).has("nokey", 1).vertices().count() == 0 and GraphQuery(graph).hasNot("nokey").vertices().count() == 12
    assert VertexQuery(graph, graph.vertices().where("name = 'hercules'")).labels("battled").direction("OUT").orderBy("time", "desc").limit(1).edges().first()["time"] == 12
    assert VertexQuery(graph).direction("IN").properties().count() == 0
    assert {r["vertex"]: r["count"] for r in VertexQuery(graph).count().collect()}[4] == 7


def test_order_nulls_last(graph):
    for way in ("asc", "desc"):
        rows = GraphQuery(graph).orderBy("age", way).vertices().collect()
        assert all(r["age"] is None for r in rows[-6:])


def test_drop_and_ghosts(graph, g):
    left = g.V().has("name", "hercules").drop()
    assert left.vertices().count() == 11 and left.edges().count() == 12
    broken = graph.with_vertices("titan", graph.vertex_tables["titan"].where("false"))
    assert mutations.ghost_edges(broken).count() == 1 and mutations.remove_ghosts(broken).edges().count() == 16


def test_olap_invariants(graph):
    out = olap.degree_counts(graph)
    assert sum(r["degree"] for r in out.collect()) == 17
    ranks = olap.page_rank(graph)
    assert ranks.count() == 12 and all(r["rank"] > 0 for r in ranks.collect())
    assert {r["component"] for r in olap.connected_components(graph).collect()} == {1}
    d = {r["id"]: r["distance"] for r in olap.shortest_distance(graph, 1).collect()}
    assert d[4] == 1 and d[6] == 2 and d[7] is None


def test_union_group_project(g):
    counts = dict(g.V().groupCount("label").df.select("_key", "_value").collect())
    assert counts["god"] == 3 and counts["location"] == 3
    t = g.V().hasLabel("god").project("name", "homes", by=["name", __.out("lives").count()])
    assert {r[0]["name"]: r[0]["homes"] for r in t.df.select("_value").collect()} == {"jupiter": 1, "neptune": 1, "pluto": 1}
    t = g.V().has("name", "jupiter").union(__.out("brother"), __.out("father")).values("name")
    assert sorted(t.toList()) == ["neptune", "pluto", "saturn"]
    assert dict(g.V().has("name", "jupiter").valueMap("name", "age").next()) == {"name": "jupiter", "age": "5000"}
