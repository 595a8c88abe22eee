"""Traversers that are counted without being made: the same counts as one by one, and no more rows than vertices and edges."""

import random
from collections import Counter

import pytest

from quivera.functions import predicates as P
from quivera.plans.graph import Graph


def most_rows(df) -> int:
    """The most rows that an operator of the executed plan made, with filters kept out of joins, which would make pairs unseen."""
    conf, rules = df.sparkSession.conf, "spark.sql.optimizer.excludedRules"
    conf.set(rules, ",".join(f"org.apache.spark.sql.catalyst.optimizer.{x}" for x in ("PushDownPredicates", "PushPredicateThroughJoin")))
    try:
        df.collect()
    finally:
        conf.unset(rules)
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        rows, kind = node.metrics().get("numOutputRows"), node.getClass().getSimpleName()
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        todo += inner + [node.children().apply(k) for k in range(node.children().size())]
    return most


@pytest.fixture(scope="module")
def hub(spark):
    """300 leaves of kind a and 50 of kind b at one hub."""
    leaves = {"a": spark.range(1, 301), "b": spark.range(301, 351)}
    at = spark.range(1, 351).selectExpr("id as src", "0L as dst")
    return Graph({**leaves, "hub": spark.range(1)}, {"at": at}, {"at": (("a", "b"), ("hub",))})


@pytest.fixture(scope="module")
def odd(spark):
    """Random edges, some parallel, some loops, some without an end or to a vertex that is not there."""
    rng = random.Random(3)
    ends = [*range(12), 99, None]
    rows = [(rng.randrange(12), rng.choice(ends)) for _ in range(60)] + [(1, 1), (1, 1), (2, 3), (2, 3), (3, 2)]
    names = spark.createDataFrame([(k, "even" if k % 2 == 0 else None) for k in range(12)], "id long, name string")
    return Graph({"low": names.where("id < 6"), "high": names.where("id >= 6")}, {"e": spark.createDataFrame(rows, "src long, dst long")}, {"e": (("low", "high"), ("low", "high"))})


def one_by_one(t, *, by=None) -> Counter:
    return Counter(t.select("s", by=by).toList())


def counted(t, *, by=None) -> dict:
    return {r["key"]: r["value"] for r in t.select("s", by=by).groupCount().result(key="key", value="value").collect()}


def agree(t) -> None:
    for by in (None, "name"):
        assert counted(t, by=by) == one_by_one(t, by=by)
    assert t.count().next() == t.select("s").count().next() == len(t.df.collect())


def test_where_neq_counts_as_one_by_one(odd):
    for t in (odd.traversal().V().as_("s").out("e").in_("e"), odd.traversal().V().as_("s").out("e").out("e"), odd.traversal().V().as_("s").out("e")):
        agree(t.where(P.neq("s")))
        agree(t.hasLabel("low").where(P.neq("s")))
        agree(t.where(P.neq("s")).hasLabel("high"))
    none = odd.traversal().V(77).as_("s").out("e").where(P.neq("s"))
    assert none.count().next() == 0 and counted(none) == {}


def test_where_neq_makes_no_pairs(hub):
    t = hub.traversal().V().hasLabel("a").as_("s").out("at").in_("at").hasLabel("a").where(P.neq("s"))
    assert counted(t) == {k: 299 for k in range(1, 301)}
    assert most_rows(t.select("s").groupCount().df) <= 2000


def test_query_where_neq_label_makes_no_pairs(spark):
    """Some 90,000 pairs at this size, made one by one before."""
    from quivera.queries import QUERIES

    df = QUERIES["where_neq_label"](spark, "/root/testdata/sf0.01")
    assert most_rows(df) <= 20_000


def test_cyclic_path_counts_as_one_by_one(odd):
    for t in (odd.traversal().V().as_("s").out("e").in_("e"), odd.traversal().V().as_("s").out("e").out("e"), odd.traversal().V().as_("s").out("e").in_("e").out("e")):
        agree(t.cyclicPath())
        agree(t.hasLabel("low").cyclicPath())
        agree(t.cyclicPath().hasLabel("high"))
    assert odd.traversal().V(77).out("e").cyclicPath().count().next() == 0


def test_cyclic_path_makes_no_pairs(hub):
    t = hub.traversal().V().hasLabel("a").out("at").in_("at").hasLabel("a").cyclicPath()
    assert t.count().next() == 300
    assert most_rows(t.count().df) <= 2000


def test_query_cyclic_path_makes_no_pairs(spark):
    """100 suppliers with some 64 neighbours by nation were 6,400 pairs before."""
    from quivera.queries import QUERIES

    assert most_rows(QUERIES["cyclic_path"](spark, "/root/testdata/sf0.01")) <= 4_000


def test_simple_path_counts_as_one_by_one(odd):
    for t in (odd.traversal().V().as_("s").out("e").in_("e"), odd.traversal().V().as_("s").out("e").in_("e").out("e")):
        agree(t.simplePath())
        agree(t.hasLabel("low").simplePath())
    assert odd.traversal().V(77).out("e").simplePath().count().next() == 0


def test_a_second_filter_is_kept(odd):
    t = odd.traversal().V().as_("s").out("e").as_("m").out("e")
    agree(t.where(P.neq("s")).where(P.neq("m")))
    agree(t.simplePath().where(P.neq("m")))
    agree(t.where(P.neq("s")).cyclicPath())


def test_simple_path_makes_no_pairs(hub):
    t = hub.traversal().V().hasLabel("a").as_("s").out("at").in_("at").hasLabel("a").simplePath()
    assert counted(t) == {k: 299 for k in range(1, 301)}
    assert most_rows(t.select("s").groupCount().df) <= 2000


def test_query_simple_path_makes_no_pairs(spark):
    """100 suppliers with some 64 neighbours by nation were 6,400 pairs before."""
    from quivera.queries import QUERIES

    assert most_rows(QUERIES["simple_path"](spark, "/root/testdata/sf0.01")) <= 4_000
