"""Schema rules, changes, the change log as a stream, and graph files."""

import json

import pytest

from quivera.operators import mutations
from quivera.plans.schema import EdgeLabel, GraphSchema, Index, PropertyKey, SchemaViolation, VertexLabel, multiplicity_violations, unique_violations
from quivera.sources.graphson import read_graphml, read_graphson, to_graphson
from quivera.sources.tables import read_graph, write_graph
from quivera.streaming import changelog
from tests.gods import gods


def test_index_lifecycle():
    s = GraphSchema().with_key(PropertyKey("name")).with_index(Index("by_name", ("name",), unique=True))
    s = s.update_index("by_name", "REGISTER_INDEX").update_index("by_name", "ENABLE_INDEX")
    assert s.indexes["by_name"].status == "ENABLED"
    with pytest.raises(SchemaViolation):
        s.update_index("by_name", "DROP_INDEX")
    assert "by_name" in s.describe() and "title" in s.rename("name", "title").keys


def test_json_schema():
    doc = {"vertexLabels": [{"label": "god"}], "edgeLabels": [{"label": "father", "multiplicity": "MANY2ONE"}], "propertyKeys": [{"key": "age", "className": "java.lang.Integer"}, {"key": "tags", "className": "java.lang.String", "cardinality": "SET"}]}
    s = GraphSchema.from_json(json.dumps(doc))
    assert s.edge_labels["father"].multiplicity == "MANY2ONE" and s.vertex_type("god")["tags"].dataType.simpleString() == "array<string>"
    with pytest.raises(SchemaViolation):
        s.with_key(PropertyKey("age"))
    assert GraphSchema().with_vertex_label(VertexLabel("x")).vertex_labels["x"].static is False


@pytest.mark.parametrize(("rule", "n"), [("MULTI", 0), ("SIMPLE", 1), ("MANY2ONE", 1), ("ONE2MANY", 1), ("ONE2ONE", 2)])
def test_multiplicity(spark, rule, n):
    e = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "src long, dst long")
    assert multiplicity_violations(e, rule).count() == n


def test_unique_skips_missing(spark):
    v = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id long, name string")
    assert [tuple(r) for r in unique_violations(v, ["name"]).collect()] == [("a", 2)]


def test_mutations(spark):
    g = gods(spark)
    more = mutations.add_vertices(g, "god", spark.createDataFrame([(4, "again", 1), (20, "mars", 3000)], "id long, name string, age int"))
    assert more.vertex_tables["god"].count() == 4
    tagged = mutations.set_property(more, "god", "tags", spark.createDataFrame([(4, "a"), (4, "b"), (4, "a")], "id long, value string"), "SET")
    assert sorted(tagged.vertex_tables["god"].where("id = 4").first()["tags"]) == ["a", "b"]
    with pytest.raises(SchemaViolation):
        mutations.add_edges(g, "father", spark.createDataFrame([(99, 4, 5)], "id long, src long, dst long"), EdgeLabel("father", "MANY2ONE"))
    merged = mutations.merge_edges(g, "pet", spark.createDataFrame([(1, 8, 11), (2, 8, 10)], "id long, src long, dst long"))
    assert merged.edge_tables["pet"].count() == 2


def test_change_log_stream(spark, tmp_path):
    g = gods(spark)
    after = g.traversal().V().has("name", "hercules").drop()
    path, seen = str(tmp_path / "log"), []
    changelog.append(changelog.changes_between(g, after, "main", 1, "2024-01-01 00:00:00"), path)
    processor = changelog.LogProcessor(spark, path, "main", "p1", str(tmp_path / "marks"))
    processor.add(lambda s, n: seen.append((s.vertices(changelog.REMOVED).count(), s.edges(changelog.REMOVED).count(), s.vertices(changelog.ADDED).count(), s.relations().count())))
    processor.start(once=True).awaitTermination()
    assert seen == [(1, 5, 0, 7)]
    processor.start(once=True).awaitTermination()
    assert len(seen) == 1  # its mark stands behind the first batch
    changelog.append(changelog.changes_between(after, g, "main", 2, "2024-01-02 00:00:00"), path)
    processor.start(once=True).awaitTermination()
    assert seen[1][2] == 1
    assert changelog.latest_state(spark.read.parquet(path)).count() == 6


def test_files(spark, tmp_path):
    g = gods(spark)
    write_graph(g, str(tmp_path / "g"))
    assert read_graph(spark, str(tmp_path / "g"), list(g.vertex_tables), list(g.edge_tables)).edges().count() == 17
    to_graphson(g).write.text(str(tmp_path / "json"))
    back = read_graphson(spark, str(tmp_path / "json"))
    assert back.vertices().count() == 12 and back.edges().count() == 17
    assert back.traversal().V().has("name", "saturn").in_("father").values("name").toList() == ["jupiter"]
    (tmp_path / "x.graphml").write_text('<graphml><graph><node id="1"><data key="labelV">god</data><data key="name">pluto</data></node><node id="2"><data key="labelV">god</data><data key="name">x</data></node><edge id="7" source="1" target="2"><data key="labelE">brother</data><data key="w">1</data></edge></graph></graphml>')
    v, e = read_graphml(spark, str(tmp_path / "x.graphml"))
    assert v.where("label = 'god'").count() == 2 and e.first()["label"] == "brother"
