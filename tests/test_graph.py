"""Graph operators on small graphs."""

import pytest

from codeweft.operators import dupes, graph


@pytest.fixture(scope="module")
def g(spark):
    nodes = spark.createDataFrame(
        [("a", "Foo", "code", "src/Foo.cs", "L1"), ("b", "Foo", "code", "src/Bar.cs", "L5"), ("c", "Foo()", "concept", "docs/foo.md", "L1"), ("t", "FooTests", "code", "Tests/FooTests.cs", "L1"), ("d", "Bar", "code", "src/Bar.cs", "L1")],
        "id string, label string, file_type string, source_file string, source_location string",
    )
    edges = spark.createDataFrame([("d", "a", "calls"), ("t", "a", "calls"), ("d", "b", "references"), ("a", "c", "method")], "src string, dst string, relation string")
    return nodes, edges


def test_resolve_prefers_code_definitions(g):
    row = graph.resolve(*g, "Foo").first()
    assert (row.id, row.match, row.n_candidates, row.fragments, row.ambiguous, row.alternatives) == ("a", "exact", 2, 1, True, ["c"])
    assert graph.resolve(*g, "Nothing").count() == 0


def test_bfs_and_cap(g, spark):
    start = spark.createDataFrame([("a",)], "id string")
    assert {(r.id, r.hop) for r in graph.bfs(g[1], start, "in").collect()} == {("d", 1), ("t", 1)}
    capped = graph.bfs(g[1], start, "both", (), 2, node_cap=2).collect()
    assert len(capped) == 2 and all(r.truncated for r in capped)


def test_paths(g, spark):
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    row = graph.shortest_path(g[1], one("d"), one("c")).first()
    assert (row.nodes, row.relations, row.reversed) == (["d", "a", "c"], ["calls", "method"], False)
    assert graph.shortest_path(g[1], one("c"), one("d")).first().reversed
    assert graph.shortest_path(g[1], one("t"), one("b")).count() == 0


def test_tests_impact_conventions(g, spark):
    start = spark.createDataFrame([("a",)], "id string")
    assert [r.id for r in graph.tests_for(*g, start).collect()] == ["t"]
    assert {r.category for r in graph.impact(*g, start).collect()} == {"tests", "backend"}
    assert ("a", "tested_by", "t") in {tuple(r) for r in graph.convention_links(g[0]).collect()}


def test_components(spark):
    p = spark.createDataFrame([("A", "B"), ("B", "C"), ("D", "E")], "a string, b string")
    assert {tuple(r) for r in graph.components(p).collect()} == {("A", "A"), ("B", "A"), ("C", "A"), ("D", "D"), ("E", "D")}
    assert graph.components(p.limit(0)).count() == 0


def test_histogram(spark):
    d = spark.createDataFrame([(0.001,), (0.015,), (0.025,)], "dist double")
    assert {tuple(r) for r in dupes.histogram(d).collect()} == {(0.02, 2), (0.04, 1)}


def test_dangling_edges_vanish(g, spark):
    links = spark.createDataFrame([("a", "d", None, None), ("a", "zz", "calls", 2.0)], "source string, target string, relation string, weight double")
    assert [tuple(r) for r in graph.load_edges(links, g[0]).collect()] == [("a", "d", "link", 1.0)]
