"""The four-node graph: a controller needs a service, that a repository and a model, and the repository the model."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import metrics
from loomgraph.operators.graph import DependencyGraph
from loomgraph.plans import iterate

C, S, R, M = "UserController", "UserService", "UserRepository", "UserModel"


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([(n, n, "", "TestProject", "Class", False, False, False, i) for i, n in enumerate((C, S, R, M))], "node_id string, name string, namespace string, project string, kind string, is_abstract boolean, is_sealed boolean, is_static boolean, node_seq long")
    edges = [(1, C, S, "Constructor"), (2, S, R, "Constructor"), (3, S, M, "Property"), (4, R, M, "Field")]
    edges = spark.createDataFrame([(i, a, b, k, f"{a}To{b}") for i, a, b, k in edges], "edge_seq long, src string, dst string, dep_type string, member_name string")
    return DependencyGraph(nodes, edges)


def ids(df, column="node_id"):
    return sorted(r[0] for r in df.select(column).collect())


def test_edges(graph):
    assert ids(graph.dependencies_of(S), "dst") == [M, R] and ids(graph.dependents_of(S), "src") == [C]
    assert ids(graph.dependents_of(M), "src") == [R, S] == ids(graph.dependents_from_graph(M), "src")
    assert ids(graph.types_with_dependents()) == [M, R, S]
    assert ids(graph.targets_of(S)) == [M, R]


def test_degrees(graph):
    found = {r.node_id: (r.fan_in, r.fan_out) for r in graph.degrees.collect()}
    assert found == {C: (0, 1), S: (1, 2), R: (1, 1), M: (2, 0)}
    assert ids(graph.high_fan_in(1)) == [M, R, S] and ids(graph.high_fan_out(1)) == [C, R, S]
    assert ids(graph.stable_types()) == [M] and ids(graph.unstable_types()) == []
    assert graph.is_stable(M) and not graph.is_stable(S) and not graph.is_unstable("Nobody")
    assert graph.fan_in_out().count() == 4


def test_scopes(graph):
    assert ids(graph.impact_scope(M)) == ids(graph.dependency_scope(C)) == sorted((C, S, R, M))
    assert ids(graph.impact_scope("Nobody")) == []
    assert {r.node_id: r.score for r in graph.impact_scores([M, S, C]).collect()} == {M: 4, S: 2, C: 1}
    assert {r.node_id: r.score for r in graph.dependency_scores([C, S, R]).collect()} == {C: 4, S: 3, R: 2}


def test_paths(graph):
    assert graph.dependency_chain(C, M) == [C, S, M] and graph.dependent_chain(M, C) == [M, S, C]
    assert [graph.distance(C, x) for x in (M, S, C)] == [2, 1, 0] and graph.distance(M, C) == -1
    assert graph.dependency_chain(M, C) == []
    assert graph.strongest_path(C, M)[0] == C
    paths = {tuple(r.path) for r in graph.all_paths(C, M, 4).collect()}
    assert paths == {(C, S, M), (C, S, R, M)}


def test_metrics(graph):
    m = metrics.metrics(graph).first()
    assert (m.total_types, m.total_dependencies, m.total_dependents, m.max_fan_in, m.max_fan_out, m.stable_types, m.unstable_types) == (4, 4, 4, 2, 2, 1, 0)
    t = metrics.type_metrics(graph, S).first()
    assert (t.fan_in, t.fan_out, t.is_stable, t.is_unstable, t.impact_score, t.dependency_score) == (1, 2, False, False, 2, 3)
    report = metrics.report(graph)
    assert "Total Types: 4" in report and "Total Dependencies: 4" in report


def test_strength(graph):
    want = {
        1: ("ApplicationService", 0.95, 0.675, 0.10, 0.46, 0.425, 0.633333, 0.564333),
        2: ("Repository", 0.95, 0.675, 0.15, 0.46, 0.425, 0.666667, 0.580667),
        3: ("Unknown", 0.60, 0.650, 0.20, 0.46, 0.375, 0.666667, 0.493167),
        4: ("Unknown", 0.70, 0.625, 0.15, 0.46, 0.325, 0.666667, 0.498167),
    }
    for r in graph.scored.collect():
        pattern, *values = want[r.edge_seq]
        assert r.edge_pattern == pattern and r.profile == "Balanced"
        assert [r.structural, r.semantic, r.coupling, r.stability, r.criticality, r.testability, r.composite] == pytest.approx(values, abs=1e-6)


def test_cycles_and_order(graph, spark):
    assert graph.cyclic.isEmpty() and not graph.is_in_cycle(S)
    order = [r.node_id for r in graph.topological_order().orderBy("processing_order").collect()]
    assert order == [C, S, R, M]
    assert [r.node_id for r in graph.topological_order(dependents_first=False).orderBy("processing_order").collect()] == [M, R, S, C]
    back = graph.edges.union(spark.createDataFrame([(5, M, C, "Field", None)], graph.edges.schema))
    loop = DependencyGraph(graph.nodes, back)
    assert ids(loop.cyclic) == sorted((C, S, R, M))
    assert loop.topological_order().filter("level is not null").count() == 4
    with pytest.raises(ValueError):
        loop.topological_order(on_cycle="fail")
    assert loop.topological_order(on_cycle="ignore").count() == 0


def test_duplicate_and_external_types(graph, spark):
    again = graph.nodes.unionByName(graph.node(S).withColumns({"name": F.lit("Other"), "node_seq": F.lit(9).cast("long")}))
    edges = graph.edges.union(spark.createDataFrame([(5, S, "System.String", "Field", None)], graph.edges.schema))
    g = DependencyGraph(again, edges)
    assert g.node(S).first().name == S
    assert g.dependencies_of(S).count() == 2 and g.dependents_from_graph("System.String").count() == 1
    assert g.cross_project().count() == 1
    assert g.scored.count() == 5


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_both_forms_of_iteration(spark):
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (4, 5), (6, 5), (7, 7), (5, 8), (9, 6)]
    e = spark.createDataFrame([(i, a, b, ((a * 7 + b) % 5) / 4) for i, (a, b) in enumerate(edges)], "edge_seq long, src long, dst long, cost double")
    for work in (lambda n: iterate.reach(e, [0, 9], n), lambda n: iterate.strong_components(e, n), lambda n: iterate.cheapest(e, 0, n).select("node", "cost"), lambda n: iterate.levels(e.select(F.col("src").alias("node_id")), e.filter("src < dst"), n)):
        assert rows(work(0)) == rows(work(1000))
    assert iterate.shortest_chain(e, 0, 5, 0) == iterate.shortest_chain(e, 0, 5) == [0, 1, 2, 3, 4, 5]


def test_all_edges_have_a_processing_place(spark, graph):
    known = spark.createDataFrame([(M, 0), (R, 1)], "node_id string, processing_order int")
    typed = DependencyGraph(graph.nodes, graph.edges.withColumn("dep_ord", F.lit(1)))
    rows = sorted(typed.processing_places(known).collect(), key=lambda r: r.place)
    # ends without a level come last
    assert [(r.place, r.edge_seq) for r in rows] == [(1, 4), (2, 3), (3, 2), (4, 1)]


def test_the_processing_order_is_whole(spark):
    from loomgraph.plans import fixtures
    from loomgraph.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    places = [r.place for r in QUERIES["O05_processing_order"](spark, sf).collect()]
    n = fixtures.view(spark, sf, "fx_edges").count()
    assert n > 100 and sorted(places) == list(range(1, n + 1))


def test_reach_has_no_depth_bound(spark):
    n = 10_050
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found = iterate.reach(chain, [0])
    assert found.count() == n + 1 and found.agg(F.max("depth")).first()[0] == n


def test_rounds_end_in_one_task(spark):
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (4, 5), (6, 5), (7, 7), (5, 8), (9, 6), (8, 10), (10, 11), (11, 8)]
    e = spark.createDataFrame(edges, "src long, dst long")
    assert rows(iterate.strong_components(e, 5)) == rows(iterate.strong_components(e)) == [(0, 0, 3), (1, 0, 3), (10, 8, 3), (11, 8, 3), (2, 0, 3), (3, 3, 2), (4, 3, 2), (8, 8, 3)]
    nodes, forwards = e.select(F.col("src").alias("node_id")).union(e.select("dst")), e.filter("src < dst or src = 11 and dst = 8")
    assert rows(iterate.levels(nodes, forwards, 5)) == rows(iterate.levels(nodes, forwards))
    named = e.select(F.col("src").cast("string"), F.col("dst").cast("string"))
    assert rows(iterate.strong_components(named)) == [("0", "0", 3), ("1", "0", 3), ("10", "10", 3), ("11", "10", 3), ("2", "0", 3), ("3", "3", 2), ("4", "3", 2), ("8", "10", 3)]


def test_numbers_beyond_the_plain_bound_stay_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(iterate, "LOCAL_EDGES", 2)
    monkeypatch.setattr(iterate, "_coloured", None)
    ring = spark.range(1000).select(F.col("id").alias("src"), ((F.col("id") + 1) % 1000).alias("dst"))
    assert iterate.strong_components(ring).filter("component = 0 and size = 1000").count() == 1000
    costs = ring.withColumn("cost", F.lit(0.5))
    assert iterate.cheapest(costs, 0).filter("node = 999").first().asDict() == {"node": 999, "cost": 499.5, "parent": 998}
    assert rows(iterate.cheapest(costs, -1)) == [(-1, 0.0, None)]
