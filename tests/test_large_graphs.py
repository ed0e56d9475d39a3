"""Ways that large graphs take, against those of small ones."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import graph
from loomgraph.operators.graph import DependencyGraph
from loomgraph.plans import fixtures, iterate
from loomgraph.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_both_forms_of_the_edges(spark, monkeypatch):
    lines = fixtures.view(spark, SF, "lineitem")
    few, many = fixtures.view(spark, SF, "fx_edges"), fixtures._many_edges(lines)
    assert few.dtypes == many.dtypes and few.count() == many.count() > 100
    assert few.exceptAll(many).isEmpty()
    monkeypatch.setattr(fixtures, "BROADCAST_ORDERS", 0)
    assert few.exceptAll(fixtures._many_edges(lines)).isEmpty()


def test_lines_without_an_order_are_one_group(spark):
    plain = fixtures.view(spark, SF, "lineitem")
    lines = plain.limit(40).selectExpr(*[f"cast(null as bigint) as {c}" if c == "l_orderkey" else f"{'50D' if c == 'l_quantity' else repr('R')} as {c}" if c in ("l_quantity", "l_returnflag") else c for c in plain.columns])
    assert fixtures._many_edges(lines).count() == 39


def test_components_by_passes_and_node_by_node():
    random = np.random.default_rng(7)
    for _ in range(100):
        n, m = int(random.integers(1, 40)), int(random.integers(1, 90))
        g = iterate.Coded(pa.table({"src": random.integers(0, n, m), "dst": random.integers(0, n, m)}))
        want = iterate._tarjan(len(g.nodes), *g.by(g.src, g.dst))
        for passes in (0, 1, 2, 4, 7, 200):
            assert np.array_equal(iterate._component_of(g, passes), want)


def test_numbers_far_apart_and_close():
    for kind in (np.int8, np.int64):
        g = iterate.Coded(pa.table({"src": np.array([-128, 127], kind), "dst": np.array([127, 0], kind)}))
        assert g.nodes.tolist() == [-128, 0, 127] and g.src.tolist() == [0, 2] and g.dst.tolist() == [2, 1]
    g = iterate.Coded(pa.table({"src": np.arange(5) + 10, "dst": np.arange(5) + 11}))
    assert g.nodes.tolist() == [10, 11, 12, 13, 14, 15] and g.dst.tolist() == [1, 2, 3, 4, 5]


#: Queries and the tables of scores that they write: none where these are read once.
WRITTEN = {
    "F08_strength": [],
    "A05_mean_dimensions": [],
    "A06_profiles": [],
    "A07_pair_strength": [],
    "A08_relationship_strength": [],
    "A09_strongest_types": [],
    "A10_semantic_types": [],
    "A10_structural_types": [],
    "F06_edge_pattern": [],
    "F18_edge_strings": [],
    "G12_strongest_path": [],
    "O02_strongest_weakest": ["rated"],
    "O03_strongest_composite": [],
    "O04_strongest_of_each": [],
    "P06_by_profile_or_pattern": [],
    "W04_lifted_strength": [],
    "F18_finding_strings": ["rated"],
    "F19_report": ["rated"],
}


@pytest.mark.parametrize("name", WRITTEN)
def test_whole_scores_are_not_written(spark, monkeypatch, name):
    written, stored = [], iterate.stored
    monkeypatch.setattr(iterate, "stored", lambda df, name="round": written.append(name) or stored(df, name))
    QUERIES[name](spark, SF).count()
    assert [w for w in written if w in ("scored", "rated")] == WRITTEN[name]


#: Queries and the tables that they write over the edges: types and pairs come from one task, in one of two forms.
SURVEYED = {name: ["classes", "context", "survey"] + WRITTEN[name] for name in WRITTEN if name not in ("F06_edge_pattern", "F19_report", "F18_finding_strings")} | {
    "F06_edge_pattern": ["classes"],
    "F18_finding_strings": ["classes", "context", "nodes", "rated", "survey"],
    "F19_report": ["classes", "context", "degrees", "nodes", "rated", "survey"],
    "U06_cycle_edges": ["knots"],
    "G03_G04_cyclic": ["knots"],
}


@pytest.mark.parametrize("name", SURVEYED)
def test_stored_edges_are_not_written_again(spark, monkeypatch, name):
    written, stored = [], iterate.stored
    monkeypatch.setattr(fixtures, "PLAIN_LINES", 0)
    monkeypatch.setattr(iterate, "stored", lambda df, name="round": written.append(name) or stored(df, name))
    QUERIES[name](spark, SF).count()
    assert sorted(w for w in written if w not in ("orders", "runs", "round")) == sorted(SURVEYED[name] + ["edges"])


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_survey_gives_what_joins_give(spark, monkeypatch):
    random = np.random.default_rng(3)
    kinds = ["Method", "Interface", "Field", None]
    ends = random.integers(0, 12, (60, 2))
    edges = spark.createDataFrame([(i, int(a), int(b), kinds[i % 4], None) for i, (a, b) in enumerate(ends)], "edge_seq int, src long, dst long, dep_type string, member_name string")
    nodes = spark.createDataFrame([(i, f"N{i}Service", "a.domain", "p", "Class", False, False, False) for i in range(9)], "node_id long, name string, namespace string, project string, kind string, is_abstract boolean, is_sealed boolean, is_static boolean")
    one = DependencyGraph(nodes, edges)
    assert one.survey is not None
    found = [one.components, one.cyclic, one.scored]
    monkeypatch.setattr(iterate, "LOCAL_NUMBERS", 0)
    joined = DependencyGraph(nodes, edges)
    assert joined.survey is None and joined.knots is None
    for a, b in zip(found, [joined.components, joined.cyclic, joined.scored], strict=True):
        assert a.dtypes == b.dtypes and _rows(a) == _rows(b)
    assert DependencyGraph(nodes, edges.unionByName(edges.limit(1).withColumn("src", F.lit(None).cast("long")))).survey is None


def _named_graph(spark):
    random = np.random.default_rng(5)
    kinds = ["Method", "Interface", "Constructor", "Event", "Inheritance", None]
    names = ["OrderRepository", "UserFactory", "PriceService", "JobHandler", "İService", "ServİceTest", "TestMock", None, "AppSettings", "DataContext"]
    spaces = ["Shop.Domain", "Shop.Infrastructure.External", "shop.Data.Persistence", "Web.UI", "Tests", None, "", "Shop.Domain.Models"]
    ends = random.integers(0, 40, (300, 2))
    edges = spark.createDataFrame([(i, int(a), int(b), kinds[i % 6], "SaveAll" if i % 4 else None) for i, (a, b) in enumerate(ends)], "edge_seq int, src long, dst long, dep_type string, member_name string")
    rows = [(i, names[i % 10], spaces[i % 8], "p", [None, "Class", "Interface"][i % 3], [None, True, False][i % 3], i % 4 == 0, i % 5 == 0, i) for i in range(35)]
    rows += [(3, "Second", "Other", "p", "Class", False, False, False, 99)]
    return spark.createDataFrame(rows, "node_id long, name string, namespace string, project string, kind string, is_abstract boolean, is_sealed boolean, is_static boolean, node_seq int"), edges


def test_types_that_tasks_know_give_what_joins_give(spark, monkeypatch):
    nodes, edges = _named_graph(spark)
    g = DependencyGraph(nodes, edges)
    found, few, patterns = g.scored, g.scores("profile", "src"), g.with_patterns()
    plan = g.scores("profile").sparkSession._jvm.PythonSQLUtils.explainString(few._jdf.queryExecution(), "simple")
    assert "Join" not in plan and "Exchange" not in plan  # edges are neither joined nor moved
    monkeypatch.setattr(graph, "KNOWN_TYPES", 0)
    g = DependencyGraph(nodes, edges)
    assert found.dtypes == g.scored.dtypes and _rows(found) == _rows(g.scored)
    assert _rows(few) == _rows(g.scored.select("profile", "src"))
    assert patterns.dtypes == g.with_patterns().dtypes and _rows(patterns) == _rows(g.with_patterns())


def test_edges_without_ends_have_patterns(spark, monkeypatch):
    nodes, edges = _named_graph(spark)
    edges = edges.withColumns({"src": F.when(F.col("edge_seq") % 3 > 0, F.col("src")), "dst": F.when(F.col("edge_seq") % 5 > 0, F.col("dst"))})
    found = _rows(DependencyGraph(nodes, edges).with_patterns())
    monkeypatch.setattr(graph, "KNOWN_TYPES", 0)
    assert found == _rows(DependencyGraph(nodes, edges).with_patterns())


def test_lines_without_a_number_come_first(spark):
    lines = fixtures.view(spark, SF, "lineitem").filter("l_orderkey < 300")
    lines = lines.withColumn("l_linenumber", F.when(F.col("l_partkey") % 3 > 0, F.col("l_linenumber"))).cache()
    plain = spark.sql(fixtures.FX["fx_edges"].replace("lineitem", "{lines}"), lines=lines)
    many = fixtures._many_edges(lines)
    # the fixture numbers edges of a source by order and line; rows alike in both are told apart by the rest
    assert plain.count() > 20 and _rows(plain) == _rows(many.select(plain.columns))
    lines.unpersist()


def test_each_score_is_written_once_for_all_its_rows(monkeypatch):
    made = []
    plain = text.Decimal
    monkeypatch.setattr(text, "Decimal", lambda v="0": made.append(v) or plain(v))
    values = [0.125, -0.125, 0.0, -0.0, float("nan"), float("inf"), float("-inf"), 2.675] * 50
    found = text.fixed2.func(pd.Series(values)).tolist()
    assert found == ["0.13", "-0.13", "0.00", "-0.00", "NaN", "∞", "-∞", "2.67"] * 50
    assert len([v for v in made if v != "0.01"]) == 8
    assert text.fixed2.func(pd.Series([], dtype="float64")).tolist() == []
