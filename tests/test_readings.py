"""Queries that need a graph's edges many times make them once."""

import pytest

from loomgraph.plans import fixtures
from loomgraph.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
ONCE = [
    "A04_metrics",
    "A05_mean_dimensions",
    "A06_profiles",
    "A07_pair_strength",
    "A08_relationship_strength",
    "A09_strongest_types",
    "A10_semantic_types",
    "A10_structural_types",
    "F06_edge_pattern",
    "F08_strength",
    "F18_edge_strings",
    "G12_strongest_path",
    "G16_in_cycle",
    "O02_strongest_weakest",
    "O03_strongest_composite",
    "O04_strongest_of_each",
    "P06_by_profile_or_pattern",
    "U06_cycle_edges",
    "W04_lifted_strength",
    "G03_components",
    "F18_finding_strings",
    "G03_G04_cyclic",
    "F19_report",
    "G13_order_of_cyclic",
]


@pytest.mark.parametrize("name", ONCE)
def test_edges_are_made_once(spark, monkeypatch, name):
    made, edges = spark.sparkContext.accumulator(0), fixtures.edges

    def counted(spark, d):
        df = edges(spark, d)

        def through(batches):
            for b in batches:
                made.add(b.num_rows)
                yield b

        return df.mapInArrow(through, df.schema)

    monkeypatch.setattr(fixtures, "edges", counted)
    QUERIES[name](spark, SF).count()
    assert made.value == edges(spark, SF).count()
