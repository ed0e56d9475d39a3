"""A query for each operator over the fixture views, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, coercion, literals, text
from ..functions.strength import DIMENSIONS
from ..operators import metrics, nested, projects, requests, runs
from ..operators.graph import is_system
from ..operators.hierarchy import KnowledgeGraph
from ..schemas import DEPENDENCY_TYPES, PROFILES
from ..sources import files, store
from ..streaming import pipeline
from . import fixtures as fx
from . import iterate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, recursive: bool = False, extra: str = ""):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = fx.oracle(sql, recursive, extra)
        return f

    return register


def _case(column: str, table: dict, default) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


# fixed values, stated here again so that the SQL does not take them from the engine
_WEIGHTS = {"Inheritance": 10, "Interface": 9, "Constructor": 8, "Field": 7, "Property": 6, "ReturnType": 5, "NewExpression": 5, "Method": 4, "GenericArgument": 4, "Delegate": 4, "MethodCall": 4, "Parameter": 3, "Event": 3, "StaticReference": 3, "FieldAccess": 3, "PropertyAccess": 3, "LocalVariable": 2, "LocalVariableType": 2}
_ENHANCED = {"Inheritance": 10, "Interface": 9, "Constructor": 8, "Field": 7, "Property": 6, "ReturnType": 5, "Method": 4, "GenericArgument": 4, "Parameter": 3, "Event": 3, "LocalVariable": 2}
_CHANGES = {"DomainCore": 0.1, "Infrastructure": 0.3, "ApplicationService": 0.2, "Testing": 0.5, "Configuration": 0.4}
# structural, semantic, coupling, stability, criticality, testability
_DIMENSIONS = {"Default": (0.25, 0.2, 0.2, 0.15, 0.1, 0.1), "MicroservicesBoundary": (0.3, 0.2, 0.3, 0.1, 0.05, 0.05), "DomainCore": (0.2, 0.4, 0.1, 0.2, 0.05, 0.05), "Infrastructure": (0.4, 0.1, 0.2, 0.3, 0.0, 0.0), "ApplicationService": (0.2, 0.3, 0.2, 0.1, 0.1, 0.1), "Testing": (0.1, 0.1, 0.1, 0.1, 0.1, 0.5)}


KINDS = "e AS (SELECT *, [" + ", ".join(f"'{k}'" for k in DEPENDENCY_TYPES) + "][dep_ord + 1] AS dep_type FROM fx_edges)"
DEGREES = """d AS (SELECT node_id, coalesce(i, 0) AS fan_in, coalesce(o, 0) AS fan_out FROM fx_nodes LEFT JOIN (SELECT dst AS node_id, count(*) AS i FROM fx_edges GROUP BY 1) USING (node_id)
  LEFT JOIN (SELECT src AS node_id, count(*) AS o FROM fx_edges GROUP BY 1) USING (node_id)),
a AS (SELECT *, fan_in > avg(fan_in) OVER () AND fan_out < avg(fan_out) OVER () AS is_stable, fan_out > avg(fan_out) OVER () AND fan_in < avg(fan_in) OVER () AS is_unstable FROM d)"""
CLOSURE = "clo AS (SELECT src AS x, dst AS y FROM fx_edges UNION SELECT x, dst FROM clo JOIN fx_edges ON y = src),\ncyc AS (SELECT DISTINCT x AS node_id FROM clo WHERE x = y)"


def _contains(column: str, *parts: str) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{p}')" for p in parts) + ")"


_C = _contains
TYPE_PATTERN = f"""CASE WHEN {_C("name", "repository")} OR {_C("namespace", "repository")} THEN 'Repository' WHEN {_C("name", "factory", "builder")} THEN 'Factory'
  WHEN {_C("name", "service")} AND NOT {_C("namespace", "infrastructure")} THEN 'ApplicationService' WHEN {_C("namespace", "domain", "core")} THEN 'DomainCore'
  WHEN {_C("namespace", "infrastructure")} THEN 'Infrastructure' WHEN {_C("namespace", "test")} THEN 'Testing' WHEN {_C("namespace", "config")} THEN 'Configuration' ELSE 'Unknown' END"""
LAYER = f"""CASE WHEN {_C("namespace", "presentation", "ui", "web")} THEN 'Presentation' WHEN {_C("namespace", "application")} OR ({_C("namespace", "service")} AND NOT {_C("namespace", "infrastructure")}) THEN 'Application'
  WHEN {_C("namespace", "domain", "core", "business")} THEN 'Domain' WHEN {_C("namespace", "infrastructure", "external")} THEN 'Infrastructure'
  WHEN {_C("namespace", "data", "persistence", "repository")} THEN 'Data' WHEN {_C("namespace", "test")} THEN 'Test' WHEN {_C("namespace", "config")} THEN 'Configuration' ELSE 'Unknown' END"""
_PATTERN = f"""CASE WHEN ({_C("t.name", "repository")} OR {_C("t.namespace", "repository", "data", "persistence")}) AND dep_type IN ('Interface', 'Constructor') THEN 'Repository'
  WHEN ({_C("t.name", "factory", "builder")} OR {_C("s.name", "factory", "builder")}) AND dep_type IN ('Method', 'Interface') THEN 'Factory'
  WHEN dep_type = 'Interface' AND {_C("t.name", "strategy", "handler", "processor")} THEN 'Strategy'
  WHEN dep_type = 'Event' OR (dep_type = 'Interface' AND {_C("t.name", "observer", "listener", "handler")}) THEN 'Observer'
  WHEN dep_type = 'Constructor' AND t.kind = 'Interface' THEN 'DependencyInjection'
  WHEN {_C("t.namespace", "domain", "core", "business")} OR ({_C("t.namespace", "model")} AND NOT {_C("t.namespace", "view")}) THEN 'DomainCore'
  WHEN ({_C("t.namespace", "service")} AND NOT {_C("t.namespace", "infrastructure")}) OR {_C("t.namespace", "application")} OR ({_C("t.name", "service")} AND NOT {_C("t.name", "test")}) THEN 'ApplicationService'
  WHEN {_C("t.namespace", "infrastructure", "external", "integration", "persistence")} THEN 'Infrastructure'
  WHEN {_C("t.namespace", "data", "repository", "dal", "persistence")} OR {_C("t.name", "repository", "context")} THEN 'DataAccess'
  WHEN {_C("s.name", "test", "mock")} OR {_C("t.name", "test", "mock")} OR {_C("s.namespace", "test")} OR {_C("t.namespace", "test")} THEN 'Testing'
  WHEN {_C("t.namespace", "configuration", "config", "settings")} OR {_C("t.name", "configuration", "config", "settings")} THEN 'Configuration'
  WHEN lower(split_part(s.namespace, '.', 1)) <> lower(split_part(t.namespace, '.', 1)) THEN 'MicroservicesBoundary' ELSE 'Unknown' END"""
_MEMBER = f"CASE WHEN member_name IS NULL THEN 0.4 WHEN {_C('member_name', 'execute', 'process', 'handle')} THEN 0.8 WHEN {_C('member_name', 'get', 'set', 'save', 'delete')} THEN 0.6 WHEN {_C('member_name', 'helper', 'util', 'convert')} THEN 0.3 ELSE 0.4 END"
STRENGTH = (
    KINDS
    + ",\n"
    + CLOSURE
    + f""",
fs AS (SELECT node_id, min(edge_seq) AS first_seen, sum(i) AS ca, sum(o) AS ce FROM (SELECT src AS node_id, edge_seq, 0 AS i, 1 AS o FROM fx_edges UNION ALL SELECT dst, edge_seq, 1, 0 FROM fx_edges) GROUP BY 1),
ctx AS (SELECT n.*, {TYPE_PATTERN} AS pattern, {LAYER} AS layer, first_seen, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, c.node_id IS NOT NULL AS cyclic FROM fx_nodes n LEFT JOIN fs USING (node_id) LEFT JOIN cyc c USING (node_id)),
cf AS (SELECT *, CAST({_case("pattern", _CHANGES, 0.2)} AS DOUBLE) AS freq FROM ctx),
j AS (SELECT e.*, {_PATTERN} AS edge_pattern, s.namespace AS sns, t.namespace AS tns, t.kind AS tkind, t.is_abstract AS tab, t.is_sealed AS tse, t.is_static AS tst, s.ce AS sce, t.ca AS tca, t.ce AS tce,
    s.cyclic OR t.cyclic AS cyclic, s.freq AS sfreq, t.freq AS tfreq,
    CASE WHEN s.first_seen < edge_seq THEN s.pattern ELSE 'Unknown' END AS sp, CASE WHEN t.first_seen < edge_seq THEN t.pattern ELSE 'Unknown' END AS tp,
    CASE WHEN s.first_seen < edge_seq THEN s.layer ELSE 'Unknown' END || '>' || CASE WHEN t.first_seen < edge_seq THEN t.layer ELSE 'Unknown' END AS ly
  FROM e JOIN cf s ON s.node_id = src JOIN cf t ON t.node_id = dst),
k AS (SELECT *, CAST({_case("dep_type", _WEIGHTS, 1)} AS INTEGER) AS weight,
  least(1.0, ({_case("dep_type", _ENHANCED, 1)}) / 10.0::DOUBLE * CASE WHEN tp = 'DomainCore' THEN 1.3 WHEN sp = 'DomainCore' THEN 1.2 WHEN tp = 'Infrastructure' THEN 0.8 ELSE 1 END::DOUBLE
    * ({_case("tp", {"Factory": 1.2, "Repository": 1.3, "Strategy": 1.1, "Singleton": 0.7}, 1.0)})::DOUBLE
    * CASE WHEN ly IN ('Presentation>Application', 'Application>Domain', 'Infrastructure>Domain') THEN 1.2 WHEN ly IN ('Domain>Application', 'Domain>Presentation', 'Application>Presentation') THEN 0.6 ELSE 1 END::DOUBLE
    * CASE ly WHEN 'Domain>Presentation' THEN 0.5 WHEN 'Domain>Application' THEN 0.7 ELSE 1 END::DOUBLE + CASE dep_type WHEN 'Interface' THEN 0.2 WHEN 'Constructor' THEN 0.15 ELSE 0 END::DOUBLE) AS structural,
  (CASE dep_type WHEN 'Interface' THEN 0.9 WHEN 'Inheritance' THEN 0.85 WHEN 'Constructor' THEN 0.8 WHEN 'Property' THEN 0.7 WHEN 'Field' THEN 0.6 WHEN 'LocalVariable' THEN 0.2 WHEN 'Method' THEN {_MEMBER} ELSE 0.4 END::DOUBLE
    + CASE WHEN sns = tns THEN 0.8 WHEN starts_with(sns, tns) OR starts_with(tns, sns) THEN 0.6 ELSE 0.4 END::DOUBLE + CASE WHEN tkind = 'Interface' THEN 0.9 WHEN tab THEN 0.8 WHEN tse THEN 0.4 ELSE 0.6 END::DOUBLE
    + CASE WHEN sp = 'Repository' AND tp = 'DomainCore' THEN 0.9 WHEN sp = 'ApplicationService' AND tp = 'Repository' THEN 0.8 ELSE 0.5 END::DOUBLE) / 4 AS semantic,
  CASE WHEN tca + sce = 0 THEN 0.1 ELSE least(1.0, least(1.0, (tca + sce) / 20.0::DOUBLE) * CASE WHEN cyclic THEN 1.3 ELSE 1 END::DOUBLE) END AS coupling,
  greatest(0.1, (CASE dep_type WHEN 'Interface' THEN 0.9 ELSE 0.5 END::DOUBLE + CASE WHEN tkind = 'Interface' THEN 0.9 WHEN tab THEN 0.8 WHEN tse THEN 0.6 ELSE 0.5 END::DOUBLE) / 2 - least(0.5, 0.2::DOUBLE * (sfreq + tfreq) / 2)) AS stability,
  (CASE tp WHEN 'DomainCore' THEN 0.9 WHEN 'ApplicationService' THEN 0.7 WHEN 'Infrastructure' THEN 0.5 ELSE 0.3 END::DOUBLE + CASE WHEN tp = 'DomainCore' THEN 0.9 WHEN sp = 'DomainCore' THEN 0.8 ELSE 0.4 END::DOUBLE
    + CASE dep_type WHEN 'Constructor' THEN 0.8 WHEN 'Interface' THEN 0.7 ELSE 0.4 END::DOUBLE + CASE dep_type WHEN 'Method' THEN 0.6 WHEN 'Property' THEN 0.4 ELSE 0.2 END::DOUBLE) / 4 AS criticality,
  (CASE WHEN tkind = 'Interface' THEN 0.9 WHEN tab THEN 0.8 WHEN tse THEN 0.2 ELSE 0.5 END::DOUBLE + (1 - least(1.0, (tca + tce) / 10.0::DOUBLE)) + (1 - CASE WHEN tst THEN 0.8 WHEN dep_type = 'StaticReference' THEN 0.9 ELSE 0.3 END::DOUBLE)) / 3 AS testability
  FROM j),
m AS (SELECT *, """
    + " + ".join(f"{d} * ({_case('edge_pattern', {p: w[i] for p, w in _DIMENSIONS.items() if p != 'Default'}, _DIMENSIONS['Default'][i])})::DOUBLE" for i, d in enumerate(DIMENSIONS))
    + """ AS composite FROM k),
st AS (SELECT *, CASE WHEN structural > 0.8 AND semantic > 0.8 THEN 'HighQualityCore' WHEN coupling > 0.8 AND stability < 0.4 THEN 'HighRiskCoupling' WHEN testability < 0.3 THEN 'TestingChallenge'
    WHEN criticality > 0.8 THEN 'BusinessCritical' WHEN structural < 0.3 AND semantic < 0.3 THEN 'WeakConnection' ELSE 'Balanced' END AS profile,
  CASE WHEN count(*) OVER w > 1 THEN greatest(composite, least(1.0, least(1.0, sum(weight) OVER w / (max(weight) OVER w)::DOUBLE / 10) + least(0.3, count(*) OVER w * 0.05::DOUBLE) + least(0.2, kinds * 0.03::DOUBLE))) ELSE composite END AS strength
  FROM m JOIN (SELECT src, dst, count(DISTINCT dep_type) AS kinds FROM e GROUP BY ALL) USING (src, dst) WINDOW w AS (PARTITION BY src, dst))"""
)


def r6(c) -> Column:
    """Rounded, with minus zero made plain."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def _edges_out(df: DataFrame) -> DataFrame:
    return df.select("edge_seq", "src", "dst")


g = fx.graph

# projections and filters


@query("P01_node_lookup", "SELECT node_id, name, namespace, project FROM fx_nodes WHERE node_id = 42")
def _(spark, d):
    return g(spark, d).node(42).select("node_id", "name", "namespace", "project")


@query("P02_nodes_by_project", "SELECT node_id, name FROM fx_nodes WHERE project = 'Brand#13'")
def _(spark, d):
    return g(spark, d).nodes_by_project("Brand#13").select("node_id", "name")


@query("P03_edges_of_node", "SELECT edge_seq, src, dst, 'out' AS role FROM fx_edges WHERE src = 0 AND dst IN (SELECT node_id FROM fx_nodes) UNION ALL SELECT edge_seq, src, dst, 'in' FROM fx_edges WHERE dst = 0 AND src IN (SELECT node_id FROM fx_nodes)")
def _(spark, d):
    x = g(spark, d)
    return _edges_out(x.dependencies_of(0)).withColumn("role", F.lit("out")).unionByName(_edges_out(x.dependents_of(0)).withColumn("role", F.lit("in")))


@query("P04_graph_in_edges", "SELECT edge_seq, src, dst FROM fx_edges WHERE dst = 10")
def _(spark, d):
    return _edges_out(g(spark, d).dependents_from_graph(10))


@query("P05_types_with_dependents", "SELECT DISTINCT dst AS node_id FROM fx_edges")
def _(spark, d):
    return g(spark, d).types_with_dependents()


@query("P06_by_profile_or_pattern", "SELECT edge_seq, profile, edge_pattern FROM st WHERE profile = 'TestingChallenge' OR edge_pattern = 'Repository'", True, STRENGTH)
def _(spark, d):
    return g(spark, d).scores("edge_seq", "profile", "edge_pattern").filter("profile = 'TestingChallenge' or edge_pattern = 'Repository'").select("edge_seq", "profile", "edge_pattern")


@query("P07_high_fan", "SELECT node_id, fan_in, fan_out FROM d WHERE fan_in >= 4 OR fan_out >= 4", extra=DEGREES)
def _(spark, d):
    x = g(spark, d)
    return x.high_fan_in(4).union(x.high_fan_out(4)).select("node_id", "fan_in", "fan_out").distinct()


@query("P08_stable_unstable", "SELECT node_id, is_stable, is_unstable FROM a WHERE is_stable OR is_unstable", extra=DEGREES)
def _(spark, d):
    x = g(spark, d)
    return x.stable_types().union(x.unstable_types()).select("node_id", "is_stable", "is_unstable")


@query("P09_is_stable", "SELECT is_stable, is_unstable FROM a WHERE node_id = 10", extra=DEGREES)
def _(spark, d):
    return g(spark, d).analysis.filter("node_id = 10").select("is_stable", "is_unstable")


@query("P10_system_types", "SELECT c_custkey FROM customer WHERE NOT regexp_matches(CASE WHEN c_custkey % 3 = 0 THEN 'System.IO' WHEN c_custkey % 3 = 1 THEN 'Microsoft.X' ELSE c_name END, '^(System|Microsoft|mscorlib)')")
def _(spark, d):
    c = fx.view(spark, d, "customer")
    ns = F.when(F.col("c_custkey") % 3 == 0, "System.IO").when(F.col("c_custkey") % 3 == 1, "Microsoft.X").otherwise(F.col("c_name"))
    return c.filter(~is_system(ns)).select("c_custkey")


@query(
    "P11_ast_predicates",
    "SELECT file_path, name FROM fx_ast WHERE lower(type) = 'class' AND lower(namespace) = 'shop.data.persistence' AND list_contains(string_split(modifiers_csv, '|'), 'public') AND list_has_any(string_split(base_types_csv, '|'), ['IEntity', 'IDisposable'])",
)
def _(spark, d):
    return nested.query_ast(fx.ast(spark, d), type="Class", namespace="Shop.DATA.Persistence", modifiers=["public"], base_types=["IEntity", "IDisposable"]).select("file_path", "name")


@query("P12_file_predicates", "SELECT doc_id, file_path FROM fx_files WHERE regexp_matches(file_path, '(?i)/EN/.*.md') AND has_ast AND doc_id BETWEEN 100 AND 700 AND status = 'Completed'")
def _(spark, d):
    at = lambda i: F.timestamp_seconds(F.lit(1_700_000_000 + i * 60))
    return nested.query_files(fx.entries(spark, d), pattern="/EN/*.md", has_level="Ast", after=at(100), before=at(700), status="Completed").select("doc_id", "file_path")


_DOMAIN_DOCS = "dd AS (SELECT file_path, unnest([split_part(content, ' ', 1), split_part(content, ' ', 2)]) AS name, source AS reasoning FROM fx_files JOIN documents USING (doc_id) WHERE has_domain)"


def _domain_docs(spark, d):
    f = fx.view(spark, d, "fx_files").filter("has_domain").join(fx.view(spark, d, "documents").select("doc_id", "source"), "doc_id")
    one = lambda i: F.struct(F.split_part("content", F.lit(" "), F.lit(i)).alias("name"), F.col("source").alias("reasoning"))
    return f.select("file_path", F.to_json(F.struct(F.array(one(1), one(2)).alias("domains"))).alias("content"))


@query("P13_domain_predicates", "SELECT file_path, name, reasoning FROM dd WHERE trim(name) <> '' AND regexp_matches(name, '(?i)^t.*e')", extra=_DOMAIN_DOCS)
def _(spark, d):
    return nested.query_domains(nested.domain_rows(_domain_docs(spark, d)), pattern="^t.*e")


@query("P14_unfiltered", "SELECT file_path, type, name FROM fx_ast")
def _(spark, d):
    return nested.query_ast(fx.ast(spark, d)).select("file_path", "type", "name")


@query("P15_path_predicates", "SELECT file_path, name FROM fx_ast WHERE regexp_matches(file_path, '(?i)/src/shop.*7.md')")
def _(spark, d):
    return nested.query_ast(fx.ast(spark, d), file_pattern="/src/shop*7.md").select("file_path", "name")


def _kg(spark, d):
    x = g(spark, d)
    members = x.edges.filter("member_name is not null").select(F.col("src").alias("node_id"), "member_name", F.lit("Method").alias("member_kind"))
    return KnowledgeGraph.build(x, members)


@query(
    "P16_kg_accessors",
    """SELECT 'child' AS role, 'type:' || node_id AS kg_id FROM fx_nodes WHERE project = 'Brand#13' AND namespace = 'Shop.Tests' UNION ALL
SELECT 'parent', 'namespace:' || project || '/' || namespace FROM fx_nodes WHERE node_id = 10 UNION ALL
SELECT 'sibling', 'type:' || b.node_id FROM fx_nodes a JOIN fx_nodes b USING (project, namespace) WHERE a.node_id = 10 AND b.node_id <> 10 UNION ALL
SELECT 'needs', 'type:' || dst FROM (SELECT DISTINCT dst FROM fx_edges WHERE src = 10)""",
)
def _(spark, d):
    k = _kg(spark, d)
    tag = lambda df, role, c="kg_id": df.select(F.lit(role).alias("role"), F.col(c).alias("kg_id"))
    out = tag(k.children("namespace:Brand#13/Shop.Tests"), "child").union(tag(k.parent("type:10"), "parent")).union(tag(k.siblings("type:10"), "sibling"))
    return out.union(tag(k.outgoing("type:10").filter("edge_type = 'DependsOn'"), "needs", "target"))


@query("P17_class_endpoints", "SELECT DISTINCT s.name AS src_name, t.name AS dst_name FROM fx_edges JOIN fx_nodes s ON s.node_id = src JOIN fx_nodes t ON t.node_id = dst WHERE s.kind = 'Class' AND t.kind = 'Class'")
def _(spark, d):
    x = g(spark, d)
    classes = x.nodes.filter("kind = 'Class'").select("node_id", "name")
    out = x.edges.join(classes.select(F.col("node_id").alias("src"), F.col("name").alias("src_name")), "src").join(classes.select(F.col("node_id").alias("dst"), F.col("name").alias("dst_name")), "dst")
    return out.select("src_name", "dst_name").distinct()


@query("P18_up_to_date", "SELECT file_path FROM fx_files WHERE status = 'Completed' AND doc_id % 4 <> 0")
def _(spark, d):
    done = fx.entries(spark, d).withColumn("file_hash", text.content_hash(F.col("content")))
    found = done.select("file_path", F.when(F.col("doc_id") % 4 == 0, "changed").otherwise(F.col("file_hash")).alias("file_hash"))
    return store.up_to_date(found, done).select("file_path")


@query("P19_extension_filter", "SELECT doc_id FROM fx_files WHERE ends_with(file_path, '1.md')")
def _(spark, d):
    return fx.view(spark, d, "fx_files").filter(F.endswith("file_path", F.lit("1.md"))).select("doc_id")


# joins


@query("J01_edge_ends", "SELECT edge_seq, s.name AS src_name, t.name AS dst_name FROM fx_edges LEFT JOIN fx_nodes s ON s.node_id = src LEFT JOIN fx_nodes t ON t.node_id = dst")
def _(spark, d):
    x = g(spark, d)
    name = lambda e: x.nodes.select(F.col("node_id").alias(e), F.col("name").alias(f"{e}_name"))
    return x.edges.join(name("src"), "src", "left").join(name("dst"), "dst", "left").select("edge_seq", "src_name", "dst_name")


@query("J02_cross_project", "SELECT edge_seq, s.project AS src_project, t.project AS dst_project FROM fx_edges LEFT JOIN fx_nodes s ON s.node_id = src LEFT JOIN fx_nodes t ON t.node_id = dst WHERE s.project IS DISTINCT FROM t.project")
def _(spark, d):
    return g(spark, d).cross_project().select("edge_seq", "src_project", "dst_project")


@query("J03_edge_context", "SELECT edge_seq, sp AS s_pattern, tp AS t_pattern, tca AS t_ca, sce AS s_ce FROM j", True, STRENGTH)
def _(spark, d):
    from ..functions import strength

    x = g(spark, d)
    out = strength.with_context(x.edges, strength.context(x.nodes, x.edges, x.cyclic))
    return out.select("edge_seq", F.col("s_seen_pattern").alias("s_pattern"), F.col("t_seen_pattern").alias("t_pattern"), F.col("t_ca").cast("decimal(38,0)").alias("t_ca"), F.col("s_ce").cast("decimal(38,0)").alias("s_ce"))


@query("J04_weights", f"SELECT edge_seq, dep_type, CAST({_case('dep_type', _WEIGHTS, 1)} AS INTEGER) AS weight FROM e", extra=KINDS)
def _(spark, d):
    return fx.edges(spark, d).select("edge_seq", "dep_type", literals.weight(F.col("dep_type")).alias("weight"))


@query("J05_reverse_edges", "SELECT edge_seq FROM fx_edges e WHERE EXISTS (SELECT 1 FROM fx_edges r WHERE r.src = e.dst AND r.dst = e.src)")
def _(spark, d):
    return g(spark, d).bidirectional().select("edge_seq")


@query("J06_targets", "SELECT DISTINCT node_id, name FROM fx_nodes JOIN fx_edges ON dst = node_id WHERE src = 0")
def _(spark, d):
    return g(spark, d).targets_of(0).select("node_id", "name")


LEVELS = """p AS (SELECT src, dst, 1 AS n FROM fx_dag UNION SELECT p.src, q.dst, n + 1 FROM p JOIN fx_dag q ON p.dst = q.src),
lv AS (SELECT node_id, CAST(coalesce(max(n), 0) AS INTEGER) AS level FROM fx_nodes LEFT JOIN p ON src = node_id GROUP BY 1)"""


def _dag(spark, d):
    x = g(spark, d)
    dag = fx.view(spark, d, "fx_dag").withColumn("edge_seq", F.monotonically_increasing_id())
    return type(x)(x.nodes, dag)


@query("J07_first_level", "SELECT node_id FROM fx_nodes WHERE node_id NOT IN (SELECT src FROM fx_dag)")
def _(spark, d):
    return _dag(spark, d).dependency_levels.filter("level = 0").select("node_id")


@query("J08_within_level", "SELECT node_id, NOT EXISTS (SELECT 1 FROM fx_dag JOIN lv b ON b.node_id = dst WHERE src = a.node_id AND a.level = b.level) AS can_parallel FROM lv a", True, LEVELS)
def _(spark, d):
    return _dag(spark, d).processing_plan().select("node_id", "can_parallel")


@query("J09_kg_edge_nodes", "SELECT 'type:' || node_id AS target, 'namespace:' || project || '/' || namespace AS source, name FROM fx_nodes")
def _(spark, d):
    k = _kg(spark, d)
    return k.edges.filter("edge_type = 'Contains'").join(k.by_type("Type").select(F.col("kg_id").alias("target"), "name"), "target").select("source", "target", "name")


@query("J10_new_files", "SELECT file_path, CASE WHEN has_ast THEN 'kept' WHEN contains(content, '!') THEN 'Failed' ELSE 'new' END AS ast FROM fx_files WHERE status <> 'Completed' OR NOT has_ast")
def _(spark, d):
    kept = store.FileStore(spark, iterate.shared_path(spark, "store"))
    old = F.transform_values(F.map_filter("level_data", lambda k, _: k == "Ast"), lambda _, v: v.withField("content", F.lit("kept")))
    kept.upsert(_store_entries(spark, d).withColumn("level_data", old))
    out = pipeline.process(_found_files(spark, d), kept, {"Ast": _plain_ast, "DomainKeywords": _plain_domains}, "2024-01-01 00:00:00")
    ast = F.col("level_data")["Ast"]
    return out.select("file_path", F.when(~ast["is_success"], "Failed").when(ast["content"] == "kept", "kept").otherwise("new").alias("ast"))


@query("J11_substitution", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS value FROM orders")
def _(spark, d):
    state = F.create_map(F.lit("F"), F.lit("finished"), F.lit("O"), F.lit("open"))
    return fx.view(spark, d, "orders").select("o_orderkey", runs.substitute(F.col("o_orderstatus"), state).alias("value"))


@query("J12_unknown_tools", "SELECT event_id, event_type AS tool, CASE WHEN event_type NOT IN ('click', 'view') THEN 'unknown tool ' || event_type || ', known are: click, view' END AS error FROM events")
def _(spark, d):
    calls = fx.view(spark, d, "events").select("event_id", F.col("event_type").alias("tool"))
    return runs.registered(calls, spark.createDataFrame([("click",), ("view",)], "tool string")).select("event_id", "tool", "error")


@query("J13_call_responses", "SELECT run_id, step_number, 'c' || step_number AS call_id, content AS body FROM fx_steps WHERE role <> 'user' AND step_number % 2 = 1")
def _(spark, d):
    s = fx.steps(spark, d).filter("observations is not null")
    calls = s.select("run_id", "step_number", F.concat(F.lit("c"), F.col("step_number").cast("string")).alias("call_id"))
    responses = s.select("run_id", F.explode("observations").alias("content"))
    return runs.call_pairs(calls, responses, "run_id").select("run_id", "step_number", "call_id", text.call_body(F.col("content")).alias("body"))


# aggregations


@query("A01_edge_count", "SELECT count(*) AS n_edges, count(DISTINCT src) AS n_sources FROM fx_edges")
def _(spark, d):
    return fx.view(spark, d, "fx_edges").agg(F.count("*").alias("n_edges"), F.count_distinct("src").alias("n_sources"))


@query("A02_degrees", "SELECT node_id, fan_in, fan_out FROM d", extra=DEGREES)
def _(spark, d):
    return g(spark, d).degrees.select("node_id", "fan_in", "fan_out")


@query("A03_all_dependents", "SELECT dst, src, edge_seq FROM fx_edges")
def _(spark, d):
    return fx.view(spark, d, "fx_edges").select("dst", "src", "edge_seq")


_METRICS = f"""SELECT count(*) AS total_types, max(fan_in) AS max_fan_in, max(fan_out) AS max_fan_out, round(avg(fan_in), 6) AS avg_fan_in, round(avg(fan_out), 6) AS avg_fan_out,
  count(*) FILTER (is_stable) AS stable_types, count(*) FILTER (is_unstable) AS unstable_types,
  count(*) FILTER (fan_in >= greatest(5, trunc(2 * (SELECT avg(fan_in) FROM d)))) AS high_fan_in_types, count(*) FILTER (fan_out >= greatest(5, trunc(2 * (SELECT avg(fan_out) FROM d)))) AS high_fan_out_types,
  count(*) FILTER (fan_in = 0) AS types_without_dependents, count(*) FILTER (fan_out = 0) AS types_without_dependencies,
  (SELECT count(*) FROM st) AS total_dependencies, (SELECT count(*) FROM st) AS total_dependents,
  {", ".join(f"(SELECT round({f}({c}), 6) FROM st) AS {n}" for f, c, n in [("avg", "composite", "avg_strength"), ("max", "composite", "max_strength"), ("min", "composite", "min_strength")] + [("avg", x, f"avg_{x}") for x in DIMENSIONS[:4]])},
  {", ".join(f"(SELECT count(*) FROM st WHERE profile = '{p}') AS n_{p}" for p in PROFILES)},
  (SELECT count(DISTINCT project) FROM fx_nodes) AS total_projects, (SELECT count(DISTINCT namespace) FROM fx_nodes) AS total_namespaces FROM a"""


@query("A04_metrics", _METRICS, True, STRENGTH + ",\n" + DEGREES)
def _(spark, d):
    out = metrics.metrics(g(spark, d))
    return out.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("A05_mean_dimensions", "SELECT round(avg(structural), 6) AS structural, round(avg(semantic), 6) AS semantic, round(avg(coupling), 6) AS coupling, round(avg(stability), 6) AS stability FROM st", True, STRENGTH)
def _(spark, d):
    return g(spark, d).scores(*DIMENSIONS[:4]).agg(*[r6(F.avg(c)).alias(c) for c in DIMENSIONS[:4]])


@query("A06_profiles", "SELECT profile, count(*) AS n FROM st GROUP BY 1", True, STRENGTH)
def _(spark, d):
    return g(spark, d).scores("profile").groupBy("profile").agg(F.count("*").alias("n"))


@query("A07_pair_strength", "SELECT src, dst, count(*) AS n, round(max(strength), 6) AS strength FROM st GROUP BY ALL HAVING count(*) > 1", True, STRENGTH)
def _(spark, d):
    return g(spark, d).scores("src", "dst", "strength").groupBy("src", "dst").agg(F.count("*").alias("n"), r6(F.max("strength")).alias("strength")).filter("n > 1")


_TRADE_KINDS = KINDS.replace("fx_edges", "fx_trade")


@query(
    "A07_pair_strength_trade",
    f"""SELECT src, dst, count(*) AS n, round(least(1.0, least(1.0, sum(w) / max(w)::DOUBLE / 10) + least(0.3, count(*) * 0.05::DOUBLE) + least(0.2, count(DISTINCT dep_type) * 0.03::DOUBLE)), 6) AS strength
FROM (SELECT *, {_case("dep_type", _WEIGHTS, 1)} AS w FROM e) GROUP BY ALL""",
    extra=_TRADE_KINDS,
)
def _(spark, d):
    from ..functions.strength import pair_strength

    kinds = F.array(*map(F.lit, DEPENDENCY_TYPES))
    t = fx.view(spark, d, "fx_trade").withColumn("dep_type", F.element_at(kinds, (F.col("dep_ord") + 1).cast("int"))).withColumn("w", literals.weight(F.col("dep_type")))
    out = t.groupBy("src", "dst").agg(F.count("*").alias("n"), F.count_distinct("dep_type").alias("k"), F.sum("w").alias("s"), F.max("w").alias("m"))
    return out.select("src", "dst", "n", r6(pair_strength(F.col("n"), F.col("k"), F.col("s"), F.col("m"))).alias("strength"))


@query("A08_relationship_strength", "SELECT src, dst, round(sum(strength * weight) / sum(weight), 6) AS strength FROM st GROUP BY ALL", True, STRENGTH)
def _(spark, d):
    return g(spark, d).relationship_strength().select("src", "dst", r6("strength").alias("strength"))


for _id, _column in (("A09_strongest_types", "strength"), ("A10_structural_types", "structural"), ("A10_semantic_types", "semantic")):

    @query(_id, f"SELECT src, round(avg({_column}), 6) AS mean FROM st GROUP BY 1 ORDER BY round(avg({_column}), 9) DESC, src LIMIT 15", True, STRENGTH)
    def _(spark, d, column=_column):
        return g(spark, d).top_by_mean(column, 15).select("src", r6("mean").alias("mean"))


REACH = "r AS (SELECT 0::BIGINT AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN fx_edges ON src = node WHERE depth < 60)"


@query(
    "A11_type_metrics",
    """SELECT node_id, fan_in, fan_out, is_stable, is_unstable, (SELECT count(*) FROM (SELECT x FROM clo WHERE y = 0 UNION SELECT 0)) AS impact_score, (SELECT count(*) FROM (SELECT y FROM clo WHERE x = 0 UNION SELECT 0)) AS dependency_score FROM a WHERE node_id = 0""",
    True,
    CLOSURE + ",\n" + DEGREES,
)
def _(spark, d):
    return metrics.type_metrics(g(spark, d), 0).select("node_id", "fan_in", "fan_out", "is_stable", "is_unstable", "impact_score", "dependency_score")


@query("A12_fan_in_out", "SELECT node_id, fan_in, fan_out, is_stable, is_unstable FROM a ORDER BY fan_in + fan_out DESC, node_id", extra=DEGREES)
def _(spark, d):
    return g(spark, d).fan_in_out().select("node_id", "fan_in", "fan_out", "is_stable", "is_unstable")


@query("A13_A14_instability", "SELECT node_id, fan_in AS ca, fan_out AS ce, round(CASE WHEN fan_in + fan_out = 0 THEN 0 ELSE fan_out / (fan_in + fan_out)::DOUBLE END, 6) AS instability FROM d", extra=DEGREES)
def _(spark, d):
    return g(spark, d).instability().withColumn("instability", r6("instability"))


@query("A15_coupling_intensity", "SELECT edge_seq, round(least(1.0, (t.fan_in + s.fan_out) / 20.0::DOUBLE), 6) AS intensity FROM fx_edges JOIN d s ON s.node_id = src JOIN d t ON t.node_id = dst", extra=DEGREES)
def _(spark, d):
    return g(spark, d).coupling_intensity().select("edge_seq", r6("intensity").alias("intensity"))


_PROJECTS = """pr AS (SELECT DISTINCT right(project, 1) AS solution, project, CASE WHEN right(project, 1) = '3' THEN 'VB' ELSE 'C#' END AS language FROM fx_nodes UNION ALL SELECT '1', 'Brand#0', 'C#'),
dc AS (SELECT project, concat(name, CASE WHEN project = 'Brand#12' THEN '.txt' ELSE '.cs' END) AS name FROM fx_nodes)"""


def _projects(spark, d):
    """Projects by their brand's last digit, one without documents, one without documents of its language."""
    n = fx.view(spark, d, "fx_nodes")
    last = F.right("project", F.lit(1))
    some = n.select(last.alias("solution"), "project", F.when(last == "3", "VB").otherwise("C#").alias("language")).distinct()
    documents = n.select("project", F.concat("name", F.when(F.col("project") == "Brand#12", ".txt").otherwise(".cs")).alias("name"))
    return some.union(spark.createDataFrame([("1", "Brand#0", "C#")], some.schema)), documents


@query(
    "A16_solution_summary",
    "SELECT solution, count(*) AS project_count, count(*) FILTER (language = 'C#') AS language_project_count, CAST(coalesce(sum(n) FILTER (language = 'C#'), 0) AS BIGINT) AS total_documents, coalesce(string_agg(project, ',' ORDER BY project) FILTER (language = 'C#'), '') AS project_names FROM pr LEFT JOIN (SELECT project, count(*) AS n FROM dc GROUP BY 1) USING (project) GROUP BY 1",
    extra=_PROJECTS,
)
def _(spark, d):
    return projects.summary(*_projects(spark, d)).withColumn("project_names", F.array_join("project_names", ","))


@query(
    "A17_validation",
    """SELECT solution, count(*) FILTER (language = 'C#') > 0 AS is_valid, CASE WHEN count(*) FILTER (language = 'C#') > 0 THEN '' ELSE 'No C# projects found in solution' END AS errors, coalesce(string_agg(w, '; ' ORDER BY w), '') AS warnings FROM (
SELECT solution, language, CASE WHEN language <> 'C#' THEN NULL WHEN project NOT IN (SELECT project FROM dc) THEN concat('Project ', chr(39), project, chr(39), ' contains no documents')
  WHEN project NOT IN (SELECT project FROM dc WHERE ends_with(name, '.cs')) THEN concat('Project ', chr(39), project, chr(39), ' contains no C# files') END AS w FROM pr) GROUP BY 1""",
    extra=_PROJECTS,
)
def _(spark, d):
    return projects.validate(*_projects(spark, d)).withColumns({"errors": F.array_join("errors", "; "), "warnings": F.array_join("warnings", "; ")})


@query(
    "A18_kg_metrics",
    """SELECT count(*) AS n_types, count(DISTINCT project) AS n_projects, (SELECT count(*) FROM (SELECT DISTINCT project, namespace FROM fx_nodes)) AS n_namespaces, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM fx_edges)) AS n_depends,
(SELECT count(*) FROM (SELECT DISTINCT src, member_name FROM fx_edges WHERE member_name IS NOT NULL)) AS n_members FROM fx_nodes""",
)
def _(spark, d):
    m = _kg(spark, d).metrics()
    return m.select(F.col("n_Type").alias("n_types"), F.col("n_Project").alias("n_projects"), F.col("n_Namespace").alias("n_namespaces"), F.col("n_DependsOn").alias("n_depends"), F.col("n_Member").alias("n_members"))


@query("A19_cache_statistics", "SELECT count(*) AS total_files, count(*) FILTER (status = 'Completed') AS completed, count(*) FILTER (status = 'Failed') AS failed, CAST(sum(file_size) AS BIGINT) AS total_size, count(*) FILTER (has_ast) AS n_Ast, count(*) FILTER (has_domain) AS n_DomainKeywords FROM fx_files")
def _(spark, d):
    return store.statistics(fx.entries(spark, d), pipeline.REQUIRED).drop("oldest", "newest")


@query("A20_queue_statistics", "SELECT count(*) FILTER (status = 'Pending') AS pending, count(*) FILTER (status = 'Processing') AS active, count(*) FILTER (status = 'Completed') AS completed, count(*) FILTER (status = 'Failed') AS failed, round(avg(duration_s) FILTER (status = 'Completed'), 6) AS avg_duration_s FROM fx_jobs")
def _(spark, d):
    return pipeline.queue_statistics(fx.view(spark, d, "fx_jobs")).withColumn("avg_duration_s", r6("avg_duration_s"))


def _ast_documents(spark, d):
    """A JSON document for each namespace: its types, by kind."""
    plural = {"class": "classes", "interface": "interfaces", "enum": "enums", "record": "records", "struct": "structs"}
    rows = fx.ast(spark, d)
    one = F.struct("name", "modifiers", F.col("base_types").alias("baseTypes"), "attributes")
    arrays = [F.sort_array(F.collect_list(F.when(F.col("type") == t, one))).alias(p) for t, p in plural.items()]
    out = rows.groupBy("namespace").agg(*arrays)
    body = F.struct(F.lit("CompilationUnit").alias("Type"), F.col("namespace").alias("Namespace"), F.expr("cast(array() as array<string>)").alias("usings"), *plural.values())
    return out.select(F.concat(F.lit("/src/"), "namespace").alias("file_path"), F.to_json(body).alias("content"))


@query(
    "A21_index_counts",
    """SELECT '/src/' || namespace AS file_path, namespace, CAST(count(*) FILTER (type = 'class') AS INTEGER) AS n_classes, CAST(count(*) FILTER (type = 'interface') AS INTEGER) AS n_interfaces, CAST(count(*) FILTER (type = 'enum') AS INTEGER) AS n_enums,
CAST(count(*) FILTER (type = 'record') AS INTEGER) AS n_records, CAST(count(*) FILTER (type = 'struct') AS INTEGER) AS n_structs FROM fx_ast GROUP BY namespace""",
)
def _(spark, d):
    return nested.index(_ast_documents(spark, d)).drop("usings")


@query(
    "A22_job_results",
    """SELECT file_path, '[' || concat_ws(',', CASE WHEN has_ast THEN '"Ast"' END, CASE WHEN has_domain THEN '"DomainKeywords"' END) || ']' AS levels, CASE WHEN has_ast THEN 'true' END AS ast_success, CASE WHEN has_domain THEN '{}' END AS domain_content,
CASE WHEN has_ast THEN 1.5 ELSE 0 END::DOUBLE + CASE WHEN has_domain THEN 0.25 ELSE 0 END::DOUBLE AS total_duration FROM fx_files""",
)
def _(spark, d):
    timed = F.transform_values("level_data", lambda k, v: v.withField("duration_s", F.when(k == "Ast", 1.5).otherwise(0.25)))
    out = pipeline.job_results(_store_entries(spark, d).withColumn("level_data", timed))
    part = lambda path, name: F.get_json_object("result", path).alias(name)
    return out.select("file_path", part("$.ProcessedLevels", "levels"), part("$.Results.Ast.Success", "ast_success"), part("$.Results.DomainKeywords.Content", "domain_content"), F.get_json_object("result", "$.TotalDuration").cast("double").alias("total_duration"))


@query("A22_worker_load", "SELECT worker_id, count(*) AS n, round(sum(duration_s), 4) AS seconds FROM fx_jobs GROUP BY 1")
def _(spark, d):
    return pipeline.worker_load(fx.view(spark, d, "fx_jobs")).select("worker_id", F.col("jobs").alias("n"), F.round("seconds", 4).alias("seconds"))


_STEPS = "s AS (SELECT *, CAST(trunc(n_chars / 4) AS BIGINT) AS input_tokens, CAST(trunc(n_chars / 8) AS BIGINT) AS output_tokens, n_chars / 100.0::DOUBLE AS duration_s FROM fx_steps)"


@query("A23_A24_run_totals", "SELECT run_id, count(*) AS n_steps, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(avg(duration_s), 6) AS avg_duration_s, round(sum(duration_s), 6) AS total_duration_s FROM s GROUP BY 1", extra=_STEPS)
def _(spark, d):
    out = runs.totals(fx.steps(spark, d))
    return out.withColumns({c: r6(c) for c in ("avg_duration_s", "total_duration_s")})


@query("A23_run_state", "SELECT run_id, CASE WHEN count(*) >= 6 THEN 'max_steps_error' ELSE 'running' END AS state FROM fx_steps GROUP BY 1")
def _(spark, d):
    return runs.run_state(fx.steps(spark, d), 6)


@query("A25_grouped_dependents", "SELECT dst, string_agg(DISTINCT dep_type, ', ' ORDER BY dep_type) AS kinds FROM e GROUP BY 1", extra=KINDS)
def _(spark, d):
    return fx.edges(spark, d).groupBy("dst").agg(F.array_join(F.array_sort(F.collect_set("dep_type")), ", ").alias("kinds"))


@query("A26_filter_accounting", "SELECT count(*) AS filtered_from, count(*) FILTER (status = 'Completed') AS filtered FROM fx_files")
def _(spark, d):
    return fx.view(spark, d, "fx_files").agg(F.count("*").alias("filtered_from"), F.count_if(F.col("status") == "Completed").alias("filtered"))


# windows


@query("W01_value_vs_average", "SELECT node_id, round(fan_in / avg(fan_in) OVER (), 6) AS in_ratio, round(fan_out / avg(fan_out) OVER (), 6) AS out_ratio FROM d", extra=DEGREES)
def _(spark, d):
    return g(spark, d).analysis.select("node_id", r6(F.col("fan_in") / F.col("avg_in")).alias("in_ratio"), r6(F.col("fan_out") / F.col("avg_out")).alias("out_ratio"))


@query("W02_first_seen", "SELECT node_id, min(edge_seq) AS first_seen FROM (SELECT src AS node_id, edge_seq FROM fx_edges UNION ALL SELECT dst, edge_seq FROM fx_edges) GROUP BY 1")
def _(spark, d):
    e = fx.view(spark, d, "fx_edges")
    return e.select(F.col("src").alias("node_id"), "edge_seq").union(e.select("dst", "edge_seq")).groupBy("node_id").agg(F.min("edge_seq").alias("first_seen"))


@query("W03_running_tokens", "SELECT run_id, step_number, CAST(row_number() OVER w AS INTEGER) AS step_index, CAST(sum(input_tokens) OVER w AS BIGINT) AS input_so_far FROM s WINDOW w AS (PARTITION BY run_id ORDER BY step_number)", extra=_STEPS)
def _(spark, d):
    return runs.running_tokens(fx.steps(spark, d)).select("run_id", "step_number", "step_index", "input_so_far")


@query("W04_lifted_strength", "SELECT edge_seq, round(strength, 6) AS strength, round(composite, 6) AS composite FROM st WHERE strength > composite", True, STRENGTH)
def _(spark, d):
    return g(spark, d).scores("edge_seq", "strength", "composite").filter("strength > composite").select("edge_seq", r6("strength").alias("strength"), r6("composite").alias("composite"))


@query("W05_processing_order", "SELECT node_id, CAST(row_number() OVER (ORDER BY level DESC, node_id) - 1 AS INTEGER) AS processing_order FROM lv", True, LEVELS)
def _(spark, d):
    return _dag(spark, d).topological_order().select("node_id", "processing_order")


@query("W06_planning_steps", "SELECT run_id, step_number, step_number + 1 = 1 OR step_number % 3 = 0 AS plans FROM fx_steps")
def _(spark, d):
    return fx.view(spark, d, "fx_steps").select("run_id", "step_number", runs.plans_at(F.col("step_number") + 1, 3).alias("plans"))


@query("W07_latest_entry", "SELECT worker_id, arg_max(job_id, struct_pack(a := created_at, b := job_id)) AS job_id FROM fx_jobs GROUP BY 1")
def _(spark, d):
    j = fx.view(spark, d, "fx_jobs").withColumn("at", F.struct("created_at", "job_id"))
    return store.latest(j, "worker_id", "at").select("worker_id", "job_id")


@query("W08_snippet", "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 7), chr(10)) AS snippet FROM documents")
def _(spark, d):
    return fx.view(spark, d, "documents").select("doc_id", text.snippet(F.col("text"), F.lit(2), F.lit(2)).alias("snippet"))


@query("W09_trimmed_history", "SELECT run_id, step_number FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step_number) AS n, count(*) OVER (PARTITION BY run_id) AS c FROM fx_steps) WHERE c <= 6 OR n > 2")
def _(spark, d):
    return runs.trimmed(fx.view(spark, d, "fx_steps")).select("run_id", "step_number")


# sort and limit


@query("O01_most_connected", "(SELECT node_id, fan_out AS degree, 'out' AS role FROM d ORDER BY fan_out DESC, node_id LIMIT 10) UNION ALL (SELECT node_id, fan_in, 'in' FROM d ORDER BY fan_in DESC, node_id LIMIT 10)", extra=DEGREES)
def _(spark, d):
    x = g(spark, d)
    return x.most_dependencies().select("node_id", F.col("fan_out").alias("degree"), F.lit("out").alias("role")).union(x.most_dependents().select("node_id", "fan_in", F.lit("in")))


@query("O02_strongest_weakest", "(SELECT edge_seq, 'strong' AS role FROM st ORDER BY round(strength, 9) DESC, edge_seq LIMIT 20) UNION ALL (SELECT edge_seq, 'weak' FROM st ORDER BY round(strength, 9), edge_seq LIMIT 20)", True, STRENGTH)
def _(spark, d):
    x = g(spark, d)
    x.scored = x.rated.withColumn("strength", F.round("strength", 9))
    return x.strongest().select("edge_seq", F.lit("strong").alias("role")).union(x.weakest().select("edge_seq", F.lit("weak")))


@query("O03_strongest_composite", "SELECT edge_seq, round(composite, 6) AS composite FROM st ORDER BY round(composite, 9) DESC, edge_seq LIMIT 20", True, STRENGTH)
def _(spark, d):
    x = g(spark, d)
    x.scored = x.scores("edge_seq", "composite").withColumn("composite", F.round("composite", 9))
    return x.strongest(20, "composite").select("edge_seq", r6("composite").alias("composite"))


@query("O04_strongest_of_each", "SELECT src, edge_seq, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(strength, 9) DESC, edge_seq) AS n FROM st) WHERE n <= 2", True, STRENGTH)
def _(spark, d):
    x = g(spark, d)
    x.scored = x.scores("src", "edge_seq", "strength").withColumn("strength", F.round("strength", 9))
    return x.strongest_of_each(2).select("src", "edge_seq", "rank")


@query("O05_processing_edges", "SELECT edge_seq, t.level AS target_level, s.level AS source_level FROM fx_edges LEFT JOIN lv t ON t.node_id = dst LEFT JOIN lv s ON s.node_id = src ORDER BY t.level, s.level, dep_ord, edge_seq LIMIT 100", True, LEVELS)
def _(spark, d):
    x, order = g(spark, d), _dag(spark, d).dependency_levels.withColumnRenamed("level", "processing_order")
    return x.processing_edges(order).limit(100).select("edge_seq", F.col("target_order").alias("target_level"), F.col("source_order").alias("source_level"))


@query("O05_processing_order", "SELECT edge_seq, t.level AS target_level, s.level AS source_level, row_number() OVER (ORDER BY t.level NULLS LAST, s.level NULLS LAST, dep_ord, edge_seq) AS place FROM fx_edges LEFT JOIN lv t ON t.node_id = dst LEFT JOIN lv s ON s.node_id = src", True, LEVELS)
def _(spark, d):
    x, order = g(spark, d), _dag(spark, d).dependency_levels.withColumnRenamed("level", "processing_order")
    return x.processing_places(order).select("edge_seq", F.col("target_order").alias("target_level"), F.col("source_order").alias("source_level"), "place")


@query("O06_cache_eviction", "SELECT doc_id FROM fx_files ORDER BY doc_id DESC LIMIT 300")
def _(spark, d):
    return store.evicted(fx.entries(spark, d), 300, "processed_at").select("doc_id")


@query("O07_completed_eviction", "SELECT job_id, status FROM fx_jobs WHERE status <> 'Completed' OR job_id IN (SELECT job_id FROM fx_jobs WHERE status = 'Completed' ORDER BY created_at DESC, job_id DESC LIMIT 100)")
def _(spark, d):
    return pipeline.keep_completed(fx.view(spark, d, "fx_jobs"), 100).select("job_id", "status")


@query("O08_report_sections", "SELECT node_id FROM a WHERE is_stable ORDER BY node_id LIMIT 10", extra=DEGREES)
def _(spark, d):
    return g(spark, d).stable_types().orderBy("node_seq").limit(10).select("node_id")


# set operations


@query("U01_edges_both_ways", "SELECT edge_seq, src, dst FROM fx_edges WHERE src = 0 UNION ALL SELECT edge_seq, src, dst FROM fx_edges WHERE dst = 0")
def _(spark, d):
    e = fx.view(spark, d, "fx_edges").select("edge_seq", "src", "dst")
    return e.filter("src = 0").unionByName(e.filter("dst = 0"))


@query("U02_tools_and_agents", "SELECT DISTINCT event_type AS tool, CASE WHEN event_type < 'd' THEN 'agent' ELSE 'tool' END AS kind FROM events")
def _(spark, d):
    names = fx.view(spark, d, "events").select(F.col("event_type").alias("tool")).distinct()
    return runs.tools_and_agents(names.withColumn("kind", F.lit("tool")), names.filter("tool < 'd'").withColumn("kind", F.lit("agent")))


@query("U03_distinct_names", "SELECT DISTINCT name FROM fx_nodes JOIN fx_edges ON node_id = dst")
def _(spark, d):
    x = g(spark, d)
    return x.nodes.join(x.types_with_dependents(), "node_id").select("name").distinct()


@query("U04_involved_nodes", "SELECT src AS node_id FROM fx_edges UNION SELECT dst FROM fx_edges")
def _(spark, d):
    e = fx.view(spark, d, "fx_edges")
    return e.select(F.col("src").alias("node_id")).union(e.select("dst")).distinct()


@query("U05_concatenated", "SELECT edge_seq, 'a' AS part FROM fx_edges WHERE dep_ord < 5 UNION ALL SELECT edge_seq, 'b' FROM fx_edges WHERE dep_ord < 8")
def _(spark, d):
    e = fx.view(spark, d, "fx_edges")
    return e.filter("dep_ord < 5").select("edge_seq", F.lit("a").alias("part")).unionByName(e.filter("dep_ord < 8").select("edge_seq", F.lit("b").alias("part")))


@query("U06_cycle_edges", "SELECT edge_seq FROM fx_edges WHERE src IN (SELECT node_id FROM cyc) AND dst IN (SELECT node_id FROM cyc)", True, CLOSURE)
def _(spark, d):
    x = g(spark, d)
    on = lambda e: x.cyclic.withColumnRenamed("node_id", e)
    return x.drawn.edges.join(on("src"), "src", "left_semi").join(on("dst"), "dst", "left_semi").select("edge_seq")


# scalar functions


@query("F01_F03_weights", f"SELECT edge_seq, CAST({_case('dep_type', _WEIGHTS, 1)} AS INTEGER) AS weight, CAST({_case('dep_type', _ENHANCED, 1)} AS INTEGER) AS enhanced, round(least(1.0, ({_case('dep_type', _WEIGHTS, 1)}) / 10.0::DOUBLE + CASE WHEN dep_type = 'Constructor' THEN 0.2 WHEN dep_type IN ('Property', 'Field') THEN 0.1 WHEN dep_type IN ('Inheritance', 'Interface') THEN 0.3 ELSE 0 END), 6)::DOUBLE AS base_strength FROM e", extra=KINDS)
def _(spark, d):
    k = F.col("dep_type")
    return fx.edges(spark, d).select("edge_seq", literals.weight(k).alias("weight"), literals.lookup(literals.ENHANCED_WEIGHTS, k, 1).alias("enhanced"), r6(literals.base_strength(k)).alias("base_strength"))


@query("F04_F05_classes", f"SELECT node_id, {TYPE_PATTERN} AS pattern, {LAYER} AS layer FROM fx_nodes")
def _(spark, d):
    return fx.view(spark, d, "fx_nodes").select("node_id", classify.type_pattern(F.col("name"), F.col("namespace")).alias("pattern"), classify.layer(F.col("namespace")).alias("layer"))


@query("F06_edge_pattern", "SELECT edge_seq, edge_pattern FROM j", True, STRENGTH)
def _(spark, d):
    return g(spark, d).with_patterns().select("edge_seq", "edge_pattern")


@query("F07_change_frequency", "SELECT node_id, freq FROM cf", True, STRENGTH)
def _(spark, d):
    p = classify.type_pattern(F.col("name"), F.col("namespace"))
    return fx.view(spark, d, "fx_nodes").select("node_id", literals.lookup(literals.CHANGE_FREQUENCY, p, 0.2).alias("freq"))


@query("F08_strength", "SELECT edge_seq, " + ", ".join(f"round({c}, 6) AS {c}" for c in [*DIMENSIONS, "composite", "strength"]) + ", profile FROM st", True, STRENGTH)
def _(spark, d):
    return g(spark, d).scores("edge_seq", *DIMENSIONS, "composite", "strength", "profile").select("edge_seq", *[r6(c).alias(c) for c in [*DIMENSIONS, "composite", "strength"]], "profile")


@query("F09_member_purpose", f"SELECT edge_seq, ({_MEMBER})::DOUBLE AS purpose FROM fx_edges")
def _(spark, d):
    m, has = F.col("member_name"), classify.has
    return fx.view(spark, d, "fx_edges").select("edge_seq", F.when(has(m, "execute", "process", "handle"), 0.8).when(has(m, "get", "set", "save", "delete"), 0.6).when(has(m, "helper", "util", "convert"), 0.3).otherwise(0.4).alias("purpose"))


@query("F10_hashes", "SELECT page_id, sha256(url) AS key, base64(unhex(sha256(html))) AS hash FROM pages")
def _(spark, d):
    return fx.view(spark, d, "pages").select("page_id", text.path_key(F.col("url")).alias("key"), text.content_hash(F.col("html")).alias("hash"))


@query("F11_request_key", """SELECT run_id, step_number, sha256('salt:{"run_id":' || run_id || ',"step_number":' || step_number || '}') AS key FROM fx_steps""")
def _(spark, d):
    return fx.view(spark, d, "fx_steps").select("run_id", "step_number", text.request_key(F.struct("run_id", "step_number"), "salt").alias("key"))


@query("F12_F15_names", "SELECT node_id, string_split(namespace, '.')[-1] AS tail, array_to_string(string_split(namespace, '.')[1:-2], '.') AS parent, concat(name, ':', node_id, '-', node_id + 9) AS place FROM fx_nodes")
def _(spark, d):
    n, i = fx.view(spark, d, "fx_nodes"), F.col("node_id")
    return n.select("node_id", text.namespace_tail(F.col("namespace")).alias("tail"), text.namespace_parent(F.col("namespace")).alias("parent"), text.location(F.col("name"), i, i + 9).alias("place"))


@query("F13_kg_edge_ids", "SELECT DISTINCT concat('type:', src, '-DependsOn-type:', dst) AS edge_id FROM fx_edges")
def _(spark, d):
    return _kg(spark, d).edges.filter("edge_type = 'DependsOn'").select("edge_id")


@query("F14_signatures", "SELECT c_custkey, concat('void ', c_name, '(int ', c_mktsegment, ', long n)') AS signature FROM customer")
def _(spark, d):
    parameters = F.array(F.struct(F.lit("int").alias("type"), F.col("c_mktsegment").alias("name")), F.struct(F.lit("long").alias("type"), F.lit("n").alias("name")))
    return fx.view(spark, d, "customer").select("c_custkey", text.signature(F.col("c_name"), parameters, F.lit("void")).alias("signature"))


@query("F16_markdown", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '\r\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n\t\r]+|[ \n\t\r]+$', '', 'g') || chr(10) AS body FROM pages")
def _(spark, d):
    return fx.view(spark, d, "pages").select("page_id", text.normalise_markdown(F.col("html")).alias("body"))


@query("F17_safe_names", "SELECT c_custkey, replace(replace(replace(c_name || '<T> x', '<', ''), '>', ''), ' ', '_') AS name FROM customer")
def _(spark, d):
    return fx.view(spark, d, "customer").select("c_custkey", text.safe_file_name(F.concat("c_name", F.lit("<T> x"))).alias("name"))


@query("F18_parallel_edges", "SELECT src, dst, count(*) AS n FROM fx_edges GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return fx.view(spark, d, "fx_edges").groupBy("src", "dst").agg(F.count("*").alias("n")).filter("n > 1")


@query("F18_edge_strings", None)
def _(spark, d):
    x = g(spark, d)
    s, t = (x.nodes.select(F.col("node_id").alias(end), F.col("name").alias(f"{end}_name")) for end in ("src", "dst"))
    e = x.scores("edge_seq", "src", "dst", "member_name", "dep_type", "strength", "composite", "profile", *DIMENSIONS).join(s, "src", "left").join(t, "dst", "left")
    of, to = (F.coalesce(f"{end}_name", F.col(end).cast("string")) for end in ("src", "dst"))
    line = text.edge_display(of, F.col("member_name"), to, F.col("dep_type"), F.col("strength"), F.col("composite"), F.col("profile"), F.lit(None).cast("string"))
    return e.select("edge_seq", line.alias("edge"), text.strength_display(F.col("composite"), {k: F.col(k) for k in DIMENSIONS}, F.col("profile")).alias("strengths"))


@query("F18_node_strings", "SELECT node_id, concat(name, ' (', project, ') - ', fan_out, ' deps, ', fan_in, ' dependents') AS node FROM d JOIN fx_nodes USING (node_id)", extra=DEGREES)
def _(spark, d):
    x = g(spark, d)
    rows = x.degrees.select("node_id", "fan_in", "fan_out").join(x.nodes.select("node_id", "name", "project"), "node_id")
    return rows.select("node_id", text.node_display(F.col("name"), F.col("project"), F.col("fan_out"), F.col("fan_in")).alias("node"))


@query("F18_finding_strings", None)
def _(spark, d):
    found = metrics.anti_patterns(g(spark, d))
    return found.select("position", text.finding_display(F.col("type"), F.col("severity"), F.col("description"), F.col("n_affected")).alias("finding"))


@query("F19_report", None)
def _(spark, d):
    return spark.createDataFrame([(metrics.report(g(spark, d)),)], "report string")


@query("F20_F21_code", "SELECT doc_id, CASE WHEN length(text) > 2000 THEN concat(left(text, 1000), chr(10), '..._This content has been truncated to stay below 2000 characters_...', chr(10), right(text, 1000)) ELSE text END AS cut, regexp_extract(concat('<code> ', lang, ' </code>'), '(?s)<code>(.*?)</code>', 1).trim() AS code FROM documents")
def _(spark, d):
    code = F.concat(F.lit("<code> "), "lang", F.lit(" </code>"))
    return fx.view(spark, d, "documents").select("doc_id", text.truncate_middle(F.col("text"), 2000).alias("cut"), text.extract_code(code).alias("code"))


@query("F22_imports", "SELECT doc_id, concat(lang, ',', 'os') AS modules, CASE WHEN lang = 'en' THEN 'os' ELSE concat(lang, ',os') END AS forbidden FROM documents")
def _(spark, d):
    code = F.concat(F.lit("import "), "lang", F.lit(".x\nfrom os import path\nimport "), "lang")
    return fx.view(spark, d, "documents").select("doc_id", F.array_join(text.imports(code), ",").alias("modules"), F.array_join(text.forbidden_imports(code, ["en"]), ",").alias("forbidden"))


@query("F23_F25_markers", "SELECT event_id, event_type AS answer, concat('id', user_id) AS call, event_type AS tool, CAST(value AS VARCHAR) AS argument FROM (SELECT event_id, user_id, event_type, CAST(trunc(value) AS BIGINT) AS value FROM events)")
def _(spark, d):
    e = fx.view(spark, d, "events").withColumn("value", F.col("value").cast("long"))
    invoke = text.invocation(F.concat(F.lit("so\ninvoke "), "event_type", F.lit(": "), F.col("value").cast("string")))
    return e.select("event_id", text.final_answer(F.concat(F.lit("x FINAL_ANSWER: "), "event_type")).alias("answer"), text.call_id(F.concat(F.lit("Call id: id"), F.col("user_id").cast("string"), F.lit("\nok"))).alias("call"), invoke["name"].alias("tool"), invoke["arguments"].alias("argument"))


@query("F26_templates", "SELECT c_custkey, concat('Dear ', c_name, ', of ', c_mktsegment, '.') AS letter FROM customer")
def _(spark, d):
    return fx.view(spark, d, "customer").select("c_custkey", text.populate(F.lit("Dear {{name}}, of {{segment}}."), {"name": F.col("c_name"), "segment": F.col("c_mktsegment")}).alias("letter"))


@query("F27_F28_names", "SELECT p_partkey, regexp_matches(p_type, '^[A-Za-z_][A-Za-z0-9_]*$') AND lower(p_type) NOT IN ('class', 'int') AS valid, contains(p_name, '_') OR (length(p_name) > 1 AND regexp_matches(p_name, '^[a-z]') AND regexp_matches(p_name, '[A-Z]')) AS state FROM part")
def _(spark, d):
    return fx.view(spark, d, "part").select("p_partkey", text.valid_tool_name(F.col("p_type")).alias("valid"), text.looks_like_state(F.col("p_name")).alias("state"))


_VALUES = "v AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN '12' WHEN 1 THEN '1.5' WHEN 2 THEN 'TRUE' WHEN 3 THEN '[1, 2]' WHEN 4 THEN '{\"a\": 1}' WHEN 5 THEN event_type WHEN 6 THEN '1.0' ELSE '' END AS x FROM events)"


@query(
    "F29_coercion",
    """SELECT event_id, TRY_CAST(x AS DOUBLE) AS as_number, CASE WHEN regexp_matches(x, '^[+-]?[0-9]+$') THEN TRY_CAST(x AS INTEGER) END AS as_integer, CASE lower(x) WHEN 'true' THEN true WHEN 'false' THEN false END AS as_boolean,
CASE WHEN starts_with(x, '[') AND ends_with(x, ']') THEN x END AS as_array, CASE WHEN starts_with(x, '{') AND ends_with(x, '}') THEN x END AS as_object FROM v""",
    extra=_VALUES,
)
def _(spark, d):
    e, i = fx.view(spark, d, "events"), F.col("event_id") % 8
    x = F.when(i == 0, "12").when(i == 1, "1.5").when(i == 2, "TRUE").when(i == 3, "[1, 2]").when(i == 4, '{"a": 1}').when(i == 5, F.col("event_type")).when(i == 6, "1.0").otherwise("")
    e = e.select("event_id", x.alias("x"))
    x = F.col("x")
    return e.select("event_id", coercion.to_number(x).alias("as_number"), coercion.to_integer(x).alias("as_integer"), coercion.to_boolean(x).alias("as_boolean"), coercion.to_array(x).alias("as_array"), coercion.to_object(x).alias("as_object"))


@query("F31_F35_small", "SELECT event_id, 5.0::DOUBLE * pow(2, event_id % 4) AS wait_s, 60.0::DOUBLE / (event_id % 7 + 1) AS interval_s, lower(event_type) AS role, right(event_type, 3) AS tail FROM events")
def _(spark, d):
    i, t = F.col("event_id"), F.col("event_type")
    return fx.view(spark, d, "events").select("event_id", text.backoff(5.0, i % 4 + 1).alias("wait_s"), text.rate_interval(i % 7 + 1).alias("interval_s"), text.role_name(t).alias("role"), text.log_tail(t, 3).alias("tail"))


@query("F34_message_text", "SELECT run_id, step_number, concat(role, chr(10), content) AS body FROM fx_steps")
def _(spark, d):
    part = lambda kind, c: F.struct(F.lit(kind).alias("type"), F.col(c).alias("text"))
    return fx.view(spark, d, "fx_steps").select("run_id", "step_number", text.message_text(F.array(part("text", "role"), part("image", "role"), part("text", "content"))).alias("body"))


# nested documents


@query("N01_ast_rows", "SELECT '/src/' || namespace AS file_path, type, name, namespace, array_to_string(list_filter(string_split(modifiers_csv, '|'), lambda x: x <> ''), ',') AS modifiers, CASE WHEN type = 'enum' THEN '' ELSE array_to_string(list_filter(string_split(base_types_csv, '|'), lambda x: x <> ''), ',') END AS base_types FROM fx_ast")
def _(spark, d):
    rows = nested.ast_rows(_ast_documents(spark, d))
    return rows.select("file_path", "type", "name", "namespace", F.array_join("modifiers", ",").alias("modifiers"), F.array_join("base_types", ",").alias("base_types"))


@query("N02_readable", "SELECT file_path, '{}' AS content FROM fx_files WHERE has_ast")
def _(spark, d):
    return nested.readable(fx.entries(spark, d), "Ast")


@query("N03_domain_rows", "SELECT file_path, name, reasoning FROM dd WHERE trim(name) <> ''", extra=_DOMAIN_DOCS)
def _(spark, d):
    return nested.domain_rows(_domain_docs(spark, d))


@query("N04_domain_errors", "SELECT file_path, CASE WHEN bool_or(trim(name) = '') THEN 'a domain without a name' WHEN bool_or(trim(reasoning) = '') THEN 'a domain without reasoning' END AS error FROM dd GROUP BY 1", extra=_DOMAIN_DOCS)
def _(spark, d):
    return _domain_docs(spark, d).select("file_path", nested.domain_error(F.col("content")).alias("error"))


_AST_FAULTS = [
    ("replace(content, 'CompilationUnit', 'Unit')", "the root is no CompilationUnit"),
    ("' '", "content is empty"),
    ("concat(content, '}')", "content is no JSON"),
    ("replace(content, '\"usings\":[]', '\"usings\":null')", "usings is null"),
    ("replace(content, '\"Namespace\"', '\"Other\"')", "namespace is null"),
    ("regexp_replace(content, '\"enums\":', '\"none\":')", "enums is null"),
    ("regexp_replace(content, '\"interfaces\":.\\\\{\"name\":\"[^\"]+\"', '\"interfaces\":[{\"name\":\" \"')", "a interface without a name"),
]


@query(
    "N05_N06_ast_errors",
    "SELECT DISTINCT '/src/' || namespace AS file_path, fault, CASE fault " + " ".join(f"WHEN {i} THEN '{e}'" for i, (_, e) in enumerate(_AST_FAULTS)) + " END AS error FROM fx_ast, (SELECT unnest(range(8)) AS fault)",
)
def _(spark, d):
    made = F.array(*[F.struct(F.lit(i).cast("long").alias("fault"), F.expr(e).alias("content")) for i, (e, _) in enumerate([*_AST_FAULTS, ("content", None)])])
    out = _ast_documents(spark, d).select("file_path", F.explode(made).alias("x")).select("file_path", "x.*")
    return out.select("file_path", "fault", nested.ast_error(F.col("content")).alias("error"))


@query("N07_valid_json", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN false ELSE json_valid(props) END AS ok FROM events")
def _(spark, d):
    e = fx.view(spark, d, "events")
    return e.select("event_id", nested.is_json(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))).alias("ok"))


@query("N09_step_json", None)
def _(spark, d):
    return runs.step_json(fx.steps(spark, d).drop("n_chars"))


@query(
    "N10_messages",
    """SELECT run_id, step_number, 0 AS sub_position, 'user' AS role, concat('New task:', chr(10), content) AS content FROM fx_steps WHERE role = 'user' UNION ALL
SELECT run_id, step_number, 0, 'assistant', content FROM fx_steps WHERE role <> 'user' UNION ALL
SELECT run_id, step_number, 1, 'tool-response', concat('Call id: c', step_number, chr(10), content) FROM fx_steps WHERE role <> 'user' AND step_number % 2 = 1""",
)
def _(spark, d):
    return runs.messages(fx.steps(spark, d))


@query("N11_nested_substitution", """SELECT event_id, '{"a": ["Riga", {"b": "' || CASE event_type WHEN 'click' THEN 'pressed' ELSE event_type END || '"}]}' AS arguments FROM events""")
def _(spark, d):
    j = F.concat(F.lit('{"a": ["cargo_port", {"b": "'), "event_type", F.lit('"}]}'))
    return fx.view(spark, d, "events").select("event_id", runs.substitute_json(j, F.lit('{"cargo_port": "Riga", "click": "pressed"}')).alias("arguments"))


@query("N12_references", "SELECT event_id, 'cargo_port,two_words here,pierNumber' AS refs, 'two_words here,pierNumber' AS missing FROM events")
def _(spark, d):
    state = F.create_map(F.lit("cargo_port"), F.lit("x"))
    j = F.concat(F.lit('{"a": ["cargo_port", {"b": "'), "event_type", F.lit('"}, "two_words here"], "c": "pierNumber"}'))
    e = fx.view(spark, d, "events").withColumn("j", j)
    return e.select("event_id", F.array_join(runs.references_json("j"), ",").alias("refs"), F.array_join(runs.missing_references(F.col("j"), state), ",").alias("missing"))


@query("N13_tool_schemas", None)
def _(spark, d):
    e = fx.view(spark, d, "events").select(F.col("event_type").alias("tool"), F.concat(F.lit("arg"), (F.col("event_id") % 3).cast("string")).alias("argument")).distinct()
    return runs.tool_schemas(e.withColumns({"type": F.lit("string"), "description": F.lit("text"), "optional": F.col("argument") == "arg0"}))


# graph algorithms


@query("G01_G02_index", "SELECT src, string_agg(dst, ',' ORDER BY edge_seq) AS targets FROM fx_edges GROUP BY 1")
def _(spark, d):
    e = fx.view(spark, d, "fx_edges").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("edge_seq", "dst"))).alias("t"))
    return e.select("src", F.array_join(F.transform("t", lambda x: x["dst"].cast("string")), ",").alias("targets"))


@query("G03_G04_cyclic", "SELECT node_id FROM cyc", True, CLOSURE)
def _(spark, d):
    return g(spark, d).cyclic


@query("G03_components", "SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM (SELECT a.x AS node, min(a.y) AS component FROM clo a JOIN clo b ON a.x = b.y AND a.y = b.x GROUP BY 1) QUALIFY size > 1", True, CLOSURE)
def _(spark, d):
    return g(spark, d).components


@query("G05_dependency_scope", "SELECT node AS node_id, min(depth) AS depth FROM r GROUP BY 1", True, REACH)
def _(spark, d):
    return g(spark, d).dependency_scope(0)


@query("G06_dependency_scores", "SELECT n AS node_id, count(DISTINCT y) AS score FROM (SELECT x AS n, y FROM clo WHERE x < 20 UNION SELECT node_id, node_id FROM fx_nodes WHERE node_id < 20) GROUP BY 1", True, CLOSURE)
def _(spark, d):
    return g(spark, d).dependency_scores(list(range(20)))


@query("G07_impact_scope", "SELECT node AS node_id, min(depth) AS depth FROM r GROUP BY 1", True, REACH.replace("SELECT dst,", "SELECT src,").replace("ON src =", "ON dst ="))
def _(spark, d):
    return g(spark, d).impact_scope(0)


@query("G08_impact_scores", "SELECT n AS node_id, count(DISTINCT x) AS score FROM (SELECT y AS n, x FROM clo WHERE y < 20 UNION SELECT node_id, node_id FROM fx_nodes WHERE node_id < 20) GROUP BY 1", True, CLOSURE)
def _(spark, d):
    return g(spark, d).impact_scores(list(range(20)))


@query("G09_chain_length", "SELECT node AS target, min(depth) + 1 AS n_nodes FROM r WHERE node IN (5, 50) GROUP BY 1", True, REACH)
def _(spark, d):
    x = g(spark, d)
    return spark.createDataFrame([(t, len(c)) for t in (5, 50) if (c := x.dependency_chain(0, t))], "target long, n_nodes int")


@query("G10_distance", "SELECT t AS target, coalesce((SELECT min(depth) FROM r WHERE node = t), -1) AS distance FROM (SELECT unnest([0, 5, 50, 999999]) AS t)", True, REACH)
def _(spark, d):
    found = iterate.reach(g(spark, d).inner_edges, [0])
    wanted = spark.createDataFrame([(0,), (5,), (50,), (999999,)], "target int")
    return wanted.join(found, F.col("node") == F.col("target"), "left").select("target", F.coalesce("depth", F.lit(-1)).alias("distance"))


@query(
    "G11_all_paths",
    "SELECT array_to_string(path, '>') AS path FROM w WHERE node = 5",
    True,
    "b AS (SELECT src, dst FROM fx_edges UNION ALL SELECT dst, src FROM fx_edges), w AS (SELECT 0::BIGINT AS node, [0::BIGINT] AS path UNION ALL SELECT dst, list_append(path, dst) FROM w JOIN b ON src = node WHERE node <> 5 AND NOT list_contains(path, dst) AND len(path) <= 4)",
)
def _(spark, d):
    return g(spark, d).all_paths(0, 5, 4).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("G12_cheapest", "SELECT node, round(min(cost), 6) AS cost FROM (SELECT node, cost FROM c2) GROUP BY 1", True, "q AS (SELECT src, dst, (dep_ord + 1) / 4.0::DOUBLE AS w FROM fx_dag JOIN fx_edges USING (src, dst)), c2 AS (SELECT 0::BIGINT AS node, 0.0::DOUBLE AS cost UNION SELECT dst, cost + w FROM c2 JOIN q ON src = node)")
def _(spark, d):
    costs = fx.view(spark, d, "fx_edges").filter("src < dst").select("src", "dst", ((F.col("dep_ord") + 1) / 4.0).alias("cost"))
    return iterate.cheapest(costs, 0).select("node", r6("cost").alias("cost"))


@query("G12_strongest_path", None)
def _(spark, d):
    path = g(spark, d).strongest_path(0, 5)
    return spark.createDataFrame([(i, n) for i, n in enumerate(path)], "position int, node_id long")


@query("G13_topological_order", "SELECT node_id, CAST(row_number() OVER (ORDER BY level, node_id) - 1 AS INTEGER) AS processing_order FROM lv", True, LEVELS)
def _(spark, d):
    return _dag(spark, d).topological_order(dependents_first=False).select("node_id", "processing_order")


@query("G14_levels", "SELECT node_id, level FROM lv", True, LEVELS)
def _(spark, d):
    return _dag(spark, d).dependency_levels


CYCLIC_LEVELS = (
    CLOSURE
    + """,
sc AS (SELECT a.x AS node, min(a.y) AS component FROM clo a JOIN clo b ON a.x = b.y AND a.y = b.x GROUP BY 1),
kept AS (SELECT DISTINCT src, dst FROM fx_edges LEFT JOIN sc a ON a.node = src LEFT JOIN sc b ON b.node = dst WHERE src <> dst AND (a.component IS DISTINCT FROM b.component OR a.component IS NULL OR src > dst)),
p AS (SELECT src, dst, 1 AS n FROM kept UNION SELECT p.src, q.dst, n + 1 FROM p JOIN kept q ON p.dst = q.src),
lv AS (SELECT node_id, CAST(coalesce(max(n), 0) AS INTEGER) AS level FROM fx_nodes LEFT JOIN p ON src = node_id GROUP BY 1)"""
)


@query("G14_levels_of_cyclic", "SELECT node_id, level FROM lv", True, CYCLIC_LEVELS)
def _(spark, d):
    return g(spark, d).dependency_levels


@query("G13_order_of_cyclic", "SELECT node_id, level, CAST(row_number() OVER (ORDER BY level DESC, node_id) - 1 AS INTEGER) AS processing_order FROM lv", True, CYCLIC_LEVELS)
def _(spark, d):
    return g(spark, d).topological_order()


@query("G13_order_without_cycles", "SELECT node_id, level, CAST(row_number() OVER (ORDER BY level DESC, node_id) - 1 AS INTEGER) AS processing_order FROM lv WHERE node_id NOT IN (SELECT node_id FROM cyc)", True, CYCLIC_LEVELS)
def _(spark, d):
    return g(spark, d).topological_order(on_cycle="ignore")


@query("G15_plan_of_cyclic", "SELECT node_id, level, fan_in, fan_out, c.node_id IS NOT NULL AS is_cyclic FROM lv JOIN d USING (node_id) LEFT JOIN cyc c USING (node_id)", True, CYCLIC_LEVELS + ",\n" + DEGREES)
def _(spark, d):
    return g(spark, d).processing_plan().drop("can_parallel")


@query("G15_processing_plan", "SELECT node_id, level, (SELECT count(*) FROM fx_dag WHERE dst = node_id) AS fan_in, (SELECT count(*) FROM fx_dag WHERE src = node_id) AS fan_out, false AS is_cyclic FROM lv", True, LEVELS)
def _(spark, d):
    return _dag(spark, d).processing_plan().drop("can_parallel")


@query("G16_in_cycle", "SELECT n.node_id, c.node_id IS NOT NULL AS in_cycle FROM fx_nodes n LEFT JOIN cyc c USING (node_id)", True, CLOSURE)
def _(spark, d):
    x = g(spark, d)
    return x.held.nodes.join(x.cyclic.withColumn("c", F.lit(True)), "node_id", "left").select("node_id", F.coalesce("c", F.lit(False)).alias("in_cycle"))


@query(
    "G17_anti_patterns",
    """SELECT type, severity, n_affected FROM (SELECT 'HighRiskCoupling' AS type, 'High' AS severity, count(*) AS n_affected FROM st WHERE profile = 'HighRiskCoupling' UNION ALL SELECT 'TestingChallenge', 'Medium', count(*) FROM st WHERE profile = 'TestingChallenge' UNION ALL
SELECT 'WeakConnection', 'Low', count(*) FROM st WHERE profile = 'WeakConnection' UNION ALL SELECT 'GodClass', 'High', count(*) FROM d WHERE fan_out >= 15 UNION ALL SELECT 'DeadCode', 'Medium', count(*) FROM d WHERE fan_in = 0 UNION ALL SELECT 'CircularDependency', 'High', count(*) FROM cyc) WHERE n_affected > 0""",
    True,
    STRENGTH + ",\n" + DEGREES,
)
def _(spark, d):
    return metrics.anti_patterns(g(spark, d)).select("type", "severity", "n_affected")


@query(
    "G18_bidirectional_patterns",
    "SELECT type, severity, n_affected FROM (SELECT 'StableCore' AS type, 'Low' AS severity, count(*) AS n_affected FROM a WHERE is_stable UNION ALL SELECT 'UnstableLeaf', 'Medium', count(*) FROM a WHERE is_unstable UNION ALL SELECT 'HighFanIn', 'Low', count(*) FROM a WHERE fan_in >= 10) WHERE n_affected > 0",
    extra=DEGREES,
)
def _(spark, d):
    return metrics.bidirectional_patterns(g(spark, d)).select("type", "severity", "n_affected")


@query("G20_kg_build", "SELECT 'type:' || node_id AS kg_id, name FROM fx_nodes UNION ALL SELECT DISTINCT 'project:' || project, project FROM fx_nodes UNION ALL SELECT DISTINCT 'namespace:' || project || '/' || namespace, string_split(namespace, '.')[-1] FROM fx_nodes")
def _(spark, d):
    return _kg(spark, d).nodes.filter("node_type <> 'Member'").select("kg_id", "name")


# sources, sinks and the pipeline


@query("S03_front_matter", "SELECT doc_id, concat(lang, chr(10), source) AS body FROM documents")
def _(spark, d):
    raw = F.concat(F.lit("---\ntitle: x\n---\n "), "lang", F.lit(" \n---\n"), "source", F.lit("\n"))
    return fx.view(spark, d, "documents").select("doc_id", text.strip_front_matter(F.regexp_replace(raw, "\n", " ")).alias("body"))


@query("S12_point_lookup", "SELECT file_path, status FROM fx_files WHERE doc_id = 42")
def _(spark, d):
    kept = store.FileStore(spark, iterate.shared_path(spark, "store"))
    kept.upsert(_store_entries(spark, d))
    path = fx.view(spark, d, "fx_files").filter("doc_id = 42").first()
    return kept.get(path.file_path if path else "").select("file_path", "status")


@query("S13_delete_by_key", "SELECT file_path FROM fx_files WHERE doc_id NOT IN (3, 13)")
def _(spark, d):
    kept = store.FileStore(spark, iterate.shared_path(spark, "store"))
    kept.upsert(_store_entries(spark, d))
    kept.invalidate([r.file_path for r in fx.view(spark, d, "fx_files").filter("doc_id in (3, 13)").select("file_path").collect()])
    return kept.read().select("file_path")


@query(
    "S14_markdown",
    """SELECT n.node_id, concat('# ', n.name, chr(10), chr(10), 'Namespace: ', n.namespace, chr(10), chr(10), '## Dependencies', coalesce(chr(10) || chr(10) || o.l, ''), chr(10), chr(10), '## Dependents', coalesce(chr(10) || chr(10) || i.l, ''), chr(10)) AS body FROM fx_nodes n
LEFT JOIN (SELECT src AS node_id, string_agg(DISTINCT '- ' || name, chr(10) ORDER BY '- ' || name) AS l FROM fx_edges JOIN fx_nodes ON node_id = dst WHERE kind = 'Class' GROUP BY 1) o USING (node_id)
LEFT JOIN (SELECT dst AS node_id, string_agg(DISTINCT '- ' || name, chr(10) ORDER BY '- ' || name) AS l FROM fx_edges JOIN fx_nodes ON node_id = src WHERE kind = 'Class' GROUP BY 1) i USING (node_id) WHERE kind = 'Class'""",
)
def _(spark, d):
    return files.markdown(g(spark, d)).select("node_id", "body")


@query("T04_required_levels", "SELECT doc_id, unnest(['Ast', 'DomainKeywords']) AS level FROM fx_files")
def _(spark, d):
    return pipeline.required_levels(fx.view(spark, d, "fx_files")).select("doc_id", "level")


@query("T05_retries", "SELECT job_id, CASE WHEN status = 'Failed' AND job_id % 4 < 3 THEN 'Retrying' ELSE status END AS next_status, CASE WHEN status = 'Failed' AND job_id % 4 < 3 THEN 5.0::DOUBLE * pow(2, job_id % 4) END AS wait_s FROM fx_jobs")
def _(spark, d):
    return pipeline.retries(fx.view(spark, d, "fx_jobs").withColumn("attempt", F.col("job_id") % 4)).select("job_id", "next_status", "wait_s")


@query("T06_completion", "SELECT job_id, CASE WHEN job_id % 3 = 0 THEN 'Completed' WHEN job_id % 3 = 1 THEN 'Failed' ELSE status END AS status, round(CASE WHEN job_id % 3 < 2 THEN 90.0 ELSE duration_s END, 6) AS duration_s FROM fx_jobs")
def _(spark, d):
    j = fx.view(spark, d, "fx_jobs")
    done = j.filter("job_id % 3 < 2").select("job_id", (F.col("job_id") % 3 == 0).alias("ok"), (F.col("created_at") + F.expr("interval 90 seconds")).alias("ended_at"))
    return pipeline.complete(j, done).select("job_id", "status", r6("duration_s").alias("duration_s"))


@query("T07_stale", "SELECT job_id FROM fx_jobs WHERE status = 'Processing' AND created_at < TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 1200 SECOND")
def _(spark, d):
    return pipeline.stale(fx.view(spark, d, "fx_jobs"), "2024-02-01 00:00:00", 600).select("job_id")


@query("T08_ageing", "SELECT file_path FROM fx_files WHERE doc_id >= 100")
def _(spark, d):
    kept = store.FileStore(spark, iterate.shared_path(spark, "store"))
    kept.upsert(_store_entries(spark, d))
    kept.expire(dt.datetime.fromtimestamp(1_700_000_000 + 100 * 60, dt.timezone.utc))
    return kept.read().select("file_path")


@query("T12_distinct_paths", "SELECT DISTINCT worker_id AS file_path FROM fx_jobs")
def _(spark, d):
    found, into = fx.view(spark, d, "fx_jobs").select(F.col("worker_id").cast("string").alias("file_path"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("last_modified")), iterate.shared_path(spark, "stream")
    found.repartition(3).write.parquet(f"{into}/in")
    stream = pipeline.distinct_paths(spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 1).parquet(f"{into}/in"))
    run = stream.writeStream.format("parquet").option("path", f"{into}/out").option("checkpointLocation", f"{into}/check").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{into}/out").select(F.col("file_path").cast("long").alias("file_path"))


@query("T14_deltas", "SELECT run_id, string_agg(role, ' ' ORDER BY step_number) AS body FROM fx_steps GROUP BY 1")
def _(spark, d):
    s = fx.view(spark, d, "fx_steps").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("step_number", "role"))).alias("x"))
    return s.select("run_id", F.array_join(F.transform("x", lambda v: v["role"]), " ").alias("body"))


@query("X08_final_checks", "SELECT run_id, step_number FROM fx_steps WHERE role <> 'user' AND length(content) > 20")
def _(spark, d):
    return fx.steps(spark, d).filter("step_type = 'Action' and length(model_output) > 20").select("run_id", "step_number")


@query("X10_argument_checks", "SELECT event_id AS call_id, 'value' AS argument, CASE WHEN event_id % 5 = 0 THEN 'value may not be null' WHEN event_id % 5 = 1 THEN 'value is no integer' END AS error FROM events")
def _(spark, d):
    e, i = fx.view(spark, d, "events"), F.col("event_id") % 5
    calls = e.select(F.col("event_id").alias("call_id"), F.lit("t").alias("tool"), F.lit("value").alias("argument"), F.when(i == 1, "x").when(i != 0, "7").alias("value"))
    inputs = spark.createDataFrame([("t", "value", "integer", False, False)], "tool string, argument string, type string, nullable boolean, optional boolean")
    return coercion.check_arguments(calls, inputs).select("call_id", "argument", "error")


@query("R23_output_types", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'image' WHEN event_id % 3 = 1 THEN 'audio' ELSE 'text' END AS output FROM events")
def _(spark, d):
    kind = F.when(F.col("event_id") % 3 == 0, "binary").when(F.col("event_id") % 3 == 1, "array").otherwise("string")
    return fx.view(spark, d, "events").select("event_id", runs.output_type(kind).alias("output"))




def _store_entries(spark, d):
    f = fx.entries(spark, d)
    hashed = f.withColumns({"file_hash": text.content_hash(F.col("content")), "last_modified": F.col("processed_at")})
    level = F.transform_values("level_data", lambda _, v: F.struct(v["content"].alias("content"), F.col("processed_at"), F.lit(0.0).alias("duration_s"), v["is_success"].alias("is_success"), F.lit(None).cast("string").alias("error_message")))
    return hashed.select("file_path", "file_hash", "processed_at", "last_modified", F.col("file_size").cast("long").alias("file_size"), "status", level.alias("level_data"))


@query("S10_S11_store", "SELECT file_path, CASE WHEN doc_id % 5 = 0 THEN 'Retried' ELSE status END AS status, CAST(has_ast AS INTEGER) + CAST(has_domain AS INTEGER) AS n_levels FROM fx_files WHERE doc_id % 7 <> 0")
def _(spark, d):
    kept = store.FileStore(spark, iterate.shared_path(spark, "store"))
    first = _store_entries(spark, d)
    kept.upsert(first)
    fifth = F.regexp_extract("file_path", r"(\d+)\.md$", 1).cast("long")
    kept.upsert(first.filter(fifth % 5 == 0).withColumns({"status": F.lit("Retried"), "processed_at": F.col("processed_at") + F.expr("interval 1 day")}))
    gone = kept.read().filter(fifth % 7 == 0).select("path_key")
    return kept.read().join(gone, "path_key", "left_anti").select("file_path", "status", F.size("level_data").alias("n_levels"))


@query("S16_cache_admin", "SELECT count(*) AS file_count, CAST(sum(length(concat('answer ', run_id))) AS BIGINT) AS total_size_bytes FROM (SELECT DISTINCT run_id FROM fx_steps) WHERE run_id % 3 <> 0")
def _(spark, d):
    asked = fx.view(spark, d, "fx_steps").select("run_id").distinct().withColumn("request_key", text.request_key(F.struct("run_id")))
    cache = store.ResponseCache(spark, iterate.shared_path(spark, "responses"))
    made = F.when(F.col("run_id") % 3 == 0, F.to_timestamp(F.lit("2024-01-01"))).otherwise(F.to_timestamp(F.lit("2024-01-05")))
    cache.append(asked.select("request_key", F.concat(F.lit("answer "), F.col("run_id").cast("string")).alias("response"), made.alias("created_at")))
    cache.expire("2024-01-10")
    # asked of a time when none had expired
    return cache.statistics("2024-01-02").select("file_count", "total_size_bytes")


@query("S15_S16_response_cache", "SELECT run_id, CASE WHEN run_id % 3 <> 0 THEN concat('answer ', run_id) END AS response FROM (SELECT DISTINCT run_id FROM fx_steps)")
def _(spark, d):
    asked = fx.view(spark, d, "fx_steps").select("run_id").distinct().withColumn("request_key", text.request_key(F.struct("run_id")))
    cache = store.ResponseCache(spark, iterate.shared_path(spark, "responses"))
    made = F.when(F.col("run_id") % 3 == 0, F.to_timestamp(F.lit("2024-01-01"))).otherwise(F.to_timestamp(F.lit("2024-01-05")))
    cache.append(asked.select("request_key", F.concat(F.lit("answer "), F.col("run_id").cast("string")).alias("response"), made.alias("created_at")))
    return cache.lookup(asked, "2024-01-10").select("run_id", "response")


def _found_files(spark, d):
    """fx_files as a scan finds them."""
    f = fx.view(spark, d, "fx_files").withColumns({"last_modified": F.lit(None).cast("timestamp"), "file_hash": text.content_hash(F.col("content"))})
    return f.select("file_path", "file_hash", F.col("file_size").cast("long").alias("file_size"), "last_modified", "content")


@query("T04_levels", "SELECT file_path, CASE WHEN contains(content, '!') THEN 'Failed' ELSE 'Completed' END AS status, CASE WHEN contains(content, '!') THEN 1 ELSE 2 END AS n_levels FROM fx_files")
def _(spark, d):
    empty = store.FileStore(spark, iterate.shared_path(spark, "store"))
    return pipeline.process(_found_files(spark, d), empty, {"Ast": _plain_ast, "DomainKeywords": _plain_domains}, "2024-01-01 00:00:00").select("file_path", "status", F.size("level_data").alias("n_levels"))


def _plain_ast(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if "!" in t else json.dumps({"type": "CompilationUnit", "namespace": t[:1], "usings": [], "classes": [], "interfaces": [], "enums": [], "records": [], "structs": []}))


def _plain_domains(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: json.dumps({"domains": [{"name": f"{len(t)} characters", "reasoning": "its length"}]}))


@query("T01_T03_stream", "SELECT file_path, CASE WHEN contains(content, '!') THEN 'Failed' ELSE 'Completed' END AS status, CASE WHEN contains(content, '!') THEN NULL ELSE length(content) || ' characters' END AS domain FROM fx_files")
def _(spark, d):
    f, into = _found_files(spark, d), iterate.shared_path(spark, "stream")
    f.repartition(4, "file_path").write.parquet(f"{into}/in")
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 2).parquet(f"{into}/in")
    kept = store.FileStore(spark, f"{into}/store")
    pipeline.start(stream, kept, {"Ast": _plain_ast, "DomainKeywords": _plain_domains}, f"{into}/check").awaitTermination()
    return kept.read().select("file_path", "status", F.get_json_object(F.col("level_data")["DomainKeywords"]["content"], "$.domains[0].name").alias("domain"))


@query(
    "F30_R22_observations",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Tool executed successfully but returned no result.' WHEN 1 THEN 'Tool executed but returned empty string.' WHEN 2 THEN event_type
WHEN 3 THEN 'kinds: [a, ' || event_type || ']' || chr(10) || 'n: 3' || chr(10) || 'ok: True' WHEN 4 THEN 'user:' || chr(10) || '  id: ' || user_id || chr(10) || '  name: x y' ELSE '[' || chr(10) || '  1,' || chr(10) || '  2' || chr(10) || ']' END AS observation FROM events""",
)
def _(spark, d):
    i, t = F.col("event_id") % 6, F.col("event_type")
    output = F.when(i == 1, '" "').when(i == 2, t).when(i == 3, F.concat(F.lit('{"kinds": ["a", "'), t, F.lit('"], "n": 3, "ok": true}')))
    output = output.when(i == 4, F.concat(F.lit('{"user": {"id": '), F.col("user_id").cast("string"), F.lit(', "name": "x y"}}'))).when(i == 5, "[1, 2]")
    return fx.view(spark, d, "events").select("event_id", runs.observation(output, F.lit("tool")).alias("observation"))


@query(
    "R21_argument_mapping",
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN '{}' WHEN 1 THEN '{"a": 1}' WHEN 2 THEN '{"text":"' || event_type || '"}' WHEN 3 THEN '{}' WHEN 4 THEN '{"query":[1]}' WHEN 5 THEN '{"input":7}' ELSE '{}' END AS arguments FROM events""",
)
def _(spark, d):
    i, none = F.col("event_id") % 7, F.expr("cast(array() as array<string>)")
    value = F.when(i == 1, '{"a": 1}').when(i.isin(2, 3), F.concat(F.lit('"'), "event_type", F.lit('"'))).when(i == 4, "[1]").when(i.isin(5, 6), "7")
    inputs = F.when(i == 2, F.array(F.lit("text"))).when(i == 3, none).when(i == 4, F.array(F.lit("x"), F.lit("y")))
    tool = F.when(i == 4, "search").when(i != 6, "other")
    return fx.view(spark, d, "events").select("event_id", runs.map_arguments(value, inputs, tool).alias("arguments"))


_MESSAGES = """messages AS (SELECT run_id, step_number, 0 AS sub_position, 'user' AS role, concat('New task:', chr(10), content) AS content FROM fx_steps WHERE role = 'user' UNION ALL
SELECT run_id, step_number, 0, 'assistant', content FROM fx_steps WHERE role <> 'user' UNION ALL
SELECT run_id, step_number, 1, 'tool-response', concat('Call id: c', step_number, chr(10), content) FROM fx_steps WHERE role <> 'user' AND step_number % 2 = 1)"""


@query(
    "R16_vendor_messages",
    """SELECT run_id, step_number, sub_position, CASE role WHEN 'tool-response' THEN 'tool' ELSE role END AS role, content, CASE WHEN role = 'tool-response' THEN 'c' || step_number END AS tool_call_id,
CASE WHEN role = 'assistant' AND step_number % 4 = 1 THEN '[{"id":"c' || step_number || '","type":"function","function":{"name":"search","arguments":"{}"}}]' END AS tool_calls FROM messages""",
    extra=_MESSAGES,
)
def _(spark, d):
    call = F.struct(F.concat(F.lit("c"), F.col("step_number").cast("string")).alias("id"), F.lit("search").alias("name"), F.lit(None).cast("string").alias("arguments"))
    said = runs.messages(fx.steps(spark, d)).withColumn("tool_calls", F.when(F.col("step_number") % 4 == 1, F.array(call)))
    return requests.vendor_messages(said)


@query(
    "R16_response_messages",
    """SELECT event_id, 'assistant' AS role, CASE event_id % 5 WHEN 0 THEN '' ELSE event_type END AS content,
CASE event_id % 5 WHEN 1 THEN '{}' WHEN 2 THEN '{"a": 1}' WHEN 3 THEN '{"value":"not \\"' || event_type || '"}' WHEN 4 THEN '{"value":"[1]"}' END AS arguments FROM events""",
)
def _(spark, d):
    i = F.col("event_id") % 5
    given = F.when(i == 1, "").when(i == 2, '{"a": 1}').when(i == 3, F.concat(F.lit('not "'), "event_type")).when(i == 4, "[1]")
    none = F.expr("cast(array() as array<struct<id: string, name: string, arguments: string>>)")
    calls = F.when(i == 0, none).otherwise(F.array(F.struct(F.lit("c").alias("id"), F.lit("t").alias("name"), given.alias("arguments"))))
    texts = F.when(i == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array("event_type", F.lit("more")))
    came = fx.view(spark, d, "events").select("event_id", texts.alias("texts"), calls.alias("tool_calls"))
    return requests.response_messages(came).select("event_id", "role", "content", F.get("tool_calls", F.lit(0))["arguments"].alias("arguments"))


@query(
    "R17_embedded_calls",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type END AS name, CASE event_id % 4 WHEN 0 THEN '{"q":' || event_id || '}' END AS arguments FROM events""",
)
def _(spark, d):
    i, whole = F.col("event_id") % 4, F.concat(F.lit('I call {"name": "'), "event_type", F.lit('", "arguments": {"q": '), F.col("event_id").cast("string"), F.lit("}}\nnow"))
    said = F.when(i == 0, whole).when(i == 1, "} nothing {").when(i == 2, F.concat(F.lit('{"name": '), "event_type", F.lit("}"))).otherwise('{"arguments": {}}')
    call = requests.embedded_call(said)
    return fx.view(spark, d, "events").select("event_id", call["name"].alias("name"), call["arguments"].alias("arguments"))


@query(
    "R18_requests",
    """SELECT run_id, '[' || string_agg('{"role":"' || CASE role WHEN 'tool-response' THEN 'user' ELSE role END || '","content":' || CAST(to_json(content) AS VARCHAR) || '}', ',' ORDER BY step_number, sub_position) || ']' AS messages,
CASE WHEN run_id % 2 = 0 THEN '["END"]' END AS stop, CASE WHEN run_id % 3 > 0 THEN '[{"type":"function","function":{"name":"search","description":"Tool: search","parameters":{"type":"object","properties":{},"required":[]}}}]' END AS tools,
CASE run_id % 3 WHEN 1 THEN '"auto"' WHEN 2 THEN '"none"' END AS tool_choice, CASE WHEN run_id % 5 = 0 THEN '0.5' ELSE '1' END AS temperature FROM messages GROUP BY run_id""",
    extra=_MESSAGES,
)
def _(spark, d):
    run, none = F.col("run_id"), F.expr("cast(array() as array<string>)")
    options = fx.view(spark, d, "fx_steps").select("run_id").distinct().withColumns(
        {
            "model": F.when(run % 2 == 0, "a/gpt-4o").otherwise("a/o3-mini"),
            "defaults": F.create_map(F.lit("temperature"), F.lit("1"), F.lit("messages"), F.lit("[]")),
            "additional": F.when(run % 5 == 0, F.create_map(F.lit("temperature"), F.lit("0.5"))),
            "stop": F.array(F.lit("END")),
            "tools": F.when(run % 3 > 0, F.array(F.lit("search"))).otherwise(none),
            "response_format": F.lit(None).cast("string"),
            "tool_choice": F.when(run % 3 == 2, '"none"'),
        }
    )
    made = requests.requests(runs.messages(fx.steps(spark, d)), options, {"tool-response": "user"})
    return made.select("run_id", *[F.try_element_at("arguments", F.lit(k)).alias(k) for k in ("messages", "stop", "tools", "tool_choice", "temperature")])


@query("R19_model_entries", "SELECT s_suppkey, s_name AS model_id, '[REDACTED]' AS api_key, 'true' AS cache_enabled, CASE WHEN s_suppkey % 2 = 0 THEN 'low' END AS effort FROM supplier")
def _(spark, d):
    s = fx.view(spark, d, "supplier")
    given = F.when(F.col("s_suppkey") % 2 == 0, F.create_map(F.lit("effort"), F.lit("low"), F.lit("model_id"), F.lit("hidden by the field")))
    entry = requests.model_entry(given, model_id=F.col("s_name"), api_key=F.col("s_suppkey"), cache_enabled=F.lit(True))
    return s.select("s_suppkey", *[F.try_element_at(entry, F.lit(k)).alias(k) for k in ("model_id", "api_key", "cache_enabled", "effort")])


@query(
    "R19_X01_tool_entries",
    """SELECT 't' || n_nationkey AS tool, '{"name":"t' || n_nationkey || '","description":"' || n_name || '","inputs":{' || CASE WHEN n_nationkey % 2 = 0 THEN '"a":{"type":"string","description":"one"},"b":{"type":"any","description":"two"}' ELSE '' END || '},"output_type":"string"}' AS entry FROM nation""",
)
def _(spark, d):
    tools = fx.view(spark, d, "nation").select("n_nationkey", F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("tool"), F.col("n_name").alias("description"), F.lit("string").alias("output_type"))
    inputs = spark.createDataFrame([("b", "any", "two"), ("a", "string", "one")], "argument string, type string, description string")
    return requests.tool_entries(tools.drop("n_nationkey"), tools.filter("n_nationkey % 2 = 0").select("tool").join(F.broadcast(inputs)))  # two rows


@query(
    "X09_input_specifications",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'type or description is missing' WHEN 1 THEN 'unknown types: ' || event_type || ', text' WHEN 2 THEN 'no type' END AS error FROM events",
)
def _(spark, d):
    i, none = F.col("event_id") % 4, F.expr("cast(array() as array<string>)")
    types = F.when(i == 1, F.array("event_type", F.lit("text"), F.lit("string"))).when(i == 2, none).otherwise(F.array(F.lit("string"), F.lit("null")))
    return fx.view(spark, d, "events").select("event_id", requests.input_error(types, F.when(i > 0, "d")).alias("error"))


@query(
    "R03_documentation",
    "SELECT node_id, CASE node_id % 4 WHEN 0 THEN '<summary>' || chr(10) || name || chr(10) || '</summary>' WHEN 1 THEN name || chr(10) || 'of ' || namespace WHEN 2 THEN 'Holds ' || name END AS documentation FROM fx_nodes",
)
def _(spark, d):
    i = F.col("node_id") % 4
    lines = F.concat(F.lit("// no\n\n  /// <summary>\n  /// "), "name", F.lit("\n  /// </summary>\n  // no\n  /// second\n"))
    block = F.concat(F.lit("\n/** "), "name", F.lit("\n  * of "), "namespace", F.lit("\n */\n"))
    leading = F.when(i == 0, lines).when(i == 1, block).when(i == 2, F.concat(F.lit("///Holds "), "name")).otherwise("//// no\n/* no */\n")
    return fx.view(spark, d, "fx_nodes").select("node_id", text.documentation(leading).alias("documentation"))


@query("P15_index_filters", "SELECT node_id FROM fx_nodes WHERE namespace = 'Shop.Tests' AND node_id % 2 = 1 AND node_id % 3 = 0")
def _(spark, d):
    one = F.when(F.col("node_id") % 2 == 1, '{"name": "A"}').otherwise('{"name": "A"}, {"name": "B"}')
    using = F.when(F.col("node_id") % 3 == 0, '"System"').otherwise("")
    body = F.concat(F.lit('{"type": "CompilationUnit", "namespace": "'), "namespace", F.lit('", "usings": ['), using, F.lit('], "classes": ['), one, F.lit('], "interfaces": [], "enums": [], "records": [], "structs": []}'))
    indexed = nested.index(fx.view(spark, d, "fx_nodes").select(F.col("node_id").cast("string").alias("file_path"), body.alias("content")))
    return nested.query_index(indexed, {"namespace": "shop.tests", "n_classes": 1, "usings": "System"}).select(F.col("file_path").cast("long").alias("node_id"))


@query("R09_store_queries", "SELECT file_path, 'files' AS asked FROM fx_files WHERE status = 'Failed' UNION ALL SELECT file_path, 'domains' FROM fx_files WHERE has_domain AND doc_id % 2 = 0")
def _(spark, d):
    kept = store.FileStore(spark, iterate.shared_path(spark, "store"))
    named = F.when(F.regexp_extract("file_path", r"(\d+)\.md$", 1).cast("long") % 2 == 0, '{"domains": [{"name": "Even", "reasoning": "r"}]}').otherwise('{"domains": [{"name": "Odd", "reasoning": "r"}]}')
    entries = _store_entries(spark, d).withColumn("_named", named)
    kept.upsert(entries.withColumn("level_data", F.transform_values("level_data", lambda k, v: v.withField("content", F.when(k == "DomainKeywords", F.col("_named")).otherwise(v["content"])))).drop("_named"))
    return kept.files(status="Failed").select("file_path", F.lit("files").alias("asked")).union(kept.domains(name="even").select("file_path", F.lit("domains")))


@query(
    "T02_claim",
    """SELECT job_id, worker_id, 'Processing' AS status FROM fx_jobs WHERE status = 'Pending' AND worker_id NOT IN (SELECT worker_id FROM fx_jobs WHERE status = 'Processing' AND job_id % 50 = 0)
QUALIFY row_number() OVER (PARTITION BY worker_id ORDER BY created_at, job_id) = 1""",
)
def _(spark, d):
    j = fx.view(spark, d, "fx_jobs")
    return pipeline.claim(j, pipeline.active_jobs(j).filter("job_id % 50 = 0"), "worker_id").select("job_id", "worker_id", "status")


@query("R11_queue_length", "SELECT count(*) AS length FROM fx_jobs WHERE status IN ('Pending', 'Retrying')")
def _(spark, d):
    return pipeline.queue_length(fx.view(spark, d, "fx_jobs"))


@query("T10_T11_shutdown", "SELECT count(*) AS rows, true AS drained, false AS active, count(*) AS stored FROM fx_files")
def _(spark, d):
    f, into = _found_files(spark, d), iterate.shared_path(spark, "stream")
    f.repartition(4, "file_path").write.parquet(f"{into}/in")
    kept = store.FileStore(spark, f"{into}/store")
    run = pipeline.start(pipeline.intake(spark, f.schema, f"{into}/in"), kept, {"Ast": _plain_ast, "DomainKeywords": _plain_domains}, f"{into}/check", once=False)
    last = pipeline.shut_down(run, 300)
    return kept.read().agg(F.count("*").alias("stored")).select(F.lit(last["rows"]).cast("long").alias("rows"), F.lit(last["drained"]).alias("drained"), F.lit(last["active"]).alias("active"), "stored")


@query(
    "X02_analysis",
    """SELECT solution, count(*) AS project_count, count(*) FILTER (language = 'C#') > 0 AS is_valid, (SELECT count(*) FROM fx_nodes) AS node_count,
'Analyzed ' || (SELECT count(*) FROM fx_nodes) || ' types with ' || (SELECT count(*) FROM fx_edges) || ' dependencies across ' || (SELECT count(DISTINCT project) FROM fx_nodes) || ' projects' AS summary FROM pr GROUP BY 1""",
    extra=_PROJECTS,
)
def _(spark, d):
    found = projects.analyze(*_projects(spark, d), fx.view(spark, d, "fx_nodes"), fx.view(spark, d, "fx_edges"), "comprehensive")
    return found.select("solution", "basic.project_count", "validation.is_valid", "dependency_graph.node_count", "dependency_graph.summary")


@query("X07_callbacks", "SELECT run_id, step_number, CASE role WHEN 'user' THEN 'Task' ELSE 'Action' END AS kind FROM fx_steps")
def _(spark, d):
    steps, into = fx.steps(spark, d).select("run_id", "step_number", "step_type"), iterate.shared_path(spark, "steps")
    steps.repartition(2, "run_id").write.parquet(f"{into}/in")
    keep = lambda kind: lambda batch: batch.select("run_id", "step_number", F.lit(kind).alias("kind")).write.mode("append").parquet(f"{into}/out")
    callbacks = {"Task": [keep("Task")], "Action": [lambda _: 1 / 0, keep("Action")]}
    run = spark.readStream.schema(steps.schema).parquet(f"{into}/in").writeStream.foreachBatch(lambda batch, _: pipeline.call_back(batch, callbacks, lambda *_: None))
    run.option("checkpointLocation", f"{into}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{into}/out")
