"""Views over the driver's tables that feed the engine's queries; one SQL text for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import DependencyGraph
from ..schemas import DEPENDENCY_TYPES
from . import iterate

FX = {
    "fx_nodes": """SELECT p_partkey AS node_id,
  CASE WHEN p_brand='Brand#13' THEN 'Shop.Tests' WHEN p_type='STANDARD' THEN 'Shop.Domain.Models' WHEN p_type='SMALL' THEN 'Shop.Application.Services'
       WHEN p_type='MEDIUM' THEN 'Shop.Infrastructure.External' WHEN p_type='LARGE' THEN 'Shop.Data.Persistence'
       WHEN p_type='ECONOMY' THEN 'Web.Presentation' ELSE 'Billing.Config' END AS namespace,
  concat('P', CAST(p_partkey AS VARCHAR(20)), CASE p_size % 10 WHEN 0 THEN 'Repository' WHEN 1 THEN 'Factory' WHEN 2 THEN 'Service' WHEN 3 THEN 'Handler'
       WHEN 4 THEN 'Listener' WHEN 5 THEN 'Builder' WHEN 6 THEN 'Context' WHEN 7 THEN 'Mock' WHEN 8 THEN 'Settings' ELSE '' END) AS name,
  CASE p_partkey % 5 WHEN 0 THEN 'Interface' WHEN 1 THEN 'Struct' ELSE 'Class' END AS kind,
  (p_partkey % 5 = 0 OR p_partkey % 7 = 0) AS is_abstract, (p_partkey % 5 = 1 OR p_partkey % 11 = 0) AS is_sealed, (p_partkey % 13 = 0) AS is_static,
  p_brand AS project
FROM part""",
    "fx_edges": """SELECT src, dst, l_orderkey AS ord_key, l_linenumber AS line_no, (l_linenumber * 5 + l_suppkey) % 31 AS dep_ord,
  CASE l_suppkey % 6 WHEN 1 THEN 'ExecuteOrder' WHEN 2 THEN 'GetPrice' WHEN 3 THEN 'ConvertUnits' WHEN 4 THEN 'SaveAll' WHEN 5 THEN 'Run' END AS member_name,
  row_number() OVER (ORDER BY src, l_orderkey, l_linenumber, dst, l_suppkey, l_extendedprice, l_shipdate) AS edge_seq
FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS dst,
        l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag, l_extendedprice, l_shipdate FROM lineitem) t
WHERE dst IS NOT NULL AND l_quantity >= 40 AND l_returnflag = 'R'""",
    "fx_dag": "SELECT DISTINCT src, dst FROM fx_edges WHERE src < dst",
    "fx_trade": """SELECT c_nationkey AS src, s_nationkey AS dst, l_orderkey AS ord_key, l_linenumber AS line_no, (l_linenumber * 5 + l_suppkey) % 31 AS dep_ord
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey""",
    "fx_files": """SELECT d.doc_id, concat('/data/', d.lang, '/', d.source, '/', CAST(d.doc_id AS VARCHAR(20)), '.md') AS file_path, d.n_chars AS file_size, d.text AS content,
  CASE WHEN l.doc_id IS NULL THEN 'Pending' WHEN l.toxic = 1 THEN 'Failed' ELSE 'Completed' END AS status,
  (l.doc_id IS NOT NULL) AS has_ast, (l.doc_id IS NOT NULL AND l.quality = 1) AS has_domain
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "fx_jobs": """SELECT event_id AS job_id, user_id AS worker_id, ts AS created_at, value AS duration_s,
  CASE event_type WHEN 'view' THEN 'Pending' WHEN 'click' THEN 'Processing' WHEN 'purchase' THEN 'Completed' WHEN 'error' THEN 'Failed' ELSE 'Retrying' END AS status
FROM events""",
    "fx_steps": "SELECT conv_id AS run_id, turn AS step_number, role, text AS content, length(text) AS n_chars FROM conversations",
    "fx_ast": """SELECT concat('/src/', namespace, '/', name, '.md') AS file_path,
  CASE node_id % 5 WHEN 0 THEN 'interface' WHEN 1 THEN 'struct' WHEN 2 THEN 'record' WHEN 3 THEN 'enum' ELSE 'class' END AS type, name, namespace,
  concat_ws('|', CASE WHEN node_id % 3 <> 0 THEN 'public' ELSE 'internal' END, CASE WHEN is_abstract THEN 'abstract' END,
            CASE WHEN is_sealed THEN 'sealed' END, CASE WHEN is_static THEN 'static' END) AS modifiers_csv,
  CASE WHEN node_id % 5 = 3 THEN '' ELSE concat_ws('|', CASE WHEN node_id % 2 = 0 THEN 'IEntity' END, CASE WHEN node_id % 4 = 0 THEN 'IDisposable' END) END AS base_types_csv,
  concat_ws('|', CASE WHEN node_id % 6 = 0 THEN 'ApiController' END, CASE WHEN node_id % 10 = 0 THEN 'Obsolete' END) AS attributes_csv
FROM fx_nodes""",
}
#: Rows of lineitem up to which fx_edges is made by its SQL.
PLAIN_LINES = 2_000_000
#: Chosen lines up to which the keys of their orders, and their numbers, are broadcast (about 70 bytes each).
BROADCAST_ORDERS = 4_000_000
_BASE = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


def needs(sql: str) -> list[str]:
    """The views that a text names, those that they need first."""
    out: list[str] = []
    for name in FX:
        if re.search(rf"\b{name}\b", sql):
            out += [n for n in [*needs(FX[name]), name] if n not in out]
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of FX, or a base table, as a DataFrame."""
    if name not in FX:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "fx_edges" and view(spark, sf_dir, "lineitem").count() > PLAIN_LINES:
        return _many_edges(view(spark, sf_dir, "lineitem"))
    used = [n for n in [*FX, *_BASE] if n != name and re.search(rf"\b{n}\b", FX[name])]
    return spark.sql(re.sub(rf"\b({'|'.join(used)})\b(?!\.)", r"{\1}", FX[name]), **{n: view(spark, sf_dir, n) for n in used})


def _many_edges(lines: DataFrame) -> DataFrame:
    """The rows of fx_edges, stored: only orders with a line that meets its conditions are sorted, and rows are numbered by runs of sources."""
    chosen = F.coalesce((F.col("l_quantity") >= 40) & (F.col("l_returnflag") == "R"), F.lit(False))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    orders = iterate.stored(lines.filter(chosen & F.col("l_orderkey").isNotNull()).select(F.col("l_orderkey").alias("_order"), F.col("l_linenumber").alias("_line")), "orders")
    lines = lines.select("l_orderkey", *order, chosen.alias("chosen"))
    if iterate.small(orders, BROADCAST_ORDERS):
        # of an order, the lines from the first chosen one on (those without a number come first); rows without an order are one group of their own
        needed = (F.col("l_orderkey") == F.col("_order")) & (F.col("_line").isNull() | (F.col("l_linenumber") >= F.col("_line")))
        lines = lines.join(F.broadcast(orders), needed, "left_semi").unionByName(lines.filter("l_orderkey is null"))
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*order))
    found = lines.withColumn("dst", after).filter("chosen and dst is not null").drop("chosen")
    names = F.create_map(*map(F.lit, [1, "ExecuteOrder", 2, "GetPrice", 3, "ConvertUnits", 4, "SaveAll", 5, "Run"]))
    columns = {
        "src": F.col("l_partkey"),
        "dst": F.col("dst"),
        "ord_key": F.col("l_orderkey"),
        "line_no": F.col("l_linenumber"),
        "dep_ord": (F.col("l_linenumber") * 5 + F.col("l_suppkey")) % 31,
        "member_name": F.try_element_at(names, (F.col("l_suppkey") % 6).cast("int")),
    }
    found = iterate.numbered_and_stored(found, "l_partkey", "place", ("l_orderkey", "l_linenumber", "dst", "l_suppkey", "l_extendedprice", "l_shipdate"), columns, "edges", 1 << 12)
    return found.select(*columns, (F.col("place") + 1).cast("int").alias("edge_seq"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_edges with its kinds by name."""
    kinds = F.array(*map(F.lit, DEPENDENCY_TYPES))
    return view(spark, sf_dir, "fx_edges").withColumn("dep_type", F.element_at(kinds, (F.col("dep_ord") + 1).cast("int")))


def graph(spark: SparkSession, sf_dir: str) -> DependencyGraph:
    made = edges(spark, sf_dir)
    return DependencyGraph(view(spark, sf_dir, "fx_nodes"), made, iterate.is_stored(made))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_files as stored entries, processed a minute apart by doc_id."""
    level = lambda has, name: F.when(F.col(has), F.struct(F.lit(name).alias("key"), F.struct(F.lit("{}").alias("content"), F.lit(True).alias("is_success")).alias("value")))
    data = F.map_from_entries(F.array_compact(F.array(level("has_ast", "Ast"), level("has_domain", "DomainKeywords"))))
    return view(spark, sf_dir, "fx_files").withColumns({"level_data": data, "processed_at": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 60)})


def ast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_ast with its lists as arrays."""
    out = view(spark, sf_dir, "fx_ast")
    none = F.expr("cast(array() as array<string>)")
    return out.select("file_path", "type", "name", "namespace", *[F.when(F.col(f"{c}_csv") == "", none).otherwise(F.split(f"{c}_csv", r"\|")).alias(c) for c in ("modifiers", "base_types", "attributes")])


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_steps as recorded steps: users' turns are tasks, others actions; tokens are a quarter of the characters."""
    out = view(spark, sf_dir, "fx_steps")
    kind = F.when(F.col("role") == "user", "Task").otherwise("Action")
    action = kind == "Action"
    return out.withColumns(
        {
            "step_type": kind,
            "model_output": F.when(action, F.col("content")),
            "observations": F.when(action & (F.col("step_number") % 2 == 1), F.array(F.concat(F.lit("Call id: c"), F.col("step_number").cast("string"), F.lit("\n"), F.col("content")))),
            "input_tokens": (F.col("n_chars") / 4).cast("long"),
            "output_tokens": (F.col("n_chars") / 8).cast("long"),
            "duration_s": F.col("n_chars") / 100.0,
        }
    )


def oracle(sql: str, recursive: bool = False, extra: str = "") -> str:
    """DuckDB SQL with the views that it names before it. extra: more common table expressions."""
    names = needs(extra + sql)
    parts = [f"{n} AS ({FX[n]})" for n in names] + ([extra] if extra else [])
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + sql if parts else sql
