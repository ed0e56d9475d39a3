"""Nested documents, the store, incremental processing and recorded runs."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import coercion, text
from loomgraph.operators import nested, runs
from loomgraph.sources import files
from loomgraph.sources.store import FileStore, ResponseCache
from loomgraph.streaming import pipeline

AST = {"type": "CompilationUnit", "namespace": "A.B", "usings": ["System"], "classes": [{"name": "K", "modifiers": ["public"], "baseTypes": ["I"], "attributes": [], "members": []}], "interfaces": [], "enums": [], "records": [], "structs": []}
MEMBERS = [
    ({"kind": "", "name": "x"}, "a member without kind or name"),
    ({"kind": "Property", "name": "x", "hasSetter": True}, "a property without accessor flags"),
    ({"kind": "method", "name": "x", "returnType": None}, "a method without return type"),
    ({"kind": "Constructor", "name": "x", "parameters": [{"name": " ", "type": "int"}]}, "a parameter without name or type"),
    ({"kind": "Field", "name": "x"}, None),
]


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("content", "error"),
    [
        ("", "content is empty"),
        ("{", "content is no JSON"),
        (json.dumps(AST | {"type": "Other"}), "the root is no CompilationUnit"),
        (json.dumps(AST | {"classes": None}), "classes is null"),
        (json.dumps(AST | {"classes": [{"name": " "}]}), "a class without a name"),
        (json.dumps(AST), None),
        (json.dumps({k.upper(): v for k, v in AST.items()}), None),
        (json.dumps(AST)[:-1] + ",}", None),
        ("// first\n" + json.dumps(AST), None),
        *[(json.dumps(AST | {"classes": [{"name": "K", "members": [m]}]}), e) for m, e in MEMBERS],
    ],
)
def test_ast_errors(spark, content, error):
    assert one(spark, nested.ast_error(F.col("c")), c=content) == error


@pytest.mark.parametrize(
    ("content", "error"),
    [(" ", "content is empty"), ("[", "content is no JSON"), ('{"domains": []}', "no domains"), ('{"domains": [{"name": "", "reasoning": "r"}]}', "a domain without a name"), ('{"domains": [{"name": "n", "reasoning": " "}]}', "a domain without reasoning"), ('{"domains": [{"name": "n", "reasoning": "r"}]}', None)],
)
def test_domain_errors(spark, content, error):
    assert one(spark, nested.domain_error(F.col("c")), c=content) == error


def test_ast_rows(spark):
    texts = [json.dumps(AST), "broken", None, json.dumps(AST | {"Enums": [{"name": "E", "baseTypes": ["X"]}], "enums": None}).replace('"enums": null, ', "")]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "file_path string, content string")
    found = [(r.file_path, r.type, r.name, r.base_types) for r in nested.ast_rows(df).orderBy("file_path", "type").collect()]
    assert found == [("0", "class", "K", ["I"]), ("3", "class", "K", ["I"]), ("3", "enum", "E", [])]
    assert {r.file_path: r.n_classes for r in nested.index(df).collect()} == {"0": 1, "1": 0, "2": 0, "3": 1}


def ast(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if "bad" in t else json.dumps({"type": "CompilationUnit", "namespace": "n", "usings": [], "classes": [], "interfaces": [], "enums": [], "records": [], "structs": []}))


def domains(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: json.dumps({"domains": [{"name": t.split()[0], "reasoning": "r"}]}))


EXTRACTORS = {"Ast": ast, "DomainKeywords": domains}


def test_stream_into_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, body in (("a.md", "good text"), ("b.md", "bad text"), ("c.txt", "other")):
        (tmp_path / "in" / name).write_text(body)
    store = FileStore(spark, str(tmp_path / "store"))

    def run():
        pipeline.start(files.watch(spark, str(tmp_path / "in")), store, EXTRACTORS, str(tmp_path / "check")).awaitTermination(120)
        return {r.file_path[-4:]: (r.status, sorted(r.level_data)) for r in store.read().collect()}

    assert run() == {"a.md": ("Completed", ["Ast", "DomainKeywords"]), "b.md": ("Failed", ["Ast"])}
    (tmp_path / "in" / "d.md").write_text("more text")
    assert set(run()) == {"a.md", "b.md", "d.md"}
    row = store.statistics(["Ast", "DomainKeywords"]).first()
    assert (row.total_files, row.completed, row.failed, row.n_DomainKeywords) == (3, 2, 1, 2)
    # what is completed with the same content is not processed again; what failed is
    again = pipeline.process(files.discover(spark, str(tmp_path / "in")), store, EXTRACTORS, "2030-01-01 00:00:00")
    assert [r.file_path[-4:] for r in again.collect()] == ["b.md"]
    path = next(r.file_path for r in store.read().collect() if r.file_path.endswith("a.md"))
    assert store.get(path).count() == 1
    store.invalidate([path])
    assert store.get(path).isEmpty() and store.read().count() == 2
    store.evict(1)
    assert store.read().count() == 1
    store.expire(dt.datetime(2100, 1, 1))
    assert store.read().isEmpty()


def test_changed_file_reuses_nothing(spark, tmp_path):
    store = FileStore(spark, str(tmp_path / "s"))
    kinds = "file_path string, file_hash string, file_size long, last_modified timestamp, content string"
    now = dt.datetime(2024, 1, 1)
    store.upsert(pipeline.process(spark.createDataFrame([("p", "h1", 1, now, "one x")], kinds), store, EXTRACTORS, now))
    store.upsert(pipeline.process(spark.createDataFrame([("p", "h2", 1, now, "two x")], kinds), store, EXTRACTORS, dt.datetime(2024, 1, 2)))
    assert "two" in store.read().first().level_data["DomainKeywords"].content and store.read().count() == 1


def test_response_cache(spark, tmp_path):
    cache = ResponseCache(spark, str(tmp_path / "c"))
    cache.append(spark.createDataFrame([("k", "old", dt.datetime(2024, 1, 1)), ("k", "new", dt.datetime(2024, 1, 5))], "request_key string, response string, created_at timestamp"))
    asked = spark.createDataFrame([("k",), ("z",)], "request_key string")
    assert {r.request_key: r.response for r in cache.lookup(asked, dt.datetime(2024, 1, 6)).collect()} == {"k": "new", "z": None}
    assert cache.statistics(dt.datetime(2024, 1, 10)).first().file_count == 1


def test_messages(spark):
    kinds = "run_id long, step_number long, step_type string, model_output string, observations array<string>, content string"
    df = spark.createDataFrame([(1, 1, "Action", "out", ["Call id: a\nx"], None), (1, 2, "Action", "out", ["Call id: a\nx", "Call id: b\ny"], None), (1, 3, "Action", None, None, None)], kinds)
    assert [r["count"] for r in runs.messages(df).groupBy("step_number").count().orderBy("step_number").collect()] == [2, 3]
    assert runs.messages(df, summary=True).count() == 3
    assert one(spark, text.call_id(F.col("c")), c="Call id: abc\nrest") == "abc"


def test_nested_state():
    state = {"cargo_port": "Riga", "pier": 4, "pier_boats": ["Alma"]}
    value = {"a": "cargo_port", "b": ["pier", "plain", {"c": "pier_boats"}]}
    assert runs.substituted(value, state) == {"a": "Riga", "b": [4, "plain", {"c": ["Alma"]}]}
    assert runs.references({"a": "cargo_port", "b": ["pierNumber", "plain words", "x", "two_words here"]}) == ["cargo_port", "pierNumber", "two_words here"]


def test_observations():
    assert runs.observed({}, "t") == "{}" and runs.observed([], "t") == "[]" and runs.observed(3, "t") == "3"
    assert runs.observed({"a": {}, "b": None, "c": [1, "x"]}, "t") == 'a:\nb: \nc: [1, "x"]'


def test_json_types(spark):
    for value, kind in (('"x"', "string"), ("true", "boolean"), ("3", "integer"), ("1.5", "number"), ("[1]", "array"), ('{"a": 1}', "object"), ("null", "null"), ("{", None)):
        assert one(spark, coercion.json_type(F.col("c")), c=value) == kind
    for value, kind, ok in (("2.5", "integer", False), ("2", "integer", True), ("1", "boolean", False), ("False", "boolean", True), ("[1", "array", False), ("x", "nothing", False)):
        assert one(spark, coercion.coercible(F.col("c"), F.col("t")), c=value, t=kind) is ok


def test_response_cache_expires_and_clears(spark, tmp_path):
    cache = ResponseCache(spark, str(tmp_path / "c"))
    cache.expire("2024-01-10")
    rows = spark.createDataFrame([("a", "old", "2024-01-01"), ("b", "new", "2024-01-05")], "request_key string, response string, created_at string")
    cache.append(rows.withColumn("created_at", F.to_timestamp("created_at")))
    cache.expire("2024-01-10")
    assert [r.request_key for r in cache.read("2024-01-02").collect()] == ["b"]
    cache.clear()
    assert cache.read("2024-01-02").count() == 0 and cache.statistics("2024-01-02").first().file_count == 0


def test_display_strings(spark):
    numbers = [0.125, 0.145, 2.675, -0.001, 1e300, float("nan"), float("inf")]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in numbers], "x double").coalesce(1).select(text.fixed2("x")).collect()]
    assert got[:4] == ["0.13", "0.14", "2.67", "-0.00"] and got[4].startswith("1000000000000000052504760255204") and got[5:] == ["NaN", "∞"]
    none = F.lit(None).cast("string")
    row = spark.range(1).select(
        text.edge_display(F.lit("A"), F.lit("Run"), F.lit("B"), F.lit("Method"), F.lit(0.5), F.lit(0.625), F.lit("Balanced"), F.lit("3,4")),
        text.edge_display(F.lit("A"), F.lit(""), F.lit("B"), F.lit("Method"), F.lit(0.5), F.lit(None).cast("double"), none, none),
        text.node_display(F.lit("A"), F.lit("P"), F.lit(2), F.lit(3)),
        text.finding_display(F.lit("GodClass"), F.lit("High"), F.lit("too many"), F.lit(4)),
        text.strength_display(F.lit(0.5), {"structural": F.lit(0.25), "semantic": F.lit(1.0)}, F.lit("Balanced")),
    ).first()
    assert list(row) == [
        "A.Run -> B (Method) [Composite: 0.63, Profile: Balanced] at 3,4",
        "A -> B (Method) [Strength: 0.50]",
        "A (P) - 2 deps, 3 dependents",
        "GodClass (High): too many - 4 dependencies affected",
        "Composite: 0.50 | Structural: 0.25 | Semantic: 1.00 | Profile: Balanced",
    ]
