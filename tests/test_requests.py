"""Requests, responses and streams' ends: odd inputs that the queries do not hold."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import nested, projects, requests
from loomgraph.streaming import pipeline

MESSAGES = "role string, content string, tool_calls array<struct<id: string, name: string, arguments: string>>"


def test_vendor_messages(spark):
    rows = [("tool-call", "nothing named", None), ("tool-response", "tool_call_id: x7\nok", None), ("user", None, [("c", "t", "{}")]), ("assistant", "", [])]
    out = requests.vendor_messages(spark.createDataFrame(rows, MESSAGES)).collect()
    assert [tuple(r) for r in out] == [("tool", "nothing named", None, "unknown"), ("tool", "tool_call_id: x7\nok", None, "x7"), ("user", None, None, None), ("assistant", "", None, None)]
    for bad, strict in (("tool-call", True), ("judge", False), (None, False)):
        with pytest.raises(Exception, match="no tool_call_id|unknown role"):
            requests.vendor_messages(spark.createDataFrame([(bad, None, None)], MESSAGES), strict).collect()
    assert requests.vendor_messages(spark.createDataFrame([], MESSAGES)).count() == 0


def test_arguments_and_calls(spark):
    given = spark.createDataFrame([(x,) for x in (None, "", "null", "{}", '{"a": [1]}', "7", "{a")], "x string")
    assert [r[0] for r in given.select(requests.parsed_arguments(F.col("x"))).collect()] == ["{}", "{}", "{}", "{}", '{"a": [1]}', '{"value":"7"}', '{"value":"{a"}']
    said = spark.createDataFrame([(x,) for x in (None, "", "{", '{"tool": "t"}', 'a {"tool": "t", "with": "b"} c', '{"tool": "t"} {"tool": "u"}')], "x string")
    found = [r[0] and tuple(r[0]) for r in said.select(requests.embedded_call(F.col("x"), "tool", "with")).collect()]
    assert found == [None, None, None, ("t", "{}"), ("t", '{"value":"b"}'), None]


def test_one_json_value(spark):
    good = ["1", ' {"a": [1, {}]} ', "[]", '"x"', "null"]
    bad = [None, "", " ", "{} {}", "1, 2", '1, "b": 2', "1] [2", '1} {"b": 2', "1]", "1}", "{a}"]
    rows = spark.createDataFrame([(x,) for x in good + bad], "x string").select(nested.is_json(F.col("x"))).collect()
    assert [r[0] for r in rows] == [True] * len(good) + [False] * len(bad)


def test_layers_and_entries(spark):
    one = spark.range(1)
    maps = [F.expr(m) for m in ("map('a', '1', 'b', '1')", "cast(null as map<string, string>)", "map('b', '2', 'c', '2')", "map('a', '3')")]
    assert one.select(requests.layered(*maps)).first()[0] == {"a": "3", "b": "2", "c": "2"}
    assert one.select(requests.model_entry(F.lit(None).cast("map<string, string>"), api_key=F.lit("secret"), endpoint=F.lit(None))).first()[0] == {"api_key": "[REDACTED]"}
    options = spark.createDataFrame([(1, None, None, None, None, None, None, None)], "run_id long, model string, defaults map<string, string>, additional map<string, string>, stop array<string>, tools array<string>, response_format string, tool_choice string")
    none = spark.createDataFrame([], "run_id long, step_number long, sub_position int, role string, content string")
    assert requests.requests(none, options).first()["arguments"] == {"messages": "[]"}


def test_documentation(spark):
    texts = [(None, None), ("", None), ("/// a\r\n/// b\r\n", "a\nb"), ("/***/ /* c */", None), ("/** d */", "d"), ("//// e", None), ("[X]\n/// f\n[Y]\n/// g", "f")]
    rows = spark.createDataFrame(texts, "x string, y string").select(text.documentation(F.col("x")).alias("got"), "y").collect()
    assert [r.got for r in rows] == [r.y for r in rows]


def test_unknown_index_field(spark):
    with pytest.raises(Exception, match="nothing"):
        nested.query_index(nested.index(spark.createDataFrame([], "file_path string, content string")), {"nothing": 1}).collect()


def test_failing_callbacks(spark):
    seen, failed = [], []
    steps = spark.createDataFrame([("Task", 1), ("Action", 2), ("Action", 3)], "step_type string, n long")
    pipeline.call_back(steps, {"Action": [lambda _: 1 / 0, lambda df: seen.append(df.count())], "Final": [lambda df: seen.append(df.count())]}, lambda kind, error: failed.append((kind, type(error))))
    assert seen == [2, 0] and failed == [("Action", ZeroDivisionError)]


def test_kinds_of_analysis(spark):
    tables = [spark.createDataFrame([], s) for s in ("solution string, project string, language string", "project string, name string", "node_id long, project string", "src long, dst long")]
    assert projects.analyze(*tables).columns == projects.summary(*tables[:2]).columns
    assert projects.analyze(*tables, "validation").count() == projects.analyze(*tables, "comprehensive").count() == 0
    assert projects.analyze(*tables, "dependency_graph").first().summary == "Analyzed 0 types with 0 dependencies across 0 projects"
    with pytest.raises(ValueError, match="unknown analysis"):
        projects.analyze(*tables, "deep")


def test_monitor_and_shutdown(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    stream = pipeline.intake(spark, spark.range(1).schema, f"{tmp_path}/in")
    seen = []
    run = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/a").trigger(availableNow=True).start()
    pipeline.monitor(run, seen.append, 0.5)
    assert seen[-1]["rows"] == 10 and not seen[-1]["active"]
    again = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/b").start()
    assert {k: v for k, v in pipeline.shut_down(again, 60).items() if k in ("rows", "active", "drained")} == {"rows": 10, "active": False, "drained": True}
    late = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").start()
    assert not pipeline.shut_down(late, 0)["drained"] and pipeline.capacity(3) == 1000 and pipeline.capacity(20) == 2000
