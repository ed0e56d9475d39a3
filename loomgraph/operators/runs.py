"""Recorded agent runs: steps, messages, tokens, timing, state variables and tool schemas."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coercion import json_type
from ..functions.text import call_id, default_argument, is_state_name


def messages(steps: DataFrame, summary: bool = False) -> DataFrame:
    """run_id, step_number, sub_position, role, content of every message of steps (run_id, step_number, step_type, model_output, observations array, content).

    An action gives its model output (not in summaries), then each tool response; planning gives its text (not in summaries) and a request to go on.
    """
    msg = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    none = F.expr("cast(array() as array<struct<role: string, content: string>>)")
    one = lambda role, c: F.when(c.isNotNull(), F.array(msg(role, c))).otherwise(none)
    tools = F.transform(F.coalesce("observations", F.expr("cast(array() as array<string>)")), lambda o: F.struct(F.lit("tool-response").alias("role"), o.alias("content")))
    action = tools if summary else F.concat(one("assistant", F.col("model_output")), tools)
    planning = none if summary else F.concat(one("assistant", F.col("content")), F.array(msg("user", F.lit("Now proceed and carry out this plan."))))
    system = none if summary else one("system", F.col("content"))
    of = F.when(F.col("step_type") == "Action", action).when(F.col("step_type") == "Planning", planning).when(F.col("step_type") == "System", system).when(F.col("step_type") == "Task", one("user", F.concat(F.lit("New task:\n"), "content"))).otherwise(one("assistant", F.col("content")))
    return steps.select("run_id", "step_number", F.posexplode(of).alias("sub_position", "m")).select("run_id", "step_number", "sub_position", "m.role", "m.content")


def step_json(steps: DataFrame) -> DataFrame:
    """Steps with their fields as a JSON object, null ones left out."""
    fields = [c for c in steps.columns if c not in ("run_id", "step_number")]
    return steps.select("run_id", "step_number", F.to_json(F.struct(*fields)).alias("json"))


def totals(steps: DataFrame) -> DataFrame:
    """Per run: steps, tokens in and out, seconds, and whether the most steps were reached without a final answer."""
    return steps.groupBy("run_id").agg(
        F.count("*").alias("n_steps"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.avg("duration_s"), F.lit(0.0)).alias("avg_duration_s"),
        F.coalesce(F.sum("duration_s"), F.lit(0.0)).alias("total_duration_s"),
    )


def run_state(steps: DataFrame, max_steps: int) -> DataFrame:
    done = F.bool_or(F.col("step_type") == "Final")
    return steps.groupBy("run_id").agg(F.when(done, "success").when(F.count("*") >= max_steps, "max_steps_error").otherwise("running").alias("state"))


def running_tokens(steps: DataFrame) -> DataFrame:
    """Steps with a counter and the tokens so far."""
    w = Window.partitionBy("run_id").orderBy("step_number")
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumns({"step_index": F.row_number().over(w), "input_so_far": F.sum("input_tokens").over(before), "output_so_far": F.sum("output_tokens").over(before)})


def plans_at(step: Column, interval: int) -> Column:
    """Whether a step is one to plan before: the first, and each interval after it."""
    return (step == 1) | ((step - 1) % interval == 0)


def trimmed(history: DataFrame, most: int = 6, drop: int = 2) -> DataFrame:
    """Messages without the first two of runs with more than six."""
    w = Window.partitionBy("run_id").orderBy("step_number")
    out = history.withColumn("_n", F.row_number().over(w)).withColumn("_all", F.count("*").over(Window.partitionBy("run_id")))
    return out.filter((F.col("_all") <= most) | (F.col("_n") > drop)).drop("_n", "_all")


def call_pairs(calls: DataFrame, responses: DataFrame, *within: str) -> DataFrame:
    """Tool calls (call_id, …) with the responses (content) that name them; within: further columns that both share, such as the run."""
    return calls.join(responses.withColumn("call_id", call_id(F.col("content"))), [*within, "call_id"], "left")


def registered(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Calls with an error that names all tools where there is none of that name."""
    names = tools.agg(F.array_join(F.array_sort(F.collect_set("tool")), ", ").alias("_all"))
    known = tools.select("tool").distinct().withColumn("_known", F.lit(True))
    out = calls.join(known, "tool", "left").join(F.broadcast(names))  # one row
    return out.withColumn("error", F.when(F.col("_known").isNull(), F.concat(F.lit("unknown tool "), "tool", F.lit(", known are: "), "_all"))).drop("_known", "_all")


def tools_and_agents(tools: DataFrame, agents: DataFrame) -> DataFrame:
    """Both by name (tool); an agent takes the place of a tool of its name."""
    return tools.join(agents.select("tool"), "tool", "left_anti").unionByName(agents)


def substitute(value: Column, state: Column) -> Column:
    """A scalar argument, or what the state (a map) holds under it."""
    return F.coalesce(F.try_element_at(state, value), value)


def substituted(value, state: dict):
    """A nested value with every text that names a state variable replaced by it."""
    if isinstance(value, dict):
        return {k: substituted(v, state) for k, v in value.items()}
    if isinstance(value, list):
        return [substituted(v, state) for v in value]
    return state.get(value, value) if isinstance(value, str) else value


@F.pandas_udf(T.StringType())
def substitute_json(arguments: pd.Series, state: pd.Series) -> pd.Series:
    """JSON arguments with state variables (a JSON object) put in, at any depth; what does not parse stays."""

    def one(a, s):
        try:
            return json.dumps(substituted(json.loads(a), json.loads(s) if s else {}), ensure_ascii=False, sort_keys=True)
        except (TypeError, ValueError):
            return a

    return pd.Series([one(a, s) for a, s in zip(arguments, state, strict=True)])


def references(value) -> list[str]:
    """Texts at any depth that look like state variables: with an underscore, or in camel case."""
    if isinstance(value, dict):
        value = list(value.values())
    if isinstance(value, list):
        return [r for v in value for r in references(v)]
    return [value] if isinstance(value, str) and is_state_name(value) else []


@F.pandas_udf(T.ArrayType(T.StringType()))
def references_json(arguments: pd.Series) -> pd.Series:
    def one(a):
        try:
            return list(dict.fromkeys(references(json.loads(a))))
        except (TypeError, ValueError):
            return []

    return arguments.map(one)


def missing_references(arguments: Column, state: Column) -> Column:
    """References that the state (a map) does not hold."""
    return F.array_except(references_json(arguments), F.map_keys(state))


def tool_schemas(inputs: DataFrame) -> DataFrame:
    """tool and its JSON schema, of inputs (tool, argument, type, description, optional)."""
    property_ = F.struct("argument", F.struct("type", "description").alias("p"))
    grouped = inputs.groupBy("tool").agg(F.array_sort(F.collect_list(property_)).alias("ps"), F.array_sort(F.collect_list(F.when(~F.col("optional"), F.col("argument")))).alias("required"))
    schema = F.struct(F.lit("object").alias("type"), F.map_from_entries("ps").alias("properties"), "required")
    return grouped.select("tool", F.to_json(schema).alias("schema"))


def output_type(kind: Column) -> Column:
    """The typed output of a value's kind: string → text, bytes → image, array → audio, null → null, else text."""
    return F.when(kind.isNull(), None).when(kind == "binary", "image").when(kind == "array", "audio").otherwise("text")


def map_arguments(arguments: Column, inputs: Column, tool: Column) -> Column:
    """A call's arguments (JSON) as an object: an object as it is, nothing for null, any other value under the name of the tool's only input.

    inputs: the names of a tool's inputs, null for an agent. A tool without inputs gets nothing; with more than one, and for agents, the value goes
    under the tool's default argument. Without a tool there is nothing to name it by.
    """
    none = F.lit("{}")
    under = lambda name: F.concat(F.lit("{"), F.to_json(F.array(name)).substr(F.lit(2), F.length(F.to_json(F.array(name))) - 2), F.lit(":"), arguments, F.lit("}"))
    kind = json_type(arguments)
    out = F.when(arguments.isNull() | (kind == "null"), none).when(kind == "object", arguments).when(tool.isNull(), none)
    return out.when(F.size(inputs) == 0, none).when(F.size(inputs) == 1, under(F.get(inputs, 0))).otherwise(under(default_argument(tool)))


def _shown(value) -> str:
    """A plain value as text; a nested one as JSON."""
    if isinstance(value, str):
        return value
    if value is None or isinstance(value, bool):
        return {None: "", True: "True", False: "False"}[value]
    return json.dumps(value, ensure_ascii=False)


def pretty(value: dict) -> str:
    """An object's entries, one a line: lists of texts in brackets, entries of an object within it indented below its name."""
    lines = []
    for k, v in value.items():
        if isinstance(v, list) and v and all(isinstance(x, str) for x in v):
            lines.append(f"{k}: [{', '.join(v)}]")
        elif isinstance(v, dict):
            lines += [f"{k}:", *(f"  {n}: {_shown(x)}" for n, x in v.items())]
        else:
            lines.append(f"{k}: {_shown(v)}")
    return "\n".join(lines).strip()


def observed(value, tool: str) -> str:
    """What a run records of a tool's output. The sentences are fixed values."""
    if value is None:
        return "Tool executed successfully but returned no result."
    if isinstance(value, str):
        return value if value.strip() else "Tool executed but returned empty string."
    shown = pretty(value) if isinstance(value, dict) else ""
    shown = shown or json.dumps(value, ensure_ascii=False, indent=2)
    return shown if shown not in ("{}", "null") or isinstance(value, dict) else f"Tool '{tool}' executed successfully."


@F.pandas_udf(T.StringType())
def observation(output: pd.Series, tool: pd.Series) -> pd.Series:
    """observed() for outputs as JSON (null: none); what does not parse counts as a text."""

    def one(o, t):
        try:
            return observed(None if o is None else json.loads(o), t)
        except ValueError:
            return observed(o, t)

    return pd.Series([one(o, t) for o, t in zip(output, tool, strict=True)])
