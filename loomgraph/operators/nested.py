"""Nested JSON documents: tolerant parsing, flattening, validation, indexes and predicate queries."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import AST_ARRAYS, AST_DOCUMENT, DOMAIN_DOCUMENT

_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/|,(?=\s*[}\]])', re.S)
# fixed values: the property names of the two kinds of document, as schemas spell them
_NAMES = {n.lower(): n for n in "type namespace usings classes interfaces enums records structs name modifiers baseTypes attributes members values kind returnType parameters hasGetter hasSetter isNullable defaultValue body domains reasoning".split()}


def canonical_json(text: str | None) -> str | None:
    """The document with comments and trailing commas gone and known property names spelled as in the schemas; null if it does not parse."""
    if text is None or not text.strip():
        return None
    bare = text
    for _ in range(2):  # a comma may trail before a comment
        bare = _TOKENS.sub(lambda m: m[0] if m[0][0] == '"' else "", bare)

    def spell(pairs):
        return {_NAMES.get(k.lower(), k): v for k, v in pairs}

    try:
        return json.dumps(json.loads(bare, object_pairs_hook=spell), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def canonical(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_json)


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value, and no more: the parser stops after the first, so the text must be whole as an array's item and as a field."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"":'), text, F.lit("}"))).isNotNull()


def parsed_ast(content: Column, tolerant: bool = True) -> Column:
    return F.from_json(canonical(content) if tolerant else content, AST_DOCUMENT)


def parsed_domains(content: Column, tolerant: bool = True) -> Column:
    return F.from_json(canonical(content) if tolerant else content, DOMAIN_DOCUMENT)


def _blank(x: Column) -> Column:
    return F.coalesce(F.trim(x), F.lit("")) == ""


def ast_rows(documents: DataFrame, tolerant: bool = True) -> DataFrame:
    """file_path, type, name, namespace, modifiers, base_types, attributes of every named element of documents (file_path, content).

    Documents that do not parse, and null arrays, give no rows. Enums have no base types.
    """
    empty = F.expr("cast(array() as array<string>)")
    parsed = documents.select("file_path", parsed_ast(F.col("content"), tolerant).alias("d")).filter("d is not null")

    def rows(array: str, tag: str) -> Column:
        def one(x):
            bases = empty if tag == "enum" else F.coalesce(x["baseTypes"], empty)
            return F.struct(F.lit(tag).alias("type"), x["name"].alias("name"), F.coalesce(x["modifiers"], empty).alias("modifiers"), bases.alias("base_types"), F.coalesce(x["attributes"], empty).alias("attributes"))

        return F.coalesce(F.transform(F.col(f"d.{array}"), one), F.expr("cast(array() as array<struct<type: string, name: string, modifiers: array<string>, base_types: array<string>, attributes: array<string>>>)"))

    every = F.explode(F.concat(*[rows(a, t) for a, t in AST_ARRAYS.items()])).alias("e")
    out = parsed.select("file_path", F.col("d.namespace").alias("namespace"), every).filter(~_blank(F.col("e.name")))
    return out.select("file_path", "e.type", "e.name", "namespace", "e.modifiers", "e.base_types", "e.attributes")


def domain_rows(documents: DataFrame, tolerant: bool = True) -> DataFrame:
    """file_path, name, reasoning of every domain of documents (file_path, content)."""
    parsed = documents.select("file_path", parsed_domains(F.col("content"), tolerant).alias("d"))
    return parsed.select("file_path", F.explode("d.domains").alias("x")).select("file_path", "x.name", "x.reasoning").filter(~_blank(F.col("name")))


def readable(entries: DataFrame, level: str) -> DataFrame:
    """file_path, content of the entries whose level succeeded and is not blank."""
    data = F.col("level_data")[level]
    return entries.filter(data["is_success"] & ~_blank(data["content"])).select("file_path", data["content"].alias("content"))


def _glob(path: Column, pattern: str) -> Column:
    """A glob as the engine means it: * is any run, the rest a regular expression, anywhere, in any case."""
    return path.rlike("(?i)" + pattern.replace("*", ".*"))


def query_ast(rows: DataFrame, type=None, name=None, namespace=None, modifiers=None, base_types=None, attributes=None, file_path=None, file_pattern=None) -> DataFrame:
    """Rows that meet all given predicates. Texts compare in any case; all modifiers must be there, any base type or attribute."""
    tests = [F.lower(c) == v.lower() for c, v in (("type", type), ("name", name), ("namespace", namespace)) if v]
    tests += [F.array_contains("modifiers", m) for m in modifiers or ()]
    tests += [F.arrays_overlap(c, F.array(*map(F.lit, v))) for c, v in (("base_types", base_types), ("attributes", attributes)) if v]
    tests += _paths(file_path, file_pattern)
    return _all(rows, tests)


def query_domains(rows: DataFrame, name=None, pattern=None, file_path=None, file_pattern=None) -> DataFrame:
    tests = [F.lower("name") == name.lower()] if name else []
    tests += [F.col("name").rlike("(?i)" + pattern)] if pattern else []
    return _all(rows, tests + _paths(file_path, file_pattern))


def query_files(entries: DataFrame, file_path=None, pattern=None, has_level=None, after=None, before=None, status=None, time="processed_at") -> DataFrame:
    """Entries that meet all given predicates; after and before are inclusive."""
    tests = _paths(file_path, pattern)
    tests += [F.map_contains_key("level_data", has_level)] if has_level else []
    tests += [F.col(time) >= F.lit(after)] if after is not None else []
    tests += [F.col(time) <= F.lit(before)] if before is not None else []
    tests += [F.col("status") == status] if status else []
    return _all(entries, tests)


def _paths(file_path, pattern) -> list[Column]:
    return ([F.col("file_path") == file_path] if file_path else []) + ([_glob(F.col("file_path"), pattern)] if pattern else [])


def _all(df: DataFrame, tests: list[Column]) -> DataFrame:
    for t in tests:
        df = df.filter(t)
    return df


def domain_error(content: Column) -> Column:
    """Why a text is no document of domains, null if it is: blank, no JSON, no domains, a blank name or reasoning. Comments and trailing commas are errors."""
    d = F.from_json(content, DOMAIN_DOCUMENT)["domains"]
    return (
        F.when(_blank(content), "content is empty").when(~is_json(content), "content is no JSON").when(d.isNull() | (F.size(d) < 1), "no domains")
        .when(F.exists(d, lambda x: _blank(x["name"])), "a domain without a name").when(F.exists(d, lambda x: _blank(x["reasoning"])), "a domain without reasoning")
    )


def member_error(members: Column) -> Column:
    """Why members are incomplete, null if they are not."""
    kind = lambda m: F.lower(m["kind"])
    holed = lambda m: F.exists(F.coalesce(m["parameters"], F.array()), lambda p: _blank(p["name"]) | _blank(p["type"]))
    some = lambda test: F.coalesce(F.exists(members, test), F.lit(False))
    return (
        F.when(some(lambda m: _blank(m["kind"]) | _blank(m["name"])), "a member without kind or name")
        .when(some(lambda m: (kind(m) == "property") & (m["hasGetter"].isNull() | m["hasSetter"].isNull())), "a property without accessor flags")
        .when(some(lambda m: (kind(m) == "method") & m["returnType"].isNull()), "a method without return type")
        .when(some(lambda m: kind(m).isin("method", "constructor") & F.coalesce(holed(m), F.lit(False))), "a parameter without name or type")
    )


def ast_error(content: Column) -> Column:
    """Why a text is no AST document, null if it is."""
    d = parsed_ast(content)
    out = F.when(_blank(content), "content is empty").when(d.isNull() | canonical(content).isNull(), "content is no JSON")
    out = out.when(F.coalesce(d["type"], F.lit("")) != "CompilationUnit", "the root is no CompilationUnit").when(d["namespace"].isNull(), "namespace is null").when(d["usings"].isNull(), "usings is null")
    for a in AST_ARRAYS:
        out = out.when(d[a].isNull(), f"{a} is null")
    for a, tag in AST_ARRAYS.items():
        out = out.when(F.exists(d[a], lambda x: _blank(x["name"])), f"a {tag} without a name")
    return F.coalesce(out, *[member_error(F.flatten(F.transform(d[a], lambda x: F.coalesce(x["members"], F.array())))) for a in AST_ARRAYS])


def index(documents: DataFrame) -> DataFrame:
    """file_path, namespace, usings and a count for each array of documents (file_path, content); what does not parse counts 0."""
    d = F.col("d")
    counts = [F.coalesce(F.when(d[a].isNotNull(), F.size(d[a])), F.lit(0)).alias(f"n_{a}") for a in AST_ARRAYS]
    parsed = documents.select("file_path", parsed_ast(F.col("content")).alias("d"))
    return parsed.select("file_path", F.coalesce(d["namespace"], F.lit("")).alias("namespace"), F.coalesce(d["usings"], F.expr("cast(array() as array<string>)")).alias("usings"), *counts)


def query_index(indexed: DataFrame, filters: dict) -> DataFrame:
    """Rows of index() whose fields equal the filters' values; texts compare in any case, and a list of usings holds the value. An unknown field is an error."""

    def test(name, value):
        if name == "usings":
            return F.array_contains(name, value)
        return F.lower(name) == value.lower() if isinstance(value, str) else F.col(name) == F.lit(value)

    return _all(indexed, [test(n, v) for n, v in filters.items()])
