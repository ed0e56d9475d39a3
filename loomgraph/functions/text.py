"""Scalar functions on text: keys, paths, extraction, formatting. All are column expressions."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: words that no tool may be called
KEYWORDS = (
    "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false "
    "finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private "
    "protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked "
    "unsafe ushort using virtual void volatile while"
).split()
MAX_OUTPUT = 20_000


def path_key(path: Column) -> Column:
    return F.sha2(path, 256)


def content_hash(text: Column) -> Column:
    """SHA-256 in base64."""
    return F.base64(F.unhex(F.sha2(text, 256)))


def request_key(request: Column, salt: str = "") -> Column:
    """64 hexadecimal digits of a request (a struct), by its JSON."""
    return F.sha2(F.concat(F.lit(salt), F.lit(":"), F.to_json(request)), 256)


def namespace_tail(x: Column) -> Column:
    return F.element_at(F.split(x, r"\."), -1)


def namespace_parent(x: Column) -> Column:
    parts = F.split(x, r"\.")
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ".")


def location(path: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s:%d-%d", path, start, end)


def signature(name: Column, parameters: Column, returns: Column) -> Column:
    """returns name(type name, …) of an array of structs with name and type."""
    return F.concat(returns, F.lit(" "), name, F.lit("("), F.array_join(F.transform(parameters, lambda p: F.concat(p["type"], F.lit(" "), p["name"])), ", "), F.lit(")"))


def normalise_markdown(text: Column) -> Column:
    unix = F.regexp_replace(text, "\r\n", "\n")
    return F.concat(F.regexp_replace(F.regexp_replace(unix, "\n{3,}", "\n\n"), r"^[ \n\t\r]+|[ \n\t\r]+$", ""), F.lit("\n"))


def safe_file_name(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, "[<>]", ""), " ", "_")


def strip_front_matter(text: Column) -> Column:
    """Parts between --- lines, trimmed, without the first two, one to a line."""
    parts = F.transform(F.split(text, "---"), lambda p: F.trim(p))
    return F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), "\n")


def extract_code(text: Column, opening: str = "<code>", closing: str = "</code>") -> Column:
    """Code between tags or, without any, in fenced python blocks; blocks joined by an empty line."""
    tagged = F.regexp_extract_all(text, F.lit(rf"(?s)\Q{opening}\E(.*?)\Q{closing}\E"), F.lit(1))
    fenced = F.regexp_extract_all(text, F.lit(r"(?s)```(?:python|py)\s*\n(.*?)```"), F.lit(1))
    return F.array_join(F.transform(F.when(F.size(tagged) > 0, tagged).otherwise(fenced), lambda x: F.trim(x)), "\n\n")


def truncate_middle(text: Column, most: int = MAX_OUTPUT) -> Column:
    half = most // 2
    cut = F.concat(F.left(text, F.lit(half)), F.lit(f"\n..._This content has been truncated to stay below {most} characters_...\n"), F.right(text, F.lit(half)))
    return F.when(F.length(text) > most, cut).otherwise(text)


def imports(code: Column) -> Column:
    """Distinct base modules of import lines."""
    found = F.regexp_extract_all(code, F.lit(r"(?m)^\s*(?:import|from)\s+([A-Za-z_][\w.]*)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.split_part(x, F.lit("."), F.lit(1))))


def forbidden_imports(code: Column, allowed: list[str]) -> Column:
    return F.array_except(imports(code), F.array(*map(F.lit, allowed)))


def final_answer(text: Column, marker: str = "FINAL_ANSWER:") -> Column:
    return F.when(F.contains(text, F.lit(marker)), F.trim(F.substring_index(text, marker, -1)))


def invocation(text: Column) -> Column:
    """name and arguments of a line `invoke name: arguments`."""
    pattern = r"(?im)^\s*invoke\s+(\w+)\s*:\s*(.*)$"
    name = F.regexp_extract(text, pattern, 1)
    return F.when(name != "", F.struct(name.alias("name"), F.trim(F.regexp_extract(text, pattern, 2)).alias("arguments")))


def default_argument(tool: Column) -> Column:
    return F.when(tool == "final_answer", "answer").when(tool == "search", "query").when(tool == "calculator", "expression").otherwise("input")


def call_id(text: Column) -> Column:
    """The id after `Call id:` or `tool_call_id:`, null without one."""
    found = F.regexp_extract(text, r"(?i)(?:Call id|tool_call_id):\s*([^\s,]+)", 1)
    return F.when(found != "", found)


def call_body(text: Column) -> Column:
    """What follows the line with a call's id."""
    return F.regexp_replace(text, r"(?i)^(?:Call id|tool_call_id):[^\n]*\n", "")


def populate(template: Column, values: dict[str, Column]) -> Column:
    for key, value in values.items():
        template = F.replace(template, F.lit("{{" + key + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def valid_tool_name(x: Column) -> Column:
    return x.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & ~F.lower(x).isin(*KEYWORDS)


def looks_like_state(x: Column) -> Column:
    """Whether a text may name a state variable: it has an underscore, or is camel case."""
    return F.contains(x, F.lit("_")) | ((F.length(x) > 1) & x.rlike("^[a-z]") & x.rlike("[A-Z]"))


def is_state_name(x: str) -> bool:
    """As looks_like_state, for one text."""
    return "_" in x or (len(x) > 1 and x[0].islower() and any(c.isupper() for c in x))


def supports_stop(model: Column) -> Column:
    """Whether a model takes a stop parameter: the o-series from o3 on, and gpt-5, do not."""
    return ~F.regexp_extract(model, r"([^/]+)$", 1).rlike(r"^(o3[-\d]*|o4[-\d]*|o3-mini[-\d]*|gpt-5.*)$")


def backoff(base: float, attempt: Column) -> Column:
    return F.lit(base) * F.pow(F.lit(2.0), attempt - 1)


def rate_interval(per_minute: Column) -> Column:
    return F.lit(60.0) / per_minute


def message_text(parts: Column, separator: str = "\n") -> Column:
    """The text parts of a content array of structs with type and text."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), separator)


def role_name(role: Column, overrides: dict[str, str] | None = None) -> Column:
    low = F.lower(role)
    if not overrides:
        return low
    from .literals import lookup

    return F.coalesce(lookup(overrides, low, None), low)


def log_tail(log: Column, most: int) -> Column:
    return F.right(log, F.lit(most))


def snippet(text: Column, start: Column, end: Column, around: int = 5) -> Column:
    """Lines start - around to end + around (from 1), within the text."""
    lines = F.split(text, "\n")
    first = F.greatest(F.lit(1), start - around)
    last = F.least(F.size(lines), end + around)
    return F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")


@F.pandas_udf(T.StringType())
def fixed2(x: pd.Series) -> pd.Series:
    """Two decimals of a double's exact value, halves away from zero, as the original's F2; format_string rounds its shortest decimal form."""
    wide = Context(prec=400)

    def one(v):
        d = Decimal(v)
        if d.is_finite():
            return str(d.quantize(Decimal("0.01"), ROUND_HALF_UP, wide))
        return "NaN" if d.is_nan() else "∞" if d > 0 else "-∞"

    bits, at = np.unique(x.to_numpy(np.float64).view(np.int64), return_inverse=True)  # few scores differ; bits tell minus zero from zero
    return pd.Series(np.array([one(v) for v in bits.view(np.float64).tolist()], dtype=object)[at], dtype=object)


def _f2(x: Column) -> Column:
    return F.when(x.isNotNull(), fixed2(x.cast("double")))


def edge_display(source: Column, member: Column, target: Column, kind: Column, strength: Column, composite: Column, profile: Column, place: Column) -> Column:
    """source.member -> target (kind) [Composite: …, Profile: …] at place; without a composite [Strength: …], without a place no `at`."""
    of = F.when(F.coalesce(member, F.lit("")) != "", F.concat(F.lit("."), member)).otherwise("")
    scored = F.concat(F.lit("[Composite: "), _f2(composite), F.lit(", Profile: "), profile, F.lit("]"))
    plain = F.concat(F.lit("[Strength: "), _f2(strength), F.lit("]"))
    at = F.coalesce(F.concat(F.lit(" at "), place), F.lit(""))
    return F.concat(source, of, F.lit(" -> "), target, F.lit(" ("), kind, F.lit(") "), F.when(composite.isNotNull(), scored).otherwise(plain), at)


def node_display(name: Column, project: Column, n_dependencies: Column, n_dependents: Column) -> Column:
    return F.format_string("%s (%s) - %d deps, %d dependents", name, project, n_dependencies, n_dependents)


def finding_display(kind: Column, severity: Column, description: Column, n_affected: Column) -> Column:
    return F.format_string("%s (%s): %s - %d dependencies affected", kind, severity, description, n_affected)


def strength_display(composite: Column, dimensions: dict[str, Column], profile: Column) -> Column:
    """Composite: … | Structural: … | … | Profile: …, for the dimensions in their order."""
    parts = [F.concat(F.lit(f"{k.capitalize()}: "), _f2(c)) for k, c in {"composite": composite, **dimensions}.items()]
    return F.concat_ws(" | ", *parts, F.concat(F.lit("Profile: "), profile))


def documentation(leading: Column) -> Column:
    """The first documentation comment of what stands before a declaration: a run of lines that begin with three slashes, or a block that begins with two stars.

    Without the slashes, or the block's marks, and the space about each line; null if there is none.
    """
    block = F.regexp_extract(F.regexp_replace(leading, r"\r\n?", "\n"), r"(?s)(?m)(^[ \t]*///(?!/)[^\n]*(?:\n[ \t]*///(?!/)[^\n]*)*|/\*\*(?![*/]).*?\*/)", 1)
    bare = F.regexp_replace(F.regexp_replace(block, r"^/\*\*|\*/$", ""), r"(?m)^[ \t]*(?:///|\*)?[ \t]*|[ \t]+$", "")
    return F.when(block != "", F.trim(F.regexp_replace(bare, r"^\n+|\n+$", "")))
