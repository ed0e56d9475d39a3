"""Operator 6, quality rules: a ledger of failure bits and measurements, evaluated once, judged by versioned policies.

ledger() measures every whole text and sets one bit for each rule that it fails, in one expression of each row, and is stored. A policy is
a version and a mask of the rules that it enforces: judge() applies one to a ledger, and ablations() tells from counts of bit
patterns alone what each rule of a policy costs. Only DataFrame operations are used, within each row: nothing is shuffled but the counts.

Null and empty texts have no words, so they fail too_few_words. Rows without doc_id are measured like any other, repeated rows each; empty
tables give no rows. Texts are measured whole, whatever their length: a task holds one text's words at a time. A share equal to a rule's bound passes. Other columns are
kept by accepted() as they are, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Stored, text_or_empty

#: Bit by bit: the rule's name and when a text fails it. Bits are never renumbered.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 4 * n_lines"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 12 * n_words)"),
    ("capitals", "2 * n_capitals > word_chars"),
    ("exclamations", "10 * n_exclamations > 3 * n_words"),
]
#: Masks by version: 1 has the base rules alone.
POLICIES: dict[int, int] = {1: 0b0000011, 2: 0b1111111}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_exclamations"]


def _count(characters: str) -> str:
    return f"cast(length(regexp_replace(text, r'[^{characters}]+', '')) as long)"


def _let(name: str, value: str, body: str) -> str:
    """SQL for body with a name for value, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeated(words: str) -> str:
    """SQL for the number of words in windows of three that occur twice or more: windows are sorted with their places, equal ones are then neighbours."""
    zipped = f"arrays_zip(slice({words}, 1, size({words}) - 2), slice({words}, 2, size({words}) - 2), slice({words}, 3, size({words}) - 2), sequence(0, size({words}) - 3))"
    same = " and ".join(f"x.`0`.`{i}` = x.`1`.`{i}`" for i in range(3))
    covered = ", ".join(f"x.`{side}`.`3` + {k}" for side in (0, 1) for k in range(3))
    twice = f"filter(arrays_zip(slice(g, 1, size(g) - 1), slice(g, 2, size(g) - 1)), x -> {same})"
    counted = _let("g", f"sort_array({zipped})", f"cast(size(array_distinct(flatten(transform({twice}, x -> array({covered}))))) as long)")
    return f"case when size({words}) > 3 then {counted} else 0L end"


def _measured() -> Column:
    """One struct of all measurements of a column text and of failed, from one pass over the words and one over the lines."""
    values = {
        "n_words": "cast(size(w) as long)",
        "word_chars": "cast(length(array_join(w, '')) as long)",
        "n_symbols": _count("#*$%&|<>"),
        "n_lines": "cast(size(l) as long)",
        "n_dup_lines": "cast(size(l) - size(array_distinct(l)) as long)",
        "n_repeat_words": _repeated("w"),
        "n_capitals": _count("A-ZÀ-ÖØ-Þ"),
        "n_exclamations": _count("!"),
    }
    struct = "named_struct(" + ", ".join(f"'{name}', {values[name]}" for name in MEASURES) + ")"
    measures = _let("w", f"array_remove(split(text, r'[{SPACES}]+'), '')", _let("l", f"filter(split(text, '\\n'), x -> x rlike r'[^{SPACES}]')", struct))
    bits = " + ".join(f"case when {re.sub('(?<![a-z_])(' + '|'.join(MEASURES) + ')(?![a-z_])', r'm.\1', test)} then {1 << i} else 0 end" for i, (_, test) in enumerate(RULES))
    return F.expr(_let("m", measures, "named_struct(" + ", ".join(f"'{name}', m.{name}" for name in MEASURES) + f", 'failed', cast({bits} as long))"))


def ledger(df: DataFrame, stored: Stored | None = None) -> DataFrame:
    """doc_id, the measurements (long) and failed (long): bit i for rule i. With stored, written once and read again."""
    book = text_or_empty(df).select("doc_id", _measured().alias("_book")).select("doc_id", "_book.*")
    return stored.put(book, "ledger") if stored else book


def judge(book: DataFrame, version: int = max(POLICIES)) -> DataFrame:
    """Adds policy (the version), base_failed and kept under a policy."""
    base, mask = POLICIES[1], POLICIES[version]
    return book.withColumns({"policy": F.lit(version), "base_failed": F.col("failed").bitwiseAND(F.lit(base)) != 0, "kept": F.col("failed").bitwiseAND(F.lit(base | mask)) == 0})


def accepted(df: DataFrame, stored: Stored, version: int = max(POLICIES)) -> DataFrame:
    """The rows that a policy keeps, with all their columns as they were. The ledger is stored beside the rows, so no join finds them again."""
    whole = df.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    book = stored.put(whole.select("_row", _measured().alias("_book")).select("_row", "_book.failed"), "ledger")
    return judge(book, version).filter("kept").select("_row.*")


def ablations(book: DataFrame, version: int = max(POLICIES)) -> DataFrame:
    """For each rule of a policy: rows failing it, rows failing it alone, and rows kept if it were dropped.

    Rows are first counted by bit pattern, of which there are 2^7 at most.
    """
    mask = POLICIES[version]
    patterns = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(i).alias("bit"), F.lit(name).alias("rule")) for i, (name, _) in enumerate(RULES) if mask >> i & 1]))
    each = patterns.select("bits", "n", rules.alias("r")).withColumn("one", F.expr("shiftleft(1L, r.bit)"))
    counted = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    without = F.col("bits").bitwiseAND(F.bitwise_not("one"))
    return each.groupBy(F.col("r.bit").alias("bit"), F.col("r.rule").alias("rule")).agg(
        counted(F.col("bits").bitwiseAND(F.col("one")) != 0).alias("n_failed"),
        counted(F.col("bits") == F.col("one")).alias("n_failed_alone"),
        counted(without == 0).alias("n_kept_without"),
    )


#: DuckDB SQL for the ledger of a table documents under policy 2.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT row_id, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] AS gram
      FROM (SELECT row_id, words, unnest(generate_series(1, len(words) - 2)) AS p FROM d)),
r AS (SELECT row_id, p FROM (SELECT row_id, p, count(*) OVER (PARTITION BY row_id, gram) AS c FROM g) WHERE c > 1),
n AS (SELECT row_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT row_id, unnest([p, p + 1, p + 2]) AS q FROM r) GROUP BY row_id),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(lines) AS BIGINT) AS n_lines,
    length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS n_capitals,
    length(regexp_replace(text, '[^!]+', '', 'g')) AS n_exclamations
  FROM d LEFT JOIN n USING (row_id)),
b AS (SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 10 * n_dup_lines > 4 * n_lines THEN 8 ELSE 0 END + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words) THEN 16 ELSE 0 END
    + CASE WHEN 2 * n_capitals > word_chars THEN 32 ELSE 0 END + CASE WHEN 10 * n_exclamations > 3 * n_words THEN 64 ELSE 0 END AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed, 2 AS policy, failed & 3 <> 0 AS base_failed, failed = 0 AS kept
FROM b
"""
#: DuckDB SQL for the ablations of policy 2.
ABLATIONS_SQL = f"""
WITH book AS ({SQL}), rules(bit, rule) AS (VALUES (0, 'too_few_words'), (1, 'repeated_windows'), (2, 'symbols'), (3, 'duplicate_lines'), (4, 'word_length'), (5, 'capitals'), (6, 'exclamations'))
SELECT bit, rule, count(*) FILTER (WHERE failed >> bit & 1 = 1) AS n_failed, count(*) FILTER (WHERE failed = 1 << bit) AS n_failed_alone,
  count(*) FILTER (WHERE failed & ~(1 << bit) = 0) AS n_kept_without
FROM rules, book GROUP BY bit, rule
"""
