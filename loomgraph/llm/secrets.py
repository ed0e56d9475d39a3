"""Operator 10, secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

Base spans come from three patterns (assignments, access keys, long hexadecimal runs). Besides, every maximal run of
20 or more characters of base64's alphabets is a candidate: its encoding is inferred (hex, base32, base64; runs that are
one plain word or number are none), and three tests ask whether its symbols could be uniform draws: chi-squared over
cells of the alphabet, Wald-Wolfowitz runs about the alphabet's middle, and lag-one serial correlation. Fisher's rule combines the
three p-values into one.

True secrets have uniform p-values and text has tiny ones. So in each class of encoding and length the share above one half
tells how many secrets there are; the least threshold is taken above which the excess over them, which is text, is at most
FDR of all. Counts by class and hundredth of p are summed over all documents. Only DataFrame operations are used.

Null texts count as empty: no spans. Repeated rows give repeated results. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, text_or_empty

#: Kinds in the order of the contract; random is the method's own.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
PLAIN = r"^([A-Z]?[a-z]+|[A-Z]+|[0-9]+|[=_+/-]+)$"
#: Share of false discoveries to allow, bins of p.
FDR, BINS = 0.05, 100


def _spans(pattern: str, more: str = "", text: str = "text") -> str:
    """SQL for array<struct<start, end, found>> of all matches: lengths of what lies between matches give places."""
    quoted = pattern.replace("'", "\\u0027")
    p = "r'" + quoted + "'"
    pieces, found = f"split({text}, {p}, -1)", f"regexp_extract_all({text}, {p}, 0)"
    group = f"regexp_extract_all({text}, {p}, {more})" if more else found
    zipped = f"arrays_zip(transform({pieces}, x -> length(x)), transform({found}, x -> length(x)), {group})"
    step = "(a, x) -> named_struct('at', a.at + x.`0` + coalesce(x.`1`, 0), 'out', case when x.`1` is null then a.out else array_append(a.out, named_struct('start', a.at + x.`0`, 'end', a.at + x.`0` + x.`1`, 'found', x.`2`)) end)"
    start = "named_struct('at', 0, 'out', cast(array() as array<struct<start: int, end: int, found: string>>))"
    none = "cast(array() as array<struct<start: int, end: int, found: string>>)"
    return f"case when {text} rlike {p} then aggregate({zipped}, {start}, {step}, a -> a.out) else {none} end"


def _tail(z: str) -> str:
    """The upper tail of the normal distribution, by a logistic in z and its cube (error below 0.0002)."""
    return f"1 / (1 + exp(least(700, greatest(-700, 1.5976D * ({z}) + 0.07056D * pow({z}, 3)))))"


def battery(tokens: DataFrame) -> DataFrame:
    """For a column found (a candidate): encoding, n symbols, klass of length, p_chi, p_runs, p_serial, p (double)."""
    body = "regexp_replace(found, '=+$', '')"
    out = tokens.withColumn(
        "encoding",
        F.expr(f"case when found rlike r'{PLAIN}' then 'plain' when found rlike '^([0-9a-f]+|[0-9A-F]+)$' then 'hex' when found rlike '^[A-Z2-7]+=*$' then 'base32' else 'base64' end"),
    )
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    out = out.withColumn("size", F.expr("case encoding when 'hex' then 16 when 'base32' then 32 else 64 end"))
    alphabet = f"case encoding when 'hex' then '0123456789abcdef' when 'base32' then '{upper}234567' else '{upper}{lower}0123456789+/' end"
    symbols = f"case encoding when 'hex' then lower({body}) when 'base32' then {body} else translate({body}, '-_', '+/') end"
    out = out.withColumn("v", F.expr(f"case when encoding <> 'plain' then transform(filter(split({symbols}, ''), c -> c not in ('', '=')), c -> locate(c, {alphabet}) - 1) end"))
    out = out.withColumn("n", F.expr("size(v)")).withColumn("cells", F.expr("least(16, greatest(2, n div 5))"))
    # runs too short to tell anything are left out, as are those with symbols of no alphabet
    out = out.filter("n >= 16 and array_min(v) >= 0")
    moments = F.expr(
        """aggregate(arrays_zip(v, slice(v, 2, greatest(n - 1, 0))), named_struct('s', 0L, 'q', 0L, 'x', 0L, 'hi', 0L, 'turns', 0L),
        (a, x) -> named_struct('s', a.s + x.v, 'q', a.q + x.v * x.v, 'x', a.x + coalesce(x.v * x.`1`, 0), 'hi', a.hi + int(2 * x.v >= size),
          'turns', a.turns + coalesce(int((2 * x.v >= size) <> (2 * x.`1` >= size)), 0)))"""
    )
    out = out.withColumns(
        {
            "chi": F.expr("aggregate(transform(sequence(0, cells - 1), k -> size(filter(v, x -> x * cells div size = k))), 0D, (a, c) -> a + c * c) * cells / n - n"),
            "m": moments,
        }
    )
    df_ = "(cells - 1)"
    z_chi = f"(pow(chi / {df_}, 1 / 3D) - (1 - 2 / (9D * {df_}))) / sqrt(2 / (9D * {df_}))"
    mean = "(2D * m.hi * (n - m.hi) / n + 1)"
    z_runs = f"abs(m.turns + 1 - {mean}) / sqrt(greatest(1e-9, ({mean} - 1) * ({mean} - 2) / (n - 1)))"
    # the correlation of neighbours times the root of their number
    z_serial = "abs((m.x - (n - 1D) * pow(m.s / n, 2)) / greatest(1e-9, m.q - m.s * m.s / double(n))) * sqrt(n)"
    out = out.withColumns({"p_chi": F.expr(_tail(z_chi)), "p_runs": F.expr(f"least(1, 2 * {_tail(z_runs)})"), "p_serial": F.expr(f"least(1, 2 * {_tail(z_serial)})")})
    f = "(-2 * (ln(greatest(1e-300, p_chi)) + ln(greatest(1e-300, p_runs)) + ln(greatest(1e-300, p_serial))))"
    half = f"({f} / 2)"
    return out.withColumn("p", F.expr(f"exp(-{half}) * (1 + {half} + {half} * {half} / 2)")).withColumn("klass", F.expr("case when n < 28 then 0 when n < 40 then 1 when n < 64 then 2 else 3 end")).drop("size", "cells", "v", "chi", "m")


def thresholds(tested: DataFrame, fdr: float = FDR) -> dict[tuple[str, int], float]:
    """The least p of a secret by encoding and length class; at most 12 classes of BINS counts come to the driver."""
    rows = tested.groupBy("encoding", "klass", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).count().collect()
    bins: dict[tuple[str, int], list[int]] = {}
    for r in rows:
        bins.setdefault((r.encoding, r.klass), [0] * BINS)[r.bin] += r["count"]
    found = {}
    for key, counts in bins.items():
        secrets = sum(counts[BINS // 2 :]) * 2
        above = 0
        for b in reversed(range(BINS)):
            above += counts[b]
            if b and above and max(0.0, above - secrets * (1 - b / BINS)) / above <= fdr:
                found[key] = b / BINS
    return found


def scan(df: DataFrame, stored: Stored, fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (long) and spans: array<struct<start, rank, kind, end>> by start, then kind as listed."""
    base = text_or_empty(df).select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.expr(f"filter({_spans(ASSIGN, '2')}, x -> length(x.found) >= 8)").alias("assign"),
        F.expr(_spans(ACCESS)).alias("access"),
        F.expr(_spans(HEX)).alias("hex"),
        F.expr(f"filter({_spans(RUN)}, x -> not x.found rlike r'{PLAIN}')").alias("runs"),
    )
    base = stored.put(base, "base-spans")
    runs = base.filter("size(runs) > 0").select("row", F.explode("runs").alias("run")).select("row", "run.*")
    tested = stored.put(battery(runs.select("found").distinct()), "tested-runs")
    least = thresholds(tested, fdr)
    passed = " or ".join(f"(encoding = '{e}' and klass = {k} and p >= {t})" for (e, k), t in sorted(least.items())) or "false"
    hits = runs.join(tested.filter(passed).select("found"), "found").groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("random"))
    spans = "concat(" + ", ".join(f"transform({kind}, x -> struct(x.start as start, {rank} as rank, '{kind}' as kind, x.end as end))" for rank, kind in enumerate(KINDS)) + ")"
    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")
    out = base.join(hits, "row", "left").withColumn("random", F.coalesce("random", none))
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]
    return out.select("doc_id", *counts, F.expr(f"array_sort({spans})").alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")
