"""Operator 4, personal data: fixed patterns, and terms that the corpus shows to reveal protected entities.

Base spans (email, ip, card, phone) come from patterns over whole texts. Each distinct value is a protected entity. Terms (runs of
three or more letters, in lower case) within WINDOW words of an entity co-occur with it. Over all documents, a term discloses
an entity by P(entity | term) = occurrences beside it / all occurrences, and log2 of that over P(entity) bits of information.
Terms seen beside an entity in SUPPORT different contexts, with BITS of information at least, are generalised from P >= GENERALISE on
and removed from P >= REMOVE on, wherever they stand. Copies of one passage are one context, so boilerplate alone is no evidence.

Null texts count as empty: no spans. Repeated rows, and rows without doc_id, give each their results. Texts are searched whole, whatever their length. A term that
reaches both thresholds is removed. An empty table gives no rows. Only doc_id and text are read; sanitise() keeps other columns whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunks
from .common import Stored

KINDS = ["email", "ip", "card", "phone", "general", "remove"]
PLACEHOLDERS = ["<EMAIL>", "<IP>", "<CARD>", "<PHONE>", "<TERM>", ""]
WINDOW, SUPPORT, BITS, GENERALISE, REMOVE = 8, 3, 5.0, 0.5, 0.9
#: Bits of the filter through which terms are looked up: 1 MB, whatever the number of terms; what passes it is joined exactly.
FILTER_BITS, FILTER_HASHES = 1 << 23, 4

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that fails fails from each of its digits, so only its first is tried
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def find(text: str) -> list[tuple[int, int, int]]:
    """Base spans as (kind, start, end), by kind, then start."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append((0, start, done))
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.groups()]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, str, int]]:
    """(entity, term, context) for the terms beside each span; entities and contexts by their hashes."""
    if not spans:
        return []
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts = np.array([a for a, _ in words])
    ends = np.array([b for _, b in words])
    out = []
    for kind, a, b in spans:
        first, last = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        value = text[a:b].lower() if kind < 2 else _digits(text[a:b])
        around = [text[x:y] for x, y in words[max(0, first - WINDOW) : first] + words[last : last + WINDOW]]
        context = _hash(" ".join(around)) - (1 << 63)
        entity = _hash(f"{kind}:{value}") - (1 << 63)
        out += [(entity, t.lower(), context) for w in around if "@" not in w for t in _TERM.findall(w)]
    return out


def _key() -> Column:
    """128 bits: rows that agree in it are taken to agree in doc_id and text, so they share their results."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))


def _texts(df: DataFrame) -> DataFrame:
    return df.select(_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")


def _base(df: DataFrame) -> DataFrame:
    kinds = pa.struct([("rank", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    beside = pa.struct([("entity", pa.int64()), ("term", pa.string()), ("context", pa.int64())])

    def run(batches):
        for batch in (part for whole in batches for part in chunks.slices(whole)):
            texts = batch.column(1).to_pylist()
            spans = [find(t) for t in texts]
            near = [[dict(zip(("entity", "term", "context"), c, strict=True)) for c in contexts(t, s)] for t, s in zip(texts, spans, strict=True)]
            found = [[dict(zip(("rank", "start", "end"), s, strict=True)) for s in one] for one in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(kinds)), pa.array(near, pa.list_(beside))], ["key", "doc_id", "base", "near"])
        chunks.give_back()

    return _texts(df).mapInArrow(run, "key string, doc_id long, base array<struct<rank: int, start: int, end: int>>, near array<struct<entity: long, term: string, context: long>>")


def term_filter(terms: DataFrame) -> bytes:
    """A Bloom filter of a column term: FILTER_BITS bits, at most FILTER_BITS / 64 rows to the driver."""
    h = F.xxhash64("term")
    places = F.array(*[F.pmod(F.xxhash64(h, F.lit(i)), F.lit(FILTER_BITS)) for i in range(FILTER_HASHES)])
    rows = terms.select(F.explode(places).alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.tobytes()


class TermFilter(dict):
    """Whether a term may be among those of a filter; remembers what it was asked."""

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, np.int64)

    def __missing__(self, term: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        h = _hash(term).to_bytes(8, "little")
        seen = True
        for i in range(FILTER_HASHES):
            # Spark hashes its columns in turn, each with the hash so far as seed
            seed = xxhash.xxh64_intdigest(h, 42)
            at = xxhash_int(i, seed)
            at = (at - (1 << 64) if at >> 63 else at) % FILTER_BITS
            if not int(self.bits[at // 64]) >> (at % 64) & 1:
                seen = False
                break
        self[term] = seen
        return seen


def xxhash_int(value: int, seed: int) -> int:
    return xxhash.xxh64_intdigest(value.to_bytes(4, "little"), seed)


def _counts(df: DataFrame, bits) -> DataFrame:
    """How often terms that pass a filter occur in all texts: one row for a term and task."""

    def run(batches):
        known, counts = TermFilter(bits.value), Counter()
        for batch in (part for whole in batches for part in chunks.slices(whole)):
            counts.update(_TERM.findall("\n".join(batch.column(1).to_pylist()).lower()))
            if len(counts) > 500_000:
                yield rows(known, counts)
                counts.clear()
        yield rows(known, counts)
        del known, counts
        chunks.give_back()

    def rows(known, counts):
        kept = [(t, n) for t, n in counts.items() if known[t]]
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["term", "n"])

    return _texts(df).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def _hits(df: DataFrame, bits) -> DataFrame:
    """Where terms that pass a filter stand: key, term, start, end."""

    def run(batches):
        known = TermFilter(bits.value)
        for batch in (part for whole in batches for part in chunks.slices(whole)):
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if any(known[t] for t in {*_TERM.findall(text.lower())}):
                    out += [(key, t, m.start(), m.end()) for m in _TERM.finditer(text) if known[t := m[0].lower()]]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["key", "term", "start", "end"])
        del known
        chunks.give_back()

    return _texts(df).mapInArrow(run, "key string, term string, start int, end int")


def disclosing(base: DataFrame, df: DataFrame, stored: Stored) -> DataFrame:
    """term, p, bits, rank (its place in KINDS): the terms that exceed the thresholds."""
    spark = df.sparkSession
    near = base.filter("size(near) > 0").select(F.explode("near").alias("x")).select("x.*")
    pairs = near.groupBy("entity", "term", "context").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.count("*").alias("contexts"), F.sum("n").alias("n_pair"))
    pairs = stored.put(pairs.filter(F.col("contexts") >= SUPPORT), "pairs")
    bits = spark.sparkContext.broadcast(term_filter(pairs.select("term").distinct()))
    counts = _counts(df, bits)
    total = base.agg(F.coalesce(F.sum(F.size("base")), F.lit(0)).alias("n")).first().n
    each = base.filter("size(base) > 0").select(F.explode(F.array_distinct("near.entity")).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    p = F.least(F.lit(1.0), F.col("n_pair") / F.col("n_term"))
    known = pairs.join(counts, "term").join(each, "entity").withColumn("p", p).withColumn("bits", F.log2(F.col("p") * F.lit(float(max(1, total))) / F.col("n_entity")))
    known = known.filter((F.col("p") >= GENERALISE) & (F.col("bits") >= BITS)).groupBy("term").agg(F.max("p").alias("p"), F.max("bits").alias("bits"))
    return stored.put(known.withColumn("rank", F.when(F.col("p") >= REMOVE, 5).otherwise(4)), "disclosing")


def scan(df: DataFrame, stored: Stored) -> DataFrame:
    """key, doc_id, base and spans: arrays of struct<rank, start, end> by kind, then start; a rank is a place in KINDS."""
    base = stored.put(_base(df), "base")
    terms = disclosing(base, df, stored)
    bits = df.sparkSession.sparkContext.broadcast(term_filter(terms))
    hits = _hits(df, bits).join(terms.select("term", "rank"), "term").select("key", F.struct("rank", "start", "end").alias("span"))
    more = hits.groupBy("key").agg(F.collect_set("span").alias("more"))
    out = base.select("key", "doc_id", "base").join(more, "key", "left")
    return out.withColumn("spans", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))).drop("more")


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat(element_at({names}, x.rank + 1), ':', x.start, ':', x.end)), ',')")


def replace(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with a placeholder for each span; of spans that overlap, the first names what they cover together."""
    out, at = [], 0
    for start, end, rank in sorted((s, e, r) for r, s, e in spans):
        if start >= at:
            out += [text[at:start], PLACEHOLDERS[rank]]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(df: DataFrame, stored: Stored) -> DataFrame:
    """The table with personal data and disclosing terms replaced in text; nulls stay."""
    spans = scan(df, stored).filter("size(spans) > 0").dropDuplicates(["key"]).select("key", "spans")
    rows = df.select(_key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    joined = rows.join(spans, "key", "left")

    @F.pandas_udf("string")
    def clean(texts: pd.Series, found: pd.Series) -> pd.Series:
        return texts.combine(found, lambda t, s: t if t is None or s is None else replace(t, [(x["rank"], x["start"], x["end"]) for x in s]))

    text = F.when(F.col("spans").isNotNull(), clean(F.when(F.col("spans").isNotNull(), F.col("row.text")), "spans")).otherwise(F.col("row.text"))
    return joined.select(F.col("row").withField("text", text).alias("row")).select("row.*")
