"""Operator 3, quality by importance resampling: documents drawn in proportion to target(text) / raw(text).

Both distributions are multinomial models of hashed n-grams (words and punctuation runs, one and two at a time, BUCKETS buckets):
raw from every n-gram of every document, target from documents labelled quality = 1. A document's log-weight is the sum of its
n-grams' log-ratios. Adding standard Gumbel noise, seeded by doc_id, and keeping the k largest keys is sampling k documents without
replacement with those weights. The k-th key is found by radix selection over counts, so nothing is ranked in one task.

Null and empty texts weigh 0. Ties at the k-th key are all kept. Repeated rows share their key; rows without doc_id draw their noise by their text.
Texts are weighed whole, whatever their length. Columns but doc_id and text are not read, whatever their names. The target is fitted on at most SAMPLE_ROWS
labelled rows, those with the least hash of doc_id; without any, all weights are 0 and the sample is uniform. Empty tables give no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks
from .common import Stored, text_or_empty

BUCKETS, SAMPLE_ROWS, SMOOTHING = 1 << 16, 50_000, 1.0
#: Share of the documents that the sample keeps, and the seed of its noise.
SHARE, SEED = 0.85, 20
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class Hashes(dict):
    """Hashes of tokens; forgets all beyond so many."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[token] = xxhash.xxh32_intdigest(token.encode("utf-8", "surrogatepass"))
        return h


def buckets(texts: list[str], hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of the texts, text by text, and how many each text has."""
    tokens: list[str] = []
    ends = []
    for text in texts:
        tokens += _TOKEN.findall(text)
        ends.append(len(tokens))
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    counts = np.diff([0, *ends])
    text_of = np.repeat(np.arange(len(texts)), counts)
    pair = np.flatnonzero(text_of[1:] == text_of[:-1])
    two = (h[pair] * np.uint64(0x9E3779B97F4A7C15) + h[pair + 1] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
    at = np.concatenate([h % BUCKETS, two % BUCKETS]).astype(np.int64)
    owner = np.concatenate([text_of, text_of[pair]])
    order = np.argsort(owner, kind="stable")
    return at[order], np.bincount(owner, minlength=len(texts))


def counts_of(texts: DataFrame) -> np.ndarray:
    """N-grams by bucket over all texts: each task sends a count for each bucket, whatever its input."""

    def run(batches):
        hashes, total = Hashes(), np.zeros(BUCKETS, np.int64)
        for batch in (part for whole in batches for part in chunks.slices(whole)):
            total += np.bincount(buckets(batch.column(1).to_pylist(), hashes)[0], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])
        del hashes
        chunks.give_back()

    rows = texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.float64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def log_ratios(df: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    known = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    rows = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()
    if not rows:
        return np.zeros(BUCKETS)
    chosen = df.sparkSession.createDataFrame([(r.doc_id,) for r in rows], "doc_id long")
    raw, target = counts_of(text_or_empty(df)), counts_of(text_or_empty(df).join(F.broadcast(chosen), "doc_id"))
    share = lambda n: np.log((n + SMOOTHING) / (n.sum() + SMOOTHING * BUCKETS))
    return share(target) - share(raw)


def weights(at: np.ndarray, n: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """The log-weight of each text: its own n-grams' ratios are summed in their order, so it depends on nothing beside it."""
    return np.bincount(np.repeat(np.arange(len(n)), n), ratios[at], len(n))


def resample(df: DataFrame, labels: DataFrame, stored: Stored, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, key (log_weight with its noise) and kept of every row."""
    ratios = df.sparkSession.sparkContext.broadcast(log_ratios(df, labels))

    def run(batches):
        hashes = Hashes()
        for batch in (part for whole in batches for part in chunks.slices(whole)):
            texts = batch.column(1).to_pylist()
            at, n = buckets(texts, hashes)
            weight = weights(at, n, ratios.value)
            u = np.array([xxhash.xxh64_intdigest(f" {t}" if d is None else str(d), seed) for d, t in zip(batch.column(0).to_pylist(), texts, strict=True)], np.float64)
            key = weight - np.log(-np.log((u + 0.5) / 2.0**64 * (1 - 2.0**-52)))
            bits = key.view(np.int64)
            rank = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)  # ordered as the keys are
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (weight, key, rank))], ["doc_id", "log_weight", "key", "rank"])
        del hashes
        chunks.give_back()

    keyed = stored.put(text_or_empty(df).mapInArrow(run, "doc_id long, log_weight double, key double, rank long"), "keys")
    least = kth_largest(keyed.select("rank"), round(share * keyed.count()))
    return keyed.select("doc_id", "log_weight", "key", (F.lit(least is not None) & (F.col("rank") >= F.lit(least if least is not None else 0))).alias("kept"))


def kth_largest(ranks: DataFrame, k: int) -> int | None:
    """The k-th largest of a column of longs: 16 bits at a time, by at most 65,536 counts."""
    if k < 1:
        return None
    column, low = F.col(ranks.columns[0]), -(1 << 63)
    for shift in (48, 32, 16, 0):
        inside = ranks.filter(column.between(low, low + (1 << (shift + 16)) - 1))
        digit = F.shiftright(column, shift) - F.lit(low >> shift)
        counts = {r.digit: r["count"] for r in inside.groupBy(digit.alias("digit")).count().collect()}
        for digit in sorted(counts, reverse=True):
            if k <= counts[digit]:
                low += digit << shift
                break
            k -= counts[digit]
    return low
