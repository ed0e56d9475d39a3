"""Operator 2, toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The features are densities of a lexicon learned from labels (in three tiers of log-odds), its nearness to the second person,
capitals, punctuation and obfuscation. The lexicon holds words that significantly more toxic than clean labelled texts have.
Features of a training row come from a lexicon that never saw the row's fold, as at scoring time. Trees are fitted on all folds but
one, calibration on that one. Everything is fitted on at most SAMPLE_ROWS labelled rows, those with the least hash of doc_id;
every row is scored, over its whole text, by text alone.

Null and empty texts are scored as texts without words. Labels that are null, or not 0 or 1, are not learned from; of repeated labels of a
document the highest counts. Without labels of both classes every score is the share of label 1 (0.0 where there are none).
Rows without doc_id are scored, are not held out, and have no label. Repeated rows give repeated results, equal texts equal scores. Texts are scored whole, whatever
their length. Empty tables give no rows. Other columns are not read, whatever their names; clean_rows() keeps them.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunks
from .common import text_or_empty

#: Bounds of the fit: labelled rows, words of the lexicon, folds.
SAMPLE_ROWS, LEXICON_WORDS, FOLDS = 30_000, 20_000, 5
#: A lexicon word's least z-score and texts; lower bounds of the tiers of its log-odds.
LEAST_Z, LEAST_TEXTS, TIERS = 3.0, 3, (1.0, 2.0, 3.5)
#: Words between a lexicon word and the second person.
NEAR = 4
TREES, DEPTH, RATE, BINS, LEAST_HESSIAN = 80, 3, 0.15, 32, 1.0
# fixed values: second-person words of the four languages
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split())
_WORD = re.compile(r"\w+")
_SPACED = re.compile(r"(?:\b[^\W\d_][ .\-]){3,}[^\W\d_]\b")
_MIXED = re.compile(r"[^\W\d_]+[0-9@$*!#]+[^\W\d_]+|" + _SPACED.pattern)
_STRETCHED = re.compile(r"([^\W\d_])\1{3,}")
_LEET = str.maketrans("013457@$!", "oieastasi")
_NAMES = ["lexicon1", "lexicon2", "lexicon3", "hits", "mass", "strongest", "near_you", "you", "leet_hits", "capitals", "capital_words", "exclaims", "questions", "punctuation", "mixed", "stretched", "length"]
FEATURES = len(_NAMES)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """The dense features of a text, in the order of _NAMES."""
    words = words_of(text)
    n = max(1, len(words))
    hits = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    odds = [v for _, v in hits]
    tiers = [sum(low <= v < high for v in odds) / n for low, high in zip(TIERS, (*TIERS[1:], math.inf), strict=True)]
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if you and hits:
        at = np.array([i for i, _ in hits])
        places = np.searchsorted(np.array(you), at)
        padded = np.array([-(10**9), *you, 10**9])
        near = int((np.minimum(at - padded[places], padded[places + 1] - at) <= NEAR).sum())
    size = max(1, len(text))
    bytes_ = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=128)
    # without a digit or symbol only the spaced branch can match, so both give the same
    mixed = (_MIXED if bytes_[_OBFUSCATING].any() else _SPACED).findall(text)
    leet = sum(w in lexicon for m in mixed for w in (re.sub(r"[^\w]", "", m.lower().translate(_LEET)),))
    return [
        *tiers,
        math.log1p(len(hits)),
        sum(odds) / n,
        max(odds, default=0.0),
        near / n,
        len(you) / n,
        leet / n,
        bytes_[65:91].sum() / size,
        sum(map(str.isupper, text.split())) / n,
        bytes_[33] / n,
        bytes_[63] / n,
        (bytes_[33:48].sum() + bytes_[58:65].sum()) / size,
        len(mixed) / n,
        len(_STRETCHED.findall(text)) / n,
        math.log1p(len(words)),
    ]


_OBFUSCATING = np.array([ord(c) for c in "0123456789@$*!#"])


def lexicon_of(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float, words: list[str]) -> dict[str, float]:
    """Log-odds of the words that significantly more toxic texts have, the most significant first."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    z = odds / np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    kept = np.flatnonzero((z >= LEAST_Z) & (toxic >= LEAST_TEXTS) & (odds >= TIERS[0]))
    kept = kept[np.argsort(-z[kept], kind="stable")][:LEXICON_WORDS]
    return {words[i]: float(odds[i]) for i in kept}


class Trees:
    """Second-order boosting of the logistic loss over binned features."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.trees, self.depth, self.rate = trees, depth, rate
        self.first, self.nodes = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
        # cuts lie above the share of zeros, too, which most densities have
        self.cuts = [np.unique(np.concatenate([np.quantile(c, quantiles), np.quantile(c[c > 0], quantiles) if (c > 0).any() else []])) for c in x.T]
        binned = self._bin(x)
        width = max(len(c) for c in self.cuts) + 1
        share = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.first = math.log(share / (1 - share))
        margin = np.full(len(y), self.first)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            at = np.zeros(len(y), np.int64)
            tree = {}
            for level in range(self.depth):
                leaves = 1 << level
                best = [(1e-6, -1, 0)] * leaves
                for f in range(x.shape[1]):
                    slot = at * width + binned[:, f]
                    gs = np.bincount(slot, g, leaves * width).reshape(leaves, width).cumsum(1)
                    hs = np.bincount(slot, h, leaves * width).reshape(leaves, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < LEAST_HESSIAN) | (ht - hs < LEAST_HESSIAN)] = 0
                    for leaf, cut in enumerate(gain.argmax(1)):
                        if gain[leaf, cut] > best[leaf][0]:
                            best[leaf] = (float(gain[leaf, cut]), f, int(cut))
                split = np.array([[f, c] for _, f, c in best])
                tree[level] = split
                at = self._step(at, binned, split)
            leaves = 1 << self.depth
            value = -self.rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + 1)
            self.nodes.append(([tree[k] for k in range(self.depth)], value))
            margin += value[at]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)], 1)

    @staticmethod
    def _step(at: np.ndarray, binned: np.ndarray, split: np.ndarray) -> np.ndarray:
        f, cut = split[at, 0], split[at, 1]
        return 2 * at + ((f >= 0) & (binned[np.arange(len(at)), f] > cut))

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned, out = self._bin(x), np.full(len(x), self.first)
        for levels, value in self.nodes:
            at = np.zeros(len(x), np.int64)
            for split in levels:
                at = self._step(at, binned, split)
            out += value[at]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit (pooled adjacent violators), one per pool."""
    pools: list[list[float]] = []
    order = np.argsort(score, kind="stable")
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        pools.append([v, 1.0, s])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            (v1, n1, s1), (v2, n2, s2) = pools[-2:]
            n = n1 + n2
            pools[-2:] = [[(v1 * n1 + v2 * n2) / n, n, (s1 * n1 + s2 * n2) / n]]
    return np.array([p[2] for p in pools]), np.array([p[0] for p in pools])


class Model:
    """Lexicon, trees and calibration; share is the score where there is nothing to learn."""

    def __init__(self, lexicon: dict[str, float], trees: Trees | None, knots: tuple[np.ndarray, np.ndarray] | None, share: float):
        self.lexicon, self.trees, self.knots, self.share = lexicon, trees, knots, share

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        margin = self.trees.margin(np.array([features(t, self.lexicon) for t in texts]).reshape(len(texts), FEATURES))
        # a thousandth of the trees' own probability keeps the order within a pool
        return 0.999 * np.interp(margin, *self.knots) + 0.001 / (1 + np.exp(-margin))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from labels of rows that are not held out."""
    spark = df.sparkSession
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # at most sample_rows rows of two numbers come to the driver, and go out again
    rows = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()
    chosen = spark.createDataFrame([(r.doc_id, r.toxic) for r in rows], "doc_id long, toxic int")
    sample = text_or_empty(df).join(F.broadcast(chosen), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FOLDS)).cast("int")).select("text", "toxic", "fold")
    sizes = np.zeros((FOLDS, 2))
    for r in sample.groupBy("fold", "toxic").count().collect():
        sizes[r.fold, r.toxic] = r["count"]
    share = float(sizes[:, 1].sum() / max(1.0, sizes.sum()))
    if not sizes.sum(0).all():
        return Model({}, None, None, share)

    def count(batches):
        counts: dict[tuple[str, int, int], int] = {}

        def out():
            columns = [[k[0] for k in counts], [k[1] for k in counts], [k[2] for k in counts], list(counts.values())]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "fold", "toxic", "n"])

        for batch in (part for whole in batches for part in chunks.slices(whole, 0)):
            for text, toxic, fold in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for word in {*words_of(text)}:
                    key = (word, fold, toxic)
                    counts[key] = counts.get(key, 0) + 1
            if len(counts) > 300_000:
                yield out()
                counts = {}
        yield out()
        del counts
        chunks.give_back()

    columns = [F.coalesce(F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n"))), F.lit(0)).alias(f"n{f}_{t}") for f in range(FOLDS) for t in (0, 1)]
    counted = sample.mapInArrow(count, "word string, fold int, toxic int, n long").groupBy("word").agg(*columns)
    toxic, clean = (sum((F.col(f"n{f}_{t}") for f in range(FOLDS)), F.lit(0)) for t in (1, 0))
    # a word that is no more common in toxic texts can be in no lexicon
    ratio = float(sizes[:, 1].sum() / sizes[:, 0].sum())
    likely = counted.filter((toxic >= LEAST_TEXTS) & (toxic > clean * ratio * 1.5)).orderBy((toxic / (clean + 1)).desc(), "word").limit(2 * LEXICON_WORDS).toArrow()
    words = likely.column("word").to_pylist()
    n = np.array([[likely.column(f"n{f}_{t}").to_numpy() for t in (0, 1)] for f in range(FOLDS)], np.float64).reshape(FOLDS, 2, len(words))

    def lexicon(without: int | None) -> dict[str, float]:
        folds = [f for f in range(FOLDS) if f != without]
        c, s = n[folds].sum(0), sizes[folds].sum(0)
        return lexicon_of(c[1], c[0], s[1], s[0], words)

    parts = spark.sparkContext.broadcast([lexicon(f) for f in range(FOLDS)])

    def measure(batches):
        for batch in (part for whole in batches for part in chunks.slices(whole, 0)):
            rows = [features(t, parts.value[f]) for t, f in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "toxic", "fold"])
        chunks.give_back()

    table = sample.mapInArrow(measure, "x array<double>, toxic int, fold int").toArrow()
    parts.destroy()
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
    y, fold = (table.column(c).to_numpy() for c in ("toxic", "fold"))
    order = np.lexsort((*x.T, y, fold))
    x, y, fold = x[order], y[order].astype(np.float64), fold[order]
    rest = fold != 0
    if not (0 < y[rest].sum() < rest.sum() and 0 < y[~rest].sum() < (~rest).sum()):
        rest = np.ones(len(y), bool)
    trees = Trees().fit(x[rest], y[rest])
    on = ~rest if not rest.all() else rest
    return Model(lexicon(None), trees, isotonic(trees.margin(x[on]), y[on]), share)


def score(df: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in (part for whole in batches for part in chunks.slices(whole)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])
        chunks.give_back()

    return text_or_empty(df).mapInArrow(run, "doc_id long, score double")


def clean_rows(df: DataFrame, model: Model, most: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score below most."""
    shared, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index("text")

    def run(batches):
        for batch in (part for whole in batches for part in chunks.slices(whole, at)):
            scores = shared.value.score(["" if t is None else t for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(scores < most))
        chunks.give_back()

    return df.mapInArrow(run, df.schema)
