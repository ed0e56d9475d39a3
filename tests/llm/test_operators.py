"""Each operator on odd rows, on none, and against plain versions of its contract."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import components, near_vectors, packing, pieces, private_data, quality_rules, resampling, secrets, shingle_join, token_output, toxicity
from tests.compare import duck, plain

from .conftest import ROWS, make

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# 1


@pytest.mark.parametrize("group_docs", [3, 1000])
def test_packing(odd, group_docs):
    t = tokenizer(WORD)
    want = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids + [1])) for i, x, *_ in ROWS)
    rows = packing.pack_documents(odd, WORD, group_docs=group_docs).collect()
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for pieces_ in by_seq.values():
        at = 0
        for r in sorted(pieces_, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048 and {r.sequence_tokens for r in pieces_} == {at}
    for (doc, ids), times in want.items():
        got = Counter((r.start, r.length, r.ids_crc32) for r in by_doc[doc])
        assert sum(r.length for r in by_doc[doc]) == len(ids) * times == sum(n * k[1] for k, n in got.items())
        for start, length, crc in got:
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())


def test_first_fit_decreasing():
    lengths = [5, 7, 5, 2, 4, 2, 5, 1, 6]
    bins = packing.first_fit_decreasing(lengths, 10)
    want: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        for b in want:
            if sum(lengths[j] for j in b) + lengths[i] <= 10:
                b.append(i)
                break
        else:
            want.append([i])
    assert bins == want
    packed = packing.pack([3000, 1, 2048, 700, 1500, 5], 2048)
    assert sum(n for s in packed for _, _, n in s) == 7254
    assert sum(sum(p[2] for p in s) < 2048 for s in packed) <= 1


# 2


def _toxic_rows():
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        bad = " you clown, total trash!" if toxic and i % 12 else ""
        rows.append((i, f"calm words number {i % 17} here{bad} and more words", "en", 0))
        labels.append((i, int(bool(bad))))
    return rows, labels


def test_toxicity(spark, odd, empty):
    rows, labels = _toxic_rows()
    known = spark.createDataFrame([*labels, (0, None), (1, 7), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(make(spark, rows), known)
    assert "clown" in model.lexicon and "trash" in model.lexicon
    got = {r.doc_id: r.score for r in toxicity.score(make(spark, rows), model).collect()}
    truth = dict(labels)
    assert all((got[i] >= 0.5) == bool(truth[i]) for i in got)
    scored = toxicity.score(odd, model).collect()
    assert len(scored) == len(ROWS) and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score(empty, model).collect() == []
    assert toxicity.clean_rows(odd, model).columns == odd.columns
    assert {r.held for r in odd.select(toxicity.held_out().alias("held"), "doc_id").filter("doc_id is null").collect()} == {False}
    nothing = toxicity.fit(empty, known.limit(0))
    assert {r.score for r in toxicity.score(odd, nothing).collect()} == {0.0}


def test_spaced_letters_in_long_texts():
    at = [toxicity._NAMES.index(n) for n in ("mixed", "leet_hits")]
    for insult in ("i d i o t", "i.d.i.o.t", "i-d-i-o-t"):
        for filler in (10, 400):
            text = "calm words here " * filler + insult
            n = len(toxicity.words_of(text))
            assert [toxicity.features(text, {"idiot": 3.0})[i] * n for i in at] == pytest.approx([1, 1])
    assert len(text) > 2000
    # whatever a text's length and symbols, the features are those of the whole pattern
    import random

    rnd = random.Random(2)
    for letters in ("ab .-é", "ab .-1@"):
        for k in (60, 3000):
            text = "".join(rnd.choices(letters, k=k))
            n = max(1, len(toxicity.words_of(text)))
            assert toxicity.features(text, {})[at[0]] == len(toxicity._MIXED.findall(text)) / n


def test_isotonic():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert y.tolist() == [0.0, 0.5, 1.0] and (np.diff(x) > 0).all()


# 3


def test_resampling(spark, odd, empty, stored):
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0)], "doc_id long, quality int")
    rows = resampling.resample(odd, labels, stored, share=0.5).collect()
    keys = sorted((r.key for r in rows), reverse=True)
    k = round(0.5 * len(rows))
    assert all(r.kept == (r.key >= keys[k - 1]) for r in rows) and sum(r.kept for r in rows) >= k
    assert all(r.log_weight == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert resampling.resample(empty, labels, stored).collect() == []
    assert {r.log_weight for r in resampling.resample(odd, labels.limit(0), stored).collect()} == {0.0}


def test_resampling_by_hand(spark, stored):
    """Weights and keys from counts of n-grams kept in dicts; equal texts weigh the same wherever they stand."""
    import math
    import random

    import xxhash

    rnd = random.Random(4)
    docs = [(i, " ".join(rnd.choices(["good", "bad", "plain", "word", "and,", "so."], k=rnd.randrange(0, 30)))) for i in range(200)]
    docs += [(None, "no id"), (None, "no id"), (None, "nor this"), (500, docs[7][1])]
    labels = [(i, int("good" in t)) for i, t in docs[:150]]
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int"), stored).collect()
    h = lambda t: xxhash.xxh32_intdigest(t.encode())

    def grams(text):
        tokens = [h(t) for t in re.findall(r"\w+|[^\w\s]+", text)]
        pairs = [((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) % 2**64 >> 40) % resampling.BUCKETS for a, b in zip(tokens, tokens[1:])]
        return [t % resampling.BUCKETS for t in tokens] + pairs

    raw, target = Counter(), Counter()
    good = {i for i, q in labels if q}
    for i, t in docs:
        raw.update(grams(t))
        if i in good:
            target.update(grams(t))
    share = lambda c, g: math.log((c[g] + 1) / (sum(c.values()) + resampling.BUCKETS))
    want = Counter()
    for i, t in docs:
        weight = sum(share(target, g) - share(raw, g) for g in grams(t))
        u = xxhash.xxh64_intdigest(f" {t}" if i is None else str(i), resampling.SEED)
        want[i, round(weight, 6), round(weight - math.log(-math.log((u + 0.5) / 2**64)), 6)] += 1
    assert Counter((r.doc_id, round(r.log_weight, 6), round(r.key, 6)) for r in got) == want
    same = {r.log_weight for r in got if r.doc_id in (7, 500)}
    assert len(same) == 1


def test_kth_largest(spark):
    values = [5, -3, 5, 1 << 62, -(1 << 63), 0, (1 << 63) - 1, 7]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    assert [resampling.kth_largest(df, k) for k in range(1, 9)] == sorted(values, reverse=True)


# 4

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub(r"\D", "", m)) <= 19 and private_data._luhn(re.sub(r"\D", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
]


def base_spans(text):
    return [(k, m.start(), m.end()) for k, (_, p, ok) in enumerate(BASE) for m in re.finditer(p, text) if ok(m[0])]


def test_private_patterns():
    import random

    rnd = random.Random(1)
    texts = [t or "" for _, t, *_ in ROWS] + ["".join(rnd.choices("a@.1 2+-()é", k=40)) for _ in range(3000)] + ["".join(rnd.choices("1.25 ", k=60)) for _ in range(2000)]
    for t in texts:
        assert sorted(private_data.find(t)) == sorted(base_spans(t)), t


def test_private_data(odd, empty, stored, spark):
    rows = private_data.scan(odd, stored).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, *_ in ROWS)
    clean = {r.doc_id: r.text for r in private_data.sanitise(odd, stored).collect()}
    assert clean[6] == "Mail <EMAIL> or <PHONE>; host <IP>, card <CARD>." and clean[3] is None and clean[1] == ROWS[0][1]
    assert private_data.sanitise(odd, stored).columns == odd.columns
    named = odd.withColumn("_key", F.lit(1)).withColumn("_spans", F.lit("x")).withColumn("spans", F.lit("y")).withColumn("row", F.lit("z"))
    assert private_data.sanitise(named, stored).columns == named.columns
    assert {r.doc_id: r.text for r in private_data.sanitise(named, stored).collect()} == clean
    assert private_data.scan(empty, stored).collect() == [] and private_data.sanitise(empty, stored).collect() == []


def test_disclosing_terms(spark, stored):
    rows = [(i, f"note {'abcdefgh'[i]}x the agent Zorblatt wrote to z@mail.example.com on day {'klmnopqr'[i]}y", "en", 0) for i in range(8)]
    rows += [(100 + i, "the agent wrote on a day like any other", "en", 0) for i in range(40)] + [(200, "Zorblatt came", "en", 0)]
    rows += [(300 + i, f"write to user{i}@mail.example.com about it", "en", 0) for i in range(400)]
    found = {r.doc_id: r.text for r in private_data.sanitise(make(spark, rows), stored).collect()}
    assert found[200] == "<TERM> came" or found[200] == " came"
    assert found[100] == rows[8][1]


# 5


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k, "x", 1) for i, v, k in rows], "vec_id long, embedding array<float>, label int, rep string, copies int")


@pytest.mark.parametrize("block", [7, 2048])
def test_near_vectors(spark, stored, block):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 16))
    x = np.concatenate([x, x[:30] + rng.normal(size=(30, 16)) * 0.25, x[:5], np.tile(x[0], (20, 1)) + rng.normal(size=(20, 16)) * 0.05]).astype(np.float32)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] + [1.0] * 15, 1), (1003, [None] + [1.0] * 15, 1), (1004, x[0].tolist(), None), (1005, [], 1), (1006, [float("inf")] * 16, 1), (None, [1.0, 2.0], 0), (1007, [1.0, 2.0], 0), (1008, [1.0, 2.0], 0), (0, x[0].tolist(), 0)]
    got = near_vectors.near_duplicates(vectors(spark, rows), stored, block=block, shared=1).collect()
    assert len(got) == len(rows)
    good = [(i, np.array(v, np.float64), k) for i, v, k in rows if i is not None and k is not None and v and all(a is not None and np.isfinite(a) for a in v) and any(v)]
    links = defaultdict(int)
    pairs = []
    for a in range(len(good)):
        for b in range(a):
            (i, v, k), (j, w, m) = good[a], good[b]
            if k == m and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.93:
                links[a] += 1
                links[b] += 1
                pairs.append((i, j))
    root = components.union(pairs)
    want = Counter((i, links[n], root.get(i, i)) for n, (i, _, _) in enumerate(good))
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None and (r.vec_id < 1000 or r.vec_id in (1007, 1008))) == want
    assert all(r.n_links == 0 and r.kept for r in got if r.vec_id is None or 1000 <= r.vec_id < 1007)


def test_no_vectors(spark, stored):
    assert near_vectors.near_duplicates(vectors(spark, []), stored).collect() == []


def test_recall_at_the_threshold(spark, stored):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.94 * x + np.sqrt(1 - 0.94**2) * z
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, y]))]
    got = near_vectors.near_duplicates(vectors(spark, rows), stored).agg(F.sum("n_links")).first()[0]
    assert got >= 0.9 * 3000


def test_contraction_of_many_edges(spark):
    chain = spark.range(0, 1_200_000, 1, 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components._contract(chain).agg(F.count("*"), F.countDistinct("u"), F.max("v")).first()
    assert tuple(got) == (1_200_000, 1_200_000, 0)


def test_long_lists_lose_no_candidate(spark, stored):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 24))
    x = np.concatenate([x + rng.normal(size=x.shape) * 0.12 for _ in range(12)])
    rows = vectors(spark, [(i, v.tolist(), i % 2) for i, v in enumerate(x)])
    whole, split, cut = (sorted(near_vectors.near_duplicates(rows, stored, block=block).collect()) for block in (2048, 40, 3))
    assert whole == split == cut
    assert sum(r.n_links for r in whole) > 1000


def test_components(spark, stored):
    import random

    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 400)] + [(1000, i) for i in range(1001, 1300)] + [(rnd.randrange(5000, 5600), rnd.randrange(5000, 5600)) for _ in range(350)] + [(7, 7)]
    rnd.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.node: r.component for r in components.components(df, stored).collect()}
    want = components.union([e for e in edges if e[0] != e[1]])
    assert got == want
    assert components.components(df.limit(0), stored).collect() == []


# 6


def test_quality_rules(odd, empty, spark, stored):
    con = duck("/root/testdata/sf0.001")
    con.execute("DROP VIEW documents")
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    rows = [(i, t) for i, t, *_ in ROWS if "\0" not in (t or "")] + [(50, "a b c a b c " * 30), (51, "l one\nl one\n\nl two\n" * 20)]
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    res = con.execute(quality_rules.SQL)
    names = [c[0] for c in res.description]
    got = quality_rules.judge(quality_rules.ledger(make(spark, [(i, t, "en", 0) for i, t in rows]))).select(*names)
    assert plain([tuple(r) for r in got.collect()]) == plain(res.fetchall())
    res = con.execute(quality_rules.ABLATIONS_SQL)
    names = [c[0] for c in res.description]
    got = quality_rules.ablations(quality_rules.ledger(make(spark, [(i, t, "en", 0) for i, t in rows]), stored)).select(*names)
    assert plain([tuple(r) for r in got.collect()]) == plain(res.fetchall())
    kept = quality_rules.accepted(odd.withColumn("failed", F.lit(1)).withColumn("_row", F.lit("x")).withColumn("kept", F.lit(False)).withColumn("w", F.lit(None)), stored)
    assert kept.columns == [*odd.columns, "failed", "_row", "kept", "w"] and [r.doc_id for r in kept.collect()] == [r.doc_id for r in quality_rules.judge(quality_rules.ledger(odd)).filter("kept").collect()]
    assert quality_rules.accepted(empty, stored).collect() == []
    assert quality_rules.ledger(empty).collect() == [] and quality_rules.ablations(quality_rules.ledger(empty)).collect() == []


def test_ablations(odd):
    book = quality_rules.ledger(odd)
    bits = [r.failed for r in book.collect()]
    for r in quality_rules.ablations(book).collect():
        one = 1 << r.bit
        assert (r.n_failed, r.n_failed_alone, r.n_kept_without) == (sum(bool(b & one) for b in bits), sum(b == one for b in bits), sum(not b & ~one for b in bits))


# 7


def test_shingle_join(spark, stored, sample, monkeypatch):
    for frequent, leaf, block, hot in ((32, 16, 2048, 200_000), (4, 3, 20, 200_000), (2, 4, 15, 12)):
        for name, value in (("FREQUENT", frequent), ("LEAF", leaf), ("BLOCK", block), ("HOT_POSTINGS", hot), ("MEETING", block)):
            monkeypatch.setattr(shingle_join, name, value)
        got = shingle_join.near_duplicates(spark.createDataFrame(sample, "doc_id long, text string").repartition(5), stored).collect()
        sets = {}
        for i, t in sample:
            w = t.encode().lower().split()
            sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        where = defaultdict(list)
        for i, s in sets.items():
            for x in s:
                where[x].append(i)
        common = Counter((a, b) for l in where.values() for n, b in enumerate(l) for a in l[:n])
        root = components.union([p for p, n in common.items() if 100 * n >= 75 * (len(sets[p[0]]) + len(sets[p[1]]) - n)])
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), root.get(i, i)) for i, s in sets.items()}


def test_shingle_join_odd_rows(spark, odd, empty, stored):
    got = shingle_join.near_duplicates(odd, stored).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in ROWS)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None and r.doc_id <= 8} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8)}
    kept = shingle_join.one_of_each(odd, stored)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == Counter([None, None, *{i for i, *_ in ROWS} - {2, None}])
    assert shingle_join.near_duplicates(empty, stored).collect() == [] and shingle_join.one_of_each(empty, stored).collect() == []


def test_bound_of_very_long_sets():
    """Groups of more than 65,535 shingles: the bound stays above the overlap, in the tree as well."""
    points = np.full((20, shingle_join.GROUPS), 80_000, np.int32)
    sizes = points.sum(1, dtype=np.int64)
    assert shingle_join.enough(shingle_join.overlap(points[0], points[1]), sizes[0], sizes[1])
    assert len(shingle_join.CountTree(points, sizes).candidates(points[0], int(sizes[0]))) == 20


def test_tree_prunes_nothing_that_overlaps():
    rng = np.random.default_rng(0)
    points = rng.poisson(2, size=(300, 32))
    points[100:200] = np.maximum(points[:100] + rng.integers(-1, 2, size=(100, 32)), 0)
    sizes = points.sum(1)
    tree = shingle_join.CountTree(points, sizes)
    visited = 0
    for i in range(300):
        want = {j for j in range(300) if shingle_join.enough(np.minimum(points[i], points[j]).sum(), sizes[i], sizes[j]) and 4 * min(sizes[i], sizes[j]) >= 3 * max(sizes[i], sizes[j])}
        found = tree.candidates(points[i], int(sizes[i])).tolist()
        assert want <= set(found)
        visited += len(found)
    assert visited < 300 * 300


# 8


def test_token_output(spark, odd, empty):
    t = tokenizer(BYTE)
    path = token_output.encode_write(spark, odd, BYTE)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.start, bytes(r.ids)) for r in token_output.read_shards(spark, path).collect())
    at, want = 0, []
    for i, text, *_ in sorted(ROWS, key=lambda r: -1 if r[0] is None else r[0]):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((-1 if i is None else i, at, np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == sorted(want)
    block = token_output.Block(bytes(spark.read.parquet(path).first().payload))
    every = block.all()
    for k in range(block.docs):
        assert (block.document(k) == every[k]).all()
        assert (block.span(k, 1, 4) == every[k][1:4]).all()
    assert token_output.read_shards(spark, token_output.encode_write(spark, empty, BYTE)).collect() == []


@pytest.mark.parametrize("terminals", [300, 70_000])
def test_repair_round_trip(terminals):
    rng = np.random.default_rng(1)
    phrase = rng.integers(0, terminals, 50)
    docs = [np.concatenate([rng.choice([0, 1, 2, 299], 200), phrase, np.zeros(30, np.int64)]) for _ in range(60)] + [np.zeros(1, np.int64)]
    block = token_output.Block(token_output.write_block(np.arange(len(docs)), np.concatenate(docs), np.array([len(d) for d in docs]), terminals))
    assert len(block.symbols) < sum(map(len, docs)) / 2
    assert all((a == b).all() for a, b in zip(block.all(), docs, strict=True)) and (block.document(7) == docs[7]).all()
    assert (block.lengths == token_output.expansion_lengths(np.stack([block.left, block.right], 1), terminals)).all()


def _apart(symbols, last):
    """Uses of each pair apart from one another, within documents."""
    uses, end = Counter(), {}
    for k in range(len(symbols) - 1):
        pair = (symbols[k], symbols[k + 1])
        if not last[k] and end.get(pair) != k:
            uses[pair] += 1
            end[pair] = k + 1
    return uses


def test_repair_goes_on_to_the_end():
    rng = np.random.default_rng(6)
    for case in range(120):
        ids = rng.integers(0, rng.integers(1, 9), rng.integers(1, 900))
        if case % 3 == 0:
            ids = np.tile(ids[:40], 15)
        last = rng.random(len(ids)) < rng.choice([0, 0.05])
        last[-1] = True
        symbols, ends, rules = token_output.repair(ids, last, 10)
        assert max(_apart(symbols.tolist(), ends.tolist()).values(), default=0) < token_output.LEAST_USES
        assert ends.sum() == last.sum() and token_output.expansion_lengths(rules, 10).max(initial=2) >= 2


# 9


def test_pieces(odd, empty):
    sp = pieces.load(PIECE)
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in pieces.encode_decode(odd, PIECE).collect())
    assert got == Counter((i, tuple(ids := sp.encode(t or "")), sp.decode(ids)) for i, t, *_ in ROWS)
    assert pieces.encode_decode(empty, PIECE).collect() == []


# 10

SECRETS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def test_secrets(spark, odd, empty, stored):
    import random

    rnd = random.Random(1)
    rows = [(i, t, "en", 0) for i, t, *_ in ROWS]
    for n in range(300):
        text = " ".join(rnd.choices(["é word", "Token:", "secretpassword = x", "API_KEY='abcdefgh-_.'", "AKIA" + "Z9" * 7, "deadbeef" * 5, "token = token: abcdefghi", "🙂", "passwd=12345678", "ſecret: abcdefghij"], k=8))
        rows.append((100 + n, text + " " + "".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=48)) + " getUserNameByIdentifierAndThenSome1", "en", 0))
    got = secrets.scan(make(spark, rows), stored).withColumn("all", secrets.listed("spans")).collect()
    want = Counter()
    for i, t, *_ in rows:
        found = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(SECRETS) for m in p.finditer(t or "") if ok(m)]
        want[i, ",".join(f"{name}:{a}:{b}" for a, _, name, b in sorted(found))] += 1
    assert Counter((r.doc_id, ",".join(s for s in r["all"].split(",") if not s.startswith("random"))) for r in got) == want
    text = {i: t for i, t, *_ in rows}
    marked = [text[r.doc_id][s.start : s.end] for r in got if (r.doc_id or 0) >= 100 for s in r.spans if s.kind == "random"]
    assert sum(len(m) == 48 for m in marked) > 250 and not any(m.startswith("getUser") for m in marked)
    assert secrets.scan(empty, stored).collect() == []
    assert len(secrets.scan(odd, stored).collect()) == len(ROWS)


def test_battery(spark):
    import random

    rnd = random.Random(3)
    draw = lambda alphabet, k: "".join(rnd.choices(alphabet, k=k))
    rows = [("hex", draw("0123456789abcdef", 40)) for _ in range(200)] + [("text", draw("aaaaeeeeiot", 30) + "1A") for _ in range(200)]
    out = secrets.battery(spark.createDataFrame(rows, "kind string, found string")).groupBy("kind").agg(F.expr("percentile(p, 0.5)").alias("p")).collect()
    p = {r.kind: r.p for r in out}
    assert 0.25 < p["hex"] < 0.8 and p["text"] < 1e-3
