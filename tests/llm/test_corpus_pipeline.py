"""The pipeline's stages against plain versions of them, on the smallest documents and copies of some."""

from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F
import pytest

import corpus_pipeline
from loomgraph.llm import common, components, private_data, quality_rules, toxicity
from tests.compare import duck

from .test_operators import base_spans, tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    copies = d.filter("doc_id % 20 = 0").selectExpr("doc_id + 100000 as doc_id", "concat(text, ' once more') as text", "lang", "source", "n_chars")
    return d.union(copies)


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, docs):
    stored = common.Stored(spark)
    start = rows(docs)
    names, steps = zip(*corpus_pipeline.STAGES, strict=True)
    assert len(names) == 5

    con = duck(SF)
    con.execute("DROP VIEW documents")
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(start.items()))
    good = {i for i, kept in con.execute(f"SELECT doc_id, kept FROM ({quality_rules.SQL})").fetchall() if kept}
    one = stored.put(steps[0](spark, docs, SF), "one")
    assert one.columns == docs.columns and rows(one) == {i: t for i, t in start.items() if i in good}

    two = stored.put(steps[1](spark, one, SF), "two")
    model = toxicity.fit(one, spark.read.parquet(f"{SF}/labels.parquet"))
    before = rows(one)
    scores = dict(zip(before, model.score(list(before.values())), strict=True))
    assert two.columns == docs.columns and rows(two) == {i: t for i, t in before.items() if scores[i] < 0.5}

    three = stored.put(steps[2](spark, two, SF), "three")
    before = rows(two)
    sets = {}
    for i, t in before.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    common_ = Counter((a, b) for l in where.values() for n, b in enumerate(l) for a in l[:n])
    root = components.union([p for p, n in common_.items() if 100 * n >= 75 * (len(sets[p[0]]) + len(sets[p[1]]) - n)])
    assert three.columns == docs.columns and rows(three) == {i: t for i, t in before.items() if root.get(i, i) == i}
    assert three.count() < two.count()

    four = stored.put(steps[3](spark, three, SF), "four")
    before, after = rows(three), rows(four)
    assert four.columns == docs.columns and set(before) == set(after)
    for i, t in before.items():
        spans = base_spans(t)
        assert not base_spans(after[i]) and (spans or after[i] == t or any(p in after[i] for p in ("<TERM>",)) or len(after[i]) < len(t))
        if spans and "<TERM>" not in after[i]:
            assert after[i] == private_data.replace(t, spans) or len(after[i]) < len(private_data.replace(t, spans))

    five = steps[4](spark, four, SF).collect()
    t = tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    lengths = Counter()
    for r in five:
        lengths[r.doc_id] += r.length
    assert lengths == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in after.items()}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns[:4] == ["doc_id", "start", "length", "ids_crc32"]


def test_odd_rows_through_all_stages(spark, odd, empty, tmp_path):
    """Nulls, empty and very long texts, repeated rows, an empty table and further columns pass all stages."""
    from .conftest import KINDS, make

    words = " ".join(f"word{i}" for i in range(400))
    long = [(60, words, "en", 0), (61, words + " more", "en", 0), (None, words.replace("word", "term"), None, 0), (None, None, None, 0), (62, " ".join(f"very{i} long{i}" for i in range(60_000)), "en", 0)]
    both = odd.union(make(spark, long)).withColumn("_row", F.lit(1)).withColumn("spans", F.lit(2))
    labels = tmp_path / "labels.parquet"
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(labels))
    for table in (both, empty):
        now, stored = table, common.Stored(spark)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            if name != "packing":
                assert out.columns == table.columns
                now = stored.put(out, name)
        packed = Counter(r.doc_id for r in out.collect())
        assert (packed[60], packed[61]) == ((1, 0) if table is both else (0, 0)) and (62 in packed) == (None in packed) == (table is both)
    assert KINDS
