"""The registered queries' own columns on the smallest documents, against the libraries and plain patterns."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from loomgraph.llm import pieces, queries

from .test_operators import SECRETS, base_spans, tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sha(parts):
    return hashlib.sha256(",".join(map(str, parts)).encode()).hexdigest()


def test_packing(spark, texts):
    t = tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: t.encode(x, add_special_tokens=False).ids + [1] for i, x in texts.items()}
    met, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op1_packing(spark, SF).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length])
        met[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        assert gapless(met[i]) == len(x)
    assert all(gapless(s) <= 2048 for s in sequences.values())
    assert sum(map(len, ids.values())) > 0.95 * 2048 * len(sequences)


def gapless(spans):
    at = 0
    for start, length in sorted(spans):
        assert start == at and length > 0
        at += length
    return at


def test_toxicity(spark, texts):
    rows = queries.op2_toxicity(spark, SF).collect()
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows) and len(rows) == len(texts)


def test_toxicity_of_rows_held_out(spark):
    """On the next larger documents: the smallest have 19 labelled rows that are held out."""
    larger = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    seen = [(toxic[r.doc_id], r.predicted) for r in queries.op2_toxicity(spark, larger).collect() if r.held_out and toxic.get(r.doc_id) in (0, 1)]
    assert len(seen) > 50 and sum(a == b for a, b in seen) >= 0.9 * len(seen)


def test_private_data(spark, texts):
    names = ["email", "ip", "card", "phone"]
    for r in queries.op4_private_data(spark, SF).collect():
        spans = sorted(base_spans(texts[r.doc_id]))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in spans) for i in range(4)]
        listed = [f"{names[k]}:{a}:{b}" for k, a, b in spans]
        assert r.base_sha256 == sha(listed) and set(listed) <= set(r.spans.split(","))


def test_token_output(spark, texts):
    t, at = tokenizer(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op8_token_output(spark, SF).collect()}
    for i in sorted(texts):
        ids = t.encode(texts[i], add_special_tokens=False).ids + [0]
        assert got.pop(i) == (at, len(ids), crc(ids))
        at += len(ids)
    assert not got


def test_sentencepiece(spark, texts):
    sp = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    for r in queries.op9_sentencepiece(spark, SF).collect():
        ids = sp.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(ids), hashlib.sha256(sp.decode(ids).encode()).hexdigest())


def test_secrets(spark, texts):
    for r in queries.op10_secrets(spark, SF).collect():
        found = sorted((m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(SECRETS) for m in p.finditer(texts[r.doc_id]) if ok(m))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _, _ in found) for i in range(3)]
        assert r.base_sha256 == sha(f"{name}:{a}:{b}" for a, _, name, b in found)


def test_near_vectors(spark):
    """Recall with production parameters over all pairs of the table, and nothing linked that is not near."""
    rows = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding is not None and r.label is not None]
    by = defaultdict(list)
    for r in rows:
        x = np.array([np.nan if v is None else v for v in r.embedding], np.float64)
        if np.isfinite(x).all() and x.any():
            by[r.label].append((r.vec_id, x / np.linalg.norm(x)))
    want = defaultdict(int)
    for group in by.values():
        x = np.stack([v for _, v in group])
        for (i, _), n in zip(group, ((x @ x.T) >= 0.93).sum(1) - 1, strict=True):
            want[i] = int(n)
    got = {r.vec_id: r for r in queries.op5_near_vectors(spark, SF).collect()}
    assert all(r.kept == (i == r.component_id) and r.n_links <= want[i] for i, r in got.items())
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(want.values())
