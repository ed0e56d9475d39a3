"""Chunk tables against the libraries themselves."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import chunks, pieces

ALPHABET = " \n'sdltvemrABabé.,!?0123\t×ß<|>"
TEXT = st.text(st.one_of(st.sampled_from(" \n'sdltvemrABabé.,!?0123\t\r\x01\x1c\x85\xa0▁ß’²½ıİΣς一́🙂"), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.fixture(scope="module", params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def table(request):
    return chunks.HubTable(public_tokenizers.path(request.param))


def test_kind(table):
    assert table.kind in ("word", "byte")


@settings(max_examples=1500, deadline=None)
@given(text=TEXT)
def test_same_ids_as_the_library(table, text):
    want = table.tokenizer.encode(text, add_special_tokens=False).ids
    assert chunks.encode_texts(table, [text, "", text])[2].tolist() == want


def test_many_texts_at_once(table, monkeypatch):
    rnd = random.Random(7)
    tokens = ["<|endoftext|>", "<|startoftext|>", " don't", "\n\n  we'll", "0123"]
    for window in (40, 3000, chunks.WINDOW):
        monkeypatch.setattr(chunks, "WINDOW", window)
        for letters in (ALPHABET[:24], ALPHABET, [*ALPHABET[:24], *tokens]):
            texts = ["".join(rnd.choices(letters, k=rnd.choice([0, 1, 7, 60, 400]))) for _ in range(300)] + [None, "é" * 5000, "a" * 40_000, " " * 3000, ""]
            ids, counts = table.encode(pa.array(texts, pa.string()).slice(2))
            want = [e.ids for e in table.tokenizer.encode_batch([t or "" for t in texts[2:]], add_special_tokens=False)]
            assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_no_texts(table):
    ids, counts = table.encode(pa.array([], pa.string()))
    assert len(ids) == len(counts) == 0
    ids, counts = chunks.with_end(*table.encode(pa.array(["", None], pa.string())), 9)
    assert ids.tolist() == [9, 9] and counts.tolist() == [1, 1]


def test_merges_as_the_library(table):
    rnd = random.Random(3)
    words = {"".join(rnd.choices("aaabeéßtThe r1.'", k=rnd.randrange(1, 17))) for _ in range(20_000)}
    words = sorted(w for w in words if len(w.encode()) <= 16)
    low, high = (np.array([chunks._key(w)[i] for w in words], np.uint64) for i in (0, 1))
    ids, counts = table.merges.encode(low, high)
    want = table._encode(words)
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_table_starts_anew(table):
    small = chunks.HubTable.__new__(chunks.HubTable)
    small.__dict__ |= table.__dict__
    small.limit = 3
    small.reset()
    texts = ["one two three", "four five six seven", "one two"] * 3
    for text in texts:
        assert chunks.encode_texts(small, [text])[0].tolist() == table.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=1500, deadline=None)
@given(text=TEXT)
def test_marked_words(text):
    sp = _piece_model()
    words = pieces.segment_words(sp, pieces.marked_words(text))
    ids = [i for w in words for i in w]
    assert ids == sp.encode(text)
    assert "".join(" " + sp.decode(w) for w in words)[1:] == sp.decode(ids)


_MODEL = []


def _piece_model():
    if not _MODEL:
        _MODEL.append(pieces.load(public_tokenizers.path("piece_bpe_32k.model"), check=True))
    return _MODEL[0]
