"""Operator 9, SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of the model has a white-space marker behind another character, the segmentation of a text falls apart
at each run of markers: a run with the characters after it (a marked word) is segmented alike wherever it stands. Each
task segments each distinct marked word once, and joins the ids, and the decoded strings, back by position. A model
with pieces that cross markers is refused, as is one that rewrites its input (a normalisation table).

Null and empty texts have no ids and decode to an empty text. Repeated rows give repeated results. Empty tables give no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import chunks
from .common import text_or_empty

MARK = "▁"
_WORD = re.compile(r" *[^ ]+| +")


def marked_words(text: str) -> list[str]:
    """Cuts a text, as the library marks it (a marker before all, markers for spaces), before each run of markers."""
    return _WORD.findall(" " + text.replace(MARK, " ")) if text else []


def load(path: str, check: bool = False):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if check:
        pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("the model has pieces that cross white-space markers")
        for probe in ("  a  b ", "ﬁ ÅÅ\t　x", "á"):
            if sp.decode(sp.encode(probe)) != probe:
                raise ValueError("the model rewrites its input, so words cannot be segmented alone")
    return sp


def segment_words(sp, words: list[str]) -> list[list[int]]:
    """Ids of marked words: the library puts the first marker itself, but none before an empty text."""
    ids = sp.encode([w[1:] for w in words], num_threads=1)
    return [x or [sp.piece_to_id(MARK)] for x in ids]


class PieceTable(chunks.ChunkTable):
    """A chunk table that also holds what each marked word decodes to."""

    def __init__(self, path: str, limit: int = chunks.TABLE_LIMIT):
        self.sp, self.plain = load(path), []
        super().__init__(self._segment, limit)

    def _segment(self, words: list[str]) -> list[list[int]]:
        ids = segment_words(self.sp, words)
        # the library drops the first marker of what it decodes
        self.plain.extend([" " + s for s in self.sp.decode(ids, num_threads=1)])
        return ids

    def _thin_out(self) -> np.ndarray:
        plain, kept = self.plain, super()._thin_out()
        self.plain = [plain[k] for k in kept.tolist()]
        return kept


def encode_decode(df: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string."""
    load(model_path, check=True)

    def run(batches):
        table = chunks.of_worker(model_path, lambda: PieceTable(model_path))
        for batch in (part for whole in batches for part in chunks.slices(whole)):
            words: list[str] = []
            ends = [0]
            for text in batch.column(1).to_pylist():
                words += marked_words(text)
                ends.append(len(words))
            rows = table.rows(words)
            each = table.count[rows]
            ids = chunks.gather(table.flat, table.start[rows], each)
            at = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])[ends]
            back = list(map(table.plain.__getitem__, rows.tolist()))
            decoded = ["".join(back[a:b])[1:] for a, b in zip(ends, ends[1:], strict=False)]
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return text_or_empty(df).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
