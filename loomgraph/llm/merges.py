"""Byte-pair merges of many short chunks at once.

Every chunk is a row of at most WIDTH symbols, linked both ways. A step takes, in each row, the leftmost of the pairs of least rank, joins it
and ranks the two pairs about it anew; rows without a ranked pair are done. That is the order in which one chunk alone is merged.
"""

from __future__ import annotations

import numpy as np

WIDTH = 16
_NEVER = np.int32((1 << 31) - 1)


class Merges:
    """The merge table of a byte-level model, as a tokenizers file states it."""

    def __init__(self, model: dict, letters: list[str]):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)
        ranks = {}
        for n, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            ranks[vocab[a], vocab[b]] = n, vocab[a + b]
        pairs = np.array(list(ranks), np.uint64).reshape(-1, 2)
        self.keys = pairs[:, 0] << np.uint64(32) | pairs[:, 1]
        self.rank, self.made = (np.array([v[i] for v in ranks.values()], np.int32) for i in (0, 1))
        self.made_by_rank = np.zeros(len(model["merges"]), np.int32)
        self.made_by_rank[self.rank] = self.made
        self.slots = np.full(1 << (4 * len(self.keys) + 4).bit_length(), -1, np.int32)
        rows, at = np.arange(len(self.keys), dtype=np.int32), self._slots_of(self.keys)
        while len(rows):
            free = self.slots[at] < 0
            self.slots[at[free]] = rows[free]
            on = self.slots[at] != rows
            rows, at = rows[on], (at[on] + 1) & (len(self.slots) - 1)

    @staticmethod
    def known(model: dict, letters: list[str]) -> bool:
        """Whether a model is one that this module merges as its library does."""
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix"))
        return plain and all(c in model["vocab"] and c + (model.get("end_of_word_suffix") or "") in model["vocab"] for c in letters)

    def _slots_of(self, keys: np.ndarray) -> np.ndarray:
        x = keys * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        return ((x * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or _NEVER."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint32)
        out, at, open_ = np.full(len(keys), _NEVER), self._slots_of(keys), None
        while len(at):
            row = self.slots[at]
            same = (row >= 0) & (self.keys[row] == keys)
            hit = np.flatnonzero(same)
            out[hit if open_ is None else open_[hit]] = self.rank[row[hit]]
            on = np.flatnonzero((row >= 0) & ~same)
            open_ = on if open_ is None else open_[on]
            keys, at = keys[on], (at[on] + 1) & (len(self.slots) - 1)
        return out

    def encode(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks of 1 to 16 bytes, none of them zero, given as two little-endian numbers; and how many each has."""
        n = len(low)
        raw = np.stack([low, high], 1).astype("<u8").view(np.uint8).reshape(n, WIDTH)
        size = (raw != 0).sum(1)
        every = np.arange(n)
        # a last column stands for what is beyond either end: no pair with it has a rank
        symbol = np.full((n, WIDTH + 1), -1, np.int32)
        symbol[:, :WIDTH] = np.where(raw != 0, self.inner[raw], -1)
        symbol[every, size - 1] = self.last[raw[every, size - 1]]
        after = np.tile(np.arange(1, WIDTH + 2, dtype=np.int8), (n, 1))
        after[every, size - 1] = WIDTH
        before = np.tile(np.arange(-1, WIDTH, dtype=np.int8), (n, 1))
        before[:, 0] = WIDTH
        rank = np.full((n, WIDTH + 1), _NEVER)
        for k in range(int(size.max(initial=1)) - 1):
            rows = np.flatnonzero(size > k + 1)
            rank[rows, k] = self._ranks(symbol[rows, k], symbol[rows, k + 1])
        row = every
        while True:
            left = rank[row].argmin(1)
            least = rank[row, left]
            on = least < _NEVER
            row, left, least = row[on], left[on], least[on]
            if not len(row):
                break
            right = after[row, left]
            beyond = after[row, right]
            symbol[row, left] = self.made_by_rank[least]
            symbol[row, right] = -1
            after[row, left], before[row, beyond] = beyond, left
            rank[row, right] = _NEVER
            first = before[row, left]
            here, ahead, behind = symbol[row, left], symbol[row, beyond], symbol[row, first]
            rank[row, left] = np.where(ahead < 0, _NEVER, self._ranks(here, ahead))
            rank[row, first] = np.where(behind < 0, _NEVER, self._ranks(behind, here))
        kept = symbol >= 0
        return symbol[kept], kept.sum(1)
