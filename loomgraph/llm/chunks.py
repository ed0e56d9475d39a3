"""Chunk tables: cut a text where no token can cross, and tokenize each distinct chunk once per worker."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import json
import re
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .merges import WIDTH, Merges

#: Entries of a table before rare ones go: bounds a worker's memory (about 250 MB).
TABLE_LIMIT = 1_000_000
#: Bytes of text that are worked on at a time; a single text is never cut.
SLICE_BYTES = 1_500_000


class _Index(dict):
    """Numbers strings as they come; new holds those without ids yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class ChunkTable:
    """Ids of distinct chunks, kept flat; lookup() joins them back by position."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int = TABLE_LIMIT):
        self.encode, self.limit = encode, limit
        self.reset()

    def reset(self) -> None:
        self.index = _Index()
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.count, self.hits = (np.zeros(1 << 16, np.int32) for _ in range(3))

    def rows(self, chunks: list[str]) -> np.ndarray:
        """The chunks' places in the table, which takes in those that are new."""
        if len(self.index) > self.limit:
            self._thin_out()
        index = self.index
        rows = np.fromiter(map(index.__getitem__, chunks), np.int32, len(chunks))
        if index.new:
            self._add(self.encode(index.new))
            index.new = []
        self.hits[rows] += 1  # once for each lookup that has the chunk
        return rows

    def lookup(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks in order, and how many each chunk has."""
        rows = self.rows(chunks)
        return gather(self.flat, self.start[rows], self.count[rows]), self.count[rows]

    def _thin_out(self) -> np.ndarray:
        """Keeps the chunks met in more than one lookup, half as many as the limit allows at most; returns their former places."""
        n = len(self.index)
        hits = self.hits[:n]
        most = np.argsort(-hits, kind="stable")[: self.limit // 2]
        kept = np.sort(most[hits[most] > 1])
        words = list(self.index)
        flat, start, count = gather(self.flat, self.start[kept], self.count[kept]), self.count[kept].cumsum(dtype=np.int64) - self.count[kept], self.count[kept]
        self.reset()
        self.index.update((words[k], i) for i, k in enumerate(kept.tolist()))
        self._grow(len(kept), len(flat))
        self.flat[: len(flat)], self.used = flat, len(flat)
        self.start[: len(kept)], self.count[: len(kept)] = start, count
        return kept

    def _grow(self, chunks: int, ids: int) -> None:
        for name, need in (("start", chunks), ("count", chunks), ("hits", chunks), ("flat", ids)):
            have = getattr(self, name)
            if len(have) < need:
                setattr(self, name, np.concatenate([have, np.zeros(max(len(have), need - len(have)), have.dtype)]))

    def _add(self, encoded: list[list[int]]) -> None:
        counts = np.fromiter(map(len, encoded), np.int32, len(encoded))
        ids = np.fromiter((i for one in encoded for i in one), np.int32, int(counts.sum()))
        first, n = len(self.index) - len(encoded), len(self.index)
        self._grow(n, self.used + len(ids))
        self.start[first:n] = self.used + np.cumsum(counts) - counts
        self.count[first:n] = counts
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)


def gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The slices flat[start:start + count], one after another."""
    ends = np.cumsum(count, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    return flat[np.repeat((start - (ends - count)).astype(kind), count) + np.arange(total, dtype=kind)]


def slices(batch: pa.RecordBatch, column: int = 1, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about so many bytes of text each."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(ends // size)) + 1
    for first, last in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(first, last - first)


def of_worker(key: str, make: Callable[[], ChunkTable]) -> ChunkTable:
    """The table that this worker process keeps from task to task."""
    kept = sys.modules.setdefault("_loomgraph_tables", types.ModuleType("_loomgraph_tables")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def hf_tokenizer(path: str):
    """A tokenizers.Tokenizer that runs in its task's own thread."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Letters, digits and other printable characters of which every library has the same notion; nothing here composes.
_LETTERS, _OTHERS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~"
_COMMON = re.compile(rf"[ \n{_LETTERS}0-9{_OTHERS}]*")
_ODD_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f]")
_MARKED = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Stands before a chunk that must go through all of the tokenizer; no other chunk starts with it.
WHOLE = "\0"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: The two pre-tokenizers that are known here, as their files state them.
WORD_PATTERN = _ENDINGS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# letters before endings: an ending starts with an apostrophe, so their order does not matter
_WORD = re.compile(rf"[{_LETTERS}]+|{_ENDINGS}|[0-9]|[{_OTHERS}]+")
_BYTE = re.compile(rf" ?[{_LETTERS}]+|{_ENDINGS}| ?[0-9]+| ?[{_OTHERS}]+|[ \n]+(?![^ \n])|[ \n]+")
#: Classes of bytes; a position before the first byte of a text has class NONE.
NEWLINE, SPACE, LETTER, DIGIT, OTHER, ODD, NONE = range(7)


def _byte_classes() -> np.ndarray:
    """The class of each byte of a common character; bytes of other characters, and second bytes, are ODD."""
    out = np.full(256, ODD, np.uint8)
    for b in range(33, 127):
        c = chr(b)
        out[b] = LETTER if c.isalpha() else DIGIT if c.isdigit() else OTHER
    out[10], out[32], out[0xC3] = NEWLINE, SPACE, LETTER
    return out


_CLASSES = _byte_classes()
#: The low bytes of a word of eight that belong to a chunk of so many.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes that are cut, and new chunks that are merged, at a time.
WINDOW, MERGED = 1 << 19, 1 << 14


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def give_back() -> None:
    """Returns to the system what a task has freed: workers live on, and otherwise keep the most that any task needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library cannot trim
        ctypes.CDLL(None).malloc_trim(0)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (and the last ends); nulls are empty."""
    plain = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
    data = plain.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte."""
    out = _CLASSES[data]
    two = np.flatnonzero(data == 0xC3)
    # À to ÿ but for × and ÷; valid UTF-8 has a second byte
    second = data[two + 1]
    out[two + 1] = np.where((second == 0x97) | (second == 0xB7), ODD, LETTER)
    return out


def _lowered(data: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Common characters in lower case."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    two = np.flatnonzero(data == 0xC3) + 1
    out[two[(data[two] <= 0x9E) & (classes[two] == LETTER)]] += 32
    return out


def _windows(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about WINDOW bytes that no chunk crosses: they end with a text, or before a space that follows no white space."""
    a, end = 0, len(data)
    while a < end:
        b = a + WINDOW
        if b >= end:
            yield a, end
            return
        stop = int(offsets[np.searchsorted(offsets, b)])
        while b < stop:
            part = data[b - 1 : min(b + 4096, stop)]
            at = np.flatnonzero((part[1:] == 32) & (part[:-1] != 32) & (part[:-1] != 10))
            if len(at):
                b += int(at[0])
                break
            b += len(part) - 1
        yield a, b
        a = b


def cut_bytes(data: np.ndarray, classes: np.ndarray, first: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the chunks of common texts begin and end, as _BYTE and _WORD find them (kind); first: the places where texts begin."""
    n = len(data)
    before = np.empty(n, np.uint8)
    before[1:] = classes[:-1]
    before[0] = NONE
    before[first[first < n]] = NONE
    white = classes <= SPACE
    start = (classes != before) & ~(white & (before <= SPACE))
    if kind == "byte":
        # the last white space before a word is a chunk's first character if it is a space, and a chunk if it is a newline
        word = np.flatnonzero(~white & (before <= SPACE))
        start[word - 1] = True
        start[word] = before[word] == NEWLINE
        endings = np.flatnonzero((data == 39) & (before != OTHER) & (before != SPACE))
    else:
        start |= classes == DIGIT
        endings = np.flatnonzero((data == 39) & (before != OTHER))
    # 's 't 'm 'd and 're 've 'll, where an apostrophe begins a chunk
    ahead = np.concatenate([np.where(before == NONE, 0, data), np.zeros(3, np.uint8)])
    one, two = ahead[endings + 1], np.where(ahead[endings + 1] == 0, 0, ahead[endings + 2])
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
    start[endings[short | long] + 1] = False
    after = np.concatenate([endings[short] + 2, endings[long] + 3])
    start[after[after < n]] = True
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], n)
    if kind == "word":
        kept = ~white[begin]
        begin, end = begin[kept], end[kept]
    return begin, end


def packed(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each chunk: its bytes, up to 16, or a digest of 128 bits, which is taken as equal to the chunk."""
    room = np.concatenate([data, np.zeros(24, np.uint8)])
    eight = np.ascontiguousarray(np.ndarray(len(room) - 7, "<u8", room, strides=(1,)))
    size = end - begin
    low, high = eight[begin] & _LOW[np.minimum(size, 8)], eight[begin + 8] & _LOW[np.clip(size - 8, 0, 8)]
    for k in np.flatnonzero(size > WIDTH).tolist():
        low[k], high[k] = _digest(data[begin[k] : end[k]].tobytes())
    return low, high


def _digest(chunk: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(chunk, digest_size=16).digest()
    return int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little")


def _key(chunk: str) -> tuple[int, int]:
    """As packed() for one chunk."""
    b = chunk.encode("utf-8", "surrogatepass")
    if len(b) > WIDTH or chunk[:1] == WHOLE:
        return _digest(b)
    return int.from_bytes(b[:8], "little"), int.from_bytes(b[8:], "little")


class HubTable:
    """Ids of distinct chunks over a tokenizers file. Texts are cut as the file's pre-tokenizer cuts them.

    Chunks of common characters are cut and looked up many at a time, from the texts' bytes; new ones are merged many at a time, long ones by the model.
    Other texts are cut one by one, and their words of other characters go, whole, through all of the tokenizer. So do texts with an added token's
    string, and all texts if the file's pre-tokenizer is not known here. Past limit chunks, those met rarely go.
    """

    def __init__(self, path: str, limit: int = TABLE_LIMIT):
        self.limit = limit
        self.tokenizer = hf_tokenizer(path)
        self.model = self.tokenizer.model
        self.byte = _byte_letters()
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        self.kind = "other" if any(t.normalized for t in added) else self._kind(stated)
        self.merges = Merges(stated["model"], self.byte) if self.kind != "other" and Merges.known(stated["model"], self.byte) else None
        self.reset()

    def reset(self) -> None:
        self.n, self.used = 0, 0
        self.flat = np.zeros(1 << 16, np.int32)
        self.start, self.count, self.hits = (np.zeros(1 << 15, np.int32) for _ in range(3))
        self.low, self.high = (np.zeros(1 << 15, np.uint64) for _ in range(2))
        self.slots = np.full(1 << 16, -1, np.int32)

    @staticmethod
    def _kind(file: dict) -> str:
        pre, norm = file["pre_tokenizer"] or {}, file["normalizer"]
        if norm is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            return "byte"
        steps = [x["type"] for x in (norm or {}).get("normalizers", [])]
        parts = pre.get("pretokenizers", [])
        if steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": WORD_PATTERN}:
            return "word"
        return "other"

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each text has."""
        data, offsets = utf8(texts)
        alone = self._alone(data, offsets)
        if not len(alone):
            return self._common(data, offsets)
        rest = np.ones(len(texts), bool)
        rest[alone] = False
        size = np.diff(offsets)
        ids, counts = self._common(data[np.repeat(rest, size)], np.concatenate([[0], np.cumsum(size[rest])]))
        whole = np.zeros(len(texts), np.int64)
        whole[rest] = counts
        each = dict(zip(np.flatnonzero(rest).tolist(), np.split(ids, np.cumsum(counts)[:-1]), strict=False)) if rest.any() else {}
        for k in alone.tolist():
            each[k] = self._one(data[offsets[k] : offsets[k + 1]].tobytes().decode())
            whole[k] = len(each[k])
        return np.concatenate([each[k] for k in range(len(texts))]), whole

    def _alone(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The texts that must be cut one by one."""
        if self.kind == "other":
            return np.arange(len(offsets) - 1)
        places = [np.flatnonzero(_classes(data) == ODD)]
        raw = data.tobytes()
        for token in self.added:
            token, at = token.encode(), raw.find(token.encode())
            while at >= 0:
                places.append(np.array([at]))
                at = raw.find(token, at + 1)
        # a match across two texts does no harm: the first is cut alone
        return np.unique(np.searchsorted(offsets, np.concatenate(places), "right") - 1)

    def _common(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, at = [], np.zeros(len(offsets), np.int64)
        total = 0
        for a, b in _windows(data, offsets):
            part = data[a:b]
            classes = _classes(part)
            if self.kind == "word":
                part = _lowered(part, classes)
            inside = np.flatnonzero((offsets >= a) & (offsets < b))
            begin, end = cut_bytes(part, classes, offsets[inside] - a, self.kind)
            strings = lambda k, part=part, begin=begin, end=end: [part[x:y].tobytes().decode() for x, y in zip(begin[k].tolist(), end[k].tolist(), strict=True)]
            rows = self._rows(*packed(part, begin, end), end - begin <= WIDTH, strings)
            each = self.count[rows]
            ids.append(gather(self.flat, self.start[rows], each))
            upto = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
            at[inside] = total + upto[np.searchsorted(begin, offsets[inside] - a)]
            total += int(upto[-1])
        at[offsets >= len(data)] = total
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.diff(at)

    def _one(self, text: str) -> np.ndarray:
        cut = self.cut(text)
        keys = np.array([_key(c) for c in cut], np.uint64).reshape(-1, 2)
        short = np.array([c[:1] != WHOLE and len(c.encode()) <= WIDTH for c in cut], bool)
        rows = self._rows(keys[:, 0].copy(), keys[:, 1].copy(), short, lambda k: [cut[i] for i in k.tolist()])
        return gather(self.flat, self.start[rows], self.count[rows])

    def cut(self, text: str) -> list[str]:
        """The chunks of one text."""
        if self.kind == "other" or any(t in text for t in self.added):
            return [WHOLE + text] if text else []
        if self.kind == "word":
            # white space is dropped and nothing crosses it
            return [c for w in text.replace("\n", " ").split(" ") for c in (_WORD.findall(w.lower()) if _COMMON.fullmatch(w) else [WHOLE + w])]
        # white space goes with the word after it; other white space may join its neighbours, so such a text stays whole
        if _ODD_SPACE.search(text):
            return [WHOLE + text]
        return [c for w in _MARKED.findall(text) for c in (_BYTE.findall(w) if _COMMON.fullmatch(w) else [WHOLE + w])]

    def _rows(self, low: np.ndarray, high: np.ndarray, short: np.ndarray, strings: Callable[[np.ndarray], list[str]]) -> np.ndarray:
        """The chunks' places in the table, which takes in those that are new. short: whether a chunk's numbers are its bytes."""
        if self.n > self.limit:
            self._thin_out()
        rows = self._find(low, high)
        new = np.flatnonzero(rows < 0)
        if len(new):
            new = new[np.lexsort((high[new], low[new]))]
            fresh = np.concatenate([[True], (low[new][1:] != low[new][:-1]) | (high[new][1:] != high[new][:-1])])
            which = new[fresh]
            rows[new] = self.n + np.cumsum(fresh) - 1
            if self.merges:
                # in the table, too, short chunks come first
                place = np.argsort(~short[which], kind="stable")
                at = np.empty(len(which), np.int32)
                at[place] = np.arange(len(which))
                rows[new] = self.n + at[np.cumsum(fresh) - 1]
                which = which[place]
                some = int(short[which].sum())
                for k in range(0, some, MERGED):
                    part = which[k : min(k + MERGED, some)]
                    ids, counts = self.merges.encode(low[part], high[part])
                    self._append(low[part], high[part], counts, np.zeros(len(part), np.int32), ids)
                which = which[some:]
            self._add(low[which], high[which], self._encode(strings(which)))
        self.hits[rows] += 1  # once for each lookup that has the chunk
        return rows

    def _slots_of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        x = (low ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Linear probing for many keys at once; -1 for those that are not there."""
        rows, at, left = np.full(len(low), -1, np.int32), self._slots_of(low, high), np.arange(len(low))
        while len(left):
            r = self.slots[at]
            same = (r >= 0) & (self.low[r] == low[left]) & (self.high[r] == high[left])
            rows[left[same]] = r[same]
            on = (r >= 0) & ~same
            left, at = left[on], (at[on] + 1) & (len(self.slots) - 1)
        return rows

    def _insert(self, first: int, last: int) -> None:
        rows = np.arange(first, last, dtype=np.int32)
        at = self._slots_of(self.low[first:last], self.high[first:last])
        while len(rows):
            free = self.slots[at] < 0
            self.slots[at[free]] = rows[free]
            on = self.slots[at] != rows  # the place was taken, or another key got it just now
            rows, at = rows[on], (at[on] + 1) & (len(self.slots) - 1)

    def _add(self, low: np.ndarray, high: np.ndarray, encoded: list[list[int]]) -> None:
        counts = np.fromiter(map(len, encoded), np.int32, len(encoded))
        ids = np.fromiter((i for one in encoded for i in one), np.int32, int(counts.sum()))
        self._append(low, high, counts, np.zeros(len(low), np.int32), ids)

    def _append(self, low: np.ndarray, high: np.ndarray, counts: np.ndarray, hits: np.ndarray, ids: np.ndarray) -> None:
        first, last = self.n, self.n + len(low)
        for name in ("start", "count", "hits", "low", "high"):
            setattr(self, name, _room(getattr(self, name), last))
        self.flat = _room(self.flat, self.used + len(ids))
        self.low[first:last], self.high[first:last], self.count[first:last], self.hits[first:last] = low, high, counts, hits
        self.start[first:last] = self.used + np.cumsum(counts) - counts
        self.flat[self.used : self.used + len(ids)] = ids
        self.n, self.used = last, self.used + len(ids)
        if 2 * last > len(self.slots):
            self.slots = np.full(1 << (2 * last).bit_length(), -1, np.int32)
            first = 0
        self._insert(first, last)

    def _thin_out(self) -> None:
        """Keeps the chunks met in more than one lookup, half as many as the limit allows at most."""
        most = np.argsort(-self.hits[: self.n], kind="stable")[: self.limit // 2]
        kept = np.sort(most[self.hits[most] > 1])
        rows = self.low[kept], self.high[kept], self.count[kept], np.zeros(len(kept), np.int32), gather(self.flat, self.start[kept], self.count[kept])
        self.reset()
        self._append(*rows)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        out, whole = [], []
        tokenize, byte = self.model.tokenize, self.byte
        collecting = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and hundreds of thousands of lists are alive
        try:
            for n, text in enumerate(texts):
                if text[:1] == WHOLE:
                    out.append([])
                    whole.append(n)
                else:
                    plain = text.replace(" ", byte[32]).replace("\n", byte[10]) if text.isascii() else "".join([byte[b] for b in text.encode()])
                    out.append([t.id for t in tokenize(plain)])
            for n, e in zip(whole, self.tokenizer.encode_batch([texts[n][1:] for n in whole], add_special_tokens=False), strict=True):
                out[n] = e.ids
        finally:
            if collecting:
                gc.enable()
        return out


def _room(a: np.ndarray, need: int) -> np.ndarray:
    """The array with room for so many."""
    return a if len(a) >= need else np.concatenate([a, np.zeros(max(len(a), need - len(a)), a.dtype)])


def encode_texts(table: HubTable, texts: list[str]) -> list[np.ndarray]:
    """The ids of each text, as an array."""
    ids, counts = table.encode(pa.array(texts, pa.string()))
    return np.split(ids, np.cumsum(counts)[:-1])


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after each text."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1
