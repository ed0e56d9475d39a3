"""Operator 1, packing: first-fit decreasing over a tournament tree of bin capacities.

Documents are dealt into randomised groups by a seeded hash of doc_id and ids, so no group grows with a source, with
copies or with rows without doc_id, and each group is packed by itself in one task. A document of capacity ids or more gives full sequences;
what remains of each document goes, longest first, to the first open sequence with room, which a tournament tree
over the free room finds in log(n) steps. Then the emptiest sequences are taken apart, cutting their pieces, to fill
the gaps of the others, so that one sequence a group at most is not full.

Null texts count as empty; an empty text is its end id alone. Repeated rows are packed as often as they occur (all in one group: they share their hash).
A null doc_id is packed like any other. Texts are packed whole, whatever their length; one text's ids are held at a time. Of equally long rests that with the
lesser doc_id, then ids, goes first. An empty table gives no rows. Columns but doc_id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks
from .common import n_parts, text_or_empty

#: Documents to a group: some 2.6 MB of ids on average prose. Chunks that a task keeps.
GROUP_DOCS, TABLE_LIMIT = 1024, 400_000
_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


class CapacityTree:
    """A tournament tree: each inner node holds the largest free room below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, need: int) -> int:
        """The first bin with that much room, which it takes."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < need:
                at += 1
        room[at] -= need
        found = at - self.leaves
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return found


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items by bin. Ties keep the order of the items."""
    tree = CapacityTree(max(1, len(lengths)), capacity)
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = tree.place(lengths[i])
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
    return bins


def pack(tokens: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) for documents of so many tokens."""
    full = [[(d, at, capacity)] for d, n in enumerate(tokens) for at in range(0, n - capacity + 1, capacity)]
    rest = [d for d, n in enumerate(tokens) if n % capacity]
    left = [tokens[d] % capacity for d in rest]
    bins = [[(rest[i], tokens[rest[i]] - left[i], left[i]) for i in b] for b in first_fit_decreasing(left, capacity)]
    bins.sort(key=lambda b: -sum(p[2] for p in b))
    used = [sum(p[2] for p in b) for b in bins]
    into, last = 0, len(bins) - 1
    while into < last:
        gap = capacity - used[into]
        if not gap:
            into += 1
            continue
        doc, start, length = bins[last].pop()
        take = min(gap, length)
        bins[into].append((doc, start + length - take, take))
        if take < length:
            bins[last].append((doc, start, length - take))
        used[into] += take
        used[last] -= take
        if not bins[last]:
            last -= 1
    return full + bins[: last + 1]


def token_bytes(df: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id and each document's ids, little-endian unsigned 32-bit or, if all ids of the vocabulary fit, 16-bit."""

    def run(batches):
        table = chunks.HubTable(tokenizer_path, TABLE_LIMIT)
        kind = "<u2" if table.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else "<u4"
        for batch in (part for whole in batches for part in chunks.slices(whole)):
            ids, counts = chunks.with_end(*table.encode(batch.column(1)), end_id)
            ids = ids.astype(kind)
            at = np.concatenate([[0], np.cumsum(counts)]) * ids.itemsize
            blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), blobs, pa.array(np.full(len(counts), ids.itemsize, np.int32))], ["doc_id", "ids", "width"])
        del table
        chunks.give_back()

    return text_or_empty(df).mapInArrow(run, "doc_id long, ids binary, width int")


def pack_documents(df: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, group_docs: int = GROUP_DOCS, seed: int = 7) -> DataFrame:
    """One row per piece: where its document's ids went. sequence_id: the group times 2^32, and a number within it."""
    groups = n_parts(df.count(), group_docs, most=1 << 30)
    dealt = token_bytes(df, tokenizer_path, end_id).withColumn("grp", F.pmod(F.xxhash64("doc_id", "ids", F.lit(seed)), F.lit(groups)))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.take(pa.compute.sort_indices(table, [("doc_id", "ascending"), ("ids", "ascending")]))
        docs, blobs = table.column("doc_id").to_pylist(), table.column("ids")
        width = table.column("width")[0].as_py()
        ids = [np.frombuffer(b.as_buffer(), f"<u{width}") for b in blobs]
        base = key[0].as_py() << 32
        rows = []
        for n, sequence in enumerate(pack([len(x) for x in ids], capacity)):
            at, total = 0, sum(p[2] for p in sequence)
            for d, start, length in sequence:
                crc = zlib.crc32(ids[d][start : start + length].astype("<u4").tobytes())
                rows.append((docs[d], start, length, crc, len(ids[d]), base + n, at, total))
                at += length
        names = [c.split()[0] for c in _OUT.split(", ")]
        return pa.table({name: pa.array([r[i] for r in rows], pa.int64()) for i, name in enumerate(names)})

    return dealt.groupBy("grp").applyInArrow(run, _OUT)
