"""Operator 8, token ids in a binary format: Re-Pair grammars per block, with random access by document.

Documents are range-partitioned by doc_id into shards, tokenized, and written as blocks of about a million ids in
ascending order. In each block frequent pairs of neighbouring ids are replaced by nonterminals again and again; pairs
never span two documents, so a document is a slice of the block's symbols, and any one can be decoded alone from the
rules and their expansion lengths. A round replaces many pairs at once: where chosen pairs overlap, the more frequent one wins. Rounds go
on until no pair has LEAST_USES uses apart from one another.

A shard table is Parquet (shard, block, n_docs, n_ids, payload), so any store that Spark writes to will do. A payload is
little-endian: magic "RPB1", a header of eight unsigned 32-bit integers (terminals, rules, symbols, documents, width of
symbols in bytes, three zeros), left and right sides of the rules (unsigned 32-bit), expansion lengths (unsigned 32-bit),
first symbol and first id of each document and of the end (unsigned 32-bit), doc_ids (signed 64-bit), symbols.

Null texts count as empty; an empty text is its end id alone. Texts are encoded whole, whatever their length; one is held at a time, and never cut between blocks. Columns but doc_id and
text are not read. Repeated rows are written as often as they occur, ordered by the text's hash, then text, where doc_ids tie. Rows without doc_id come first; the least long stands for none in the format. An empty table gives no blocks.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import chunks
from .common import new_path, n_parts, text_or_empty

#: Stands for a null doc_id.
NO_ID = -(1 << 63)
MAGIC, HEADER = b"RPB1", "<8I"
#: Documents to a shard, ids to a block, least uses of a new rule (a rule takes 12 bytes, a use saves 2 or 4).
SHARD_DOCS, BLOCK_IDS, LEAST_USES = 4096, 1 << 20, 12
_SLOT_BITS = 18


def repair(ids: np.ndarray, last: np.ndarray, terminals: int, least: int = LEAST_USES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, their last-of-document marks and the rules' (left, right) sides.

    A round names all pairs with enough uses and replaces them, until there are none. Symbols are linked, and a round looks only at those
    whose pair may have enough uses: what the round before left over, and the neighbours of its new symbols.
    """
    n, none = len(ids), np.int32((1 << 31) - 1)
    s, last, rules, base = ids.astype(np.int64), last.copy(), [], terminals
    after, before = np.arange(1, n + 1), np.arange(-1, n)
    alive, flags = np.ones(n, bool), np.zeros(n + 1, bool)
    rank = np.full(n + 1, none)  # of the pair that a place begins; the last one is beyond either end
    slot_pair, slot_rank = np.zeros(1 << _SLOT_BITS, np.int64), np.full(1 << _SLOT_BITS, none)
    waits = np.zeros(1 << _SLOT_BITS, bool)  # slots with a pair that another keeps from its turn
    at = np.flatnonzero(~last[:-1])
    while len(at):
        code = (s[at] << 32) | s[after[at]]
        slot = _slot(code)
        if len(at) >> 14:
            some = np.flatnonzero((np.bincount(slot, minlength=1 << _SLOT_BITS) >= least)[slot])
            at, code, slot = at[some], code[some], slot[some]
        ordered = np.sort(code)
        edge = np.flatnonzero(np.concatenate([[len(at) > 0], ordered[1:] != ordered[:-1]]))
        uses = np.diff(np.append(edge, len(at)))
        often = np.flatnonzero(uses >= least)
        often = often[np.argsort(-uses[often], kind="stable")]
        if not len(often):
            break
        # one slot for each hash: the more frequent pair keeps it, the other waits for a later round
        pairs = ordered[edge[often]]
        mine = _slot(pairs)
        slot_pair[mine[::-1]], slot_rank[mine[::-1]] = pairs[::-1], np.arange(len(pairs), dtype=np.int32)[::-1]
        found = slot_rank[slot]
        found[slot_pair[slot] != code] = none
        slot_rank[mine] = none
        # the more frequent of two pairs that overlap wins; of a run of one symbol every other pair does
        rank[at] = found
        left = rank[before[at]]
        taken = (found < left) & (found <= rank[after[at]])
        twins = np.flatnonzero(np.append(pairs >> 32 == pairs & 0xFFFFFFFF, False)[np.minimum(found, len(pairs))])
        if len(twins):
            place, k = at[twins], np.arange(len(twins))
            run = np.concatenate([[False], (before[place[1:]] == place[:-1]) & (found[twins][1:] == found[twins][:-1])])
            even = (k - np.maximum.accumulate(np.where(run, 0, k))) % 2 == 0
            taken[twins] |= even & (found[twins] == left[twins]) & (found[twins] <= rank[after[place]])
        rank[at] = none
        taken = np.flatnonzero(taken)
        which = found[taken]
        kept = np.flatnonzero(np.bincount(which, minlength=len(pairs)) >= least)
        if not len(kept):
            # the first pair has too few uses apart from one another
            at = at[found > 0]
            continue
        name = np.full(len(pairs), -1, np.int64)
        name[kept] = base + np.arange(len(kept))
        new = name[which]
        i, new = at[taken[new >= 0]], new[new >= 0]
        rules.append(np.stack([pairs[kept] >> 32, pairs[kept] & 0xFFFFFFFF], 1))
        base += len(kept)
        j = after[i]
        s[i], last[i], after[i], alive[j] = new, last[j], after[j], False
        before[after[i]] = i
        # pairs that have just been found rare stay so, unless a new symbol is in them
        waits[mine[slot_pair[mine] != pairs]] = True
        at = at[(found < none) | waits[slot]]
        waits[mine] = False
        if len(at) < n >> 4:
            at = np.unique(np.concatenate([at, i, before[i]]))
            at = at[(at >= 0) & alive[at] & ~last[at]]
        else:
            flags[at] = flags[i] = flags[before[i]] = True
            at = np.flatnonzero(flags[:n] & alive & ~last)
            flags[:] = False
    return s[alive], last[alive], np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)


def _slot(codes: np.ndarray) -> np.ndarray:
    return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def expansion_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Ids that each rule stands for; a rule's sides come before it."""
    out = [0] * len(rules)
    for i, (a, b) in enumerate(rules.tolist()):
        out[i] = (out[a - terminals] if a >= terminals else 1) + (out[b - terminals] if b >= terminals else 1)
    return np.array(out, np.int64)


def write_block(doc_ids: np.ndarray, ids: np.ndarray, counts: np.ndarray, terminals: int) -> bytes:
    """A payload of documents that have so many (one at least) of these ids each."""
    last = np.zeros(len(ids), bool)
    last[np.cumsum(counts) - 1] = True
    symbols, last, rules = repair(ids, last, terminals)
    first = np.concatenate([[0], np.flatnonzero(last) + 1])
    at = np.concatenate([[0], np.cumsum(counts)])
    width = 2 if terminals + len(rules) <= 1 << 16 else 4
    parts = [rules[:, 0].astype("<u4"), rules[:, 1].astype("<u4"), expansion_lengths(rules, terminals).astype("<u4"), first.astype("<u4"), at.astype("<u4"), np.array(doc_ids, "<i8"), symbols.astype(f"<u{width}")]
    return MAGIC + struct.pack(HEADER, terminals, len(rules), len(symbols), len(counts), width, 0, 0, 0) + b"".join(p.tobytes() for p in parts)


class Block:
    """A payload, opened; documents are decoded one by one or all at once."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        self.terminals, rules, symbols, self.docs, width, *_ = struct.unpack_from(HEADER, payload, 4)
        self._at, self._payload = 4 + struct.calcsize(HEADER), payload
        self.left, self.right, self.lengths = (self._take("<u4", rules) for _ in range(3))
        self.first, self.start = (self._take("<u4", self.docs + 1).astype(np.int64) for _ in range(2))
        self.doc_ids = self._take("<i8", self.docs)
        self.symbols = self._take(f"<u{width}", symbols).astype(np.int64)
        self._flat = None

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self._payload, kind, n, self._at)
        self._at += out.nbytes
        return out

    def _expand(self, symbol: int, out: list[int]) -> None:
        stack = [symbol]
        while stack:
            x = stack.pop()
            if x < self.terminals:
                out.append(x)
            else:
                stack += (int(self.right[x - self.terminals]), int(self.left[x - self.terminals]))

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document alone."""
        out: list[int] = []
        for x in self.symbols[self.first[k] : self.first[k + 1]].tolist():
            self._expand(x, out)
        return np.array(out, np.int64)

    def span(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the k-th document: symbols before them are skipped by their expansion lengths."""
        symbols = self.symbols[self.first[k] : self.first[k + 1]]
        ends = np.cumsum(np.where(symbols < self.terminals, 1, self._lengths_of(symbols)))
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        out: list[int] = []
        for x in symbols[a:b].tolist():
            self._expand(x, out)
        skipped = int(ends[a - 1]) if a else 0
        return np.array(out[start - skipped : stop - skipped], np.int64)

    def _lengths_of(self, symbols: np.ndarray) -> np.ndarray:
        rule = np.maximum(symbols - self.terminals, 0)
        return self.lengths[rule].astype(np.int64) if len(self.lengths) else np.ones(len(symbols), np.int64)

    def all(self) -> list[np.ndarray]:
        """Every document's ids."""
        rules: list[bytes] = []
        for a, b in zip(self.left.tolist(), self.right.tolist(), strict=True):
            rules.append(b"".join(rules[x - self.terminals] if x >= self.terminals else x.to_bytes(4, "little") for x in (a, b)))
        flat = np.concatenate([np.arange(self.terminals, dtype="<u4"), np.frombuffer(b"".join(rules), "<u4")])
        lengths = self.lengths.astype(np.int64)
        start = np.concatenate([np.arange(self.terminals), self.terminals + np.cumsum(lengths) - lengths])
        count = np.concatenate([np.ones(self.terminals, np.int64), lengths])
        ids = chunks.gather(flat, start[self.symbols], count[self.symbols])
        return np.split(ids, self.start[1:-1])


def write_shards(df: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, shard_docs: int = SHARD_DOCS, block_ids: int = BLOCK_IDS) -> None:
    """Writes the documents' ids in ascending doc_id order."""
    df = df.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("doc_id"), "text")
    # the hash deals rows of one doc_id, or of none, to several shards
    keyed = text_or_empty(df).withColumn("h", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(n_parts(df.count(), shard_docs), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")

    def run(batches):
        from pyspark import TaskContext

        shard, block = TaskContext.get().partitionId(), 0
        table = chunks.of_worker(tokenizer_path, lambda: chunks.HubTable(tokenizer_path))
        terminals = max(table.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        held, size = [], 0

        def out(held):
            docs, ids, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            columns = [[shard], [block], [len(docs)], [len(ids)], [write_block(docs, ids, counts, terminals)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "block", "n_docs", "n_ids", "payload"])

        for batch in (part for whole in batches for part in chunks.slices(whole)):
            docs = batch.column(0).to_numpy()
            ids, counts = chunks.with_end(*table.encode(batch.column(1)), end_id)
            while len(docs):
                ends = np.cumsum(counts)
                n = int(np.searchsorted(ends, block_ids - size)) + 1  # documents until the block is full
                first = int(ends[min(n, len(docs)) - 1])
                held.append((docs[:n], ids[:first], counts[:n]))
                size += first
                docs, ids, counts = docs[n:], ids[first:], counts[n:]
                if size >= block_ids:
                    yield out(held)
                    held, size, block = [], 0, block + 1
        if held:
            yield out(held)

    ordered.mapInArrow(run, "shard int, block int, n_docs long, n_ids long, payload binary").write.parquet(path)


#: Blocks up to which their first ids are sent to all tasks (24 bytes each); beyond it blocks are shuffled to them.
BROADCAST_BLOCKS = 200_000


def map_documents(spark: SparkSession, path: str, work: Callable[[np.ndarray], list], schema: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and what work makes of each document's ids, from the files alone.

    schema: the columns of what work returns.
    """
    blocks = spark.read.parquet(path)
    # two steps, so that no task orders all blocks: totals of the shards, then blocks within each shard
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    shards = shards.select("shard", before(Window.orderBy("shard")).alias("shard_start"))
    sizes = blocks.select("shard", "block", before(Window.partitionBy("shard").orderBy("block")).alias("in_shard"))
    starts = sizes.join(shards, "shard").select("shard", "block", (F.col("shard_start") + F.col("in_shard")).alias("first"))
    if blocks.count() <= BROADCAST_BLOCKS:
        starts = F.broadcast(starts)
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), *T._parse_datatype_string(schema).fields])
    kinds = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for first, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block(payload.as_py())
                made = list(zip(*map(work, block.all()), strict=True))
                columns = [pa.array(c, f.type) for c, f in zip([block.doc_ids, first + block.start[:-1], *made], kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    found = blocks.join(starts, ["shard", "block"]).select("first", "payload").mapInArrow(run, out)
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids binary (little-endian unsigned 32-bit)."""
    return map_documents(spark, path, lambda ids: [ids.astype("<u4").tobytes()], "ids binary")


def encode_write(spark: SparkSession, df: DataFrame, tokenizer_path: str) -> str:
    """Writes a table's ids to the shared folder and returns the path."""
    path = new_path(spark, "token-ids")
    write_shards(df, path, tokenizer_path)
    return path
