"""Operator 7, n-gram Jaccard join: count-vector R-trees over cells of documents that share a rare shingle.

A document is the set of its distinct 5-word shingles. Documents with one word sequence (lower-cased) are one class, compared once.
A shingle's hash deals it to one of GROUPS groups, and a document is the point of its group counts. Two sets overlap at most by the
sum of the lesser counts, coordinate by coordinate; the same holds between a point and a box of points, with the box's upper corner.
Packed R-trees over such points prune pairs, and what survives is verified on the shingles.

Alone, R-trees do not scale here: boxes of unrelated documents overlap in hundreds of dimensions, and a search visits nearly all. So
trees stand over cells, whose choice loses no link: in one fixed order of all shingles, two sets with Jaccard similarity of
3/4 or more share one of their first n - ceil(3n/4) + 1 shingles. The order puts frequent shingles last (by a filter of fixed
size that all tasks share), so shared passages rarely make cells. Links are found in three rounds: first each class is
compared with the closest of the middle classes of a few cells; then, where a cell holds much of one component, its other
classes are compared with all of that component, once; last, trees compare what is left of each cell, classes of different components
alone. Every pair of a cell is thus linked, pruned or verified, or lies within a component.

Null, empty and wordless texts have the empty set, and link with nothing. Texts are taken whole, whatever their length; other columns are not
read, whatever their names, and one_of_each() keeps them. Rows that share a doc_id are one document if their texts agree,
and otherwise belong to one component. Repeated rows are returned as often as they occur. A row without doc_id links with nothing, and has no component. Empty
tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks
from .common import Stored, n_parts, text_or_empty
from .components import components

WORDS, GROUPS = 5, 256  # groups of small sets, and of the trees
#: Documents with a shingle (as tasks met it more than once) from which on it is frequent; bits of the filter that holds frequent ones (8 MB).
FREQUENT, FILTER_BITS = 8, 1 << 26
#: Documents to a bucket of postings, first rare and first frequent keys of a document whose cells look for its closest, middle classes of a cell, points to a leaf of a tree, classes to a block of a cell.
BUCKET_DOCS, EARLY_KEYS, MIDDLE, LEAF, BLOCK = 8192, 4, 4, 16, 2048
#: Documents with a shingle from which on its postings are dealt to several tasks, of so many postings each about.
HOT_POSTINGS = 200_000
#: Members of a component, and classes beside it, that meet in one task; classes of a cell that look for their closest in one.
MEETING = 512
# odd multipliers, one for each word of a shingle
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def words_of(text: str) -> list[bytes]:
    """Words with A-Z in lower case; bytes.split() cuts at just the contract's white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(words: list[bytes], hashes: dict[bytes, int]) -> np.ndarray:
    """The sorted distinct hashes of a document's shingles."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    if len(h) < WORDS:
        h = np.concatenate([h, np.full(WORDS - len(h), len(h), np.uint64)])
    n = len(h) - WORDS + 1
    x = h[:n] * _ODD[0]
    for k in range(1, WORDS):
        x += (h[k : k + n] ^ (h[k : k + n] >> np.uint64(31))) * _ODD[k]
    x ^= x >> np.uint64(32)
    x *= _ODD[3]
    x ^= x >> np.uint64(29)
    x *= _ODD[1]
    x ^= x >> np.uint64(32)
    return np.unique(x)


def counts_of(sets: np.ndarray) -> bytes:
    """The point of a set: counts by the top bits of the hashes, each in 8 or 32 bits after a byte that tells which.

    The larger a set, the more groups: 4 to 16 shingles share one, so that counts of unrelated sets differ.
    """
    bits = 8
    while len(sets) >> bits >= 4 and bits < 14:
        bits += 2
    c = np.bincount((sets >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    small = c.max() < 256
    return bytes([1 if small else 4]) + c.astype(np.uint8 if small else "<u4").tobytes()


def point(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint8 if blob[0] == 1 else "<u4", offset=1).astype(np.int32)


def folded(point: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The same point with fewer groups."""
    return point.reshape(groups, -1).sum(1)


def overlap(p: np.ndarray, q: np.ndarray) -> int:
    """The bound on the overlap of two sets by their points, in the groups of the coarser one."""
    groups = min(len(p), len(q))
    return int(np.minimum(folded(p, groups), folded(q, groups)).sum())


def prefix(sets: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """The set's first n - ceil(3n/4) + 1 hashes, frequent ones last, in order; and how many are not frequent."""
    n = len(sets)
    keep = n - -(-3 * n // 4) + 1
    mask = np.uint64(FILTER_BITS - 1)
    one, two = sets & mask, (sets >> np.uint64(32)) & mask
    hot = _bit(frequent, one) & _bit(frequent, two)
    # copies: a slice would hold all of the set
    rare = sets[~hot][:keep].copy()
    return (rare, len(rare)) if len(rare) == keep else (np.concatenate([rare, sets[hot][: keep - len(rare)]]), len(rare))


def _bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


class _Firsts(set):
    """Classes that a task has met; forgetting some costs repeated work alone."""

    def first(self, key) -> bool:
        if key in self:
            return False
        if len(self) > 200_000:
            self.clear()
        self.add(key)
        return True


def _documents(batches):
    """doc_id, words, class (two longs) for each text of Arrow batches of doc_id and text, in runs."""
    for batch in (part for whole in batches for part in chunks.slices(whole)):
        docs, found, classes = batch.column(0).to_pylist(), [], []
        for text in batch.column(1).to_pylist():
            words = words_of(text)
            found.append(words)
            digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
            classes.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)))
        yield docs, found, classes


def survey(df: DataFrame) -> DataFrame:
    """Rows of documents (doc_id, hi, lo, n, point), and rows of shingles that a task has met more than once (shingle, times)."""

    def run(batches):
        hashes, firsts, seen, size = _Hashes(), _Firsts(), [], 0
        for docs, found, classes in _documents(batches):
            sets = [shingles(w, hashes) for w in found]
            columns = [docs, [c[0] for c in classes], [c[1] for c in classes], [len(s) for s in sets], [counts_of(s) if len(s) else None for s in sets]]
            yield rows(columns, [None, None])
            for c, s in zip(classes, sets, strict=True):
                if firsts.first((c[0] << 64) ^ c[1]):
                    seen.append(s)
                    size += len(s)
            if size > 1_500_000:
                yield often(seen)
                seen, size = [], 0
        yield often(seen)
        del seen, hashes, firsts
        chunks.give_back()

    def often(seen):
        values, times = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.uint64), return_counts=True)
        kept = times > 1
        return rows([None] * 5, [values[kept].view(np.int64), times[kept]])

    def rows(left, right):
        n = len(left[0]) if left[0] is not None else len(right[0])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        columns = [pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in zip([*left, *right], kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "hi", "lo", "n", "point", "shingle", "times"])

    return text_or_empty(df).mapInArrow(run, "doc_id long, hi long, lo long, n long, point binary, shingle long, times long")


def bit_filter(values: DataFrame) -> np.ndarray:
    """A filter over a long column: two bits of FILTER_BITS for each, FILTER_BITS / 64 rows to the driver at most."""
    x, mask = values.columns[0], FILTER_BITS - 1
    places = F.expr(f"explode(array({x} & {mask}L, shiftrightunsigned({x}, 32) & {mask}L))").alias("at")
    rows = values.select(places).groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def postings(df: DataFrame, frequent, buckets: int, hot) -> DataFrame:
    """bucket, blob: keys, classes (lo), set sizes and places in the prefix of many postings.

    hot: sorted keys whose postings are dealt by class to so many buckets beyond the others, each key to its own (keys, first buckets, buckets).
    """

    def run(batches):
        hashes, firsts, held, size = _Hashes(), _Firsts(), [], 0
        for _, found, classes in _documents(batches):
            for words, c in zip(found, classes, strict=True):
                if words and firsts.first((c[0] << 64) ^ c[1]):
                    sets = shingles(words, hashes)
                    keys, rare = prefix(sets, frequent.value)
                    held.append((keys, c[1], len(sets), rare))
                    size += len(keys)
            if size > 600_000:
                yield from out(held)
                held, size = [], 0
        yield from out(held)
        del held, hashes, firsts
        chunks.give_back()

    def out(held):
        if not held:
            return
        counts = [len(h[0]) for h in held]
        keys = np.concatenate([h[0] for h in held])
        lo, n = np.repeat(np.array([h[1] for h in held], np.int64), counts), np.repeat(np.array([h[2] for h in held], np.uint32), counts)
        # places count anew from the first frequent key on, which copies share while their rare ones may be edits
        place = np.concatenate([np.minimum(np.concatenate([np.arange(r), np.arange(c - r)]), 255) for c, (_, _, _, r) in zip(counts, held, strict=True)]).astype(np.uint8)
        bucket = ((keys >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
        names, starts, parts = hot.value
        if len(names):
            at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
            mine = names[at] == keys
            bucket = np.where(mine, buckets + starts[at] + lo % parts[at], bucket)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        parts = np.split(order, cuts)
        blobs = [b"".join(a[p].tobytes() for a in (keys, lo, n, place)) for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array([int(bucket[p[0]]) for p in parts], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return text_or_empty(df).mapInArrow(run, "bucket long, blob binary")


def _open(blobs: list[bytes]) -> list[np.ndarray]:
    parts = []
    for b in blobs:
        n = len(b) // 21
        parts.append((np.frombuffer(b, np.uint64, n), np.frombuffer(b, np.int64, n, 8 * n), np.frombuffer(b, np.uint32, n, 16 * n), np.frombuffer(b, np.uint8, n, 20 * n)))
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def hot_keys(times: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For postings(): the shingles of HOT_POSTINGS documents or more. There are fewer of them than all postings over HOT_POSTINGS."""
    rows = times.filter(F.col("times") >= HOT_POSTINGS).select("shingle", F.expr(f"times div {HOT_POSTINGS} + 1").alias("parts")).toArrow()
    names, parts = rows.column("shingle").to_numpy().view(np.uint64), rows.column("parts").to_numpy().astype(np.int64)
    order = np.argsort(names)
    names, parts = names[order], parts[order]
    return names, np.cumsum(parts) - parts, parts


def cells(posted: DataFrame, buckets: int) -> DataFrame:
    """Rows (cell, part, members): sets of classes that share a key; and rows (cell, lo): the cells of each class's first keys.

    A cell of a key whose postings are dealt to several buckets is named by the key, and comes in parts.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, lo, n, place = _open(table.column("blob").to_pylist())
        order = np.lexsort((lo, n, keys))
        keys, lo, n, place = keys[order], lo[order], n[order].astype(np.int64), place[order]
        fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (lo[1:] != lo[:-1])])
        keys, lo, n, place = keys[fresh], lo[fresh], n[fresh], place[fresh]
        # neighbours in a cell may be linked only if their sizes are near; where they are not, the cell falls apart
        dealt = key[0].as_py() >= buckets
        joined = np.concatenate([[False], (keys[1:] == keys[:-1]) & (dealt | (4 * n[:-1] >= 3 * n[1:]))])
        start = np.flatnonzero(~joined)
        size = np.diff(np.concatenate([start, [len(keys)]]))
        start, size = start[(size > 1) | dealt], size[(size > 1) | dealt]
        found, first, early = {}, [], []
        for s, m in zip(start.tolist(), size.tolist(), strict=True):
            members = lo[s : s + m].tobytes()
            cell = xxhash.xxh64_intdigest(keys[s : s + 1].tobytes() if dealt else members) - (1 << 63)
            if cell not in found:
                found[cell] = members
            soon = np.flatnonzero(place[s : s + m] < EARLY_KEYS)
            if len(soon):
                first.append(np.full(len(soon), keys[s : s + 1].view(np.int64)[0]))
                early.append(lo[s + soon])
        rows, soon = len(found), sum(map(len, first))
        return pa.table(
            {
                "cell": pa.array(np.concatenate([np.fromiter(found, np.int64, rows), *first])),
                "part": pa.array(np.full(rows + soon, key[0].as_py())),
                "members": pa.array([*found.values(), *[None] * soon], pa.binary()),
                "lo": pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *early]))]),
            }
        )

    return posted.groupBy("bucket").applyInArrow(run, "cell long, part long, members binary, lo long")


def closest(members: DataFrame, stored: Stored) -> DataFrame:
    """Pairs (a, b) of each class and the class closest to it, by points, among the middle ones of its cells: one row per class at most.

    The middle of a cell is where the mean of its points lies. Where classes are copies of one, that one is near it. Cells beyond MEETING classes
    are cut into blocks by hash, and the middle classes of the blocks are compared in turn.
    """
    level, n = members.select("cell", "rep", "n", "point"), 0
    found = None
    while True:
        sizes = level.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(MEETING)).cast("int").alias("blocks"))
        dealt = level.join(stored.put(sizes, "closest-sizes"), "cell").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(n)), F.col("blocks")))
        step = stored.put(dealt.groupBy("cell", "block").applyInArrow(_closest, "a long, b long, near double, cell long, rep long, n long, point binary"), "closest")
        pairs = step.filter("a is not null").select("a", "b", "near")
        found = pairs if found is None else found.union(pairs)
        level, n = step.filter("rep is not null").select("cell", "rep", "n", "point"), n + 1
        if level.isEmpty():
            break
    found = found.groupBy("a").agg(F.max_by("b", F.struct("near", "b")).alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _closest(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """a, b, near: each class of a block and the one closest to it of the middle ones; and, where the cell has more blocks, the middle ones."""
    rep, n, blobs = table.column("rep").to_numpy(), table.column("n").to_numpy(), table.column("point")
    order = np.argsort(rep)
    rep, n, blobs = rep[order], n[order], blobs.take(pa.array(order))
    p = np.stack([folded(point(b)) for b in blobs.to_pylist()])
    mean = p.mean(0)
    centre = np.argsort(-np.minimum(p, mean).sum(1) * 2 / (n + mean.sum()), kind="stable")[:MIDDLE]
    best, near = np.full(len(rep), -1), np.zeros(len(rep))
    for c in centre.tolist():
        bound = np.minimum(p, p[c]).sum(1)
        ratio = np.where(enough(bound, n, n[c]) & (4 * np.minimum(n, n[c]) >= 3 * np.maximum(n, n[c])), bound / (n + n[c]), 0)
        ratio[c] = 0
        best = np.where(ratio > near, c, best)
        near = np.maximum(near, ratio)
    kept = np.flatnonzero(best >= 0)
    on = centre if table.column("blocks")[0].as_py() > 1 else centre[:0]
    columns = {"a": rep[kept], "b": rep[best[kept]], "near": near[kept], "cell": np.full(len(on), key[0].as_py()), "rep": rep[on], "n": n[on]}
    pad = {"a": (0, len(on)), "b": (0, len(on)), "near": (0, len(on)), "cell": (len(kept), 0), "rep": (len(kept), 0), "n": (len(kept), 0)}
    out = {}
    for name, (before, after) in pad.items():
        kind = pa.float64() if name == "near" else pa.int64()
        out[name] = pa.concat_arrays([pa.nulls(before, kind), pa.array(columns[name], kind), pa.nulls(after, kind)])
    out["point"] = pa.concat_arrays([pa.nulls(len(kept), pa.binary()), pa.array(blobs.take(pa.array(on)).to_pylist(), pa.binary())])
    return pa.table(out)


class CountTree:
    """A packed R-tree over count vectors: leaves of LEAF points of like size, and four nodes to a node above them."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        # points of like size and like heaviest groups lie together
        heavy = np.argsort(-points, axis=1, kind="stable")[:, :2]
        self.order = np.lexsort((heavy[:, 1], heavy[:, 0], sizes // 64))
        p, s = points[self.order], sizes[self.order]
        self.levels = []
        width = LEAF
        while True:
            starts = np.arange(0, len(p), width)
            self.levels.append((np.maximum.reduceat(p, starts), np.minimum.reduceat(s, starts), np.maximum.reduceat(s, starts)))
            p, s, width = *self.levels[-1][:2], 4
            self.levels[-1] = (*self.levels[-1][:2], np.maximum.reduceat(self.levels[-2][2], starts) if len(self.levels) > 1 else self.levels[-1][2])
            if len(starts) == 1:
                break

    def candidates(self, point: np.ndarray, size: int) -> np.ndarray:
        """Points in leaves that some set may lie in that overlaps enough with one of this size and point."""
        nodes = np.zeros(1, np.int64)
        for depth in reversed(range(len(self.levels))):
            high, least, most = self.levels[depth]
            bound = np.minimum(high[nodes], point).sum(1)
            nodes = nodes[enough(bound, size, least[nodes]) & (4 * most[nodes] >= 3 * size) & (4 * size >= 3 * least[nodes])]
            if not len(nodes):
                return nodes
            if depth:
                nodes = (nodes[:, None] * 4 + np.arange(4)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][1])]
        at = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
        return self.order[at[at < len(self.order)]]


def enough(overlap, a, b):
    """Whether 100 * overlap >= 75 * union, for sets of a and b."""
    return 7 * overlap >= 3 * (a + b)


def join_cells(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes of different components that the points do not prune, for rows of cell, rep, n, point, component.

    Cells beyond BLOCK classes are cut into blocks by hash, of which
    every two meet; a cell of LEAF classes or fewer is a single leaf, and needs no tree.
    """
    sizes = members.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")).cast("int")
    dealt = members.join(sizes, "cell").withColumn("mine", mine).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep", "n", "component", "point")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            # rows come sorted by group: whole groups are worked on as soon as there is enough
            held.append(batch)
            size += batch.num_rows
            if size >= 30_000:
                table = pa.Table.from_batches(held)
                key = [table.column(c).to_numpy() for c in ("cell", "i", "j")]
                last = np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]) | (key[2] != key[2][-1]))
                if len(last):
                    yield pairs_of(table.slice(0, int(last[-1]) + 1))
                    held = table.slice(int(last[-1]) + 1).to_batches()
                    size = sum(b.num_rows for b in held)
        if size:
            yield pairs_of(pa.Table.from_batches(held))
        del held
        chunks.give_back()

    def pairs_of(table):
        cell, i, j, mine, rep, n, component = (table.column(c).to_numpy() for c in ("cell", "i", "j", "mine", "rep", "n", "component"))
        blobs = table.column("point").to_pylist()
        known: dict[int, int] = {}
        row = np.array([known.setdefault(r, k) for k, r in enumerate(rep.tolist())], np.int64)  # a class's first row
        fine = {k: point(blobs[k]) for k in known.values()}
        coarse = np.zeros((len(rep), GROUPS), np.int32)
        for k, x in fine.items():
            coarse[k] = folded(x)
        start = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        size = np.diff(np.concatenate([start, [len(cell)]]))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m in range(2, LEAF + 1):
            at = start[size == m]
            x, y = np.triu_indices(m, 1)
            left.append((at[:, None] + x).ravel())
            right.append((at[:, None] + y).ravel())
        for s, m in zip(start[size > LEAF].tolist(), size[size > LEAF].tolist(), strict=True):
            one, two = (s + np.flatnonzero(mine[s : s + m] == b) for b in (i[s], j[s]))
            if not len(one) or not len(two):
                continue
            tree = CountTree(coarse[row[two]], n[two])
            for x in one.tolist():
                y = two[tree.candidates(coarse[row[x]], int(n[x]))]
                left.append(np.full(len(y), x))
                right.append(y)
        a, b = np.concatenate(left), np.concatenate(right)
        kept = (component[a] != component[b]) & (4 * np.minimum(n[a], n[b]) >= 3 * np.maximum(n[a], n[b]))
        a, b = row[a[kept]], row[b[kept]]
        a, b = np.minimum(a, b), np.maximum(a, b)
        both = np.unique(a * len(rep) + b)
        a, b = both // len(rep), both % len(rep)
        kept = np.concatenate([enough(np.minimum(coarse[x], coarse[y]).sum(1, dtype=np.int64), n[x], n[y]) for x, y in zip(np.array_split(a, len(a) // 20_000 + 1), np.array_split(b, len(a) // 20_000 + 1), strict=True)])
        a, b = a[kept], b[kept]
        bound = np.array([overlap(fine[x], fine[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
        kept = enough(bound, n[a], n[b])
        a, b = a[kept], b[kept]
        a, b = rep[a], rep[b]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    dealt = dealt.repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "rep")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def sets_of(df: DataFrame, wanted: DataFrame, stored: Stored, name: str) -> DataFrame:
    """rep, sets (binary), stored: the shingles of the documents in a column rep, read from the texts again.

    Texts pass a filter of the wanted ids before they are worked on, so they are not shuffled; what passes it by chance is dropped in the join.
    """
    bits = df.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(F.xxhash64("rep").alias("h"))))
    mask = FILTER_BITS - 1

    def passing(batches):
        for batch in batches:
            h = batch.column(2).to_numpy().view(np.uint64)
            hit = _bit(bits.value, h & np.uint64(mask)) & _bit(bits.value, (h >> np.uint64(32)) & np.uint64(mask))
            yield batch.filter(pa.array(hit))

    def run(batches):
        hashes = _Hashes()
        for batch in (part for whole in passing(batches) for part in chunks.slices(whole)):
            blobs = [shingles(words_of(t), hashes).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["rep", "sets"])
        chunks.give_back()

    found = text_or_empty(df.filter("doc_id is not null")).withColumn("h", F.xxhash64(F.col("doc_id").cast("long"))).mapInArrow(run, "rep long, sets binary")
    found = stored.put(found.join(wanted, "rep", "left_semi"), name)
    bits.destroy()
    return found


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches):
        for batch in batches:
            hit = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                hit.append(bool(enough(int((y[at] == x).sum()), len(x), len(y))))
            yield batch.select([0, 1]).filter(pa.array(hit, pa.bool_()))

    left = sets.select(F.col("rep").alias("a"), F.col("sets").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("sets").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def against_components(outside: DataFrame, parts: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between classes and the components beside which they stand: rows of rep and component, all that a class links with there, or one for it.

    A component's members, and the classes beside it, are cut into blocks by hash, every two of which meet. Overlaps with a block's members are
    counted through the block's inverted lists: no pair leaves its task but a link for each class and block.
    """
    wide = outside.groupBy("component").agg(F.ceil(F.count("*") / F.lit(MEETING)).cast("int").alias("sides"))
    inside = parts.select(F.col("node").alias("rep"), "component").join(outside.select("component").distinct(), "component", "left_semi")
    blocks = inside.groupBy("component").agg(F.ceil(F.count("*") / F.lit(MEETING)).cast("int").alias("blocks"))
    shape = blocks.join(wide, "component")
    deal = lambda by: F.pmod(F.xxhash64("rep", F.lit(9)), F.col(by)).cast("int")
    inside = inside.join(shape, "component").select("component", deal("blocks").alias("block"), F.explode(F.expr("sequence(0, sides - 1)")).alias("side"), "rep", F.lit(True).alias("inside"))
    outside = outside.join(shape, "component").select("component", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), deal("sides").alias("side"), "rep", F.lit(False).alias("inside"))
    dealt = inside.unionByName(outside).join(sets, "rep")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rep, inner = table.column("rep").to_numpy(), table.column("inside").to_numpy()
        each = [np.frombuffer(b, np.uint64) for b in table.column("sets").to_pylist()]
        there = np.flatnonzero(inner)
        size = np.array([len(each[k]) for k in there], np.int64)
        hashes = np.concatenate([each[k] for k in there]) if len(there) else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], np.repeat(np.arange(len(there)), size)[order]
        links = []
        for k in np.flatnonzero(~inner).tolist() if len(there) else []:
            first, last = np.searchsorted(hashes, each[k], "left"), np.searchsorted(hashes, each[k], "right")
            common = np.bincount(chunks.gather(owner, first, last - first), minlength=len(there))
            hit = np.flatnonzero(enough(common, size, len(each[k])))
            if len(hit):
                links.append((rep[k], rep[there[hit[0]]]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return dealt.groupBy("component", "block", "side").applyInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, stored: Stored) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every row."""
    spark = df.sparkSession
    seen = stored.put(survey(df), "survey")
    docs = seen.filter("hi is not null").select("doc_id", "hi", "lo", "n", "point")
    times = seen.filter("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times")).filter(F.col("times") >= FREQUENT)
    times = stored.put(times, "times")
    frequent = spark.sparkContext.broadcast(bit_filter(times.select("shingle")))
    # any_value: the sets of a class agree
    classes = docs.filter("doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("point").alias("point"))
    classes = stored.put(classes, "classes")
    buckets, hot = n_parts(df.count(), BUCKET_DOCS, most=200_000), spark.sparkContext.broadcast(hot_keys(times))
    found = stored.put(cells(postings(df, frequent, buckets, hot), buckets), "cells")
    frequent.destroy()
    hot.destroy()
    stored.drop("times")

    names = classes.filter("n > 0").select("lo", "rep")
    shapes = classes.filter("n > 0").select("rep", "point", "n").dropDuplicates(["rep", "n", "point"])
    early = found.filter("lo is not null").select("cell", "lo").join(names, "lo").select("cell", "rep").distinct()
    first = stored.put(closest(early.join(shapes, "rep"), stored), "first-pairs")
    stored.drop("closest", "closest-sizes")
    links = stored.put(checked(df, first, stored, "first"), "first-links")

    # one cell may come from several buckets; parts of a cell are of one bucket each
    part = F.when(F.col("part") >= buckets, F.col("part"))
    sets = found.filter("members is not null").groupBy("cell", part.alias("part")).agg(F.any_value("members").alias("members")).drop("part")
    members = sets.mapInArrow(_unpack, "cell long, lo long").join(names, "lo").select("cell", "rep").distinct()
    parts = components(links, stored)
    placed = members.join(parts, F.col("rep") == F.col("node"), "left").select("cell", "rep", F.coalesce("component", "rep").alias("component"))
    placed = stored.put(placed, "placed")
    shares = placed.groupBy("cell", "component").agg(F.count("*").alias("n"))
    mixed = shares.groupBy("cell").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.max("n").alias("most"), F.sum("n").alias("all")).filter("most < all")
    # written before the join, which then has nothing beside it and can split large cells
    mixed = stored.put(placed.join(stored.put(mixed, "mixed-cells"), "cell"), "mixed")
    # in a large cell with a large component, the others meet that component once, whatever the number of cells they share with it
    large = (F.col("most") > LEAF) & (F.col("all") > 4 * LEAF)
    outside = mixed.filter(large & (F.col("component") != F.col("largest"))).select("rep", F.col("largest").alias("component")).distinct()
    outside = stored.put(outside, "outside")
    if not outside.isEmpty():
        beside = parts.join(outside.select("component").distinct(), "component", "left_semi").select(F.col("node").alias("rep"))
        known = sets_of(df, stored.put(beside.union(outside.select("rep")).distinct(), "beside-wanted"), stored, "beside-sets")
        links = stored.put(links.union(against_components(outside, parts, known)), "outside-links")
        parts = components(links, stored)
        mixed = mixed.filter(~large | (F.col("component") != F.col("largest"))).drop("component").join(parts, F.col("rep") == F.col("node"), "left")
        mixed = mixed.select("cell", "rep", F.coalesce("component", "rep").alias("component"))
    second = join_cells(mixed.select("cell", "rep", "component").join(shapes, "rep"))
    second = stored.put(second.join(first, ["a", "b"], "left_anti"), "second-pairs")
    links = links.union(checked(df, second, stored, "second"))
    # rows of one doc_id with different texts are one node already; classes of one sequence are one row of classes
    parts = components(links.union(docs.join(classes.select("hi", "lo", "rep"), ["hi", "lo"]).filter("n > 0 and doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))), stored)
    stored.drop(*(name for name in list(stored.paths) if name != "survey" and not name.startswith("stars")))
    out = docs.join(parts, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(df: DataFrame, stored: Stored) -> DataFrame:
    """The table without all but one document of each component (that with the least doc_id), and without repeats of a doc_id."""
    each = stored.put(near_duplicates(df, stored).groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n")), "each")
    again = each.filter("n > 1 and doc_id = component_id").select("doc_id")
    gone = each.filter("n > 1 or doc_id <> component_id").select("doc_id")
    out = df.join(gone, "doc_id", "left_anti").select(*df.columns)
    if again.isEmpty():
        return out
    return out.union(df.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*df.columns))


def checked(df: DataFrame, pairs: DataFrame, stored: Stored, name: str) -> DataFrame:
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    wanted = stored.put(wanted, f"{name}-wanted")
    if wanted.isEmpty():
        return pairs
    return verify(pairs, sets_of(df, wanted, stored, f"{name}-sets"))


def _unpack(batches):
    for batch in batches:
        lists = [np.frombuffer(m.as_buffer(), np.int64) for m in batch.column(1)]
        cell = np.repeat(batch.column(0).to_numpy(), [len(x) for x in lists]) if lists else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(np.concatenate(lists) if lists else cell, pa.int64())], ["cell", "lo"])
