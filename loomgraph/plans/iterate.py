"""Iteration over graphs: one task for graphs of a checked size, rounds of joins on stored tables beyond it.

Every algorithm has both forms, with equal results. Edges are (src, dst) of any one type.
"""

from __future__ import annotations

import heapq
import re
import tempfile
import uuid
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Edges up to which a graph is worked on in one task (about 300 bytes each).
LOCAL_EDGES = 2_000_000
#: The same where the ends are whole numbers and the work is on arrays of their places.
LOCAL_NUMBERS = 6_000_000
WHOLE = ("tinyint", "smallint", "int", "bigint")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder; in a folder of our own only where none is set and Spark is local, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/loomgraph/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "round") -> DataFrame:
    """The table, written to the shared folder and read again: cuts lineage, outlives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def is_stored(df: DataFrame) -> bool:
    """Whether a table is read from the shared folder alone."""
    bare = lambda path: re.sub(r"^[a-z0-9]+:/+", "/", path)
    root, files = bare(shared_path(df.sparkSession, "")).rpartition("/")[0] + "/", df.inputFiles()
    return bool(files) and all(bare(f).startswith(root) for f in files)


def in_one_task(edges: DataFrame, work: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """All rows of the edges to one call of work, whose tuples are the rows that come back. For edges of a checked size."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = work([tuple(r) for r in pdf.drop(columns="_all").itertuples(index=False)])
        return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})

    return edges.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, schema)


class Coded:
    """A graph as arrays: its nodes in order, and the edges as places in them, by one end."""

    def __init__(self, table: pa.Table):
        self.kind = table.schema.field("src").type
        a, b = table["src"].to_numpy(), table["dst"].to_numpy()
        if a.dtype == object:
            both, self.nodes = pd.factorize(np.concatenate([a, b]), sort=True)
            self.src, self.dst = both[: len(a)].astype(np.int32), both[len(a) :].astype(np.int32)
        elif len(a) and (wide := int(max(a.max(), b.max())) - (least := int(min(a.min(), b.min())))) < 8 * len(a):
            met = np.zeros(wide + 1, bool)
            a, b, kind = a.astype(np.int64) - least, b.astype(np.int64) - least, a.dtype
            met[a], met[b] = True, True
            places = (np.cumsum(met) - 1).astype(np.int32)
            self.nodes = (np.flatnonzero(met) + least).astype(kind)
            self.src, self.dst = places[a], places[b]
        else:
            self.nodes = np.unique(np.concatenate([a, b]))
            self.src, self.dst = (np.searchsorted(self.nodes, x).astype(np.int32) for x in (a, b))

    def by(self, near: np.ndarray, far: np.ndarray, *more: np.ndarray) -> tuple:
        """Where each node's edges begin (one number more than nodes), and the far ends and other columns in that order."""
        order = np.argsort(near, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(near, minlength=len(self.nodes)))])
        return tuple(memoryview(np.ascontiguousarray(x)) for x in (starts, far[order], *(m[order] for m in more)))

    def values(self, places: np.ndarray) -> pa.Array:
        return pa.array(self.nodes[places], self.kind)


def coded_in_one_task(edges: DataFrame, work: Callable[[pa.Table, Coded], list], schema: str) -> DataFrame:
    """All edges to one call of work, whose columns come back; nothing for no edges. For edges of a checked size, without null ends."""
    names = [c.split()[0] for c in schema.split(", ")]

    return at_once(edges, lambda table: [pa.table(work(table, Coded(table)), names)], schema)


def at_once(rows: DataFrame, work: Callable[[pa.Table], list[pa.Table]], schema: str) -> DataFrame:
    """All rows to one call of work, whose tables come back; nothing for no rows. Rows travel as whole Arrow batches, so that one task neither encodes nor decodes them one by one."""
    bundles = "rows binary"

    def bundle(b: pa.RecordBatch) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, b.schema) as out:
            out.write_batch(b)
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["rows"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bytes_ in b["rows"]:
                yield from pa.ipc.open_stream(bytes_.as_buffer())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (bundle(b) for b in batches if b.num_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := list(opened(batches)):
            for table in work(pa.Table.from_batches(found)):
                yield from (bundle(b) for b in table.to_batches(1 << 15))

    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows.mapInArrow(pack, bundles).repartition(1).mapInArrow(run, bundles).repartition(tasks).mapInArrow(opened, schema)


def small(edges: DataFrame, limit: int = LOCAL_EDGES) -> bool:
    return edges.count() <= limit


def room(edges: DataFrame) -> int:
    """Edges up to which work on arrays is done in one task."""
    return LOCAL_NUMBERS if id_type(edges) in WHOLE else LOCAL_EDGES


def id_type(edges: DataFrame) -> str:
    return edges.schema["src"].dataType.simpleString()


def reach(edges: DataFrame, starts: list, limit: int = LOCAL_EDGES) -> DataFrame:
    """start, node, depth: the least number of edges from each start to the nodes that it reaches, itself included."""
    spark, kind = edges.sparkSession, id_type(edges)
    pairs = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    schema = f"start {kind}, node {kind}, depth int"
    if small(pairs, limit):

        def work(rows):
            out = defaultdict(list)
            for a, b in rows:
                out[a].append(b)
            found = []
            for start in starts:
                depth, front = {start: 0}, [start]
                while front:
                    level = []
                    for a in front:
                        for b in out.get(a, ()):
                            if b not in depth:
                                depth[b] = depth[a] + 1
                                level.append(b)
                    front = level
                found += [(start, n, d) for n, d in depth.items()]
            return found

        local = in_one_task(pairs, work, schema)
        return local.union(spark.createDataFrame([(s, s, 0) for s in starts], schema)).distinct()
    seen = stored(spark.createDataFrame([(s, s, 0) for s in starts], schema))
    front = seen
    for depth in count(1):
        step = front.join(pairs, front.node == pairs.src).select("start", F.col("dst").alias("node")).distinct()
        front = stored(step.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)).select("start", "node", "depth"))
        if front.isEmpty():
            break
        seen = stored(seen.unionByName(front))
    return seen


def strong_components(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """node, component (its least node), size: strongly connected components of two nodes or more."""
    limit = room(edges) if limit is None else limit
    pairs = stored(edges.select("src", "dst").filter("src <> dst").distinct())
    return _in_components(pairs) if small(pairs, limit) else _coloured(pairs, limit)


def countable(edges: DataFrame) -> bool:
    """Whether survey() can take the edges: ends that are whole numbers, none of them null, and no more than there is room for."""
    if room(edges) != LOCAL_NUMBERS or LOCAL_NUMBERS <= 0:
        return False
    odd = F.col("src").isNull() | F.col("dst").isNull() | F.col("edge_seq").isNull()
    n, bad = edges.agg(F.count("*"), F.count_if(odd)).first()
    return n <= LOCAL_NUMBERS and not bad


def survey(ids: DataFrame, edges: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """What one task finds of a graph that is countable(): a row for each type that edges touch, and for each pair of ends (node, other) with more than one edge.

    Types have component and size (by edges whose ends are both among ids), cyclic, first_seen, ca and ce; pairs the columns of strength.parallel(). Without weights (of kinds, 1 for the
    rest): only types on cycles, and no more of them than component, size and cyclic. edges: src, dst, edge_seq, dep_type.
    """
    kind = id_type(edges)
    schema = f"node {kind}, component {kind}, size long, cyclic boolean, first_seen long, ca long, ce long, other {kind}, n long, kinds long, total long, most int"
    names = [c.split()[0] for c in schema.split(", ")]
    own = edges.select("src", "dst", *([F.col("edge_seq").cast("long").alias("edge_seq"), "dep_type"] if weights else []))
    both = own.unionByName(ids.filter("node_id is not null").select(F.col("node_id").cast(kind).alias("src")), allowMissingColumns=True)

    def work(table: pa.Table) -> list[pa.Table]:
        edge = table["dst"].is_valid()
        found = table.filter(edge)
        if not found.num_rows:
            return []
        parts = _surveyed(found, table["src"].filter(pc.invert(edge)).to_numpy(), weights)
        return [pa.table([part.get(n, pa.nulls(len(part["node"]), TYPES.get(n, found["src"].type))) for n in names], names) for part in parts]

    return at_once(both, work, schema)


TYPES = {"size": pa.int64(), "cyclic": pa.bool_(), "first_seen": pa.int64(), "ca": pa.int64(), "ce": pa.int64(), "n": pa.int64(), "kinds": pa.int64(), "total": pa.int64(), "most": pa.int32()}


def _surveyed(edges: pa.Table, ids: np.ndarray, weights: dict[str, int] | None) -> list[dict[str, pa.Array]]:
    g = Coded(edges)
    n, src, dst = len(g.nodes), g.src, g.dst
    known = np.isin(g.nodes, ids)
    inner = known[src] & known[dst] & (src != dst)
    g.src, g.dst = src[inner], dst[inner]
    part = _component_of(g)
    size = np.bincount(part, minlength=n)[part]
    cyclic = size > 1
    cyclic[src[src == dst]] = True
    at = np.arange(n) if weights else np.flatnonzero(cyclic)
    types = {"node": g.values(at), "component": g.values(part[at]), "size": pa.array(size[at], pa.int64()), "cyclic": pa.array(cyclic[at])}
    if not weights:
        return [types]
    seq = edges["edge_seq"].to_numpy()
    first = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(first, src, seq)
    np.minimum.at(first, dst, seq)
    counted = {name: pa.array(np.bincount(end, minlength=n), pa.int64()) for name, end in (("ca", dst), ("ce", src))}
    key = src.astype(np.int64) * n + dst
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts = np.diff(np.append(starts, len(key)))
    many = counts > 1
    of, counts, starts = order[np.repeat(many, counts)], counts[many], starts[many]
    group = np.repeat(np.arange(len(counts)), counts)
    named = edges["dep_type"].combine_chunks().dictionary_encode()
    codes = named.indices.fill_null(-1).to_numpy(zero_copy_only=False)[of].astype(np.int64)
    heavy = np.array([weights.get(k, 1) for k in [*named.dictionary.to_pylist(), None]], np.int32)[codes]
    most = np.zeros(len(counts), np.int32)
    np.maximum.at(most, group, heavy)
    wide = int(codes.max(initial=0)) + 1
    kinds = np.bincount(np.unique((group * wide + codes)[codes >= 0]) // wide, minlength=len(counts))
    pairs = {
        "node": g.values(src[order[starts]]),
        "other": g.values(dst[order[starts]]),
        "n": pa.array(counts, pa.int64()),
        "kinds": pa.array(kinds, pa.int64()),
        "total": pa.array(np.bincount(group, heavy, len(counts)).astype(np.int64)),
        "most": pa.array(most),
    }
    return [types | {"first_seen": pa.array(first)} | counted, pairs]


def _in_components(pairs: DataFrame) -> DataFrame:
    def work(_, g: Coded) -> list:
        part = _component_of(g)
        size = np.bincount(part, minlength=len(part))[part]
        node = np.flatnonzero(size > 1)
        return [g.values(node), g.values(part[node]), pa.array(size[node], pa.int64())]

    kind = id_type(pairs)
    return coded_in_one_task(pairs, work, f"node {kind}, component {kind}, size long")


#: Passes over a graph's arrays before the rest goes node by node.
PASSES = 200


def _component_of(g: Coded, passes: int = PASSES) -> np.ndarray:
    """The least node of each node's component. Nodes without edges in or out go at once, the rest by colours as in _coloured; a graph of great depth ends with Tarjan's way."""
    n = len(g.nodes)
    part, a, b = np.arange(n, dtype=np.int32), g.src, g.dst
    while len(a) and passes > 0:
        passes -= 1
        into, out = np.zeros(n, bool), np.zeros(n, bool)
        into[b], out[a] = True, True
        inner = (into & out)[a] & (into & out)[b]
        if not inner.all():
            a, b = a[inner], b[inner]
            continue
        label = np.arange(n, dtype=np.int32)
        while passes > 0:
            passes -= 1
            new = label.copy()
            np.minimum.at(new, b, label[a])
            if np.array_equal(new, label):
                break
            label = new
        else:
            break
        same = label[a] == label[b]
        a, b = a[same], b[same]
        met = label == np.arange(n)
        left = True
        while left and passes > 0:
            passes -= 1
            step = a[met[b] & ~met[a]]
            met[step] = True
            left = len(step) > 0
        if left:
            break
        part[met] = np.minimum(part, label)[met]
        rest = ~met[a] & ~met[b]
        a, b = a[rest], b[rest]
    if len(a):
        rest = np.zeros(n, bool)
        rest[a], rest[b] = True, True
        part[rest] = _tarjan(n, *g.by(a, b))[rest]
    return part


def _tarjan(n: int, starts: memoryview, ends: memoryview) -> np.ndarray:
    """The least node of each node's component."""
    index, low, at, on = array("i", bytes(4 * n)), array("i", bytes(4 * n)), array("q", starts[:n]), bytearray(n)
    part = array("i", bytes(4 * n))
    stack, met = [], 0
    for root in range(n):
        if index[root]:
            continue
        met += 1
        index[root] = low[root] = met
        on[root] = 1
        stack.append(root)
        path = [root]
        while path:
            node = path[-1]
            i = at[node]
            if i < starts[node + 1]:
                at[node] = i + 1
                nxt = ends[i]
                if not index[nxt]:
                    met += 1
                    index[nxt] = low[nxt] = met
                    on[nxt] = 1
                    stack.append(nxt)
                    path.append(nxt)
                elif on[nxt] and index[nxt] < low[node]:
                    low[node] = index[nxt]
                continue
            path.pop()
            if path and low[node] < low[path[-1]]:
                low[path[-1]] = low[node]
            if low[node] == index[node]:
                first = len(stack) - 1
                while stack[first] != node:
                    first -= 1
                least = min(stack[first:])
                for x in stack[first:]:
                    part[x] = least
                    on[x] = 0
                del stack[first:]
    return np.frombuffer(part, np.int32)


def trimmed(pairs: DataFrame, enough: int = 0) -> DataFrame:
    """The edges between nodes that have both edges in and edges out, again and again, until no more than enough are left."""
    n = pairs.count()
    while n > enough:
        pairs = stored(pairs.join(pairs.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(pairs.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        n, was = pairs.count(), n
        if n == was:
            break
    return pairs


def _spread(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each node's least label among the nodes that reach it (node, label)."""
    while True:
        sent = labels.join(pairs, labels.node == pairs.src).select(F.col("dst").alias("node"), "label")
        new = stored(labels.unionByName(sent).groupBy("node").agg(F.min("label").alias("label")))
        if new.join(labels, ["node", "label"], "left_anti").isEmpty():
            return new
        labels = new


def _coloured(pairs: DataFrame, limit: int = 0) -> DataFrame:
    """Colouring: the least label that reaches a node forwards; those that its owner is reached from within the colour are a component.

    Edges between components are of no further use; what is left goes to one task as soon as it is within the limit.
    """
    kind = id_type(pairs)
    found = pairs.sparkSession.createDataFrame([], f"node {kind}, component {kind}, size long")
    while True:
        pairs = trimmed(pairs, limit)
        if pairs.isEmpty():
            return found
        if small(pairs, limit):
            return stored(found.unionByName(_in_components(pairs)))
        nodes = pairs.select(F.col("src").alias("node")).union(pairs.select(F.col("dst").alias("node"))).distinct()
        colour = _spread(nodes.withColumn("label", F.col("node")), pairs)
        a, b = (colour.select(F.col("node").alias(n), F.col("label").alias(f"l{n}")) for n in ("src", "dst"))
        inner = stored(pairs.join(a, "src").join(b, "dst").filter("lsrc = ldst").select("src", "dst", F.col("lsrc").alias("label")))
        part = stored(colour.filter("node = label").select("node", "label"))
        front = part
        while True:
            step = front.join(inner, (front.node == inner.dst) & (front.label == inner.label)).select(F.col("src").alias("node"), front.label).distinct()
            front = stored(step.join(part, ["node", "label"], "left_anti"))
            if front.isEmpty():
                break
            part = stored(part.unionByName(front))
        sizes = part.groupBy("label").agg(F.min("node").alias("component"), F.count("*").alias("size")).filter("size > 1")
        found = stored(found.unionByName(part.join(sizes, "label").select("node", "component", "size")))
        gone = part.select("node")
        inner = inner.select("src", "dst")
        pairs = stored(inner.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))


def levels(nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """node, level: the longest path from the node along its dependencies; nodes that are on cycles, or need such, get null.

    nodes has a column node_id; edges to nodes outside it are ignored.
    """
    limit = room(edges) if limit is None else limit
    names = nodes.select(F.col("node_id").alias("node")).distinct()
    pairs = edges.select("src", "dst").distinct()
    pairs = stored(pairs.join(names.withColumnRenamed("node", "src"), "src", "left_semi").join(names.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
    if small(pairs, limit):
        found = _peeled(pairs)
    else:
        left, placed, n = pairs, None, 0
        ends = left.select(F.col("src").alias("node")).union(left.select(F.col("dst").alias("node"))).distinct()
        waiting = stored(ends)
        while not small(left, limit):
            ready = waiting.join(left.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
            ready = stored(ready.withColumn("level", F.lit(n)))
            if ready.isEmpty():
                break
            placed = ready if placed is None else stored(placed.unionByName(ready))
            waiting = stored(waiting.join(ready, "node", "left_anti"))
            left = stored(left.join(ready.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
            n += 1
        if small(left, limit):
            # nodes that nothing is left of have this level
            deeper = _peeled(left).select("node", (F.col("level") + n).alias("level"), F.lit(True).alias("deep"))
            rest = waiting.join(deeper, "node", "left").select("node", F.when(F.col("deep"), F.col("level")).otherwise(n).alias("level"))
        else:
            rest = waiting.withColumn("level", F.lit(None).cast("int"))
        found = rest if placed is None else placed.unionByName(rest)
    return names.join(found.withColumn("met", F.lit(True)), "node", "left").select("node", F.when(F.col("met").isNull(), 0).otherwise(F.col("level")).alias("level"))


def _peeled(pairs: DataFrame) -> DataFrame:
    """node, level of the ends of the edges, in one task."""

    def work(_, g: Coded) -> list:
        n = len(g.nodes)
        needs = array("q", np.bincount(g.src, minlength=n).tobytes())
        starts, users = g.by(g.dst, g.src)
        level = array("i", bytes(4 * n))
        front = [b for b in range(n) if not needs[b]]
        while front:
            nxt = []
            for b in front:
                above = level[b] + 1
                for i in range(starts[b], starts[b + 1]):
                    a = users[i]
                    needs[a] -= 1
                    if above > level[a]:
                        level[a] = above
                    if not needs[a]:
                        nxt.append(a)
            front = nxt
        return [g.values(np.arange(n)), pa.array(np.frombuffer(level, np.int32), pa.int32(), mask=np.frombuffer(needs, np.int64) > 0)]

    return coded_in_one_task(pairs, work, f"node {id_type(pairs)}, level int")


def cheapest(edges: DataFrame, start, limit: int | None = None) -> DataFrame:
    """node, cost, parent: least sums of a column cost (>= 0) from start, and the node before on such a path."""
    kind = id_type(edges)
    limit = room(edges) if limit is None else limit
    best = stored(edges.filter("src is not null and dst is not null").groupBy("src", "dst").agg(F.min("cost").alias("cost")))
    source = edges.sparkSession.createDataFrame([(start, 0.0, None)], f"node {kind}, cost double, parent {kind}")
    if small(best, limit):

        def work(table: pa.Table, g: Coded) -> list:
            starts, ends, costs = g.by(g.src, g.dst, table["cost"].to_numpy())
            first = np.flatnonzero(g.nodes == start)
            cost, parent, heap = {}, {}, [(0.0, int(x), -1) for x in first]
            while heap:
                c, node, before = heapq.heappop(heap)
                if node in cost:
                    continue
                cost[node], parent[node] = c, before
                for i in range(starts[node], starts[node + 1]):
                    if ends[i] not in cost:
                        heapq.heappush(heap, (c + costs[i], ends[i], node))
            met = [n for n in cost if parent[n] >= 0]
            before = np.array([parent[n] for n in met], np.int64)
            return [g.values(np.array(met, np.int64)), pa.array([cost[n] for n in met], pa.float64()), g.values(before)]

        return source.unionByName(coded_in_one_task(best, work, f"node {kind}, cost double, parent {kind}"))
    known = stored(source)
    while True:
        step = known.join(best.withColumnRenamed("cost", "w"), F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.col("src").alias("parent"))
        new = known.unionByName(step).groupBy("node").agg(F.min("cost").alias("cost"), F.min_by("parent", F.struct("cost", "parent")).alias("parent"))
        new = stored(new)
        if new.join(known, ["node", "cost"], "left_anti").isEmpty():
            return new
        known = new


def shortest_chain(edges: DataFrame, start, end, limit: int = LOCAL_EDGES) -> list:
    """The nodes of a shortest path; of equal ones that whose steps come first by edge_seq. Empty if there is none."""
    if start == end:
        return [start]
    depths = stored(reach(edges, [start], limit).select("node", "depth"))
    goal = depths.filter(F.col("node") == F.lit(end)).first()
    if goal is None:
        return []
    # parents, from the first level on: the earliest-queued parent, which was itself queued in order of its parent and edge
    a, b = depths.withColumnsRenamed({"node": "src", "depth": "da"}), depths.withColumnsRenamed({"node": "dst", "depth": "db"})
    steps = stored(edges.join(a, "src").join(b, "dst").filter((F.col("db") == F.col("da") + 1) & (F.col("db") <= goal.depth)).groupBy("src", "dst", "db").agg(F.min("edge_seq").alias("edge_seq")))
    order = stored(depths.filter("depth = 0").select("node", F.lit(0).cast("long").alias("place")))
    parents = []
    for depth in range(1, goal.depth + 1):
        queued = steps.filter(F.col("db") == depth).join(order.withColumnRenamed("node", "src"), "src").groupBy("dst").agg(F.min(F.struct("place", "edge_seq", "src")).alias("by"))
        parents.append(stored(queued.select("dst", "by.*")))
        order = parents[-1].select(F.col("dst").alias("node"), F.struct("place", "edge_seq").alias("by"))
        order = stored(order.select("node", F.col("by.edge_seq").alias("place"))) if depth == 1 else stored(_ranked(order))
    path, at = [end], end
    for level in reversed(parents):
        at = level.filter(F.col("dst") == F.lit(at)).first().src
        path.append(at)
    return path[::-1]


#: Consecutive numbers of a column that are counted together.
RUN = 1 << 16


def numbered(rows: DataFrame, keys: list[Column], seq: str, name: str, then: tuple = (), run: int = RUN) -> DataFrame:
    """rows with their place from 0, in the order of keys, of seq (a whole number) and of the columns then; no two rows are the same in all of these.

    Only a count for each run of numbers goes through one task; rows are numbered within their run.
    """
    named = {f"_k{i}": k for i, k in enumerate([*keys, F.floor(F.col(seq) / F.lit(run))])}
    out = rows.withColumns(named)
    counts = out.groupBy(*named).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(*named).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*(F.col(k).alias(f"{k}_") for k in named), F.coalesce(before, F.lit(0)).alias("_before"))
    out = out.withColumn("_within", F.row_number().over(Window.partitionBy(*named).orderBy(seq, *then)))
    out = out.join(counts, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in named])
    return out.withColumn(name, F.col("_before") + F.col("_within") - 1).drop("_within", "_before", *named, *(f"{k}_" for k in named))


def numbered_and_stored(rows: DataFrame, seq: str, place: str, then: tuple, columns: dict[str, Column], name: str, run: int = RUN) -> DataFrame:
    """columns of the rows, stored, with their place from 0 in the order of seq (a whole number) and of the columns then; no two rows are the same in all of these.

    As numbered(), with one pass over the rows: what comes before each run is added where the table is read.
    """
    part = F.floor(F.col(seq) / F.lit(run))
    within = F.row_number().over(Window.partitionBy("_run").orderBy(seq, *then))
    out = stored(rows.withColumn("_run", part).withColumn("_within", within).select("_run", "_within", *(c.alias(n) for n, c in columns.items())), name)
    counts = out.groupBy("_run").agg(F.max("_within").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    counts = stored(counts.select(F.col("_run").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before")), "runs")
    out = out.join(counts, F.col("_run").eqNullSafe(F.col("_of")))
    return out.select(*columns, (F.col("_before") + F.col("_within") - 1).alias(place))


def _ranked(order: DataFrame) -> DataFrame:
    """Places by (place of the parent, edge): a level of a search is small beside its graph."""
    return order.select("node", F.row_number().over(Window.orderBy("by")).cast("long").alias("place"))
