"""Connected components of links that no single machine holds: large-star and small-star rounds on tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored


def union(pairs) -> dict[int, int]:
    """Each node's least node among those that pairs connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in pairs:
        a, b = root(a), root(b)
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    return {x: root(x) for x in list(parent)}


def _contract(edges: DataFrame) -> DataFrame:
    """In each partition, stars about least nodes instead of its edges: as many rows as nodes at most."""

    def run(batches):
        pairs: list[tuple[int, int]] = []
        most = 500_000
        for batch in batches:
            pairs += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            if len(pairs) > most:
                pairs = [(x, r) for x, r in union(pairs).items() if x != r]
                most = max(most, 2 * len(pairs))
        stars = [(x, r) for x, r in union(pairs).items() if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in stars], pa.int64()) for i in (0, 1)], ["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, stored: Stored, rounds: int = 60) -> DataFrame:
    """node and component (its least node) for every node of the edges (two long columns); links to oneself are dropped.

    Every edge of a round has its larger end first. A round hangs each node's larger neighbours on the least node about it
    (large-star), then a node and its smaller neighbours on the least of those (small-star). It ends when stars are all that is left.
    """
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")
    now = stored.put(_contract(now).distinct(), "stars-0")
    state = None
    for n in range(1, rounds + 1):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).filter("u <> v")
        now = stored.put(_contract(small).distinct(), f"stars-{n}")
        stored.drop(f"stars-{n - 1}")
        was, state = state, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if was == state:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
