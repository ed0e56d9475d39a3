"""Operator 5, near-duplicate vectors: a pivot-permutation index.

Pivots are a bounded sample of the vectors. Each vector is described by its PREFIX nearest pivots in order, and entered in the
inverted list of each; two vectors are candidates if they share SHARED pivots of their prefixes, and links if their cosine, in double
precision, is high enough. A pair is met in every list it shares and counted in that of the least shared pivot.

Exact copies are one class, compared once. A list beyond BLOCK classes is split by the second shared pivot: a pair meets in the sublist
of its two least shared pivots, so the split loses no candidate, and only vectors that share two pivots meet. Sublists beyond BLOCK are
cut into blocks by hash, and every two blocks meet in a task of their own, so one of any length is compared whole by many tasks. Pairs
stay in their task: it returns for each vector how many others it links with, and a spanning forest of the links. Rows find their class
by a digest of 128 bits.

Rows whose vec_id, label or vector is null, or whose vector is empty, zero or has null or non-finite components, link with nothing. Vectors of
different length do not link. Repeated rows are vectors of their own, and copies of each other. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored
from .components import components, union

#: Vectors to a pivot, bounds of the number of pivots, length of the described prefix, shared pivots of a candidate, classes to a block.
PIVOT_EVERY, PIVOTS, PREFIX, SHARED, BLOCK = 100, (64, 2048), 8, 2, 2048


def usable() -> Column:
    finite = "not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)"
    return F.expr(f"vec_id is not null and label is not null and embedding is not null and {finite}")


def _pivots(classes: DataFrame, dim: int, n: int) -> np.ndarray:
    """Unit vectors of a sample: those of the classes with the least hash."""
    rows = classes.filter(F.size("embedding") == dim).orderBy(F.xxhash64("rep"), "rep").limit(n).select("embedding").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def links(classes: DataFrame, least: float, stored: Stored, prefix: int = PREFIX, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """For classes (rep, label, embedding, copies): rows of rep, n (copies of classes linked with it, counted in one block) and root."""
    spark = classes.sparkSession
    sizes = {r.dim: r["count"] for r in classes.groupBy(F.size("embedding").alias("dim")).count().collect()}
    most = {dim: max(PIVOTS[0], min(PIVOTS[1], n // PIVOT_EVERY)) for dim, n in sizes.items()}
    pivots = spark.sparkContext.broadcast({dim: _pivots(classes, dim, n) for dim, n in most.items()})

    def describe(batches):
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            near = [None] * len(vectors)
            for dim in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == dim]
                x, p = np.array([vectors[i] for i in at], np.float64), pivots.value[dim]
                best = np.argsort(-(x @ p.T), axis=1, kind="stable")[:, :prefix]
                for i, row in zip(at, best.tolist(), strict=True):
                    near[i] = row
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(near, pa.list_(pa.int32()))], ["rep", "label", "embedding", "copies", "near"])

    described = classes.select("rep", "label", "embedding", "copies").mapInArrow(describe, "rep long, label long, embedding array<double>, copies long, near array<int>")
    described = stored.put(described, "described")
    # the least of a pair's shared pivots has shared - 1 greater ones in both prefixes
    least_shared = F.slice(F.array_sort("near"), F.lit(1), F.greatest(F.size("near") - F.lit(shared - 1), F.lit(0)))
    posted = described.withColumn("dim", F.size("embedding")).withColumn("pivot", F.explode(least_shared))
    key = ["label", "dim", "pivot"]
    # long lists are stored, so that Spark knows their size when it plans the joins: vectors are shuffled for these only where they are many
    if shared > 1:
        long = posted.groupBy(*key).count().filter(F.col("count") > block).select(*key, F.lit(True).alias("long"))
        long = stored.put(long, "long-lists")
        posted = posted.join(long, key, "left").withColumn("second", F.explode(F.expr("if(long, filter(near, x -> x > pivot), array(-1))")))
    else:
        posted = posted.withColumn("second", F.lit(-1))
    key = [*key, "second"]
    long = posted.groupBy(*key).count().filter(F.col("count") > block).select(*key, F.ceil(F.col("count") / F.lit(block)).cast("int").alias("blocks"))
    long = stored.put(long, "long-sublists")
    posted = posted.join(long, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int")
    posted = posted.withColumn("mine", mine).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    posted = posted.select(*key, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep", "embedding", "copies", "near")

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pivot, second, i, j = (key[k].as_py() for k in (2, 3, 4, 5))
        table = table.take(pa.compute.sort_indices(table, [("rep", "ascending")]))
        dim = key[1].as_py()
        x = table.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        near = table.column("near").combine_chunks().flatten().to_numpy().reshape(len(x), -1)
        rep, copies, mine = (table.column(c).to_numpy() for c in ("rep", "copies", "mine"))
        norm = np.linalg.norm(x, axis=1)
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        n, edges = np.zeros(len(x), np.int64), []
        for rows in np.array_split(left, max(1, len(left) * len(right) // 400_000)):
            cosine = (x[rows] @ x[right].T) / (norm[rows][:, None] * norm[right][None])
            a, b = np.nonzero(cosine >= least)
            a, b = rows[a], right[b]
            if i == j:
                a, b = a[a < b], b[a < b]
            count, least_two = np.zeros(len(a), np.int32), np.full((2, len(a)), 1 << 30, np.int64)
            for k in range(near.shape[1]):
                hit = (near[a] == near[b, k][:, None]).any(1)
                count += hit
                other = np.where(hit, near[b, k], 1 << 30)
                least_two = np.stack([np.minimum(least_two[0], other), np.minimum(least_two[1], np.maximum(least_two[0], other))])
            kept = (count >= shared) & (least_two[0] == pivot) & ((second < 0) | (least_two[1] == second))
            a, b = a[kept], b[kept]
            np.add.at(n, a, copies[b])
            np.add.at(n, b, copies[a])
            edges = [*edges, *zip(a.tolist(), b.tolist(), strict=True)] if len(a) < 10_000 else [*edges, *union(zip(a.tolist(), b.tolist(), strict=True)).items()]
        root = union(edges)
        found = np.flatnonzero(n)
        return pa.table({"rep": rep[found], "n": n[found], "root": np.array([rep[root[k]] for k in found.tolist()], np.int64)})

    return posted.groupBy(*key, "i", "j").applyInArrow(meet, "rep long, n long, root long")


def near_duplicates(df: DataFrame, stored: Stored, least: float = 0.93, **index) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vec_id, embedding, label."""
    rows = df.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    digest = {f"key{i}": F.xxhash64(F.lit(i), "label", "embedding") for i in (1, 2)}
    good = rows.filter(usable()).withColumns(digest)
    classes = stored.put(good.groupBy("key1", "key2", "label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    found = stored.put(links(classes, least, stored, **index), "links")
    stored.drop("described", "long-lists", "long-sublists")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = components(found.select("rep", "root"), stored)
    each = classes.join(counts, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    each = each.select("key1", "key2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = good.select("vec_id", "key1", "key2").join(each, ["key1", "key2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.coalesce(usable(), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
