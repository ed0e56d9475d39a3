"""The dependency graph: a table of nodes and a table of typed edges, and the relational queries over them."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strength
from ..functions.literals import WEIGHTS
from ..plans import iterate

#: Types (and pairs with more than one edge, with the types that edges touch) up to which every task gets them whole (about 40 bytes each by estimate).
KNOWN_TYPES = 4_000_000


class DependencyGraph:
    """nodes: node_id, name, namespace, project, kind, is_abstract, is_sealed, is_static, node_seq. edges: edge_seq, src, dst, dep_type, member_name.

    Edges may end at types that are not nodes. Duplicate node_ids keep the first by node_seq. stored: the edges are read from a stored table, and may be read again.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, stored: bool = False):
        self.ids = nodes.select("node_id")
        if "node_seq" not in nodes.columns:
            nodes = nodes.withColumn("node_seq", F.col("node_id"))
        self.raw = nodes
        first = Window.partitionBy("node_id").orderBy("node_seq")
        self.nodes = nodes.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
        self.edges = edges
        if stored:
            self.drawn = self

    @cached_property
    def drawn(self) -> DependencyGraph:
        """The same graph, its edges written to the shared folder."""
        out = object.__new__(type(self))
        out.ids, out.raw, out.nodes, out.edges = self.ids, self.raw, self.nodes, iterate.stored(self.edges, "edges")
        out.drawn = out
        return out

    @cached_property
    def held(self) -> DependencyGraph:
        """The same graph, its tables written to the shared folder: for work that reads them more than once."""
        out = object.__new__(type(self))
        with ThreadPoolExecutor(2) as both:
            nodes, drawn = both.submit(iterate.stored, self.nodes, "nodes"), both.submit(lambda: self.drawn)
            out.nodes, out.edges = nodes.result(), drawn.result().edges
        out.raw, out.ids = out.nodes, out.nodes.select("node_id")
        out.held = out.drawn = out
        return out

    # lookups

    def node(self, node_id) -> DataFrame:
        return self.nodes.filter(F.col("node_id") == F.lit(node_id))

    def nodes_by_project(self, project: str) -> DataFrame:
        return self.nodes.filter(F.col("project") == F.lit(project))

    @cached_property
    def inner_edges(self) -> DataFrame:
        """Edges whose two ends are nodes."""
        ids = self.nodes.select("node_id")
        return self.edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(*self.edges.columns)

    def dependencies_of(self, node_id) -> DataFrame:
        return self.inner_edges.filter(F.col("src") == F.lit(node_id))

    def dependents_of(self, node_id) -> DataFrame:
        return self.inner_edges.filter(F.col("dst") == F.lit(node_id))

    def dependents_from_graph(self, node_id) -> DataFrame:
        """Edges to a type, whether it is a node or not."""
        return self.edges.filter(F.col("dst") == F.lit(node_id))

    def types_with_dependents(self) -> DataFrame:
        return self.edges.select(F.col("dst").alias("node_id")).distinct()

    def targets_of(self, node_id) -> DataFrame:
        """The nodes that a node depends on."""
        return self.nodes.join(self.dependencies_of(node_id).select(F.col("dst").alias("node_id")).distinct(), "node_id", "left_semi")

    def without_system_types(self) -> DataFrame:
        return self.nodes.filter(~is_system(F.col("namespace")))

    def cross_project(self) -> DataFrame:
        """Edges whose ends' projects differ; a type that is no node has none, and none equals none."""
        ids = self.nodes.select("node_id", "project")
        out = self.edges.join(ids.select(F.col("node_id").alias("src"), F.col("project").alias("src_project")), "src", "left")
        out = out.join(ids.select(F.col("node_id").alias("dst"), F.col("project").alias("dst_project")), "dst", "left")
        return out.filter(~F.col("src_project").eqNullSafe(F.col("dst_project")))

    # degrees

    @cached_property
    def degrees(self) -> DataFrame:
        """node_id, node_seq, fan_in, fan_out of every node."""
        incoming = self.edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("fan_in"))
        outgoing = self.edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("fan_out"))
        return self.nodes.select("node_id", "node_seq").join(incoming, "node_id", "left").join(outgoing, "node_id", "left").fillna({"fan_in": 0, "fan_out": 0})

    @cached_property
    def analysis(self) -> DataFrame:
        """Degrees beside their averages: is_stable has more in and less out than average, is_unstable the reverse."""
        means = self.degrees.agg(F.avg("fan_in").alias("avg_in"), F.avg("fan_out").alias("avg_out"))
        out = self.degrees.join(F.broadcast(means))  # one row
        more_in, less_in = F.col("fan_in") > F.col("avg_in"), F.col("fan_in") < F.col("avg_in")
        more_out, less_out = F.col("fan_out") > F.col("avg_out"), F.col("fan_out") < F.col("avg_out")
        ratio = F.when(F.col("fan_out") > 0, F.col("fan_in") / F.col("fan_out")).otherwise(F.col("fan_in").cast("double"))
        return out.withColumns({"fan_ratio": ratio, "is_stable": more_in & less_out, "is_unstable": more_out & less_in})

    def fan_in_out(self) -> DataFrame:
        """The analysis, largest total degree first."""
        return self.analysis.orderBy((F.col("fan_in") + F.col("fan_out")).desc(), "node_seq")

    def high_fan_in(self, threshold: int = 10) -> DataFrame:
        return self.degrees.filter(F.col("fan_in") >= threshold)

    def high_fan_out(self, threshold: int = 10) -> DataFrame:
        return self.degrees.filter(F.col("fan_out") >= threshold)

    def stable_types(self) -> DataFrame:
        return self.analysis.filter("is_stable")

    def unstable_types(self) -> DataFrame:
        return self.analysis.filter("is_unstable")

    def is_stable(self, node_id) -> bool:
        return not self.stable_types().filter(F.col("node_id") == F.lit(node_id)).isEmpty()

    def is_unstable(self, node_id) -> bool:
        return not self.unstable_types().filter(F.col("node_id") == F.lit(node_id)).isEmpty()

    def most_dependencies(self, n: int = 10) -> DataFrame:
        return self.degrees.orderBy(F.desc("fan_out"), "node_seq").limit(n)

    def most_dependents(self, n: int = 10) -> DataFrame:
        return self.degrees.orderBy(F.desc("fan_in"), "node_seq").limit(n)

    def bidirectional(self) -> DataFrame:
        """Edges for whose ends there is an edge the other way."""
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
        return self.edges.join(back, ["src", "dst"], "left_semi")

    def instability(self) -> DataFrame:
        """node_id, ca, ce and ce / (ca + ce), 0 where both are 0."""
        share = F.when(F.col("fan_in") + F.col("fan_out") == 0, 0.0).otherwise(F.col("fan_out") / (F.col("fan_in") + F.col("fan_out")))
        return self.degrees.select("node_id", F.col("fan_in").alias("ca"), F.col("fan_out").alias("ce"), share.alias("instability"))

    def coupling_intensity(self) -> DataFrame:
        """Edges with min(1, (ca of the target + ce of the source) / 20)."""
        ca = self.edges.groupBy("dst").agg(F.count("*").alias("ca"))
        ce = self.edges.groupBy("src").agg(F.count("*").alias("ce"))
        return self.edges.join(ca, "dst").join(ce, "src").withColumn("intensity", F.least(F.lit(1.0), (F.col("ca") + F.col("ce")) / 20.0))

    # reachability

    def dependency_scope(self, node_id) -> DataFrame:
        """node_id, depth of all nodes that a node needs, itself included; none for a type that is no node."""
        return self._scope(node_id, self.inner_edges)

    def impact_scope(self, node_id) -> DataFrame:
        """The same for all nodes that need it."""
        return self._scope(node_id, _reversed(self.inner_edges))

    def _scope(self, node_id, edges: DataFrame) -> DataFrame:
        found = iterate.reach(edges, [node_id]).select(F.col("node").alias("node_id"), "depth")
        return found.join(self.nodes.select("node_id"), "node_id", "left_semi")

    def dependency_scores(self, starts: list) -> DataFrame:
        return self._scores(starts, self.inner_edges)

    def impact_scores(self, starts: list) -> DataFrame:
        return self._scores(starts, _reversed(self.inner_edges))

    def _scores(self, starts: list, edges: DataFrame) -> DataFrame:
        found = iterate.reach(edges, starts).join(self.nodes.select(F.col("node_id").alias("start")), "start", "left_semi")
        return found.groupBy(F.col("start").alias("node_id")).agg(F.count("*").alias("score"))

    def dependency_chain(self, start, end) -> list:
        return iterate.shortest_chain(self.inner_edges, start, end)

    def dependent_chain(self, start, end) -> list:
        return iterate.shortest_chain(_reversed(self.inner_edges), start, end)

    def distance(self, start, end) -> int:
        """Edges on a shortest path: 0 to itself, -1 if there is none."""
        if start == end:
            return 0
        row = iterate.reach(self.inner_edges, [start]).filter(F.col("node") == F.lit(end)).first()
        return row.depth if row else -1

    def all_paths(self, start, end, max_depth: int) -> DataFrame:
        """path (array): simple paths of at most max_depth edges, taken in either direction; parallel edges give parallel paths."""
        spark = self.edges.sparkSession
        both = self.edges.select("src", "dst").unionAll(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        open_ = spark.createDataFrame([(start,)], f"node {iterate.id_type(self.edges)}").withColumn("path", F.array("node"))
        done = open_.filter(F.col("node") == F.lit(end))
        for _ in range(max_depth):
            open_ = open_.filter(F.col("node") != F.lit(end))
            step = open_.join(both, F.col("node") == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
            open_ = iterate.stored(step.select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path")))
            if open_.isEmpty():
                break
            done = done.unionAll(open_.filter(F.col("node") == F.lit(end)))
        return done.select("path")

    def strongest_path(self, start, end) -> list:
        """Nodes of the path with the least sum of 1 - strength; empty if there is none."""
        costs = self.scores("src", "dst", "strength").select("src", "dst", F.greatest(F.lit(0.0), 1 - F.col("strength")).alias("cost"))
        known = iterate.stored(iterate.cheapest(costs, start))
        path, at = [], end
        while at is not None:
            row = known.filter(F.col("node") == F.lit(at)).first()
            if row is None:
                return []
            path.append(at)
            at = None if at == start else row.parent
        return path[::-1]

    # cycles and order

    @cached_property
    def knots(self) -> DataFrame | None:
        """Types on cycles (node, component, size, cyclic) by one task; none where the edges are too many for it."""
        if self.drawn is not self:
            return self.drawn.knots
        if self.__dict__.get("survey") is not None:
            return self.survey
        return iterate.stored(iterate.survey(self.ids, self.edges), "knots") if self.countable else None

    @cached_property
    def survey(self) -> DataFrame | None:
        """All that one task finds of the types and pairs of the edges; none where these are too many for it."""
        if self.drawn is not self:
            return self.drawn.survey
        return iterate.stored(iterate.survey(self.ids, self.edges, WEIGHTS), "survey") if self.countable else None

    @cached_property
    def countable(self) -> bool:
        return iterate.countable(self.edges)

    @cached_property
    def components(self) -> DataFrame:
        if self.drawn is not self:
            return self.drawn.components
        if self.knots is not None:
            return self.knots.filter("size > 1").select("node", "component", "size")
        return iterate.stored(iterate.strong_components(self.inner_edges), "components")

    @cached_property
    def cyclic(self) -> DataFrame:
        """node_id of types on a cycle: in a strong component of two or more, or with an edge to itself."""
        if self.knots is not None:
            return self.knots.filter("cyclic").select(F.col("node").alias("node_id"))
        own = self.drawn.edges.filter("src = dst").select(F.col("src").alias("node_id"))
        return self.components.select(F.col("node").alias("node_id")).union(own).distinct()

    def is_in_cycle(self, node_id) -> bool:
        return not self.cyclic.filter(F.col("node_id") == F.lit(node_id)).isEmpty()

    @cached_property
    def dependency_levels(self) -> DataFrame:
        """node_id, level: dependencies lie on lower levels. Edges within a strong component that lead to a later node are not counted."""
        if self.held is not self:
            return self.held.dependency_levels
        part = self.components.select("node", "component")
        edges = self.inner_edges.select("src", "dst").filter("src <> dst").distinct()
        edges = edges.join(part.select(F.col("node").alias("src"), F.col("component").alias("cs")), "src", "left").join(part.select(F.col("node").alias("dst"), F.col("component").alias("cd")), "dst", "left")
        seq = self.nodes.select("node_id", "node_seq")
        edges = edges.join(seq.select(F.col("node_id").alias("src"), F.col("node_seq").alias("qs")), "src").join(seq.select(F.col("node_id").alias("dst"), F.col("node_seq").alias("qd")), "dst")
        kept = edges.filter("not coalesce(cs = cd, false) or qs > qd")
        return iterate.stored(iterate.levels(self.nodes, kept).withColumnRenamed("node", "node_id"), "levels")

    def topological_order(self, dependents_first: bool = True, on_cycle: str = "break") -> DataFrame:
        """node_id, level, processing_order. on_cycle: break (each node once), ignore (nodes on cycles left out), fail."""
        if on_cycle == "fail" and not self.cyclic.isEmpty():
            raise ValueError("the graph has cycles")
        out = self.dependency_levels
        if on_cycle == "ignore":
            out = out.join(self.cyclic, "node_id", "left_anti")
        out = out.join(self.held.nodes.select("node_id", "node_seq"), "node_id")
        by = -F.col("level") if dependents_first else F.col("level")
        return iterate.numbered(out, [by], "node_seq", "processing_order").select("node_id", "level", F.col("processing_order").cast("int").alias("processing_order"))

    def processing_plan(self) -> DataFrame:
        """Levels with degrees, cycle marks, and whether a node needs none of its own level."""
        level = self.dependency_levels
        same = self.held.inner_edges.join(level.select(F.col("node_id").alias("src"), F.col("level").alias("ls")), "src").join(level.select(F.col("node_id").alias("dst"), F.col("level").alias("ld")), "dst")
        tied = same.filter("ls = ld").select(F.col("src").alias("node_id")).distinct().withColumn("tied", F.lit(True))
        marked = self.cyclic.withColumn("is_cyclic", F.lit(True))
        out = level.join(self.held.degrees, "node_id").join(marked, "node_id", "left").join(tied, "node_id", "left").fillna({"is_cyclic": False})
        return out.withColumn("can_parallel", F.col("tied").isNull()).select("node_id", "level", "fan_in", "fan_out", "is_cyclic", "can_parallel")

    # strength

    @cached_property
    def scored(self) -> DataFrame:
        return self.scores(*self.edges.columns, *strength.ADDED)

    def scores(self, *columns: str) -> DataFrame:
        """Columns of scored; the others are not made where that can be saved."""
        if "scored" in self.__dict__:
            return self.scored.select(*columns)
        return self.scorer(list(columns))

    @cached_property
    def scorer(self) -> Callable[[list[str]], DataFrame]:
        if self.drawn is not self:
            return self.drawn.scorer
        if self.countable and self._whole_ids:
            with ThreadPoolExecutor(2) as each:
                found, classes = each.submit(lambda: self.survey), each.submit(self._coded, self.raw)
                known = self._known(found.result(), classes.result())
            if known is not None:
                return lambda columns: strength.score_known(self.edges, known, columns)
        scores = self._joined_scores()
        return lambda columns: scores.select(*columns)

    @property
    def _whole_ids(self) -> bool:
        return all(t.simpleString() in iterate.WHOLE for t in (self.edges.schema["src"].dataType, self.edges.schema["dst"].dataType, self.raw.schema["node_id"].dataType))

    def _coded(self, nodes: DataFrame) -> DataFrame:
        return iterate.stored(strength.coded_classes(nodes), "classes")

    def _known(self, found: DataFrame, classes: DataFrame) -> Broadcast | None:
        if not iterate.small(found, KNOWN_TYPES) or not iterate.small(classes, KNOWN_TYPES):
            return None
        seen = found.filter("other is null").select(F.col("node").alias("node_id"), "first_seen", "ca", "ce", "cyclic")
        pairs = found.filter("other is not null").select(F.col("node").alias("_a"), F.col("other").alias("_b"), "n", "kinds", "total", "most")
        types = iterate.stored(classes.join(seen.hint("shuffle_hash"), "node_id", "left").fillna({"ca": 0, "ce": 0, "cyclic": False}), "context")
        known = strength.Known(types.toArrow(), pairs.toArrow())
        if not known.once():
            return self._known(found, self._coded(self.nodes))
        return self.edges.sparkSession.sparkContext.broadcast(vars(known))

    def _joined_scores(self) -> DataFrame:
        """The scores by joins."""
        used = [c for c in strength.context_columns() if c not in ("name", "cyclic")]
        with ThreadPoolExecutor(3) as each:
            classes = each.submit(iterate.stored, strength.classes(self.nodes).select("node_id", *(c for c in used if c not in ("first_seen", "ca", "ce"))), "classes")
            found = self.survey
            if found is not None:
                seen = found.filter("other is null").select(F.col("node").alias("node_id"), "first_seen", "ca", "ce", "cyclic")
                types = classes.result().join(seen, "node_id", "left").fillna({"ca": 0, "ce": 0, "cyclic": False})
                pairs = found.filter("other is not null").select(F.col("node").alias("_a"), F.col("other").alias("_b"), "n", "kinds", "total", "most")
                return strength.score(self.edges, iterate.stored(types, "context"), pairs)
            cyclic = each.submit(lambda: self.cyclic)
            pairs = each.submit(iterate.stored, strength.parallel(self.edges), "pairs")
            types = iterate.stored(strength.touched(classes.result(), self.edges), "context")
        return strength.score(self.edges, strength.marked(types, cyclic.result()), pairs.result())

    @cached_property
    def rated(self) -> DataFrame:
        """The scores beside the ends of their edges, stored: for work that reads them more than once."""
        if self.drawn is not self:
            return self.drawn.rated
        return iterate.stored(self.scores("edge_seq", "src", "dst", *strength.DIMENSIONS, "composite", "strength", "profile"), "rated")

    def with_patterns(self) -> DataFrame:
        """The edges with their edge_pattern alone, which needs no cycles."""
        if self._whole_ids:
            classes = self._coded(self.raw)
            if iterate.small(classes, KNOWN_TYPES):
                known = strength.Known(classes.toArrow())
                if not known.once():
                    known = strength.Known(self._coded(self.nodes).toArrow())
                return strength.pattern_known(self.edges, self.edges.sparkSession.sparkContext.broadcast(vars(known)), [*self.edges.columns, "edge_pattern"])
        return strength.with_pattern(self.edges, iterate.stored(strength.classes(self.nodes).select("node_id", "namespace", "kind", "traits"), "classes"))

    def by_profile(self, profile: str) -> DataFrame:
        return self.scored.filter(F.col("profile") == profile)

    def by_pattern(self, pattern: str) -> DataFrame:
        return self.scored.filter(F.col("edge_pattern") == pattern)

    def strongest(self, n: int = 20, by: str = "strength") -> DataFrame:
        return self.scored.orderBy(F.desc(by), "edge_seq").limit(n)

    def weakest(self, n: int = 20) -> DataFrame:
        return self.scored.orderBy("strength", "edge_seq").limit(n)

    def strongest_of_each(self, n: int = 10, role: str = "src") -> DataFrame:
        w = Window.partitionBy(role).orderBy(F.desc("strength"), "edge_seq")
        return self.scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)

    def relationship_strength(self) -> DataFrame:
        """src, dst and the mean strength of their edges, weighted."""
        return self.scores("src", "dst", "strength", "weight").groupBy("src", "dst").agg((F.sum(F.col("strength") * F.col("weight")) / F.sum("weight")).alias("strength"))

    def top_by_mean(self, column: str, n: int) -> DataFrame:
        """Types with the largest mean of a column over their edges."""
        return self.scores("src", column).groupBy("src").agg(F.avg(column).alias("mean")).orderBy(F.desc(F.round("mean", 9)), "src").limit(n)

    def processing_edges(self, order: DataFrame) -> DataFrame:
        """Edges by the order of their target, then source, then kind; ends without a place come last."""
        place = order.select("node_id", "processing_order")
        out = self.edges.join(place.select(F.col("node_id").alias("dst"), F.col("processing_order").alias("target_order")), "dst", "left")
        out = out.join(place.select(F.col("node_id").alias("src"), F.col("processing_order").alias("source_order")), "src", "left")
        return out.orderBy(F.asc_nulls_last("target_order"), F.asc_nulls_last("source_order"), "dep_ord", "edge_seq")

    def processing_places(self, order: DataFrame) -> DataFrame:
        """All edges with their place, from 1, in that order. Only the counts of each kind of edge between two levels go through one task."""
        kind = ["target_order", "source_order", "dep_ord"]
        edges = self.processing_edges(order)
        first = Window.orderBy(*map(F.asc_nulls_last, kind)).rowsBetween(Window.unboundedPreceding, -1)
        counts = edges.groupBy(*kind).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(first), F.lit(0)))
        counts = counts.select(*(F.col(k).alias(f"_{k}") for k in kind), "_before")
        within = F.row_number().over(Window.partitionBy(*kind).orderBy("edge_seq"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in kind]
        return edges.withColumn("_within", within).join(counts, same).withColumn("place", F.col("_before") + F.col("_within")).drop("_before", "_within", *(f"_{k}" for k in kind))


def is_system(namespace: Column) -> Column:
    return F.coalesce(namespace, F.lit("")).rlike("^(System|Microsoft|mscorlib)")


def _reversed(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})
