"""The six-dimensional strength of an edge, as arithmetic on Arrow batches of edges that carry both ends' context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from .classify import EDGE_PATTERNS, LAYERS, PATTERNS, Lowered, edge_pattern, edge_pattern_of, layer, traits, type_pattern
from .literals import CHANGE_FREQUENCY, DIMENSION_WEIGHTS, ENHANCED_WEIGHTS, WEIGHTS, lookup, weight

DIMENSIONS = ["structural", "semantic", "coupling", "stability", "criticality", "testability"]
_CONTEXT = ["name", "namespace", "kind", "is_abstract", "is_sealed", "is_static", "pattern", "layer", "traits", "first_seen", "ca", "ce", "freq", "cyclic"]


def context_columns() -> list[str]:
    return list(_CONTEXT)


def classes(nodes: DataFrame) -> DataFrame:
    """One row per type: what its name and namespace say of it."""
    own = ["node_id", "name", "namespace", "kind", "is_abstract", "is_sealed", "is_static"]
    low = nodes.select(*own, F.lower("name").alias("_name"), F.lower("namespace").alias("_ns"))  # once for all rules
    name, ns = F.col("_name"), F.col("_ns")
    known = low.select(*own, type_pattern(name, ns, True).alias("pattern"), layer(ns, True).alias("layer"), traits(name, ns, True).alias("traits"))
    return known.withColumn("freq", lookup(CHANGE_FREQUENCY, F.col("pattern"), 0.2))


def coded_classes(nodes: DataFrame) -> DataFrame:
    """node_id, namespace and code of every node: what classes() says of it, in bits."""
    flag = lambda test, at: F.when(test, F.lit(1 << at)).otherwise(F.lit(0))
    flags = flag(F.col("kind") == "Interface", 16) + flag(F.col("is_abstract"), 17) + flag(F.col("is_sealed"), 18) + flag(F.col("is_static"), 19)
    nodes = nodes.filter("node_id is not null").repartition(nodes.sparkSession.sparkContext.defaultParallelism, "node_id")  # a small file makes few tasks
    low = nodes.select("node_id", "namespace", flags.cast("int").alias("code"), F.lower("name").alias("_name"), F.lower("namespace").alias("_ns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                name, ns = Lowered(b["_name"]), Lowered(b["_ns"])
                code = b["code"].to_numpy() | type_pattern(name, ns) | layer(ns) << 3 | traits(name, ns) << 6
                yield pa.RecordBatch.from_arrays([b["node_id"], b["namespace"], pa.array(code, pa.int32())], names=["node_id", "namespace", "code"])

    return low.mapInArrow(run, StructType([low.schema[c] for c in ("node_id", "namespace", "code")]))


class Known:
    """What scores need of types and pairs, as arrays that every task gets whole; the last type stands for ends that are no nodes.

    types: the rows of coded_classes() and, for whole scores, first_seen, ca, ce and cyclic; pairs: those of parallel().
    """

    def __init__(self, types: pa.Table, pairs: pa.Table | None = None):
        ids = types["node_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        take = lambda values, last, kind: np.append(values[order], last).astype(kind)
        spaces = types["namespace"].fill_null("").dictionary_encode().unify_dictionaries().combine_chunks()
        self.spaces = [*spaces.dictionary.to_pylist(), ""]
        roots = {}
        self.roots = np.array([roots.setdefault(s.split(".")[0].lower(), len(roots)) for s in self.spaces], np.int32)
        self.space = take(spaces.indices.to_numpy(), len(self.spaces) - 1, np.int32)
        self.code = take(types["code"].to_numpy(), len(PATTERNS) - 1 | len(LAYERS) - 1 << 3, np.int32)
        if pairs is not None:
            self.first_seen = take(types["first_seen"].fill_null(np.iinfo(np.int64).max).to_numpy(), np.iinfo(np.int64).max, np.int64)
            self.ca, self.ce = (take(types[c].to_numpy(), 0, np.int64) for c in ("ca", "ce"))
            self.cyclic = take(types["cyclic"].to_numpy(), False, bool)
            a, b = pairs["_a"].to_numpy(), pairs["_b"].to_numpy()
            self.ends = np.unique(np.concatenate([a, b]))
            keys = self._key(a, b)
            order = np.argsort(keys)
            self.keys = keys[order]
            self.pairs = {c: np.append(pairs[c].to_numpy()[order], 1) for c in ("n", "kinds", "total", "most")}

    @classmethod
    def of(cls, arrays: dict) -> Known:
        """From the arrays, which travel by themselves: where tasks run, this package need not be installed."""
        out = cls.__new__(cls)
        out.__dict__ |= arrays
        return out

    def once(self) -> bool:
        """Whether no node comes twice."""
        return not (self.ids[1:] == self.ids[:-1]).any()

    def _key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = len(self.ends)
        a, b = _places(self.ends, a), _places(self.ends, b)
        return np.where((a < n) & (b < n), a * (n + 1) + b, -1)

    def pair(self, a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
        at = _places(self.keys, self._key(a, b)) if len(self.keys) else np.zeros(len(a), np.int64)
        return {c: values[at] for c, values in self.pairs.items()}


def _places(found: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where values are in an array in order; those that are not there get its length."""
    if not len(found):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(found, values), len(found) - 1)
    return np.where(found[at] == values, at, len(found))


def context(nodes: DataFrame, edges: DataFrame, cyclic: DataFrame) -> DataFrame:
    """One row per type: its class, when an edge first touched it, edge counts, change frequency, whether it is on a cycle."""
    return marked(touched(classes(nodes), edges), cyclic)


def touched(types: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of classes() with when an edge first touched a type, and its edge counts."""
    ends = edges.select(F.col("src").alias("node_id"), "edge_seq", F.lit(0).alias("ca"), F.lit(1).alias("ce")).unionByName(
        edges.select(F.col("dst").alias("node_id"), "edge_seq", F.lit(1).alias("ca"), F.lit(0).alias("ce"))
    )
    seen = ends.groupBy("node_id").agg(F.min("edge_seq").alias("first_seen"), F.sum("ca").alias("ca"), F.sum("ce").alias("ce"))
    return types.join(seen, "node_id", "left").fillna({"ca": 0, "ce": 0})


def marked(types: DataFrame, cyclic: DataFrame) -> DataFrame:
    return types.join(cyclic.select("node_id", F.lit(True).alias("cyclic")), "node_id", "left").fillna({"cyclic": False})


def parallel(edges: DataFrame) -> DataFrame:
    """Pairs of ends (_a, _b) with more than one edge: n, distinct kinds, and their weights' total and most."""
    w = weight(F.col("dep_type"))
    return edges.groupBy(F.col("src").alias("_a"), F.col("dst").alias("_b")).agg(F.count("*").alias("n"), F.count_distinct("dep_type").alias("kinds"), F.sum(w).alias("total"), F.max(w).alias("most")).filter("n > 1")


def with_context(edges: DataFrame, ctx: DataFrame) -> DataFrame:
    """Edges with s_ and t_ columns; patterns and layers count only from the edge after the one that first touches a type."""
    for role, end in (("s", "src"), ("t", "dst")):
        side = ctx.select(F.col("node_id").alias(end), *[F.col(c).alias(f"{role}_{c}") for c in _CONTEXT if c in ctx.columns])
        edges = edges.join(side.hint("shuffle_hash"), end, "left")  # without sorting the edges
        late = F.col(f"{role}_first_seen") < F.col("edge_seq")
        for c in ("pattern", "layer"):
            edges = edges.withColumn(f"{role}_seen_{c}", F.when(late, F.col(f"{role}_{c}")).otherwise("Unknown"))
        edges = edges.fillna({f"{role}_ca": 0, f"{role}_ce": 0, f"{role}_freq": 0.0, f"{role}_cyclic": False, f"{role}_is_abstract": False, f"{role}_is_sealed": False, f"{role}_is_static": False, f"{role}_traits": 0})
    return edges


def with_pattern(edges: DataFrame, types: DataFrame) -> DataFrame:
    """Edges with their edge_pattern alone. types: the rows of classes()."""
    out = edges
    for role, end in (("s", "src"), ("t", "dst")):
        out = out.join(types.select(F.col("node_id").alias(end), *[F.col(c).alias(f"{role}_{c}") for c in ("namespace", "kind", "traits")]), end, "left").fillna({f"{role}_traits": 0})
    return out.select(*edges.columns, _pattern().alias("edge_pattern"))


def _pattern() -> Column:
    c = F.col
    return edge_pattern(c("dep_type"), c("s_traits"), c("t_traits"), c("s_namespace"), c("t_namespace"), _interface())


def _interface() -> Column:
    return F.coalesce(F.col("t_kind") == "Interface", F.lit(False))


class Coded:
    """A text column as numbers of its distinct values; null is the last."""

    def __init__(self, column: pa.Array):
        found = column.dictionary_encode()
        self.values = [*found.dictionary.to_pylist(), None]
        self.codes = found.indices.fill_null(len(self.values) - 1).to_numpy(zero_copy_only=False)

    @classmethod
    def of(cls, values, codes: np.ndarray) -> Coded:
        out = cls.__new__(cls)
        out.values, out.codes = values, codes
        return out

    def isin(self, *values: str) -> np.ndarray:
        return self.look(dict.fromkeys(values, True), False)

    def look(self, table: dict, default) -> np.ndarray:
        return np.array([table.get(v, default) for v in self.values])[self.codes]

    def __eq__(self, value: str) -> np.ndarray:
        return self.look({value: True}, False)

    def has(self, *parts: str) -> np.ndarray:
        return np.array([any(p in (v or "").lower() for p in parts) for v in self.values])[self.codes]


def _first(*cases: tuple[np.ndarray, float], other: float) -> np.ndarray:
    return np.select([test for test, _ in cases], [value for _, value in cases], other)


def _mean(*parts: np.ndarray) -> np.ndarray:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total / float(len(parts))


def _cohesion(a: Coded, b: Coded) -> np.ndarray:
    pairs, at = np.unique(a.codes.astype(np.int64) * len(b.values) + b.codes, return_inverse=True)
    found = []
    for x, y in ((a.values[p // len(b.values)], b.values[p % len(b.values)]) for p in pairs.tolist()):
        found.append(0.8 if x == y else 0.6 if x.startswith(y) or y.startswith(x) else 0.4)
    return np.array(found, np.float64)[at]


def _joined(b: pa.RecordBatch) -> dict:
    """What scores are made of, from a batch with the columns of _scoring_columns()."""
    out = {n: b[f"_{n}"].to_numpy(zero_copy_only=False).astype(bool) for n in ("interface", "abstract", "sealed", "static", "loop")}
    out |= {n: b[f"_{n}"].to_numpy(zero_copy_only=False) for n in ("around", "touched", "sf", "tf", "n", "kinds", "total", "most")}
    out |= {n: Coded(b[f"_{n}"]) for n in ("sp", "tp", "sl", "tl")}
    spaces = [Coded(b[c].fill_null("")) for c in ("_sns", "_tns")]
    return out | {"kind": Coded(b["dep_type"]), "member": Coded(b["member_name"]), "pattern": Coded(b["edge_pattern"]), "cohesion": _cohesion(*spaces)}


def _looked_up(b: pa.RecordBatch, known: Known) -> dict:
    """The same from a batch of edges and what is known of their ends."""
    a, z = b["src"].to_numpy(), b["dst"].to_numpy()
    seq, n = b["edge_seq"].to_numpy(), len(known.ids)
    s, t = _places(known.ids, a), _places(known.ids, z)
    code = known.code[t]
    out = {name: (code >> at & 1).astype(bool) for name, at in (("interface", 16), ("abstract", 17), ("sealed", 18), ("static", 19))}
    freq = np.array([CHANGE_FREQUENCY.get(p, 0.2) for p in PATTERNS])
    for role, at in (("s", s), ("t", t)):
        late = known.first_seen[at] < seq
        pattern, layer = known.code[at] & 7, known.code[at] >> 3 & 7
        out[f"{role}p"] = Coded.of(PATTERNS, np.where(late, pattern, len(PATTERNS) - 1))
        out[f"{role}l"] = Coded.of(LAYERS, np.where(late, layer, len(LAYERS) - 1))
        out[f"{role}f"] = np.where(at < n, freq[pattern], 0.0)
    out |= {"around": known.ca[t] + known.ce[s], "touched": known.ca[t] + known.ce[t], "loop": known.cyclic[s] | known.cyclic[t]} | known.pair(a, z)
    kind, spaces = Coded(b["dep_type"]), [Coded.of(known.spaces, known.space[at]) for at in (s, t)]
    return out | {"kind": kind, "member": Coded(b["member_name"]), "pattern": _pattern_of(kind, known, s, t), "cohesion": _cohesion(*spaces)}


def _pattern_of(kind: Coded, known: Known, s: np.ndarray, t: np.ndarray) -> Coded:
    bits = lambda at: known.code[at] >> 6 & 1023
    apart = known.roots[known.space[s]] != known.roots[known.space[t]]
    return Coded.of(EDGE_PATTERNS, edge_pattern_of(kind, bits(s), bits(t), (known.code[t] >> 16 & 1).astype(bool), apart))


def dimensions(v: dict) -> dict[str, np.ndarray]:
    """The dimensions of a batch, from what _joined() or _looked_up() gives."""
    kind, interface, abstract, sealed = (v[n] for n in ("kind", "interface", "abstract", "sealed"))
    sp, tp, sl, tl = (v[n] for n in ("sp", "tp", "sl", "tl"))

    def step(*pairs: tuple[str, str]) -> np.ndarray:
        return np.logical_or.reduce([(sl == x) & (tl == y) for x, y in pairs])

    role = _first((tp == "DomainCore", 1.3), (sp == "DomainCore", 1.2), (tp == "Infrastructure", 0.8), other=1.0)
    design = tp.look({"Factory": 1.2, "Repository": 1.3, "Strategy": 1.1, "Singleton": 0.7}, 1.0)
    good, bad = step(("Presentation", "Application"), ("Application", "Domain"), ("Infrastructure", "Domain")), step(("Domain", "Application"), ("Domain", "Presentation"), ("Application", "Presentation"))
    layered = _first((good, 1.2), (bad, 0.6), other=1.0)
    direction = _first((step(("Domain", "Presentation")), 0.5), (step(("Domain", "Application")), 0.7), other=1.0)
    bonus = kind.look({"Interface": 0.2, "Constructor": 0.15}, 0.0)
    structural = np.minimum(1.0, kind.look(ENHANCED_WEIGHTS, 1) / 10.0 * role * design * layered * direction + bonus)

    member = v["member"]
    by_name = _first((member.has("execute", "process", "handle"), 0.8), (member.has("get", "set", "save", "delete"), 0.6), (member.has("helper", "util", "convert"), 0.3), other=0.4)
    purpose = np.where(kind == "Method", by_name, kind.look({"Interface": 0.9, "Inheritance": 0.85, "Constructor": 0.8, "Property": 0.7, "Field": 0.6, "LocalVariable": 0.2}, 0.4))
    abstraction = _first((interface, 0.9), (abstract, 0.8), (sealed, 0.4), other=0.6)
    intent = _first(((sp == "Repository") & (tp == "DomainCore"), 0.9), ((sp == "ApplicationService") & (tp == "Repository"), 0.8), other=0.5)

    around = v["around"]
    loop = np.where(v["loop"], 1.3, 1.0)
    coupling = np.where(around == 0, 0.1, np.minimum(1.0, np.minimum(1.0, around / 20.0) * loop))

    firm = _first((interface, 0.9), (abstract, 0.8), (sealed, 0.6), other=0.5)
    stability = np.maximum(0.1, (kind.look({"Interface": 0.9}, 0.5) + firm) / 2 - np.minimum(0.5, 0.2 * (v["sf"] + v["tf"]) / 2))

    path = tp.look({"DomainCore": 0.9, "ApplicationService": 0.7, "Infrastructure": 0.5}, 0.3)
    business = _first((tp == "DomainCore", 0.9), (sp == "DomainCore", 0.8), other=0.4)
    failure, performance = kind.look({"Constructor": 0.8, "Interface": 0.7}, 0.4), kind.look({"Method": 0.6, "Property": 0.4}, 0.2)

    mock = _first((interface, 0.9), (abstract, 0.8), (sealed, 0.2), other=0.5)
    isolation = np.where(v["static"], 0.8, kind.look({"StaticReference": 0.9}, 0.3))
    testability = _mean(mock, 1.0 - np.minimum(1.0, v["touched"] / 10.0), 1.0 - isolation)
    semantic = _mean(purpose, v["cohesion"], abstraction, intent)
    return dict(zip(DIMENSIONS, [structural, semantic, coupling, stability, _mean(path, business, failure, performance), testability], strict=True))


def _scoring_columns() -> dict[str, Column]:
    c = F.col
    return {
        "edge_pattern": _pattern(), "_interface": _interface(), "_abstract": c("t_is_abstract"), "_sealed": c("t_is_sealed"), "_static": c("t_is_static"),
        "_sp": c("s_seen_pattern"), "_tp": c("t_seen_pattern"), "_sl": c("s_seen_layer"), "_tl": c("t_seen_layer"), "_sns": c("s_namespace"), "_tns": c("t_namespace"),
        "_around": c("t_ca") + c("s_ce"), "_touched": c("t_ca") + c("t_ce"), "_loop": c("s_cyclic") | c("t_cyclic"), "_sf": c("s_freq"), "_tf": c("t_freq"),
        **{f"_{k}": F.coalesce(k, F.lit(1)) for k in ("n", "kinds", "total", "most")},
    }


ADDED = {
    "weight": IntegerType(), "base_strength": DoubleType(), "edge_pattern": StringType(), **dict.fromkeys((*DIMENSIONS, "composite"), DoubleType()), "profile": StringType(), "strength": DoubleType(),
}


def score(edges: DataFrame, ctx: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges with weight, base_strength, edge_pattern, the dimensions, composite, profile and strength. ctx: the rows of context(), pairs: those of parallel().

    strength is the composite, raised for pairs with more than one edge to what those edges have together.
    """
    own = edges.columns
    out = edges.join(pairs, F.col("src").eqNullSafe(F.col("_a")) & F.col("dst").eqNullSafe(F.col("_b")), "left")
    out = with_context(out, ctx).select(*own, *[c.alias(name) for name, c in _scoring_columns().items()])
    return _on_batches(out, [*own, *ADDED], StructType(list(edges.schema.fields)), lambda b: _scores(_joined(b)))


def score_known(edges: DataFrame, known: Broadcast, columns: list[str]) -> DataFrame:
    """Columns of score(), where types and pairs are few enough for every task to know: the edges are neither joined nor moved."""
    used = {"src", "dst", "edge_seq", "dep_type", "member_name", *columns}
    return _on_batches(edges.select(*(c for c in edges.columns if c in used)), columns, edges.schema, lambda b: _scores(_looked_up(b, Known.of(known.value))))


def pattern_known(edges: DataFrame, known: Broadcast, columns: list[str]) -> DataFrame:
    """Columns of the edges and edge_pattern, in the same way."""

    def patterns(b: pa.RecordBatch) -> dict[str, pa.Array]:
        k = Known.of(known.value)
        places = (np.where(b[end].is_valid().to_numpy(zero_copy_only=False), _places(k.ids, b[end].fill_null(0).to_numpy()), len(k.ids)) for end in ("src", "dst"))
        return {"edge_pattern": _named(_pattern_of(Coded(b["dep_type"]), k, *places))}

    used = {"src", "dst", "dep_type", *columns}
    return _on_batches(edges.select(*(c for c in edges.columns if c in used)), columns, edges.schema, patterns)


def _on_batches(rows: DataFrame, columns: list[str], own: StructType, work: Callable[[pa.RecordBatch], dict[str, pa.Array]]) -> DataFrame:
    """columns of the rows and of what work adds to a batch of them. own: the types of columns that are not added."""
    schema = StructType()
    for c in columns:
        schema = schema.add(c, ADDED[c]) if c in ADDED else schema.add(own[c])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                added = work(b)
                yield pa.RecordBatch.from_arrays([added[c] if c in added else b[c] for c in columns], names=columns)

    return rows.mapInArrow(run, schema)


def _named(codes: Coded) -> pa.Array:
    return pc.take(pa.array(codes.values, pa.string()), pa.array(codes.codes))


def _scores(v: dict) -> dict[str, pa.Array]:
    kind, pattern, by = v["kind"], v["pattern"], dimensions(v)
    weights = kind.look(WEIGHTS, 1)
    base = np.minimum(1.0, weights / 10.0 + kind.look({"Constructor": 0.2, "Property": 0.1, "Field": 0.1, "Inheritance": 0.3, "Interface": 0.3}, 0.0))
    composite = np.zeros(len(weights))
    for i, d in enumerate(DIMENSIONS):
        table = {k: w[i] for k, w in DIMENSION_WEIGHTS.items() if k != "Default"}
        composite = composite + by[d] * pattern.look(table, DIMENSION_WEIGHTS["Default"][i])
    s, m, c, st, cr, t = (by[d] for d in DIMENSIONS)
    profile = _first(((s > 0.8) & (m > 0.8), 0), ((c > 0.8) & (st < 0.4), 1), (t < 0.3, 2), (cr > 0.8, 3), ((s < 0.3) & (m < 0.3), 4), other=5)
    names = pa.array(["HighQualityCore", "HighRiskCoupling", "TestingChallenge", "BusinessCritical", "WeakConnection", "Balanced"])
    n, kinds, total, most = (v[k] for k in ("n", "kinds", "total", "most"))
    together = np.minimum(1.0, np.minimum(1.0, total / most / 10) + np.minimum(0.3, n * 0.05) + np.minimum(0.2, kinds * 0.03))
    strength = np.where(n > 1, np.maximum(composite, together), composite)
    out = {"weight": pa.array(weights, pa.int32()), "base_strength": pa.array(base), "edge_pattern": _named(pattern), "composite": pa.array(composite)}
    return out | {d: pa.array(by[d]) for d in DIMENSIONS} | {"profile": pc.take(names, pa.array(profile)), "strength": pa.array(strength)}


def pair_strength(n: Column, kinds: Column, total: Column, most: Column) -> Column:
    """Strength of several edges between one pair of types."""
    one = F.lit(1.0)
    return F.least(one, F.least(one, total / most / 10) + F.least(F.lit(0.3), n * 0.05) + F.least(F.lit(0.2), kinds * 0.03))
