"""Classifiers of types and edges: ordered substring rules over lower-cased names and namespaces.

The rules hold for columns, and for arrays of one Arrow batch, where a first match is the place of its rule.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


class Lowered:
    """A batch of texts in lower case; null is empty."""

    def __init__(self, column: pa.Array):
        found = column.fill_null("").dictionary_encode()
        self.values, self.codes, self.known = found.dictionary, found.indices.to_numpy(), {}

    def has(self, part: str) -> np.ndarray:
        if part not in self.known:
            self.known[part] = pc.match_substring(self.values, part).to_numpy(zero_copy_only=False)[self.codes]
        return self.known[part]


def has(column: Column | Lowered, *parts: str, low: bool = False) -> Column | np.ndarray:
    """Whether any of the parts occurs in a lower-cased text; null has none. low: the text is in lower case."""
    if isinstance(column, Lowered):
        return np.logical_or.reduce([column.has(p) for p in parts])
    low = F.coalesce(column if low else F.lower(column), F.lit(""))
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(p)) for p in parts))


def first_match(rules: list[tuple[str, Column]], default: str = "Unknown") -> Column | np.ndarray:
    if isinstance(rules[0][1], np.ndarray):
        return np.select([test for _, test in rules], range(len(rules)), len(rules)).astype(np.int32)
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in rules], F.lit(default))


def type_pattern(name: Column, namespace: Column, low: bool = False) -> Column:
    return first_match(
        [
            ("Repository", has(name, "repository", low=low) | has(namespace, "repository", low=low)),
            ("Factory", has(name, "factory", "builder", low=low)),
            ("ApplicationService", has(name, "service", low=low) & ~has(namespace, "infrastructure", low=low)),
            ("DomainCore", has(namespace, "domain", "core", low=low)),
            ("Infrastructure", has(namespace, "infrastructure", low=low)),
            ("Testing", has(namespace, "test", low=low)),
            ("Configuration", has(namespace, "config", low=low)),
        ]
    )


def layer(namespace: Column, low: bool = False) -> Column:
    return first_match(
        [
            ("Presentation", has(namespace, "presentation", "ui", "web", low=low)),
            ("Application", has(namespace, "application", low=low) | (has(namespace, "service", low=low) & ~has(namespace, "infrastructure", low=low))),
            ("Domain", has(namespace, "domain", "core", "business", low=low)),
            ("Infrastructure", has(namespace, "infrastructure", "external", low=low)),
            ("Data", has(namespace, "data", "persistence", "repository", low=low)),
            ("Test", has(namespace, "test", low=low)),
            ("Configuration", has(namespace, "config", low=low)),
        ]
    )


def traits(name: Column, namespace: Column, low: bool = False) -> Column:
    """What edge_pattern() asks of a type's name and namespace, a bit for each of TRAITS."""
    tests = [
        has(name, "repository", low=low) | has(namespace, "repository", "data", "persistence", low=low),
        has(name, "factory", "builder", low=low),
        has(name, "strategy", "handler", "processor", low=low),
        has(name, "observer", "listener", "handler", low=low),
        has(namespace, "domain", "core", "business", low=low) | (has(namespace, "model", low=low) & ~has(namespace, "view", low=low)),
        (has(namespace, "service", low=low) & ~has(namespace, "infrastructure", low=low)) | has(namespace, "application", low=low) | (has(name, "service", low=low) & ~has(name, "test", low=low)),
        has(namespace, "infrastructure", "external", "integration", "persistence", low=low),
        has(namespace, "data", "repository", "dal", "persistence", low=low) | has(name, "repository", "context", low=low),
        has(name, "test", "mock", low=low) | has(namespace, "test", low=low),
        has(namespace, "configuration", "config", "settings", low=low) | has(name, "configuration", "config", "settings", low=low),
    ]
    return reduce(lambda a, b: a + b, (test.astype(np.int32) << i if isinstance(test, np.ndarray) else F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests)))


#: The names of type_pattern(), layer() and edge_pattern() in the order of their rules, the default last.
PATTERNS = ("Repository", "Factory", "ApplicationService", "DomainCore", "Infrastructure", "Testing", "Configuration", "Unknown")
LAYERS = ("Presentation", "Application", "Domain", "Infrastructure", "Data", "Test", "Configuration", "Unknown")
EDGE_PATTERNS = (
    "Repository", "Factory", "Strategy", "Observer", "DependencyInjection", "DomainCore", "ApplicationService", "Infrastructure", "DataAccess", "Testing", "Configuration",
    "MicroservicesBoundary", "Unknown",
)
TRAITS = ("repository", "factory", "strategy", "observer", "domain", "application", "infrastructure", "data", "testing", "configuration")


def edge_pattern(kind: Column, s_traits: Column, t_traits: Column, s_ns: Column, t_ns: Column, t_interface: Column) -> Column:
    """The first of twelve rules that an edge meets; an end that is no node has traits of 0."""
    root = lambda ns: F.lower(F.split_part(F.coalesce(ns, F.lit("")), F.lit("."), F.lit(1)))
    t = lambda name: t_traits.bitwiseAND(1 << TRAITS.index(name)) != 0
    either = lambda name: s_traits.bitwiseOR(t_traits).bitwiseAND(1 << TRAITS.index(name)) != 0
    return _edge_pattern(kind, t, either, t_interface, root(s_ns) != root(t_ns))


def edge_pattern_of(kind, s_traits: np.ndarray, t_traits: np.ndarray, t_interface: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """edge_pattern() on arrays, as places in EDGE_PATTERNS. kind: a text column with == and isin; apart: the namespaces' roots differ."""
    bit = lambda traits, name: (traits & (1 << TRAITS.index(name))) != 0
    return _edge_pattern(kind, lambda name: bit(t_traits, name), lambda name: bit(s_traits | t_traits, name), t_interface, apart)


def _edge_pattern(kind, t, either, t_interface, apart):
    interface = kind == "Interface"
    return first_match(
        [
            ("Repository", t("repository") & kind.isin("Interface", "Constructor")),
            ("Factory", either("factory") & kind.isin("Method", "Interface")),
            ("Strategy", interface & t("strategy")),
            ("Observer", (kind == "Event") | (interface & t("observer"))),
            ("DependencyInjection", (kind == "Constructor") & t_interface),
            ("DomainCore", t("domain")),
            ("ApplicationService", t("application")),
            ("Infrastructure", t("infrastructure")),
            ("DataAccess", t("data")),
            ("Testing", either("testing")),
            ("Configuration", t("configuration")),
            ("MicroservicesBoundary", apart),
        ]
    )
