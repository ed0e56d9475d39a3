"""Lookup tables of the strength model, as plain values and as map columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: weight of each kind of dependency, 1 for the rest
WEIGHTS = {
    "Inheritance": 10, "Interface": 9, "Constructor": 8, "Field": 7, "Property": 6, "ReturnType": 5, "NewExpression": 5, "Method": 4,
    "GenericArgument": 4, "Delegate": 4, "MethodCall": 4, "Parameter": 3, "Event": 3, "StaticReference": 3, "FieldAccess": 3,
    "PropertyAccess": 3, "LocalVariable": 2, "LocalVariableType": 2,
}
# fixed values: weight in the structural dimension, 1 for the rest
ENHANCED_WEIGHTS = {"Inheritance": 10, "Interface": 9, "Constructor": 8, "Field": 7, "Property": 6, "ReturnType": 5, "Method": 4, "GenericArgument": 4, "Parameter": 3, "Event": 3, "LocalVariable": 2}
# fixed values: how often types of a pattern change, 0.2 for the rest
CHANGE_FREQUENCY = {"DomainCore": 0.1, "Infrastructure": 0.3, "ApplicationService": 0.2, "Testing": 0.5, "Configuration": 0.4}
# fixed values: weights of structural, semantic, coupling, stability, criticality, testability
DIMENSION_WEIGHTS = {
    "Default": (0.25, 0.2, 0.2, 0.15, 0.1, 0.1),
    "MicroservicesBoundary": (0.3, 0.2, 0.3, 0.1, 0.05, 0.05),
    "DomainCore": (0.2, 0.4, 0.1, 0.2, 0.05, 0.05),
    "Infrastructure": (0.4, 0.1, 0.2, 0.3, 0.0, 0.0),
    "ApplicationService": (0.2, 0.3, 0.2, 0.1, 0.1, 0.1),
    "Testing": (0.1, 0.1, 0.1, 0.1, 0.1, 0.5),
}


def lookup(table: dict, key: Column, default) -> Column:
    """The value of a key in a literal table."""
    found = F.create_map(*map(F.lit, chain.from_iterable(table.items())))
    return F.coalesce(F.try_element_at(found, key), F.lit(default))


def weight(kind: Column) -> Column:
    return lookup(WEIGHTS, kind, 1)


def base_strength(kind: Column) -> Column:
    """A tenth of the weight and a bonus for structural kinds, 1 at most."""
    bonus = F.when(kind == "Constructor", 0.2).when(kind.isin("Property", "Field"), 0.1).when(kind.isin("Inheritance", "Interface"), 0.3).otherwise(0.0)
    return F.least(F.lit(1.0), weight(kind) / F.lit(10.0) + bonus)
