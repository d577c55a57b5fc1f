"""Grammar of predicate terms, `kind:namespace:label`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of terms, and the characters of their parts.
KINDS = ("C", "E", "EV", "L", "R")
PART = "[a-zA-Z0-9_-]+"
LENIENT = rf"^(E|R|EV|L|C):({PART}):([a-zA-Z0-9_:-]+)$"


def valid(term: Column) -> Column:
    """The lenient form, whose label may hold colons."""
    return F.coalesce(term.rlike(LENIENT), F.lit(False))


def reason(term: Column) -> Column:
    """Why the strict form, of exactly three parts, does not hold; null if it does. The first of the checks counts."""
    # fixed values: the texts, and the order of the checks
    parts = F.split(term, ":")
    n, (kind, namespace, label) = F.size(parts), (F.get(parts, i) for i in range(3))
    chars = "contains invalid characters (allowed: alphanumeric, underscore, hyphen)"
    return (
        F.when(term.isNull() | (term == ""), "Empty term")
        .when(n < 2, "Missing colon separators (expected kind:namespace:label)")
        .when(n < 3, F.format_string("Insufficient components: got %d, expected 3 (kind:namespace:label)", n))
        .when(n > 3, F.format_string("Too many components: got %d, expected 3 (kind:namespace:label)", n))
        .when(~kind.isin(*KINDS), F.format_string(f"Invalid kind '%s'. Must be one of: {', '.join(KINDS)}", kind))
        .when(namespace == "", "Empty namespace")
        .when(label == "", "Empty label")
        .when(~namespace.rlike(f"^{PART}$"), F.format_string(f"Namespace '%s' {chars}", namespace))
        .when(~label.rlike(f"^{PART}$"), F.format_string(f"Label '%s' {chars}", label))
    )


def suggested_plugin(name: Column) -> Column:
    """A plugin for a predicate, from its name. The parts of names and what they stand for."""
    return (
        F.when(name.contains("occursAt") | F.lower(name).contains("time"), "timeseries")
        .when(name.contains("locatedAt") | name.contains("partOf") | name.contains("geo:"), "geospatial")
        .when(name.contains("Quantity") | name.contains("count") | name.contains("Amount"), "counter")
        .otherwise("multivalue_set")
    )
