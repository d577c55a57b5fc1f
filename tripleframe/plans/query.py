"""Triple patterns: which terms are bound decides the layout that is read.

A pattern is planned on the driver: predicates that are bound become literals (or partition filters), those
that are not are narrowed to the registry's entries that support the access path. Counters answer 0 for
subjects that they do not hold, if a pattern binds the subject.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleframe.functions.cid import Cid
from tripleframe.operators.registry import Registry
from tripleframe.schema import TRIPLE
from tripleframe.sources import tables


@dataclass(frozen=True)
class Pattern:
    """None is unbound; an object is an identifier or an integer."""

    s: Cid | None = None
    p: Cid | None = None
    o: Cid | int | None = None

    @property
    def bound(self) -> str:
        return "".join(n for n, x in zip("spo", (self.s, self.p, self.o), strict=True) if x is not None)


def is_object(o: Cid | int, typed: bool):
    """A filter for an object. Untyped, an integer equals the identifier of the same number and the other way round."""
    if isinstance(o, Cid):
        small = int.from_bytes(o.raw, "big")
        same = F.col("o_cid") == o.lit
        return same if typed or small >= 1 << 63 else same | (F.col("o_int") == small)
    same = F.col("o_int") == o
    return same if typed or o < 0 else same | (F.col("o_cid") == Cid.of_int(o).lit)


class Store:
    """The registered predicates' triples (p, s, o_cid, o_int), and the registry.

    They come from stored layouts (`stored`, the path of tables.save_triples), whose folders are predicates and whose
    order is the subject's or the object's, so that a pattern reads the pages that can hold its terms; or else from
    one source for each predicate, made when a plan needs it. A source may have a method `having` that reads less for
    the object that a pattern binds without a subject; the pattern's filters follow in any case.
    """

    def __init__(self, registry: Registry, sources: dict[Cid, Callable[[], DataFrame]], spark: SparkSession, kv: DataFrame | None = None, counter_default: int | None = 0, stored: str | None = None):
        self.registry, self.sources, self.spark, self.kv, self.counter_default, self.stored = registry, sources, spark, kv, counter_default, stored

    def _source(self, p: Cid, o: Cid | int | None) -> DataFrame:
        having = getattr(self.sources[p], "having", None)
        return self.sources[p]() if o is None or having is None else having(o)

    def _of(self, predicates: list[Cid], s: Cid | None = None, o: Cid | int | None = None, typed: bool = True) -> DataFrame:
        """Triples of some predicates, with a subject or an object."""
        if not predicates:
            return self.spark.createDataFrame([], TRIPLE)
        if self.stored is not None:
            every = len(predicates) == len(self.sources)
            out = tables.load_triples(self.spark, self.stored, "spo" if s is not None or o is None else "osp", None if every else predicates).select("p", "s", "o_cid", "o_int")
        else:
            out = None
            for p in predicates:
                part = self._source(p, o if s is None else None).select(p.lit.alias("p"), "s", "o_cid", "o_int")
                out = part if out is None else out.unionByName(part)
        if s is not None:
            out = out.where(F.col("s") == s.lit)
        return out if o is None else out.where(is_object(o, typed))

    def _capable(self, *flags: str) -> list[Cid]:
        return [c for c, e in self.registry.entries.items() if any(getattr(e.plugin, f) for f in flags)]

    def _is_counter(self, p: Cid) -> bool:
        return self.registry.entries[p].plugin.name == "counter"

    def _of_subject(self, s: Cid, predicates: list[Cid]) -> DataFrame:
        """A subject's triples, with 0 for each counter that has none; each predicate is read once."""
        counters = [p for p in predicates if self._is_counter(p)] if self.counter_default is not None else []
        if not counters:
            return self._of(predicates, s)
        none = self.spark.createDataFrame([(bytearray(p.raw),) for p in counters], "p binary")
        both = self._of(counters, s).select("p", F.lit(0).alias("late"), "o_int").unionByName(none.select("p", F.lit(1).alias("late"), F.lit(self.counter_default).cast("long").alias("o_int")))
        held = both.groupBy("p").agg(F.min_by("o_int", "late").alias("o_int"))  # at most 200 predicates
        held = held.select("p", s.lit.alias("s"), F.lit(None).cast("binary").alias("o_cid"), "o_int")
        others = [p for p in predicates if p not in counters]
        return self._of(others, s).unionByName(held) if others else held

    def query(self, pattern: Pattern) -> DataFrame:
        """p, s, o_cid, o_int of the matching triples; triples of unregistered predicates are never among them."""
        s, p, o = pattern.s, pattern.p, pattern.o
        empty = self._of([])
        if p is not None and p not in self.sources:
            return empty
        match pattern.bound:
            case "spo":
                return self._of_subject(s, [p]).where(is_object(o, typed=False))
            case "sp":
                return self._of_subject(s, [p])
            case "so":
                return self._of_subject(s, self.registry.all()).where(is_object(o, typed=False))
            case "po":
                return self._of([p], o=o) if p in self._capable("supports_osp", "supports_pos") else empty
            case "s":
                return self._of_subject(s, self.registry.all())
            case "o":
                return self.by_object(o)
            case "p":
                return empty
            case _:
                warnings.warn("a full scan is expensive and yields nothing", UserWarning, stacklevel=2)
                return empty

    def by_object(self, o: Cid | int, subjects: DataFrame | None = None) -> DataFrame:
        """Fan-out over all predicates with an object index. subjects (s): keeps theirs, unless it has no row."""
        rows = self._of(self._capable("supports_osp"), o=o)
        if subjects is None or not subjects.limit(1).count():
            return rows
        return rows.join(subjects.select("s").distinct(), "s", "left_semi").select("p", "s", "o_cid", "o_int")

    def by_object_all(self, o: Cid | int) -> DataFrame:
        """s, p over all predicates, whatever they support."""
        return self._of(self.registry.all(), o=o).select("s", "p")

    def query_triple(self, pattern: Pattern) -> DataFrame:
        """One access path: values of (s, p), subjects of (p, o), or (s, p) of o. Other shapes have no rows."""
        s, p, o = pattern.s, pattern.p, pattern.o
        if pattern.bound == "sp":
            if p in self.sources:
                return self.query(pattern).select("o_cid", "o_int")
            return self.kv.where(F.col("key") == s.lit).select(F.col("value").alias("o_cid"), F.lit(None).cast("long").alias("o_int"))
        if pattern.bound == "po":
            return self._of([p] if p in self.sources else [], o=o).select("s")
        if pattern.bound == "o":
            return self.by_object(o).select("s", "p")
        return self._of([]).select("s", "p")

    def by_value(self, p: Cid, o: Cid | int) -> DataFrame:
        return self._of([p] if p in self.sources else [], o=o).select("s")

    def get_triple(self, s: Cid, p: Cid) -> DataFrame:
        """As stored: no row where there is none, and none for unregistered predicates."""
        return self._of([p] if p in self.sources else [], s).select("o_cid", "o_int")

    def enumerate(self, p: Cid) -> DataFrame:
        """All triples of a predicate (beyond the eight patterns)."""
        return self._of([p] if p in self.sources else [])

    def everything(self) -> DataFrame:
        return self._of(self.registry.all())

    def join(self, left: DataFrame, p: Cid, on: str, to: str) -> DataFrame:
        """Follows a predicate from a column of identifiers to its objects, as a column `to` (a two-pattern join)."""
        hop = self.enumerate(p).select(F.col("s").alias(on), F.col("o_cid").alias(to))
        return left.join(hop, on)
