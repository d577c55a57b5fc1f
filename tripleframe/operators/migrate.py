"""Turning a predicate's triples into those of another plugin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleframe.functions.cid import Cid, cid

from .registry import ALIASES, Registry


def converted(triples: DataFrame, old: str, new: str) -> DataFrame:
    """s, o_cid, o_int under the new plugin: a counter's value becomes an identifier named after it, a set its size."""
    none_cid, none_int = F.lit(None).cast("binary"), F.lit(None).cast("long")
    match (old, new):
        case ("counter", "counter") | ("multivalue_set", "multivalue_set"):
            return triples.select("s", "o_cid", "o_int")
        case ("counter", "multivalue_set"):
            name = F.concat(F.lit("E:migration:count_"), F.col("o_int").cast("string"))
            return triples.select("s", cid(name).alias("o_cid"), none_int.alias("o_int"))
        case ("multivalue_set", "counter"):
            return triples.groupBy("s").agg(F.count("*").alias("o_int")).select("s", none_cid.alias("o_cid"), "o_int")
    raise ValueError(f"no way from {old!r} to {new!r}")


def hot_reload(registry: Registry, sources: dict[Cid, Callable[[], DataFrame]], predicate: Cid, plugin: str, migrate: bool = True) -> dict[Cid, Callable[[], DataFrame]]:
    """Re-types a predicate and gives the sources after it. An unknown plugin raises before anything changes."""
    old, new = registry.entries[predicate].plugin.name, ALIASES.get(plugin, plugin)
    if registry.plugins.get(new) is None:
        raise ValueError(f"unknown plugin {plugin!r}")
    rows = converted(sources[predicate](), old, new) if migrate else sources[predicate]().where("false")
    registry.retype(predicate, new)
    return sources | {predicate: lambda: rows}


def stats(triples: DataFrame, old: str, new: str) -> DataFrame:
    """migrated and skipped: subjects, or values where a set stays one."""
    rows = triples.agg(F.countDistinct("s").alias("subjects"), F.count("*").alias("triples"))
    known = {old, new} <= {"counter", "multivalue_set"}
    moved = F.col("triples") if old == new == "multivalue_set" else F.col("subjects")
    zero = F.lit(0).cast("long")
    return rows.select((moved if known else zero).alias("migrated"), (zero if known else F.col("triples")).alias("skipped"))
