"""Writing triples: validation, routing between specialised predicates and the hashed multimap, statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripleframe.errors import InvalidTripleError
from tripleframe.functions import cid as C

from .registry import Registry


def validated(batch: DataFrame) -> DataFrame:
    """batch (ord, s, p, o_cid, o_text, o_int) with valid: s and p are identifiers and there is an object."""
    has = F.col("o_cid").isNotNull() | F.col("o_text").isNotNull() | F.col("o_int").isNotNull()
    ok = (F.length("s") == C.WIDTH) & (F.length("p") == C.WIDTH) & has
    return batch.withColumn("valid", F.coalesce(ok, F.lit(False)))


def routed(batch: DataFrame, predicates: DataFrame) -> DataFrame:
    """plugin, null for unregistered predicates. A registry has 200 rows at most, so it is broadcast."""
    return batch.join(F.broadcast(predicates.select("p", "plugin")), "p", "left")


def composites(batch: DataFrame) -> DataFrame:
    """key, value, text of triples of unregistered predicates; text goes to the dictionary."""
    o = C.canonical_object(F.col("o_cid"), F.coalesce("o_text", F.col("o_int").cast("string")))
    rows = batch.withColumn("o", o)
    return rows.select("ord", C.composite_key(F.col("s"), F.col("p"), F.col("o")).alias("key"), C.composite_value(F.col("p"), F.col("o")).alias("value"), C.composite_text(F.col("p"), F.col("o")).alias("text"))


def batch_stats(batch: DataFrame, predicates: DataFrame) -> DataFrame:
    """inserted, failed, specialized, composite of a batch, duplicates included. A counter takes what casts to an integer."""
    rows = routed(validated(batch), predicates)
    number = F.coalesce(F.col("o_int"), F.col("o_text").try_cast("long"))
    fits = F.when(F.col("plugin") == "counter", number.isNotNull()).when(F.col("plugin") == "multivalue_set", F.col("o_cid").isNotNull()).otherwise(True)
    good = F.col("valid") & F.coalesce(fits, F.lit(False))
    return rows.agg(
        F.count_if(good).alias("inserted"), F.count_if(~good).alias("failed"), F.count_if(good & F.col("plugin").isNotNull()).alias("specialized"), F.count_if(good & F.col("plugin").isNull()).alias("composite"),
    )


def require_valid(batch: DataFrame) -> DataFrame:
    """The batch, or an error before anything is written if some row is not valid (the atomic mode)."""
    bad = validated(batch).where("not valid").count()
    if bad:
        raise InvalidTripleError(f"{bad} invalid triples; nothing was written")
    return batch


def specialised(log: DataFrame, registry: Registry) -> DataFrame:
    """p, s, o_cid, o_int: the current triples of all registered predicates, each folded by its plugin."""
    by_plugin: dict[str, list] = {}
    for entry in registry.entries.values():
        by_plugin.setdefault(entry.plugin.name, []).append(entry)
    out = None
    for entries in by_plugin.values():
        for entry in entries:
            part = entry.plugin.fold(log.where(F.col("p") == entry.cid.lit)).select(entry.cid.lit.alias("p"), "s", "o_cid", "o_int")
            out = part if out is None else out.unionByName(part)
    return out


def existed(deletes: DataFrame, triples: DataFrame, predicates: DataFrame) -> DataFrame:
    """Whether each delete found its triple; those of unregistered predicates always say so."""
    known = triples.select("p", "s", "o_cid", "o_int", F.lit(True).alias("there"))
    same = (F.col("d.p") == F.col("t.p")) & (F.col("d.s") == F.col("t.s")) & F.col("d.o_cid").eqNullSafe(F.col("t.o_cid")) & F.col("d.o_int").eqNullSafe(F.col("t.o_int"))
    rows = routed(deletes, predicates)
    return rows.alias("d").join(known.alias("t"), same, "left").select("d.*", F.when(F.col("d.plugin").isNull(), True).otherwise(F.coalesce("t.there", F.lit(False))).alias("existed"))


@dataclass
class Transaction:
    """One at a time. By default operations apply as they come and a rollback undoes none of them; staged=True holds
    them back until the commit instead."""

    staged: bool = False
    active: bool = False
    operations: int = 0
    pending: list[DataFrame] = field(default_factory=list)

    def begin(self) -> None:
        if self.active:
            raise RuntimeError("a transaction is active already")
        self.active, self.operations, self.pending = True, 0, []

    def record(self, batch: DataFrame, rows: int, write) -> None:
        if self.staged and self.active:
            self.pending.append(batch)
        else:
            write(batch)
        if self.active:
            self.operations += rows

    def _end(self) -> int:
        if not self.active:
            raise RuntimeError("no transaction is active")
        self.active = False
        return self.operations

    def commit(self, write=None) -> dict[str, int]:
        n = self._end()
        for batch in self.pending:
            write(batch)
        self.pending = []
        return {"operations": n}

    def rollback(self) -> None:
        self._end()
        self.pending = []


def transaction_stats(log: DataFrame) -> DataFrame:
    """txn, operations and deletes of a log whose rows carry their transaction."""
    return log.groupBy("txn").agg(F.count("*").alias("operations"), F.count_if(F.col("op") == "DELETE").alias("deletes"))


def slots(kv: DataFrame) -> DataFrame:
    """Each distinct value of a key with its slot, in order of arrival."""
    first = kv.groupBy("key", "value").agg(F.min("ht").alias("ht"))
    return first.withColumn("slot", F.row_number().over(W.partitionBy("key").orderBy("ht", "value")))
