"""The store as a whole: a folder with an append-only mutation log and folded versions of it.

    path/log/batch=N-ID   mutations of one write: kind (triple or kv), op, ht, key, p, value, o_int
    path/base/vN-ID       what some batches amount to: triples by subject (spo) and by object (osp), kv by bucket,
                          and a manifest of the batches that are in it, written last
    path/dictionary/ID    texts of identifiers, the first one written counts
    path/registry/vN-ID   the predicates and their plugins

A write is one Spark append below a name of its own, which is there as a whole or not at all; writers never share a
name. Reads fold the newest version that has its manifest, and all batches that are not in it; compact() lists the
batches first and writes a new version of just those, so what is written meanwhile stays to be read. A version that a
crash left without its manifest is never read. Old versions stay for readers that have them open, until truncate().
Registered predicates' triples are (p, s=key, o_cid=value, o_int); those of unregistered ones are hashed into the
multimap, and never come out of pattern queries.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tripleframe.functions import cid as C
from tripleframe.functions.cid import Cid
from tripleframe.operators import audit, kv, maintain, migrate, triples
from tripleframe.operators.registry import Registry
from tripleframe.plans.query import Pattern, Store, is_object
from tripleframe.sources import tables

ROW = "kind string, op string, ht struct<nanos:long,seq:long,shard:int>, key binary, p binary, value binary, o_int long"
TEXTS = "ord struct<nanos:long,seq:long>, cid binary, text string"
BATCH = "ord long, s binary, p binary, o_cid binary, o_text string, o_int long"


class Facts:
    """A predicate's triples, as one version and the batches after it amount to."""

    def __init__(self, engine: Engine, entry, version: str | None, late: DataFrame):
        self.engine, self.entry, self.version, self.late = engine, entry, version, late

    def __call__(self) -> DataFrame:
        return self._fold("spo", lambda rows: rows)

    def having(self, o: Cid | int) -> DataFrame:
        """Those with one object, and others of subjects that were written since. Other objects of the version can't
        become this one, and later mutations are all read."""
        return self._fold("osp", lambda rows: rows.where(is_object(o, typed=True)))

    def _fold(self, layout: str, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
        base, own = self.engine._base(self.version, layout), F.col("p") == self.entry.cid.lit
        if "pred" in base.columns:
            base = base.where(F.col("pred") == self.entry.cid.hex)
        columns = ["op", F.col("ht").alias("ord"), F.col("key").alias("s"), F.col("value").alias("o_cid"), "o_int"]
        return self.entry.plugin.fold(kept(base.where(own).select(*columns)).unionByName(self.late.where(own).select(*columns)))


class Engine:
    """Opens the store of a path, or a new one in the shared folder. Without a registry, the stored one is used."""

    def __init__(self, spark: SparkSession, path: str | None = None, registry: Registry | None = None):
        self.spark, self.path = spark, (path or tables.shared_place(spark, "store")).rstrip("/")
        self.registry, self._saved = registry or Registry(), None
        if registry is None and (text := self._registry_text()):
            self.registry.restore(text)
            self._saved = text
        self.transaction = triples.Transaction()
        self.counts: dict[str, int] = {}

    # files

    def _at(self, *parts: str):
        """A path below the store, and its file system."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _complete(self, folder: str, marker: str = "_SUCCESS") -> list[str]:
        """Names of the sub-folders that hold a marker, by number and then by name."""
        root, fs = self._at(folder)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted((n for n in names if fs.exists(self._at(folder, n, marker)[0])), key=lambda n: (self._number(n), n))

    @staticmethod
    def _number(name: str) -> int:
        return int(name.split("-")[0].lstrip("batch=v"))

    def _name(self, folder: str, prefix: str) -> str:
        """A new name behind all others; it holds an id, so that two writers never meet."""
        root, fs = self._at(folder)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return f"{prefix}{max([-1, *map(self._number, names)]) + 1}-{uuid.uuid4().hex}"

    def _write_text(self, text: str, *parts: str) -> None:
        path, fs = self._at(*parts)
        out = fs.create(path, False)
        out.write(bytearray(text.encode()))
        out.close()

    def _read_text(self, *parts: str) -> str:
        path, fs = self._at(*parts)
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _registry_text(self) -> str | None:
        versions = self._complete("registry", "registry.json")
        return self._read_text("registry", versions[-1], "registry.json") if versions else None

    def save_registry(self) -> None:
        """Stores the registry if it has changed; every write does so, too."""
        if (text := self.registry.saved()) != self._saved:
            self._write_text(text, "registry", self._name("registry", "v"), "registry.json")
            self._saved = text

    def _state(self) -> tuple[str | None, list[str]]:
        """The newest version, and the batches that are not in it."""
        versions = self._complete("base", "_manifest")
        inside = set(json.loads(self._read_text("base", versions[-1], "_manifest"))) if versions else set()
        return (versions[-1] if versions else None), [b for b in self._complete("log") if b not in inside]

    def _batches(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(ROW).parquet(*(f"{self.path}/log/{n}" for n in names)) if names else self.spark.createDataFrame([], ROW)

    def _base(self, version: str | None, layout: str = "spo") -> DataFrame:
        """A version's triples, as inserts at the beginning of time."""
        if version is None:
            return self.spark.createDataFrame([], ROW)
        rows = tables.load_triples(self.spark, f"{self.path}/base/{version}", layout)
        return rows.select(F.lit("triple").alias("kind"), F.lit("INSERT").alias("op"), F.expr("named_struct('nanos', 0L, 'seq', 0L, 'shard', 0)").alias("ht"), F.col("s").alias("key"), "p", F.col("o_cid").alias("value"), "o_int", "pred")

    def _base_kv(self, version: str | None) -> DataFrame:
        if version is None:
            return self.spark.createDataFrame([], ROW)
        rows = tables.load_kv(self.spark, f"{self.path}/base/{version}/kv")
        return rows.select(F.lit("kv").alias("kind"), F.lit("INSERT").alias("op"), "ht", "key", F.lit(None).cast("binary").alias("p"), "value", F.lit(None).cast("long").alias("o_int"))

    def mutations(self) -> DataFrame:
        """The newest version and what was written since."""
        version, batches = self._state()
        return self._base(version).drop("pred").unionByName(self._base_kv(version)).unionByName(self._batches(batches))

    def _append(self, rows: DataFrame) -> int:
        """Writes a batch and counts its rows on the way."""
        self.save_registry()
        seen = Observation()
        rows.observe(seen, F.count("*").alias("rows"), F.count_if(F.col("op") == "DELETE").alias("deletes")).write.parquet(f"{self.path}/log/{self._name('log', 'batch=')}")
        for name, value in seen.get.items():
            self.counts[name] = self.counts.get(name, 0) + value
        self.counts["writes"] = self.counts.get("writes", 0) + 1
        return seen.get["rows"]

    def metrics(self) -> DataFrame:
        """name, value: what this engine has written, and what its folder holds."""
        version, batches = self._state()
        found = {**self.counts, "open_batches": len(batches), "versions": len(self._complete("base", "_manifest")), "predicates": len(self.registry.entries)}
        return self.spark.createDataFrame(sorted(found.items()), "name string, value long")

    def _write(self, rows: DataFrame) -> int:
        written = 0

        def append(batch: DataFrame) -> None:
            nonlocal written
            written = self._append(batch)

        self.transaction.record(rows, 0, append)
        self.transaction.operations += written if self.transaction.active else 0
        return written

    def _rows(self, df: DataFrame, kind: str, op: str, nanos: int | None = None) -> DataFrame:
        """df with key, p, value, o_int and ord, as rows of the log at one time."""
        ht = F.struct(F.lit(time.time_ns() if nanos is None else nanos).cast("long").alias("nanos"), F.col("ord").cast("long").alias("seq"), F.lit(0).alias("shard"))
        return df.select(F.lit(kind).alias("kind"), F.lit(op).alias("op"), ht.alias("ht"), "key", "p", "value", F.col("o_int").cast("long").alias("o_int"))

    # the multimap

    def insert(self, pairs: DataFrame) -> int:
        """pairs: ord, key, value. A value of zeros raises."""
        none_p, none_int = F.lit(None).cast("binary").alias("p"), F.lit(None).cast("long").alias("o_int")
        rows = pairs.select("ord", C.checked(F.col("key")).alias("key"), none_p, C.checked(F.col("value")).alias("value"), none_int)
        return self._write(kv.inserted(self._rows(rows, "kv", "INSERT")))

    def delete(self, keys: DataFrame) -> int:
        """keys: ord, key, and value to delete single pairs."""
        value = F.col("value") if "value" in keys.columns else F.lit(None).cast("binary")
        rows = keys.select("ord", "key", F.lit(None).cast("binary").alias("p"), value.alias("value"), F.lit(None).cast("long").alias("o_int"))
        return self._write(self._rows(rows, "kv", "DELETE"))

    def multimap(self) -> DataFrame:
        return self._multimap(*self._state())

    def _multimap(self, version: str | None, batches: list[str]) -> DataFrame:
        return kv.fold(self._base_kv(version).unionByName(self._batches(batches)).where("kind = 'kv'").select("op", "ht", "key", "value"))

    def has_values(self, keys: DataFrame) -> DataFrame:
        """key and whether it has more values than an entry holds, that is, a value set."""
        found = kv.modes(self.get(keys))
        return keys.select("key").distinct().join(found, "key", "left").select("key", F.coalesce(F.col("mode") == "spill", F.lit(False)).alias("has_set"))

    def get(self, keys: DataFrame) -> DataFrame:
        """key, value, slot of many keys at once; only their mutations are folded."""
        asked = keys.select("key").distinct()
        rows = self.mutations().where("kind = 'kv'").select("op", "ht", "key", "value").join(asked, "key", "left_semi")
        return kv.lookup(kv.fold(rows), asked)

    # triples

    def _split(self, batch: DataFrame, op: str) -> DataFrame:
        rows = triples.routed(triples.validated(batch), self.registry.frame(self.spark)).where("valid")
        number = F.coalesce(F.col("o_int"), F.col("o_text").try_cast("long"))
        counters = rows.where("plugin = 'counter'").select("ord", F.col("s").alias("key"), "p", F.lit(None).cast("binary").alias("value"), number.alias("o_int")).where("o_int is not null")
        others = rows.where("plugin is not null and plugin != 'counter' and o_cid is not null").select("ord", F.col("s").alias("key"), "p", F.col("o_cid").alias("value"), F.lit(None).cast("long").alias("o_int"))
        hashed = triples.composites(rows.where("plugin is null")).select("ord", "key", F.lit(None).cast("binary").alias("p"), "value", F.lit(None).cast("long").alias("o_int"))
        now = time.time_ns()
        return self._rows(counters.unionByName(others), "triple", op, now).unionByName(self._rows(hashed, "kv", op, now))

    def insert_triples(self, batch: DataFrame, atomic: bool = False) -> dict[str, int]:
        """Statistics of the batch; atomic ones raise before anything is written if some row is not valid."""
        if atomic:
            triples.require_valid(batch)
        stats = triples.batch_stats(batch, self.registry.frame(self.spark)).first().asDict()
        self._write(self._split(batch, "INSERT"))
        order = F.struct(F.lit(time.time_ns()).alias("nanos"), F.col("ord").alias("seq"))
        texts = batch.where("o_cid is null and o_text is not null").select(order.alias("ord"), C.cid(F.col("o_text")).alias("cid"), F.col("o_text").alias("text"))
        texts.write.parquet(f"{self.path}/dictionary/{uuid.uuid4().hex}")
        return stats

    def delete_triples(self, batch: DataFrame) -> DataFrame:
        """ord and existed, as found before the deletes."""
        found = triples.existed(batch.select("ord", "s", "p", "o_cid", "o_int"), self.store().everything(), self.registry.frame(self.spark)).select("ord", "existed")
        answers = self._kept(found)
        self._write(self._split(batch, "DELETE"))
        return answers

    def _kept(self, df: DataFrame) -> DataFrame:
        """df as it is now, in a folder of the store."""
        path = f"{self.path}/answers/{time.time_ns()}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def store(self) -> Store:
        return self._store(*self._state())

    def _store(self, version: str | None, batches: list[str]) -> Store:
        late = self._batches(batches).where("kind = 'triple'")

        return Store(self.registry, {c: Facts(self, e, version, late) for c, e in self.registry.entries.items()}, self.spark, self._multimap(version, batches))

    def query(self, s: Cid | None = None, p: Cid | None = None, o: Cid | int | None = None) -> DataFrame:
        return self.store().query(Pattern(s, p, o))

    def has_composite(self, s: Cid, p: Cid, o: Cid) -> bool:
        """Whether an unregistered triple is there, by its hashed key and value."""
        one = self.spark.range(1).select(C.composite_key(s.lit, p.lit, o.lit).alias("key"), C.composite_value(p.lit, o.lit).alias("v"))
        return bool(self.get(one).join(one, "key").where("value = v").limit(1).count())

    def _dictionary(self) -> DataFrame:
        names = self._complete_texts()
        return self.spark.read.schema(TEXTS).parquet(*(f"{self.path}/dictionary/{n}" for n in names)) if names else self.spark.createDataFrame([], TEXTS)

    def _complete_texts(self) -> list[str]:
        root, fs = self._at("dictionary")
        names = sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []
        return [n for n in names if fs.exists(self._at("dictionary", n, "_SUCCESS")[0])]

    def text_of(self, cids: DataFrame) -> DataFrame:
        """cid and text of identifiers that were written as texts."""
        return cids.select("cid").distinct().join(C.first_composite(self._dictionary()), "cid", "left")

    # transactions, re-typing, upkeep

    def begin(self, staged: bool = False) -> None:
        self.transaction.staged = staged
        self.transaction.begin()

    def commit(self) -> dict[str, int]:
        return self.transaction.commit(self._append)

    def rollback(self) -> None:
        self.transaction.rollback()

    def hot_reload(self, predicate: Cid, plugin: str) -> None:
        """Re-types a predicate: a new version holds its converted triples in place of the old ones."""
        self._new_version(lambda store: migrate.hot_reload(self.registry, store.sources, predicate, plugin))

    def compact(self) -> None:
        """A new version without what later mutations undid, sorted so that lookups skip pages."""
        self._new_version(lambda store: store.sources)

    def _new_version(self, sources_of) -> None:
        version, batches = self._state()
        inside = json.loads(self._read_text("base", version, "_manifest")) if version else []
        sources = sources_of(self._store(version, batches))
        facts = Store(self.registry, sources, self.spark).everything()
        pairs = self._multimap(version, batches)
        path = f"base/{self._name('base', 'v')}"
        tables.save_triples(facts, f"{self.path}/{path}", max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        tables.save_kv(pairs, f"{self.path}/{path}/kv")
        self.save_registry()
        self._write_text(json.dumps([*inside, *batches]), path, "_manifest")

    def truncate(self) -> int:
        """Deletes versions but the newest, and the batches that are in it; returns how many folders went. Only for
        when no reader has an older version open."""
        versions = self._complete("base", "_manifest")
        if not versions:
            return 0
        inside = set(json.loads(self._read_text("base", versions[-1], "_manifest")))
        gone = [("base", v) for v in versions[:-1]] + [("log", b) for b in self._complete("log") if b in inside]
        for folder, name in gone:
            path, fs = self._at(folder, name)
            fs.delete(path, True)
        return len(gone)

    def backup(self, to: str) -> None:
        """A store at another path with what this one amounts to now: version, dictionary and registry."""
        other = Engine(self.spark, to, self.registry)
        other.save_registry()
        path = f"base/{other._name('base', 'v')}"
        now = self.store()
        tables.save_triples(now.everything(), f"{other.path}/{path}", max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        tables.save_kv(self.multimap(), f"{other.path}/{path}/kv")
        self._dictionary().write.parquet(f"{other.path}/dictionary/{uuid.uuid4().hex}")
        other._write_text("[]", path, "_manifest")

    @classmethod
    def restore(cls, spark: SparkSession, backup: str, path: str, log: DataFrame | None = None) -> Engine:
        """A store at `path` from a backup, and the mutations (rows of the log) that came after it."""
        cls(spark, backup).backup(path)
        out = cls(spark, path)
        if log is not None:
            out._append(log)
        return out

    def debug_dump(self, depth: int) -> DataFrame:
        """bucket_id, name, entries, and its entries as (key, values): many rows, for looking at small stores."""
        found = self.multimap().groupBy("key").agg(F.sort_array(F.collect_list(C.hexed(F.col("value")))).alias("values"))
        return found.select(C.bucket(F.col("key"), depth).alias("bucket_id"), C.hexed(F.col("key")).alias("key"), "values").withColumn("name", C.bucket_name(F.col("bucket_id")))

    def bucket_stats(self, depth: int) -> DataFrame:
        return maintain.bucket_stats(self.multimap(), C.bucket(F.col("key"), depth))

    def audit(self) -> dict[str, DataFrame]:
        facts, predicates = self.store().everything(), self.registry.frame(self.spark)
        return {"indices": audit.consistency(*audit.orders(facts)), "counters": audit.counters(facts), "sets": audit.sets(facts), "plugins": audit.everything(facts, predicates), "unjustified": audit.unjustified(predicates)}
