"""Predicates, their plugins and the ontology: driver-side, at most LIMIT entries, broadcast where a plan needs them."""

from __future__ import annotations

import json
import re
import warnings
from abc import ABC, abstractmethod
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripleframe.errors import InvalidTermError, PredicateLimitExceededError
from tripleframe.functions import terms
from tripleframe.functions.cid import Cid
from tripleframe.schema import PREDICATE

LIMIT = 200


class Plugin(ABC):
    """How a predicate folds its mutation log (op, ord, s, o_cid, o_int; ord orders it) into its current triples."""

    name: str
    supports_osp = False
    supports_pos = False

    def __init__(self, predicate: Cid | None = None, concurrency_limit: int | None = None, **config):
        self.predicate, self.concurrency_limit, self.config = predicate, concurrency_limit, config

    @abstractmethod
    def fold(self, log: DataFrame) -> DataFrame:
        """s, o_cid, o_int."""

    def audit(self, triples: DataFrame) -> DataFrame:
        return triples.groupBy("p").agg(F.count("*").alias("triples"))


class Counter(Plugin):
    """One integer a subject; inserting overwrites, and deleting works only on the current value."""

    name, supports_osp, supports_pos = "counter", True, True

    def fold(self, log: DataFrame) -> DataFrame:
        if "op" not in log.columns:
            return log.groupBy("s").agg(F.max_by("o_int", "ord").alias("o_int")).select("s", F.lit(None).cast("binary").alias("o_cid"), "o_int")
        # a delete that names the current value leaves nothing, any other one changes nothing; so only the last insert
        # and the deletes after it matter, and two combined aggregations find them
        last = log.where("op = 'INSERT' and o_int is not null").groupBy("s").agg(F.max(F.struct("ord", "o_int")).alias("last"))
        deletes = log.where("op = 'DELETE'").groupBy("s", "o_int").agg(F.max("ord").alias("deleted"))
        rows = last.select("s", F.col("last.ord").alias("ord"), F.col("last.o_int").alias("o_int")).join(deletes, ["s", "o_int"], "left")
        return rows.where("deleted is null or deleted < ord").select("s", F.lit(None).cast("binary").alias("o_cid"), "o_int")

    def audit(self, triples: DataFrame) -> DataFrame:
        return triples.groupBy("p").agg(
            F.count("*").alias("counter_count"), F.countDistinct("o_int").alias("unique_values"), F.coalesce(F.avg("o_int"), F.lit(0.0)).alias("avg_value"),
            F.count("*").alias("spo_entries"), F.countDistinct("o_int").alias("osp_entries"), F.countDistinct("o_int").alias("pos_entries"),
        )


class MultiValueSet(Plugin):
    """Any number of identifiers a subject, each once. Options: symmetric (a member has its subject as a member, too),
    max_size (the first members of a subject stay), deduplication (False: as often as it was inserted)."""

    name, supports_osp, supports_pos = "multivalue_set", True, True

    def fold(self, log: DataFrame) -> DataFrame:
        rows = log.where("o_cid is not null")
        if self.config.get("symmetric"):
            rows = rows.unionByName(rows.withColumns({"s": F.col("o_cid"), "o_cid": F.col("s")}))
        most = self.config.get("max_size")
        if "op" not in log.columns:
            kept = rows.select("s", "o_cid") if self.config.get("deduplication") is False else rows.select("s", "o_cid").distinct()
        else:
            first = F.min(F.when(F.col("op") == "INSERT", F.col("ord"))).alias("first")
            pairs = rows.groupBy("s", "o_cid").agg(F.max_by("op", "ord").alias("op"), F.max(F.when(F.col("op") == "DELETE", F.col("ord"))).alias("gone"), first).where("op = 'INSERT'")
            kept = pairs
            if self.config.get("deduplication") is False:
                kept = rows.where("op = 'INSERT'").join(pairs.select("s", "o_cid", "gone"), ["s", "o_cid"]).where("gone is null or ord > gone").withColumn("first", F.col("ord"))
        if most is not None:
            place = F.row_number().over(W.partitionBy("s").orderBy(*(["first"] if "first" in kept.columns else []), "o_cid"))
            kept = kept.withColumn("place", place).where(F.col("place") <= most)
        return kept.select("s", "o_cid", F.lit(None).cast("long").alias("o_int"))

    def audit(self, triples: DataFrame) -> DataFrame:
        return triples.groupBy("p").agg(
            F.countDistinct("s").alias("set_count"), F.count("*").alias("total_values"), (F.count("*") / F.countDistinct("s")).alias("avg_set_size"), F.countDistinct("o_cid").alias("unique_objects"),
        )


class PluginRegistry:
    def __init__(self):
        self._classes: dict[str, type[Plugin]] = {}

    def register(self, name: str, cls: type[Plugin]) -> None:
        if name in self._classes:
            raise ValueError(f"plugin {name!r} is registered already")
        if not (isinstance(cls, type) and issubclass(cls, Plugin)):
            raise TypeError("a plugin is a subclass of Plugin")
        self._classes[name] = cls

    def get(self, name: str) -> type[Plugin] | None:
        return self._classes.get(name)

    def list(self) -> list[str]:
        return list(self._classes)

    def create(self, name: str, predicate: Cid, **config) -> Plugin:
        if name not in self._classes:
            raise ValueError(f"unknown plugin {name!r}; available: {', '.join(self._classes)}")
        return self._classes[name](predicate, **config)


def default_plugins() -> PluginRegistry:
    found = PluginRegistry()
    for cls in (Counter, MultiValueSet):
        found.register(cls.name, cls)
    return found


#: Other names of plugins that configurations use.
ALIASES = {"multivalue": "multivalue_set"}


@dataclass(frozen=True)
class Predicate:
    cid: Cid
    plugin: Plugin
    name: str | None = None
    justification: str | None = None


@dataclass
class Registry:
    plugins: PluginRegistry = field(default_factory=default_plugins)
    entries: dict[Cid, Predicate] = field(default_factory=dict)
    ontology: dict[str, object] = field(default_factory=dict)

    def register(self, predicate: Cid, plugin: str, name: str | None = None, justification: str | None = None, **config) -> Predicate:
        """Adds a predicate or replaces it; the limit counts even a replacement."""
        if len(self.entries) >= LIMIT:
            raise PredicateLimitExceededError(f"the ontology holds {LIMIT} predicates already")
        entry = Predicate(predicate, self.plugins.create(ALIASES.get(plugin, plugin), predicate, **config), name, justification)
        self.entries[predicate] = entry
        return entry

    def register_term(self, term: str, plugin: str, justification: str | None = None, **config) -> Predicate:
        """Strict grammar; the identifier is the 128-bit one of terms."""
        if why := strict_reason(term):
            raise InvalidTermError(term, why)
        return self.register(Cid.predicate(term), plugin, term, justification, **config)

    def load(self, config: dict) -> list[Predicate]:
        """Predicates of a configuration `{predicates: [{name, plugin, config, justification}]}`, lenient grammar."""
        out = []
        for item in config.get("predicates", []):
            if not re.match(terms.LENIENT, item.get("name") or ""):
                raise InvalidTermError(item.get("name") or "", "not of the form kind:namespace:label")
            out.append(self.register(Cid.predicate(item["name"]), item["plugin"], item["name"], item.get("justification"), **(item.get("config") or {})))
        return out

    def load_ontology(self, ontology: dict[str, dict]) -> None:
        for term, spec in ontology.items():
            if not re.match(terms.LENIENT, term):
                raise ValueError(f"invalid term {term!r}")
            if not (spec or {}).get("justification"):
                warnings.warn(f"{term} has no justification", UserWarning, stacklevel=2)
        self.ontology |= ontology

    def unregister(self, predicate: Cid) -> Predicate | None:
        return self.entries.pop(predicate, None)

    def retype(self, predicate: Cid, plugin: str) -> Predicate:
        """Another plugin for a predicate, whose name and justification stay. Unknown plugins change nothing."""
        old = self.entries[predicate]
        self.entries[predicate] = replace(old, plugin=self.plugins.create(ALIASES.get(plugin, plugin), predicate))
        return self.entries[predicate]

    def get(self, predicate: Cid) -> Predicate | None:
        return self.entries.get(predicate)

    def all(self) -> list[Cid]:
        return list(self.entries)

    def name_of(self, predicate: Cid) -> str | None:
        return self.entries[predicate].name if predicate in self.entries else None

    def cid_of(self, name: str) -> Cid | None:
        return next((e.cid for e in self.entries.values() if e.name == name), None)

    def violations(self) -> dict[str, list[str]]:
        """Predicates without a justification, and a warning at the limit."""
        missing = [e.name or e.cid.hex for e in self.entries.values() if not e.justification]
        return {"violations": missing, "warnings": [f"{len(self.entries)} predicates reach the limit of {LIMIT}"] if len(self.entries) >= LIMIT else []}

    def validate(self, config: dict[str, dict]) -> list[str]:
        """Errors of a configuration by predicate name, by the rules below, and of its size."""
        rules = {
            "Invalid term: {name}": lambda name, spec: re.match(terms.LENIENT, name),
            "Unknown plugin '{plugin}' for predicate {name}": lambda name, spec: self.plugins.get(ALIASES.get(spec.get("plugin"), spec.get("plugin"))),
            "Missing performance baseline for {name}": lambda name, spec: "performance_baseline" in spec,
        }
        broken = [text.format(name=name, plugin=spec.get("plugin")) for name, spec in config.items() for text, holds in rules.items() if not holds(name, spec)]
        return broken + [f"{len(config)} predicates exceed the limit of {LIMIT}"] * (len(config) > LIMIT)

    def saved(self) -> str:
        """All of the registry but its plugins' classes, as JSON."""
        entries = [{"cid": e.cid.hex, "plugin": e.plugin.name, "name": e.name, "justification": e.justification, "limit": e.plugin.concurrency_limit, "config": e.plugin.config} for e in self.entries.values()]
        return json.dumps({"entries": entries, "ontology": self.ontology}, default=lambda x: {"cid": x.hex} if isinstance(x, Cid) else str(x), sort_keys=True)

    def restore(self, text: str) -> Registry:
        """Puts the entries of saved() in place of its own; plugins must be known by name."""
        found = json.loads(text, object_hook=lambda x: Cid(bytes.fromhex(x["cid"])) if set(x) == {"cid"} else x)
        self.entries = {}
        for e in found["entries"]:
            key = Cid(bytes.fromhex(e["cid"]))
            self.entries[key] = Predicate(key, self.plugins.create(e["plugin"], key, concurrency_limit=e["limit"], **e["config"]), e["name"], e["justification"])
        self.ontology = found["ontology"]
        return self

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (bytearray(e.cid.raw), e.name, e.plugin.name, e.plugin.supports_osp, e.plugin.supports_pos, e.plugin.concurrency_limit, e.justification, i)
            for i, e in enumerate(self.entries.values())
        ]
        return spark.createDataFrame(rows, PREDICATE)


def strict_reason(term: str) -> str | None:
    """terms.reason for one term on the driver."""
    parts = (term or "").split(":")
    if not term or len(parts) != 3 or parts[0] not in terms.KINDS or not all(re.fullmatch(terms.PART, x) for x in parts[1:]):
        return "Empty term" if not term else f"not of the form kind:namespace:label with a kind of {', '.join(terms.KINDS)}"
    return None
