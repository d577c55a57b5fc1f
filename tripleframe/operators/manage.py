"""Managing plugins beyond registration: option checks, versions, guarded folds, and configurations from an ontology."""

from __future__ import annotations

import importlib
import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import Plugin, PluginRegistry

log = logging.getLogger(__name__)

#: Options of each plugin, and the type that their values have.
OPTIONS: dict[str, dict[str, type]] = {
    "counter": {"initial": int, "overflow": str},
    "accumulator": {"initial": int, "overflow": str},
    "multivalue_set": {"symmetric": bool, "max_size": int, "deduplication": bool},
    "single_value": {"versioning": bool},
    "enum": {"allowed": list, "strict": bool},
    "timeseries": {"retention_days": int},
    "fulltext": {"language": str},
}
# Category of an ontology's relation -> plugin, limit of concurrent reads, options.
CATEGORIES = {"counting": ("counter", 50, {}), "social": ("multivalue_set", 10, {"symmetric": False}), "text": ("fulltext", 2, {"language": "en"})}
OTHERWISE = ("single_value", 20, {})


def schema(plugin: str) -> dict[str, str]:
    """Names and types of a plugin's options."""
    return {name: kind.__name__ for name, kind in OPTIONS.get(plugin, {}).items()}


def option_errors(plugin: str, options: dict) -> list[str]:
    known = OPTIONS.get(plugin, {})
    return [f"{plugin} has no option {k}" if k not in known else f"{k} is not of type {known[k].__name__}" for k, v in options.items() if k not in known or not isinstance(v, known[k])]


def discovered(plugins: PluginRegistry, module: str) -> list[str]:
    """Registers the plugin classes that a module defines."""
    found = importlib.import_module(module)
    classes = [c for c in vars(found).values() if isinstance(c, type) and issubclass(c, Plugin) and c.__module__ == module and isinstance(getattr(c, "name", None), str)]
    for c in classes:
        plugins.register(c.name, c)
    return [c.name for c in classes]


def version(text: str) -> tuple[int, ...]:
    return tuple(map(int, text.split(".")))


def compatible(plugin: type[Plugin], engine: str) -> bool:
    """Whether the engine is as new as the plugin wants; only the numbers that both versions have are compared."""
    have, want = version(engine), version(getattr(plugin, "needs", "0"))
    n = min(len(have), len(want))
    return have[:n] >= want[:n]


def from_ontology(relations: DataFrame) -> DataFrame:
    """term, plugin, concurrency_limit and index support of an ontology's relations (term, category)."""

    def pick(i: int, otherwise: object) -> Column:
        out = None
        for category, how in CATEGORIES.items():
            out = F.when(F.col("category") == category, how[i]) if out is None else out.when(F.col("category") == category, how[i])
        return out.otherwise(otherwise)

    indexed = F.coalesce(F.col("category") != "text", F.lit(True))
    return relations.select("term", pick(0, OTHERWISE[0]).alias("plugin"), pick(1, OTHERWISE[1]).alias("concurrency_limit"), indexed.alias("supports_osp"), indexed.alias("supports_pos"))


@dataclass
class Guarded:
    """A plugin whose failures raise, or are logged and give an empty frame; after `most` of them it is disabled."""

    plugin: Plugin
    mode: str = "raise"
    most: int = 10
    errors: list[str] = field(default_factory=list)

    @property
    def disabled(self) -> bool:
        return len(self.errors) > self.most

    def fold(self, rows: DataFrame, checked: bool = False) -> DataFrame:
        """The plugin's fold. Frames are lazy, so what fails while rows are read shows only later; with `checked` the
        fold runs once here, which counts such a failure, too."""
        empty = rows.select("s", F.lit(None).cast("binary").alias("o_cid"), F.lit(None).cast("long").alias("o_int")).where("false")
        if self.disabled:
            return empty
        try:
            made = self.plugin.fold(rows)
            if checked:
                made.write.format("noop").mode("overwrite").save()
            return made
        except Exception as e:
            self.errors.append(str(e))
            if self.mode == "raise":
                raise
            log.warning("plugin %s: %s", self.plugin.name, e)
            return empty


@dataclass
class Migrations:
    """Ways from one version of a plugin to a later one, as functions of a frame; several are run one after another."""

    steps: dict[tuple[str, str, str], Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def add(self, plugin: str, old: str, new: str, step: Callable[[DataFrame], DataFrame]) -> None:
        self.steps[plugin, old, new] = step

    def way(self, plugin: str, old: str, new: str) -> list[tuple[str, str, str]]:
        """The shortest chain of steps, breadth first."""
        reached, open_ = {old: []}, [old]
        while open_:
            at = open_.pop(0)
            for step in sorted(self.steps):
                if step[0] == plugin and step[1] == at and step[2] not in reached:
                    reached[step[2]] = [*reached[at], step]
                    open_.append(step[2])
        if new not in reached:
            raise ValueError(f"no way from {plugin} {old} to {new}")
        return reached[new]

    def run(self, triples: DataFrame, plugin: str, old: str, new: str) -> DataFrame:
        for step in self.way(plugin, old, new):
            triples = self.steps[step](triples)
        return triples
