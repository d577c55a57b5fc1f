"""The TPC-H-like tables as a graph: one lazy source for each predicate term."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleframe.functions.cid import Cid, cid
from tripleframe.operators.registry import Registry
from tripleframe.plans.query import Store
from tripleframe.sources import tables

#: A source of triples from tables; with (i, n), only those of the i-th of n shares of its subjects.
Log = Callable[..., DataFrame]
#: Rows of a predicate's tables that one share of an audit may hold in any case, and the shares that all rows make, but for
#: shares that predicates fill in part: each share reads its tables anew, so their number must not grow with the tables.
SHARE, SHARES = 2_000_000, 16
#: Rows of tables for a task that writes a share.
TASK = 200_000


def named(kind: str, key: str) -> Column:
    return cid(F.concat(F.lit(f"E:{kind}:"), F.col(key).cast("string")))


def shared(rows: DataFrame, key: str, share: tuple[int, int] | None) -> DataFrame:
    return rows if share is None or share[1] == 1 else rows.where(F.pmod(F.xxhash64(key), F.lit(share[1])) == share[0])


def link(table: str, s: tuple[str, str], o: tuple[str, str]) -> Log:
    """Triples of two columns; the keys are made distinct before they are hashed."""
    return lambda t, share=None: shared(t(table), s[1], share).select(s[1], o[1]).where(f"{s[1]} is not null and {o[1]} is not null").distinct().select(named(*s).alias("s"), named(*o).alias("o_cid"))


def number(table: str, s: tuple[str, str], value: str, order: str) -> Log:
    """A counter: the last value by the given order, folded on the plain key before it is hashed."""
    return lambda t, share=None: shared(t(table), s[1], share).groupBy(s[1]).agg(F.max_by(F.expr(value).cast("long"), F.expr(order)).alias("o_int")).where(f"{s[1]} is not null").select(named(*s).alias("s"), "o_int")


def both(*parts: Log) -> Log:
    return lambda t, share=None: parts[0](t, share).unionByName(both(*parts[1:])(t, share)) if len(parts) > 1 else parts[0](t, share)


#: term -> (plugin, source)
PREDICATES: dict[str, tuple[str, Log]] = {
    "R:tpch:placedBy": ("multivalue_set", link("orders", ("order", "o_orderkey"), ("cust", "o_custkey"))),
    "R:tpch:hasPart": ("multivalue_set", link("lineitem", ("order", "l_orderkey"), ("part", "l_partkey"))),
    "R:tpch:suppliedBy": ("multivalue_set", link("lineitem", ("order", "l_orderkey"), ("supp", "l_suppkey"))),
    "R:tpch:inNation": ("multivalue_set", both(link("customer", ("cust", "c_custkey"), ("nation", "c_nationkey")), link("supplier", ("supp", "s_suppkey"), ("nation", "s_nationkey")))),
    "R:tpch:inRegion": ("multivalue_set", link("nation", ("nation", "n_nationkey"), ("region", "n_regionkey"))),
    "R:tpch:partSize": ("counter", number("part", ("part", "p_partkey"), "p_size", "p_partkey")),
    "R:tpch:lineCount": ("counter", number("lineitem", ("order", "l_orderkey"), "l_linenumber", "l_linenumber")),
    "R:evt:lastValue": ("counter", number("events", ("user", "user_id"), "floor(value * 100)", "struct(ts, event_id)")),
    "R:evt:did": ("multivalue_set", link("events", ("user", "user_id"), ("evt", "event_type"))),
    "R:doc:nChars": ("counter", number("documents", ("doc", "doc_id"), "n_chars", "doc_id")),
    "R:doc:lang": ("multivalue_set", link("documents", ("doc", "doc_id"), ("lang", "lang"))),
}
#: A predicate that nobody registered; its triples are hashed into the multimap.
UNREGISTERED = "R:tpch:priority"


def registry(*justified: str) -> Registry:
    out = Registry()
    for term, (plugin, _) in PREDICATES.items():
        out.register_term(term, plugin, "in use" if term in justified else None)
    return out


def triples(spark: SparkSession, sf_dir: str, term: str, share: tuple[int, int] | None = None) -> DataFrame:
    """s, o_cid, o_int of a predicate."""
    plugin, source = PREDICATES[term]
    rows = source(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), share)
    none_cid, none_int = F.lit(None).cast("binary"), F.lit(None).cast("long")
    return rows.select("s", none_cid.alias("o_cid"), "o_int") if plugin == "counter" else rows.select("s", "o_cid", none_int.alias("o_int"))


def store(spark: SparkSession, sf_dir: str, **options) -> Store:
    sources = {Cid.predicate(term): partial(triples, spark, sf_dir, term) for term in PREDICATES}
    return Store(registry(), sources, spark, **options)


def rows_read(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """Rows of the tables that each predicate is made from."""
    frames, counts, out = {}, {}, {}

    def table(name: str, own: list[str]) -> DataFrame:
        own.append(name)
        if name not in frames:
            frames[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            counts[name] = frames[name].count()
        return frames[name]

    for term, (_, source) in PREDICATES.items():
        names: list[str] = []
        source(partial(table, own=names))
        out[term] = sum(counts[x] for x in names)
    return out


def bundles(spark: SparkSession, sf_dir: str, size: int | None = None, rows: dict[str, int] | None = None, shares: int | None = None) -> list[tuple[list[str], int]]:
    """Predicates that are laid out together, and in how many shares of their subjects: at most `size` rows of tables each
    (SHARE, or one of SHARES equal parts of all rows if that is more), but for a single subject with more."""
    rows, out, held, n = rows or rows_read(spark, sf_dir), [], [], 0
    size = size or max(SHARE, -(-sum(rows.values()) // (shares or SHARES)))
    for found, term in sorted((found, term) for term, found in rows.items()):
        if held and n + found > size:
            out.append((held, -(-n // size) or 1))
            held, n = [], 0
        held, n = [*held, term], n + found
    return [*out, (held, -(-n // size) or 1)]


def laid_out(spark: SparkSession, sf_dir: str, terms: list[str], n: int, rows: dict[str, int]) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Both layouts (by subject, by object) of predicates as read back, one of n shares of their subjects at a time; `rows`
    of their tables say how many tasks a share gets. A share's folders go when the next one is asked for, so that
    predicates of any size need a share's disk."""
    for i in range(n):
        path = tables.shared_place(spark, "share")
        for term in terms:
            held = triples(spark, sf_dir, term, (i, n)).coalesce(-(-rows[term] // (n * TASK)) or 1).persist()  # hashed once for both layouts
            tables.save_share(held, Cid.predicate(term), path)
            held.unpersist(True)
        yield tuple(tables.load_triples(spark, path, layout) for layout in tables.LAYOUTS)
        tables.removed(spark, path)


#: Layouts that sessions have made, by session and folder of tables.
_stored: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, **options) -> Store:
    """The same store over its stored layouts, which a session makes once for a folder of tables, as a load does."""
    key = (spark.sparkContext.applicationId, sf_dir)
    lazy = store(spark, sf_dir, **options)
    if key not in _stored:
        path = tables.shared_place(spark, "graph")
        tables.save_triples(lazy.everything(), path, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        _stored[key] = path
    return Store(lazy.registry, lazy.sources, spark, stored=_stored[key], **options)
