"""Beyond the built-in plugins: stores that the design documents name, as folds and filters over frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripleframe.functions.cid import Cid, rotated_key

from .registry import Plugin


class SingleValue(Plugin):
    """The last value written; with versioning, all of them numbered."""

    name, supports_osp, supports_pos = "single_value", True, True

    def fold(self, log: DataFrame) -> DataFrame:
        last = log.groupBy("s").agg(F.max_by(F.struct("o_cid", "o_int"), "ord").alias("o"))
        return last.select("s", "o.o_cid", "o.o_int")

    def versions(self, log: DataFrame) -> DataFrame:
        return log.withColumn("version", F.row_number().over(W.partitionBy("s").orderBy("ord")))


class Accumulator(Plugin):
    """A counter that increments; on overflow it saturates, wraps or fails."""

    name, supports_osp, supports_pos = "accumulator", True, True

    def fold(self, log: DataFrame) -> DataFrame:
        total = F.sum(F.col("o_int").cast("decimal(38,0)")) + F.lit(self.config.get("initial", 0)).cast("decimal(38,0)")
        return log.groupBy("s").agg(bounded(total, self.config.get("overflow", "saturate")).alias("o_int")).select("s", F.lit(None).cast("binary").alias("o_cid"), "o_int")


def bounded(total: Column, overflow: str) -> Column:
    low, high = (F.lit(x).cast("decimal(38,0)") for x in (str(-(1 << 63)), str((1 << 63) - 1)))
    match overflow:
        case "saturate":
            return F.least(F.greatest(total, low), high).cast("long")
        case "wrap":
            size = F.lit(str(1 << 64)).cast("decimal(38,0)")
            return (F.pmod(total - low, size) + low).cast("long")
        case "error":
            return total.cast("long")
    raise ValueError(f"unknown overflow {overflow!r}")


class Enumeration(Plugin):
    """A single value of a fixed list; strict ones fail on others, lenient ones skip them."""

    name, supports_osp, supports_pos = "enum", True, True

    def fold(self, log: DataFrame) -> DataFrame:
        known = F.col("o_cid").isin([bytearray(c.raw) for c in self.config["allowed"]])
        if self.config.get("strict"):
            log = log.withColumn("o_cid", F.when(known, F.col("o_cid")).otherwise(F.raise_error(F.lit("a value that is not allowed")).cast("binary")))
        return SingleValue().fold(log.where(known) if not self.config.get("strict") else log)


class Boolean(Enumeration):
    """A single value that is one of two identifiers, for true and for false."""

    name = "boolean"

    def __init__(self, predicate=None, concurrency_limit=None, **config):
        super().__init__(predicate, concurrency_limit, **{"allowed": [Cid.of("true"), Cid.of("false")], **config})


class BloomFilter(Plugin):
    """A set that is asked for membership only: bits of each subject's members, which can say yes for others at times."""

    name, supports_osp, supports_pos = "bloom_filter", False, False

    def fold(self, log: DataFrame) -> DataFrame:
        return log.where("o_cid is not null").select("s", "o_cid", F.lit(None).cast("long").alias("o_int")).distinct()

    def filters(self, log: DataFrame) -> DataFrame:
        """s, slot, word: words of 64 bits that are not zero, so that a subject of any size is many rows."""
        bits = log.where("o_cid is not null").select("s", F.explode(bloom_bits(F.col("o_cid"), self.config.get("bits", 1 << 16), self.config.get("hashes", 5))).alias("bit"))
        return bits.groupBy("s", F.shiftright("bit", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word"))

    def might_hold(self, filters: DataFrame, asked: DataFrame) -> DataFrame:
        """s, o_cid and whether the filter may hold each asked pair."""
        n = self.config.get("hashes", 5)
        bits = asked.select("s", "o_cid", F.explode(bloom_bits(F.col("o_cid"), self.config.get("bits", 1 << 16), n)).alias("bit")).withColumn("slot", F.shiftright("bit", 6))
        hit = F.coalesce(F.expr("(word & shiftleft(1L, cast(bit & 63 as int))) != 0"), F.lit(False))
        return bits.join(filters, ["s", "slot"], "left").groupBy("s", "o_cid").agg(F.every(hit).alias("may_hold"))


def bloom_bits(value: Column, bits: int, hashes: int) -> Column:
    return F.array(*(F.pmod(F.xxhash64(F.lit(i), value), F.lit(bits)) for i in range(hashes)))


def series_range(series: DataFrame, start: Column, end: Column) -> DataFrame:
    """Points (s, ts, ...) of an inclusive range of time."""
    return series.where(F.col("ts").between(start, end))


def series_recent(series: DataFrame, now: Column, hours: int) -> DataFrame:
    return series.where((F.col("ts") > now - F.make_interval(hours=F.lit(hours))) & (F.col("ts") <= now))


def retained(series: DataFrame, now: Column, days: int) -> DataFrame:
    return series.where(F.col("ts") >= now - F.make_interval(days=F.lit(days)))


def symmetric(triples: DataFrame) -> DataFrame:
    """A set predicate read both ways."""
    return triples.select("s", "o_cid").union(triples.select(F.col("o_cid").alias("s"), F.col("s").alias("o_cid"))).distinct()


def at_most(log: DataFrame, size: int) -> DataFrame:
    """The first `size` distinct objects of each subject, a feature of sets with max_size."""
    first = log.groupBy("s", "o_cid").agg(F.min("ord").alias("ord"))
    return first.withColumn("r", F.row_number().over(W.partitionBy("s").orderBy("ord", "o_cid"))).where(F.col("r") <= size).drop("r")


def inverted(texts: DataFrame) -> DataFrame:
    """word, s, n of a full-text store (s, text)."""
    words = texts.select("s", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"))).alias("word"))
    return words.groupBy("word", "s").agg(F.count("*").alias("n"))


def with_all_words(index: DataFrame, *words: str) -> DataFrame:
    hits = index.where(F.col("word").isin([w.lower() for w in words])).groupBy("s").agg(F.count("*").alias("words"), F.sum("n").alias("n"))
    return hits.where(F.col("words") == len({w.lower() for w in words})).select("s", "n")


def in_box(points: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Places (s, lat, lon) of a box, which may cross the date line."""
    lon = F.col("lon").between(west, east) if west <= east else (F.col("lon") >= west) | (F.col("lon") <= east)
    return points.where(F.col("lat").between(south, north) & lon)


def bitmap_counts(triples: DataFrame, number: Column) -> DataFrame:
    """Distinct subjects by predicate through bitmaps, for subjects with small numbers."""
    parts = triples.groupBy("p", F.bitmap_bucket_number(number).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
    return parts.groupBy("p").agg(F.sum(F.bitmap_count("bits")).alias("subjects"))


def predicate_stats(triples: DataFrame) -> DataFrame:
    """Cardinality and selectivity of each predicate, for choosing what to join first."""
    per_subject = triples.groupBy("p", "s").agg(F.count("*").alias("n"))
    return per_subject.groupBy("p").agg(F.sum("n").alias("cardinality"), F.count("*").alias("subjects")).withColumn("selectivity", F.lit(1.0) / F.col("subjects"))


def plan_order(stats: DataFrame) -> list[bytes]:
    """Predicates from the most selective on; at most 200 rows come to the driver."""
    return [bytes(r["p"]) for r in stats.orderBy("cardinality", "p").limit(200).collect()]


def planned_join(store, patterns: list[tuple[Cid, str, str]], stats: DataFrame) -> DataFrame:
    """Patterns (predicate, subject's name, object's name) joined on the names they share: the most selective one first,
    then always one that is connected, so that no step is a product while there is another."""
    rank = {p: i for i, p in enumerate(plan_order(stats))}
    left = sorted(patterns, key=lambda x: (rank.get(x[0].raw, len(rank)), x[1:]))
    out, names = None, set()
    while left:
        at = next((i for i, (_, s, o) in enumerate(left) if not names or {s, o} & names), None)
        if at is None:
            raise ValueError("the patterns are not connected")
        p, s, o = left.pop(at)
        step = store.enumerate(p).select(F.col("s").alias(s), F.col("o_cid").alias(o))
        out = step if out is None else out.join(step, sorted({s, o} & names))
        names |= {s, o}
    return out


def rotations(triples: DataFrame, turns: dict[str, int]) -> DataFrame:
    """key, turn, p, s, o_cid of the rotated composite keys: a triple is stored once for each order (SPO, OSP, POS),
    and a lookup by any two terms is one equality."""
    pairs = {"spo": ("s", "p"), "osp": ("o_cid", "s"), "pos": ("p", "o_cid")}
    out = None
    for name, turn in turns.items():
        part = triples.select(rotated_key(turn)(*pairs[name]).alias("key"), F.lit(name).alias("turn"), "p", "s", "o_cid")
        out = part if out is None else out.unionByName(part)
    return out


def sharded(predicates: DataFrame, shards: int) -> DataFrame:
    return predicates.withColumn("shard", F.pmod(F.xxhash64("p"), F.lit(shards)))
