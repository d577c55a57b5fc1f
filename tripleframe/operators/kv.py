"""The multimap from identifiers to sets of identifiers, over its mutation log (op, ht, key, value).

A delete with a value removes that pair, one without it the whole key. Folding takes one aggregation by
(key, value) and one by key, both combined before their shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripleframe.functions.cid import WIDTH, bucket, hexed

#: Values that stay in an entry; more move to a value set.
INLINE = 2


def inserted(log: DataFrame, zero_is_error: bool = True) -> DataFrame:
    """The log, or an error for a value of zeros, which means an empty slot."""
    zero = F.col("value") == F.lit(bytearray(WIDTH))
    bad = F.raise_error(F.lit("the zero identifier cannot be a value")).cast("binary")
    return log.withColumn("value", F.when((F.col("op") == "INSERT") & zero, bad).otherwise(F.col("value"))) if zero_is_error else log.where(~F.coalesce(zero, F.lit(False)))


def fold(log: DataFrame) -> DataFrame:
    """key, value, ht: the pairs that are there after all mutations; ht is that of the insert since when it is."""
    pairs = log.where("value is not null").groupBy("key", "value").agg(F.max(F.when(F.col("op") == "DELETE", F.col("ht"))).alias("gone"), F.max(F.when(F.col("op") == "INSERT", F.col("ht"))).alias("last"))
    keys = log.where("value is null and op = 'DELETE'").groupBy("key").agg(F.max("ht").alias("cleared"))
    alive = pairs.join(keys, "key", "left").where("last is not null and (gone is null or last > gone) and (cleared is null or last > cleared)")
    since = log.where("op = 'INSERT'").join(alive, ["key", "value"]).where("(gone is null or ht > gone) and (cleared is null or ht > cleared)")
    return since.groupBy("key", "value").agg(F.min("ht").alias("ht"))


def lookup(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """Values of many keys at once, in the order they came in."""
    return kv.join(keys.select("key").distinct(), "key").withColumn("slot", F.row_number().over(W.partitionBy("key").orderBy("ht", "value")))


def modes(kv: DataFrame) -> DataFrame:
    """key, n_values, mode: inline while its distinct values fit in an entry, else spill."""
    return kv.groupBy("key").agg(F.countDistinct("value").alias("n_values")).withColumn("mode", F.when(F.col("n_values") <= INLINE, "inline").otherwise("spill"))


def entries(kv: DataFrame, depth: int) -> DataFrame:
    """key, bucket_id, entries, slots (values in slot order, as hex) and has_set of every entry, for looking at stores;
    a value set with very many values is one row here."""
    slots = F.transform(F.sort_array(F.collect_list(F.struct("ht", "value"))), lambda x: hexed(x["value"]))
    found = kv.groupBy("key").agg(F.count("*").alias("entries"), F.concat_ws(",", slots).alias("slots"))
    return found.select(bucket(F.col("key"), depth).alias("bucket_id"), "key", "entries", "slots", (F.col("entries") > INLINE).alias("has_set"))


def tombstones(log: DataFrame) -> DataFrame:
    return log.groupBy("key").agg(F.count_if(F.col("op") == "DELETE").alias("tombstones"))


def compacted(log: DataFrame) -> DataFrame:
    """The log without what later mutations undid."""
    return fold(log).select(F.lit("INSERT").alias("op"), "ht", "key", "value")
