"""Stored layouts: a new version is a new folder; readers follow the folder that they were given."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleframe.functions import cid as C
from tripleframe.schema import KV, TRIPLE

#: Bits of the directory that buckets of the multimap are stored by.
DEPTH = 6
STORED = T.StructType([*TRIPLE, T.StructField("pred", T.StringType())])
LAYOUTS = {"spo": ["pred", "s"], "osp": ["pred", "o_cid", "o_int"]}


def shared_place(spark: SparkSession, name: str) -> str:
    """A path that nobody has used yet, in the folder that driver and executors share: spark.checkpoint.dir, or a
    temporary folder where all of Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.gettempdir()
    return f"{found.rstrip('/')}/tripleframe-{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that no later plan reads, and lets Spark drop the shuffle files of plans that are gone, too."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    gc.collect()
    spark._jvm.System.gc()


def save_triples(triples: DataFrame, path: str, partitions: int) -> None:
    """Both layouts, partitioned by predicate (at most 200) and sorted for statistics of pages and row groups: by
    subject, and by object. The object layout serves (?, p, o) as well, as its folders are predicates."""
    rows = triples.select(C.hexed(F.col("p")).alias("pred"), "p", "s", "o_cid", "o_int")
    for name, keys in LAYOUTS.items():
        rows.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("pred").parquet(f"{path}/{name}")


def save_share(rows: DataFrame, p: C.Cid, path: str) -> None:
    """Both layouts of some subjects (s, o_cid, o_int) of one predicate: the folders and the order in files of
    save_triples, but files as rows come, not dealt by ranges, which would send all rows around for each layout."""
    for name, keys in LAYOUTS.items():
        own = rows.select(p.lit.alias("p"), "s", "o_cid", "o_int")
        own.sortWithinPartitions(*keys[1:]).write.mode("overwrite").parquet(f"{path}/{name}/pred={p.hex}")


def load_triples(spark: SparkSession, path: str, layout: str = "spo", predicates: list[C.Cid] | None = None) -> DataFrame:
    """p, s, o_cid, o_int and pred, of some predicates or all; filters on the layout's order skip pages."""
    rows = spark.read.schema(STORED).parquet(f"{path}/{layout}")
    return rows.where(F.col("pred").isin([p.hex for p in predicates])) if predicates is not None else rows


def save_kv(kv: DataFrame, path: str, depth: int = DEPTH) -> None:
    """Buckets by the key's top bits, each sorted by key."""
    kv.withColumn("bucket", C.bucket(F.col("key"), depth)).repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "ht").write.mode("overwrite").partitionBy("bucket").parquet(path)


def load_kv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*KV, T.StructField("bucket", T.LongType())])).parquet(path)


def find_kv(spark: SparkSession, path: str, key: C.Cid, depth: int = DEPTH) -> DataFrame:
    """One key: its bucket prunes folders, its bytes row groups."""
    return spark.read.parquet(path).where((F.col("bucket") == int.from_bytes(key.raw[:8], "big") >> (64 - depth)) & (F.col("key") == key.lit)).drop("bucket")


def generated(spark: SparkSession, n: int = 1_000_000, seed: int = 42) -> DataFrame:
    """A bench's random triples, the same for a seed."""
    text = [F.concat(F.lit(f"{seed}:{x}:"), F.col("id").cast("string")) for x in "spo"]
    return spark.range(n).select("id", *(C.cid(t).alias(x) for x, t in zip("spo", text, strict=True)))
