"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all
    of Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tripleframe-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used yet."""
    return f"{shared_dir(spark)}/tripleframe/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """df as a table in the shared folder, which cuts its lineage, and the table's path."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes tables made by written() that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the columns that an operator reads, cast; a table may hold others, whatever their names."""
    return df.select([F.col(f"`{c}`").cast(kind).alias(c) for c, kind in columns.items()])


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, with underscores in front until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def quoted(df: DataFrame) -> list[str]:
    """The names of df's columns, as select() takes them whatever they hold."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def mapped(df: DataFrame, run, like: DataFrame) -> DataFrame:
    """mapInArrow with the columns of `like`; names with dots, which it does not take, are put aside meanwhile."""
    kind = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(like.schema)])
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, kind).toDF(*like.columns)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_groups(batches, n_keys: int):
    """Arrow batches sorted by their first n_keys columns, regrouped so that no key goes on in the next one."""
    import pyarrow as pa

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = batch.num_rows
        last = [batch.column(i)[cut - 1] for i in range(n_keys)]
        while cut and all(batch.column(i)[cut - 1] == last[i] for i in range(n_keys)):
            cut -= 1
        if cut or held and any(held[-1].column(i)[held[-1].num_rows - 1] != batch.column(i)[0] for i in range(n_keys)):
            if cut:
                held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held).combine_chunks()
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node that it can reach) of all nodes with an edge (a, b), by alternating
    large and small stars until nothing changes; minima are aggregated before the shuffle, each round is a table in
    the shared folder."""
    spark = edges.sparkSession

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.union(df.select("b", "a")) if large else df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        out = joined.where("b > a").select("b", "m") if large else joined.where("b != m").select("b", "m").union(least.select("a", "m"))
        return out.toDF("a", "b").where("a != b").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now, path = written(edges.toDF("a", "b").where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was = state(now)
    while True:
        after, new_path = written(star(star(now, True), False), "edges")
        dropped(spark, path)
        now, path = after, new_path
        if (found := state(now)) == was:
            break
        was = found
    label = now.groupBy("a").agg(F.min("b").alias("label")).toDF("node", "label")
    return label.union(label.select("label", "label").distinct())
