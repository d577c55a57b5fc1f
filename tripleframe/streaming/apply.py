"""Applying a stream of mutations: each micro-batch appends to the log and folds into a state table.

State is a folder of versions; a batch writes the parts that it touches as version n from the versions before, so a
batch that is run again after a failure writes the same version anew. Counter and set state are what later mutations can still change: the last
insert of a subject, and the last operation of a pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folded_set(rows: DataFrame) -> DataFrame:
    """s, o, op, ord, seen: the last operation of each pair."""
    return rows.groupBy("s", "o").agg(F.max_by("op", "ord").alias("op"), F.max("ord").alias("ord"), F.max_by("seen", "ord").alias("seen"))


def folded_counter(rows: DataFrame) -> DataFrame:
    """s, o, op, ord, seen: the last write of each subject."""
    return rows.groupBy("s").agg(F.max_by("o", "ord").alias("o"), F.max_by("op", "ord").alias("op"), F.max("ord").alias("ord"), F.max_by("seen", "ord").alias("seen"))


class State:
    """A folded table in parts by the subject's first bits, below a path: a micro-batch writes only the parts that it
    touches, as version n of each; a part's newest version up to n is its state. Deletes are kept for as long as
    `keep` later batches, in which a mutation that is older than them may still come."""

    def __init__(self, spark: SparkSession, path: str, fold, parts: int = 16, keep: int = 1_000):
        self.spark, self.path, self.fold, self.parts, self.keep = spark, path, fold, parts, keep

    def _list(self, path: str) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []

    def versions(self) -> list[int]:
        return sorted(int(x[1:]) for x in self._list(self.path) if "_SUCCESS" in self._list(f"{self.path}/{x}"))

    def latest(self) -> int:
        return max(self.versions(), default=-1)

    def _paths(self, n: int) -> dict[int, str]:
        """The newest folder up to version n of each part."""
        out = {}
        for v in self.versions():
            if v <= n:
                out |= {int(x[5:]): f"{self.path}/v{v:012d}/{x}" for x in self._list(f"{self.path}/v{v:012d}") if x.startswith("part=")}
        return out

    def read(self, n: int | None = None, parts: list[int] | None = None) -> DataFrame | None:
        found = {k: x for k, x in self._paths(self.latest() if n is None else n).items() if parts is None or k in parts}
        return self.spark.read.parquet(*found.values()) if found else None

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("s", "o", "op", "ord", F.lit(batch_id).cast("long").alias("seen"))
        part = F.pmod(F.xxhash64("s"), F.lit(self.parts)).cast("int")
        touched = [r[0] for r in rows.select(part).distinct().collect()]  # at most `parts` rows
        before = self.read(batch_id - 1, touched)
        if before is not None:
            rows = before.select("s", "o", "op", "ord", "seen").unionByName(rows)
        folded = self.fold(rows).where((F.col("op") != "DELETE") | (F.col("seen") >= batch_id - self.keep))
        folded.withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/v{batch_id:012d}")

    def current(self) -> DataFrame:
        return self.read().where("op = 'INSERT'").select("s", "o")


def consume(stream: DataFrame, state: State, checkpoint: str) -> None:
    """All mutations (s, o, op, ord) that are there now; the checkpoint remembers what was consumed."""
    stream.writeStream.foreachBatch(state.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Mutations by window and operation, closed by a watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "op").count()
