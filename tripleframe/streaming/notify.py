"""Notifications of applied mutations, as a side output of the stream that applies them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def notifications(batch: DataFrame, batch_id: int) -> DataFrame:
    """topic, batch, ord and hex of subject and object for each mutation, and one heartbeat."""
    rows = batch.select(F.lower("op").alias("topic"), F.lit(batch_id).cast("long").alias("batch"), "ord", F.lower(F.hex("s")).alias("s"), F.lower(F.hex("o")).alias("o"))
    beat = batch.agg(F.lit("heartbeat").alias("topic"), F.lit(batch_id).cast("long").alias("batch"), F.max("ord").alias("ord"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("string").alias("o"))
    return rows.unionByName(beat)


def with_notifications(apply: Callable[[DataFrame, int], None], path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that applies a batch and then writes its notifications, a folder for each batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        apply(batch, batch_id)
        notifications(batch, batch_id).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run
