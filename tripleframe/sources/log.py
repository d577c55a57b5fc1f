"""The binary mutation log: 128-byte records in files, as mutation frames and back.

Layout: version and opcode in one byte, a reserved byte, nanos (u64), seq (u32), shard (u32), four words of the
key and four of the value (u64), padding, CRC-32 of all that; numbers are little-endian. Encoding and decoding are
Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleframe.functions import cid as C

RECORD, HEADER, CORE = 128, 64, 82
# Opcodes and versions.
OPS = {"INSERT": 1, "DELETE": 2, "TXN_START": 3, "TXN_COMMIT": 4, "TXN_ABORT": 5}
VERSIONS = {"PAST": 0, "NOW": 1, "NEXT": 2, "FUTURE": 3}


def little(c: Column, size: int) -> Column:
    """An integer as so many little-endian bytes."""
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.substring(F.lpad(F.hex(c.cast("long")), 16, "0"), 17 - 2 * size, 2 * size), F.lit("(..)"))), ""))


def flipped(c: Column) -> Column:
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex(c), F.lit("(..)"))), ""))


def number(rec: Column, at: int, size: int) -> Column:
    return F.conv(F.hex(flipped(F.substring(rec, at + 1, size))), 16, -10).cast("long")


def encode(log: DataFrame) -> DataFrame:
    """rec for each mutation (op, version, ht, key, value); identifiers that are missing are zeros."""
    zero = F.lit(bytearray(C.WIDTH))
    first = F.element_at(F.create_map(*(F.lit(x) for kv in OPS.items() for x in kv)), F.col("op")) + F.shiftleft(F.element_at(F.create_map(*(F.lit(x) for kv in VERSIONS.items() for x in kv)), F.col("version")), 6)

    def four(c: Column) -> list[Column]:
        return [flipped(F.substring(F.coalesce(c, zero), 1 + 8 * i, 8)) for i in range(4)]

    core = F.concat(little(first, 1), F.lit(bytearray(1)), little(F.col("ht.nanos"), 8), little(F.col("ht.seq"), 4), little(F.col("ht.shard"), 4), *four(F.col("key")), *four(F.col("value")), F.lit(bytearray(RECORD - CORE - 4)))
    rows = log.withColumn("__core", core)
    return rows.select(F.concat("__core", little(F.crc32("__core"), 4)).alias("rec"))


def decode(records: DataFrame) -> DataFrame:
    """Mutations of the records whose length and checksum are right; a value of zeros is none."""
    rec = F.col("rec")
    rows = records.where((F.length(rec) == RECORD) & (F.crc32(F.substring(rec, 1, RECORD - 4)) == number(rec, RECORD - 4, 4)))
    first = number(rec, 0, 1)
    names = F.create_map(*(F.lit(x) for k, v in OPS.items() for x in (v, k)))
    versions = F.create_map(*(F.lit(x) for k, v in VERSIONS.items() for x in (v, k)))
    zero = F.lit(bytearray(C.WIDTH))

    def identifier(at: int) -> Column:
        return F.concat(*(flipped(F.substring(rec, 1 + at + 8 * i, 8)) for i in range(4)))

    value = identifier(50)
    return rows.select(
        F.element_at(names, first.bitwiseAND(F.lit(63)).cast("int")).alias("op"), F.element_at(versions, F.shiftright(first, 6).cast("int")).alias("version"),
        F.struct(number(rec, 2, 8).alias("nanos"), number(rec, 10, 4).alias("seq"), number(rec, 14, 4).cast("int").alias("shard")).alias("ht"),
        identifier(18).alias("key"), F.when(value != zero, value).alias("value"),
    ).where("op is not null")


def write(log: DataFrame, path: str) -> None:
    """Appends records, a table of them; commits make it durable."""
    encode(log).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return decode(spark.read.parquet(path))


def read_files(spark: SparkSession, path: str, tail: int = HEADER) -> DataFrame:
    """Log files of raw records behind a header, from byte `tail` on."""
    files = spark.read.format("binaryFile").load(path)
    n = F.floor((F.col("length") - tail) / RECORD)
    rows = files.where(n > 0).select("content", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    return decode(rows.select(F.expr(f"substring(content, cast({tail} + i * {RECORD} + 1 as int), {RECORD})").alias("rec")))


def in_transaction(log: DataFrame) -> DataFrame:
    """Brackets an insert: start, insert and commit with one time."""
    ops = F.explode(F.array(F.lit("TXN_START"), F.lit("INSERT"), F.lit("TXN_COMMIT")))
    return log.select(ops.alias("op"), "version", "ht", "key", "value")


def committed(log: DataFrame) -> DataFrame:
    """Only mutations that no aborted transaction (rows of one txn id) holds."""
    aborted = log.where("op = 'TXN_ABORT'").select("txn").distinct()
    return log.where("op in ('INSERT', 'DELETE')").join(aborted, "txn", "left_anti")
