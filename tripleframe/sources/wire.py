"""Commands of the service, as rows: routed to the multimap or to triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleframe.functions import cid as C

COMMAND = T.StructType([
    *(T.StructField(x, T.StringType()) for x in ("command", "key", "value", "s", "p", "o")),
    T.StructField("triples", T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in "spo"]))),
])


def commands(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON commands, parsed; ord is kept."""
    return lines.select("ord", F.from_json(F.col(column), COMMAND).alias("c")).select("ord", "c.*")


def mutations(found: DataFrame) -> DataFrame:
    """op, ord, key, value of INSERT, DELETE, BATCH_INSERT and BATCH_DELETE; rows with a broken key are left out. Older
    clients send s and o in place of key and value, and their p is ignored."""
    of = lambda a, b: C.parse_wire(F.coalesce(a, b))
    single = found.where(F.upper("command").isin("INSERT", "DELETE")).select(F.upper("command").alias("op"), "ord", of("key", "s").alias("key"), of("value", "o").alias("value"))
    batch = found.where(F.upper("command").isin("BATCH_INSERT", "BATCH_DELETE") & F.col("triples").isNotNull())
    many = batch.select(F.regexp_replace(F.upper("command"), "^BATCH_", "").alias("op"), "ord", F.explode("triples").alias("t")).select("op", "ord", C.parse_wire(F.col("t.s")).alias("key"), C.parse_wire(F.col("t.o")).alias("value"))
    return single.unionByName(many).where("key is not null")


def lookups(found: DataFrame, kv: DataFrame) -> DataFrame:
    """ord, key, values (as hex, sorted) of LOOKUP commands, and of the older clients' QUERY, which looks up its s."""
    asked = found.where(F.upper("command").isin("LOOKUP", "QUERY")).select("ord", C.parse_wire(F.coalesce("key", "s")).alias("key")).where("key is not null")
    held = asked.join(kv.select("key", C.hexed(F.col("value")).alias("value")), "key", "left")
    return held.groupBy("ord", "key").agg(F.sort_array(F.collect_list("value")).alias("values"))


def triples(found: DataFrame) -> DataFrame:
    """ord, i, s, p, o of batch commands."""
    return found.where("triples is not null").select("ord", F.posexplode("triples").alias("i", "t")).select("ord", "i", *(C.parse_wire(F.col(f"t.{x}")).alias(x) for x in "spo"))
