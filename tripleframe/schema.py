"""Schemas of the engine's frames. Identifiers are 32-byte binaries; hex appears at the edges only."""

from pyspark.sql import types as T

HYBRID_TIME = T.StructType([T.StructField("nanos", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("shard", T.IntegerType())])
TRIPLE = T.StructType([T.StructField("p", T.BinaryType()), T.StructField("s", T.BinaryType()), T.StructField("o_cid", T.BinaryType()), T.StructField("o_int", T.LongType())])
KV = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()), T.StructField("ht", HYBRID_TIME)])
MUTATION = T.StructType([T.StructField("op", T.StringType()), T.StructField("ht", HYBRID_TIME), T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())])
DICTIONARY = T.StructType([T.StructField("cid", T.BinaryType()), T.StructField("text", T.StringType())])
PREDICATE = T.StructType([
    T.StructField("p", T.BinaryType()), T.StructField("name", T.StringType()), T.StructField("plugin", T.StringType()), T.StructField("supports_osp", T.BooleanType()),
    T.StructField("supports_pos", T.BooleanType()), T.StructField("concurrency_limit", T.IntegerType()), T.StructField("justification", T.StringType()), T.StructField("reg_order", T.IntegerType()),
])
