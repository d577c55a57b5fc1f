"""Queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embed_dedup, html_extract, langid, minhash, packing, suffix, topk, warc
from .common import table

TOKENIZER = "word_bpe_49k.json"
#: A conversation whose texts look like the template, an escape and a marker.
EXTRA_ID, EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("select cast(id as bigint) as turn, if(id = 0, 'user', 'assistant') as role from range(2)")
    extra = extra.select(F.lit(EXTRA_ID).cast("long").alias("conv_id"), "turn", "role", F.lit(EXTRA_TEXT).alias("text"))
    return chat.digests(chat.read_back(chat.format_conversations(rows.unionByName(extra))))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_and_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "kept")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(table(spark, sf_dir, "documents"))


def op10_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), marked as (
  select *, lag(role) over (partition by conv_id order by turn, role, text) as before from rows
), sized as (
  select *, replace(replace(text, '\\', '\\\\'), '<', '\\l') as t, replace(replace(role, '\\', '\\\\'), '<', '\\l') as r from marked
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(t) + case when before is not distinct from role then 8 else length(r) + 23 end) as bigint) as formatted_chars
from sized group by conv_id
"""

OP8_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) as score
  from v q, v c where q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
)
select query_id, cast(rank as int) as rank, vec_id, cast(score as bigint) as score from r where rank <= 5
"""

OP10_SQL = """
with recursive v as (
  select vec_id, cast(embedding as double[]) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), l as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.9
), r(a, b) as (
  select vec_id, vec_id from embeddings union select r.a, l.b from r join l on r.b = l.a
), c as (
  select a as vec_id, min(b) as component_id from r group by 1
), n as (
  select a as vec_id, count(*) as n_links from l group by 1
)
select c.vec_id, coalesce(n_links, 0) as n_links, component_id, c.vec_id = component_id as kept from c left join n on n.vec_id = c.vec_id
"""

QUERIES = {"op1_bpe": op1_bpe, "op2_chat": op2_chat, "op3_packing": op3_packing, "op4_html": op4_html, "op5_warc": op5_warc, "op6_langid": op6_langid, "op7_minhash": op7_minhash, "op8_topk": op8_topk, "op9_suffix": op9_suffix, "op10_embed_dedup": op10_embed_dedup}
ORACLE_SQL: dict[str, str] = {"op2_chat": OP2_SQL, "op8_topk": OP8_SQL, "op10_embed_dedup": OP10_SQL}
