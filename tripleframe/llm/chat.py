"""Chat formatting with Spark expressions alone.

A conversation becomes one string: blocks `<|role|>` escaped role `<|text|>` escaped text of each turn, split
by `<|next|>` where neighbours of one role were merged, `<|end|>`. In roles and texts a backslash is written
twice and `<` as backslash and l, so that no marker occurs inside one; unescaping undoes this exactly.

Defined results: null text and null role are empty; a null turn sorts first; rows that tie on turn are
ordered by role, then text, and repeated rows all count as turns; a null conv_id is a conversation of its own;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only

# The template's markers.
ROLE, TEXT, NEXT, END = "<|role|>", "<|text|>", "<|next|>", "<|end|>"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def unescaped(c: Column) -> Column:
    """Pairs of backslashes are found from the left, so what is between them holds none but those of `\\l`."""
    return F.array_join(F.transform(F.split(c, r"\\\\"), lambda x: F.replace(x, F.lit("\\l"), F.lit("<"))), "\\")


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id and formatted: sorts the collected turns, merges neighbours of one role, concatenates."""
    rows = only(rows, conv_id="long", turn="long", role="string", text="string")
    turns = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    t = F.col("turns")
    pieces = F.transform(
        t,
        lambda x, i: F.concat(
            F.when((i > 0) & (F.get(t, i - 1)["role"] == x["role"]), F.lit(NEXT)).otherwise(F.concat(F.lit(ROLE), escaped(x["role"]), F.lit(TEXT))),
            escaped(x["text"]),
            F.when(F.get(t, i + 1)["role"] == x["role"], F.lit("")).otherwise(F.lit(END)),
        ),
    )
    return grouped.select("conv_id", F.array_join(pieces, "").alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted and its turns (role, text), from the formatted string alone."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>"), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = unescaped(F.substring_index(F.replace(b, F.lit(ROLE), F.lit("")), TEXT, 1))
        return F.transform(F.split(F.substring_index(b, TEXT, -1), r"<\|next\|>"), lambda x: F.struct(role.alias("role"), unescaped(x).alias("text")))

    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns)).alias("turns"))


def digests(read: DataFrame) -> DataFrame:
    nl = F.lit("\n")
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], nl, x["text"], nl)), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["role"] == "assistant"), lambda x: x["text"]), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
