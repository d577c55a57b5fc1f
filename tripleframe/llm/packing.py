"""Packing of token pieces into sequences by linear grouping.

The plan is made on the driver from a histogram of piece lengths, which has at most `capacity` entries
whatever the input: large lengths are rounded up within groups of equal cardinality, the few sizes that
result are packed by a configuration program (column generation), the actual pieces take the places of the
rounded ones, and the rest goes best-fit into the space that is left. A plan is a list of runs "so many
pieces of this length, from this rank on, so many a sequence, from this sequence and offset on"; executors
look a piece up by its length and its rank among the pieces of that length. Ranks are dealt within salted
buckets, so that a length that a third of all pieces share is ranked by many tasks.

Defined results: null and empty texts become one piece that holds the end id alone; repeated rows are packed
as often as they occur; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import blocks, codec
from .common import only, shuffle_parts, written

CAPACITY = 2048
#: Lengths above such a share of the capacity count as large; the plan with the fewest sequences is kept.
LARGE = (1 / 2, 2 / 5)
#: Groups of equal cardinality that large pieces are rounded up in.
GROUPS = 128
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids and the end id, cut into pieces of at most `capacity`."""

    def run(batches):
        c, end = codec(tokenizer), np.array([end_id], np.uint32)
        for batch in batches:
            for lo, hi in blocks(batch.column(1)):
                key, piece, start, length, crc = [], array("i"), array("q"), array("q"), array("q")
                for k, parts in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), c.streams(batch.column(1).slice(lo, hi - lo).to_pylist()), strict=True):
                    for n, part in enumerate(cut(parts, end, capacity)):
                        key.append(k)
                        piece.append(n)
                        start.append(n * capacity)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.astype("<u4", copy=False).data))
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return only(docs, **{id_col: "long", text_col: "string"}).mapInArrow(run, PIECE)


def cut(parts: Iterable[np.ndarray], end: np.ndarray, capacity: int) -> Iterator[np.ndarray]:
    """Ids that come in parts, and the end id, as pieces of `capacity`; the last may be shorter."""
    rest = np.empty(0, np.uint32)
    for part in chain(parts, [end]):
        part = np.concatenate([rest, part]) if len(rest) else part
        whole = (len(part) - 1) // capacity * capacity if part is not end else 0  # the last piece waits for the end
        for at in range(0, max(whole, 0), capacity):
            yield part[at : at + capacity]
        rest = part[max(whole, 0) :]
    for at in range(0, len(rest), capacity):
        yield rest[at : at + capacity]


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns over few sizes and how often each is used (rounded down), by column generation with a dense basis."""
    k = len(sizes)
    if not k:
        return []
    fits = np.minimum(capacity // sizes, np.maximum(demand, 1))
    patterns = np.diag(fits).astype(float)
    inverse = np.diag(1 / fits)
    most = int(capacity // sizes.min())
    for _ in range(40 * k):
        x, price = inverse @ demand, inverse.sum(0)
        value = np.zeros(capacity + 1)
        chosen = []
        for _ in range(most):
            best, item = value.copy(), np.full(capacity + 1, -1)
            for g in np.flatnonzero(price > 1e-12):
                s = int(sizes[g])
                with_g = value[:-s] + price[g]
                better = with_g > best[s:] + 1e-12
                best[s:][better] = with_g[better]
                item[s:][better] = g
            chosen.append(item)
            if (item < 0).all():
                break
            value = best
        if value[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        for item in reversed(chosen):
            if (g := item[room]) >= 0:
                column[g] += 1
                room -= int(sizes[g])
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        patterns[:, out] = column
        pivot = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, pivot)
        inverse[out] = pivot
    x = np.floor(np.maximum(inverse @ demand, 0) + 1e-6).astype(np.int64)
    left, used = demand.astype(np.int64).copy(), []
    for p in range(k):
        column = patterns[:, p].astype(np.int64)
        if column.any() and (n := min(int(x[p]), *(left[column > 0] // column[column > 0]).tolist())) > 0:
            used.append((column, n))
            left -= column * n
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: tuple[float, ...] = LARGE) -> tuple[pd.DataFrame, int]:
    """Rows (length, rank, n, sequence, each, offset) and the number of sequences."""
    return min((plan_for(histogram, capacity, groups, x) for x in large), key=lambda x: x[1])


def plan_for(histogram: dict[int, int], capacity: int, groups: int, large: float) -> tuple[pd.DataFrame, int]:
    rows: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0
    rank = dict.fromkeys(histogram, 0)
    if full := histogram.get(capacity, 0):
        rows.append((capacity, 0, full, 0, 1, 0))
        sequences = full
    lengths = sorted((n for n in histogram if 0 < n < capacity), reverse=True)
    big = [n for n in lengths if n > capacity * large]
    total = sum(histogram[n] for n in big)
    # linear grouping: runs of (length, count) in groups of equal cardinality, the largest first
    share, members, room = -(-total // groups) if total else 0, [], 0
    for n in big:
        count = histogram[n]
        while count:
            if not room:
                members.append([])
                room = share
            take = min(room, count)
            members[-1].append([n, take])
            room -= take
            count -= take
    merged: list[list[list[int]]] = []
    for g in members:  # groups that one length fills are one size
        if merged and merged[-1][0][0] == g[0][0] and merged[-1][-1][0] == g[0][0] == g[-1][0]:
            merged[-1][-1][1] += g[0][1]
        else:
            merged.append(g)
    sizes = np.array([g[0][0] for g in merged], np.int64)
    demand = np.array([sum(c for _, c in g) for g in merged], float)
    spaces: dict[int, list[list[int]]] = {}  # residual -> runs of [sequence, count, used]

    def take(n: int, count: int, sequence: int, each: int, offset: int) -> None:
        rows.append((n, rank[n], count, sequence, each, offset))
        rank[n] += count

    for pattern, times in configurations(sizes, demand, capacity):
        runs = [[sequences, times, 0]]
        sequences += times
        for g in np.repeat(np.arange(len(pattern)), pattern).tolist():
            out = []
            for sequence, count, used in runs:
                while count:
                    n, have = merged[g][0]
                    m = min(have, count)
                    take(n, m, sequence, 1, used)
                    out.append([sequence, m, used + n])
                    sequence, count = sequence + m, count - m
                    if m == have:
                        merged[g].pop(0)
                    else:
                        merged[g][0][1] -= m
            runs = out
        for run in runs:
            spaces.setdefault(capacity - run[2], []).append(run)
    for n in lengths:  # best fit: what no configuration took, then the small ones
        left = histogram[n] - rank[n]
        while left:
            room = min((r for r, runs in spaces.items() if r >= n and runs), default=None)
            if room is None:
                each = capacity // n
                opened = max(left // each, 1)
                spaces.setdefault(capacity, []).append([sequences, opened, 0])
                sequences += opened
                continue
            sequence, count, used = spaces[room].pop()
            each = min(room // n, left)
            m = min(count, left // each)
            take(n, m * each, sequence, each, used)
            if m < count:
                spaces[room].append([sequence + m, count - m, used])
            spaces.setdefault(room - each * n, []).append([sequence, m, used + each * n])
            left -= m * each
    return pd.DataFrame(rows, columns=["length", "rank", "n", "sequence", "each", "offset"], dtype="int64"), sequences


def pack(found: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Pieces with sequence_id and offset."""
    spark = found.sparkSession
    held, _ = written(found, "pieces")
    histogram = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan(histogram, capacity, groups)
    buckets = max(8, shuffle_parts(spark))
    salted = held.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    starts = counts.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    within = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")) - 1
    ranked = salted.withColumn("within", within).join(starts, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within")).alias("rank"))
    runs = runs.sort_values(["length", "rank"])
    table = {c: runs[c].to_numpy() for c in runs}
    keys = (table["length"] << 44) | table["rank"]

    def look_up(batches):
        for b in batches:
            at = np.searchsorted(keys, (b["length"].to_numpy() << 44) | b["rank"].to_numpy(), "right") - 1
            within = b["rank"].to_numpy() - table["rank"][at]
            each = table["each"][at]
            yield b.drop(columns="rank").assign(sequence_id=table["sequence"][at] + within // each, offset=table["offset"][at] + within % each * table["length"][at])

    return ranked.mapInPandas(look_up, PIECE + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(pieces(docs, tokenizer, capacity, 0, id_col, text_col), capacity)


__all__ = ["CAPACITY", "configurations", "pack", "pack_documents", "pieces", "plan"]
