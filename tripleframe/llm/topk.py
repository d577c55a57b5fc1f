"""Exact top-k inner-product search with a vector-approximation file.

Components are scaled and rounded down to integers. The approximation file is a table of its own: for each block of
vectors a grid, and one byte a component, the cell that it lies in. Its scan alone gives every pair of a query and
a vector a lower and an upper bound of their score; a pair stays if its upper bound reaches the k-th largest lower
bound of its query, first within a part of the file, then over all parts. Only then exact vectors are read, by their
row numbers and in the order of their bounds: the first FIRST * k of each query, whose k-th score is what the upper
bounds of all others must reach to be read as well.

Blocks of the file are dealt to parts of bounded size; the queries, a stated set, pass each part in groups of bounded
size. Of equal vectors only the k + 1 with the smallest ids take part as candidates, as no query can return others.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, neither do rows
without an id, nor those whose length differs from the query's; a query is no candidate of its own row (rows that
repeat a vec_id are other rows and do count); ties go to the smaller vec_id; scores are exact whatever the size of
the components, and those beyond a long are its nearest value; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, only, shuffle_parts, written

CELLS = 256
SCALE = 256
#: Vectors of a block of the file, blocks of a part, and queries that pass a part at a time.
BLOCK, PART, ASKS = 1024, 16, 512
#: Exact vectors read first, as a multiple of k.
FIRST = 4
#: Components beyond this have no bounds: their vectors are always read.
WIDE = 1e150
LONG = (1 << 63) - 1
FILE = "block long, dims long, rows binary, low binary, width binary, cells binary"


def quantised(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and the components as floor(scale * x), in doubles, of whole vectors only."""
    rows = only(df, **{id_col: "long", vec_col: "array<double>"}).toDF("vec_id", "v")
    whole = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    # doubles beyond 2**52 are whole numbers; a long would not hold them
    floor = F.transform("v", lambda x: F.when(F.abs(x * scale) < 1 << 52, F.floor(x * scale).cast("double")).otherwise(x * scale))
    return rows.where(whole & F.col("vec_id").isNotNull()).select("vec_id", floor.alias("v"))


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and each row's length."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def approximation(held: DataFrame) -> DataFrame:
    """The file of the vectors of held (row, v)."""

    def run(batches):
        open_: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(dims: int):
            rows, y = (np.concatenate(x) for x in zip(*open_.pop(dims), strict=True))
            for lo in range(0, len(rows), BLOCK):
                yield block(rows[lo : lo + BLOCK], y[lo : lo + BLOCK])

        for batch in batches:
            values, sizes = matrix(batch.column(1))
            ends, rows = sizes.cumsum(), batch.column(0).to_numpy()
            for dims in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dims)
                open_.setdefault(dims, []).append((rows[own], values[ends[own][:, None] + np.arange(-dims, 0)]))
            for dims in [d for d, x in open_.items() if sum(len(r) for r, _ in x) >= BLOCK]:
                yield from out(dims)
        for dims in list(open_):
            yield from out(dims)

    def block(rows: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        low, width, cells = grid(y)
        values = [int(rows[0]), y.shape[1], rows.tobytes(), low.tobytes(), width.tobytes(), cells.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in values], ["block", "dims", "rows", "low", "width", "cells"])

    return held.select("row", "v").mapInArrow(run, FILE)


def grid(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, width, cells) of a block of whole numbers; no cells if some are too large for bounds."""
    if np.abs(y).max() > WIDE:
        return np.empty(0), np.empty(0), np.empty(0, np.uint8)
    low = y.min(0)
    width = np.maximum(np.ceil((y.max(0) - low + 1) / CELLS), 1)
    return low, width, np.clip((y - low) // width, 0, CELLS - 1).astype(np.uint8)


def bounds(queries: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of queries with a block's vectors."""
    base = queries @ (low + cells * width).T
    spread = width - 1
    largest = np.maximum(np.abs(low), np.abs(low + CELLS * width))
    slack = (np.abs(queries) @ largest * 1e-12 + 1e-3)[:, None]  # of the arithmetic
    return base + (np.minimum(queries, 0) @ spread)[:, None] - slack, base + (np.maximum(queries, 0) @ spread)[:, None] + slack


def scan(file: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """ask, row, lower, upper of the pairs that may be among the k best of a part."""
    spark = file.sparkSession
    parts = max(1, -(-file.count() // PART))
    n = F.lit(parts)
    none = [F.lit(None).cast("binary").alias(c) for c in ("low", "width", "cells")]
    left = file.select(F.pmod(F.xxhash64("block"), n).alias("part"), F.lit(0).alias("asks"), "dims", F.lit(0).cast("long").alias("ask"), "rows", "low", "width", "cells", F.lit(None).cast("array<double>").alias("v"))
    right = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("part"), F.lit(1).alias("asks"), F.size("v").cast("long").alias("dims"), F.col("row").alias("ask"), F.lit(None).cast("binary").alias("rows"), *none, "v")
    dealt = left.unionByName(right).repartition(max(8, min(parts, 4 * shuffle_parts(spark))), "part").sortWithinPartitions("part", "dims", "asks")

    def run(batches):
        place, blocks, wait_ids, wait = None, [], [], []

        def out():
            ids, asked = np.array(wait_ids), np.stack(wait)
            found = [best(ids, asked, blocks, k)] if blocks else []
            wait_ids.clear()
            wait.clear()
            for f in found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in f], ["ask", "row", "lower", "upper"])

        for batch in batches:
            part, asks, dims, ask = (batch.column(i).to_numpy() for i in range(4))
            for i in range(batch.num_rows):
                if (part[i], dims[i]) != place:
                    if wait:
                        yield from out()
                    place, blocks = (part[i], dims[i]), []
                if asks[i]:
                    wait_ids.append(ask[i])
                    wait.append(batch.column(8)[i].values.to_numpy())
                    if len(wait) == ASKS:
                        yield from out()
                else:
                    rows, low, width, cells = (np.frombuffer(batch.column(j)[i].as_py(), t) for j, t in ((4, np.int64), (5, np.float64), (6, np.float64), (7, np.uint8)))
                    blocks.append((rows, low, width, cells.reshape(-1, int(dims[i]))))
        if wait:
            yield from out()

    return dealt.mapInArrow(run, "ask long, row long, lower double, upper double")


def best(ids: np.ndarray, asked: np.ndarray, blocks: list[tuple], k: int) -> tuple[np.ndarray, ...]:
    """(ask, row, lower, upper): of each query the pairs whose upper bound reaches its k-th largest lower bound."""
    rows = np.concatenate([b[0] for b in blocks])
    lower, upper = np.full((len(ids), len(rows)), -np.inf), np.full((len(ids), len(rows)), np.inf)
    tame = np.flatnonzero(np.abs(asked).max(1) <= WIDE)
    at = 0
    for own, low, width, cells in blocks:
        if len(low) and len(tame):
            lower[tame, at : at + len(own)], upper[tame, at : at + len(own)] = bounds(asked[tame], low, width, cells)
        at += len(own)
    self_ = rows == ids[:, None]
    lower[self_], upper[self_] = -np.inf, -np.inf
    reach = np.partition(lower, -k, 1)[:, -k] if len(rows) >= k else np.full(len(ids), -np.inf)
    i, j = np.nonzero((upper >= reach[:, None]) & ~self_)
    return ids[i], rows[j], lower[i, j], upper[i, j]


def exact(pairs: DataFrame, queries: DataFrame, held: DataFrame) -> DataFrame:
    """ask, query_id, row, vec_id, score of pairs (ask, row), from the exact vectors."""
    asked = queries.select(F.col("row").alias("ask"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    joined = pairs.select("ask", "row").join(asked, "ask").join(held, "row").select("ask", "query_id", "row", "vec_id", "q", "v")

    def run(batches):
        for batch in batches:
            (q, sizes), (v, _) = matrix(batch.column(4)), matrix(batch.column(5))
            begin = np.concatenate([[0], sizes.cumsum()[:-1]])
            if not len(sizes):
                continue
            size = np.abs(q) * np.abs(v)
            score = np.add.reduceat(q * v, begin) if np.isfinite(size).all() else np.zeros(len(sizes))
            sure = np.add.reduceat(size, begin) < 1 << 52
            out = np.where(sure, score, 0).astype(np.int64)
            for i in np.flatnonzero(~sure):
                own = slice(begin[i], begin[i] + sizes[i])
                whole = sum(whole_number(a) * whole_number(b) for a, b in zip(q[own].tolist(), v[own].tolist(), strict=True))
                out[i] = max(-LONG - 1, min(LONG, whole))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out)], ["ask", "query_id", "row", "vec_id", "score"])

    return joined.mapInArrow(run, "ask long, query_id long, row long, vec_id long, score long")


def whole_number(x: float) -> int:
    return int(x) if abs(x) < float("inf") else int(np.sign(x)) << 1024


def top_k(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by `every`, against all rows."""
    spark = df.sparkSession
    held, _ = written(quantised(df, id_col, vec_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    queries = held.where(F.col("vec_id") % every == 0)
    # a window's limit works before the shuffle as well, so a very common vector is no large group
    among = F.row_number().over(W.partitionBy("v").orderBy("vec_id", "row"))
    file, file_path = written(approximation(held.withColumn("i", among).where(F.col("i") <= k + 1)), "approximation")
    found, found_path = written(scan(file, queries, k), "bounds")
    nth = F.row_number().over(W.partitionBy("ask").orderBy(F.desc("lower"), "row"))
    reach = found.withColumn("i", nth).where(F.col("i") <= k).groupBy("ask").agg(F.when(F.count("*") == k, F.min("lower")).otherwise(float("-inf")).alias("reach"))
    left, left_path = written(found.join(reach, "ask").where("upper >= reach").drop("reach", "lower"), "reaching")
    order = F.row_number().over(W.partitionBy("ask").orderBy(F.desc("upper"), "row"))
    first, first_path = written(left.withColumn("i", order).where(F.col("i") <= FIRST * k).drop("i"), "read-first")
    scored, scored_path = written(exact(first, queries, held), "scores")
    nth = F.row_number().over(W.partitionBy("ask").orderBy(F.desc("score"), "vec_id", "row"))
    certain = scored.withColumn("i", nth).where(F.col("i") <= k).groupBy("ask").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
    more = left.join(first.select("ask", "row"), ["ask", "row"], "left_anti").join(certain, "ask").where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth").cast("double")))
    out, _ = written(scored.unionByName(exact(more, queries, held)).withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score"), "best")
    dropped(spark, file_path, found_path, left_path, first_path, scored_path)
    return out
