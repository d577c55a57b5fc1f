"""Near-duplicate vectors by collision-counting projections.

Unit vectors are projected on LINES random lines. On each line the rows are sorted, and a row's window is the run of
rows whose projections lie within WINDOW chords of its own, a chord being the distance of two unit vectors at the
threshold; two rows collide on a line if one stands in the other's window. Collisions are counted per pair over all
lines, and only pairs with at least `least()` of them are verified by cosine in double precision: a pair at the
threshold collides on each line with the same probability, so its count is binomial, and `least()` is the largest
count that it misses with probability (1 - RECALL) / 2 at most.

Sorting all rows on one line would put a fixed share of all rows into a window. So rows first meet in buckets of about
BUCKET rows: those on the same sides of `width` further lines, in one of `tables` sets of such lines, so many that a
pair at the threshold meets in some with probability 1 - (1 - RECALL) / 2. Few rows need one bucket and one table.

Buckets work twice. The first time only projections are shipped, a byte a line; what leaves are the rows with enough
collisions with some other row. Vectors are read for those rows alone and meet again in their buckets, where pairs
are counted and verified; a pair belongs to the first table that it meets in. Only sums leave, a row per vector.
A bucket with more than `BLOCK` rows is split into blocks, each pair of blocks being a task of its own.

Defined results: a vector that is null, empty, zero or holds null or non-finite components has no link and is its own
component, and so is one without an id; vectors of different lengths do not link; components of any size or
smallness are scaled before they are squared; equal vectors are linked whatever their size; rows that repeat a
vec_id are vectors of their own, and the same ids count once each; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, only, shuffle_parts, whole_groups, written

THRESHOLD = 0.9
RECALL = 0.999
#: Lines that collisions are counted on, and a window's reach on either side, in chords of the threshold.
LINES, WINDOW = 64, 1.5
#: Rows of an average bucket, from which the number of lines that part the rows follows.
BUCKET = 800
#: Rows of a bucket that one task compares at once.
BLOCK = 2048
#: Buckets beyond BLOCK that may be broadcast; more are joined by a shuffle.
FEW = 10_000
#: Steps of a projection in one, as it is shipped.
STEPS = 32
SEED = 20
KEY = ["t", "key", "dims"]
TASK = [*KEY, "lo", "hi"]


def meeting(width: int, threshold: float = THRESHOLD) -> float:
    """The probability that a pair at the threshold is on the same sides of `width` lines."""
    return (1 - math.acos(threshold) / math.pi) ** width


def parting(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(width, tables) for n rows."""
    width = max(0, math.ceil(math.log2(max(n, 1) / BUCKET)))
    p = meeting(width, threshold)
    return width, 1 if p == 1 else max(1, math.ceil(math.log((1 - recall) / 2) / math.log(1 - p)))


def window(threshold: float = THRESHOLD) -> int:
    """A window's reach in steps, rounded up by what the rounding of two projections can hide."""
    return math.ceil(WINDOW * math.sqrt(2 - 2 * threshold) * STEPS) + 1


def least(lines: int = LINES, recall: float = RECALL) -> int:
    """The collisions that a pair must have."""
    p = math.erf(WINDOW / math.sqrt(2))
    missed, count = 0.0, 0
    while (missed := missed + math.comb(lines, count) * p**count * (1 - p) ** (lines - count)) <= (1 - recall) / 2:
        count += 1
    return count


@lru_cache(maxsize=8)
def lines(dims: int, n: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, n))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def sides(u: np.ndarray, width: int, tables: int) -> np.ndarray:
    """Each row's bucket in each table."""
    if not width:
        return np.zeros((len(u), tables), np.int64)
    side = (u @ lines(u.shape[1], width * tables, SEED + 1) >= 0).reshape(len(u), tables, width)
    return (side * (1 << np.arange(width, dtype=np.int64))).sum(2)


def projected(u: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(u @ lines(u.shape[1], LINES) * STEPS), -127, 127).astype(np.int8)


def colliding(p: np.ndarray, lo: int, hi: int, reach: int, count: int, split: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows lo <= i < hi and j > i that collide on `count` lines. Lines come in turn, and what can
    no longer reach the count is left out."""
    n, of = len(p), p.shape[1]
    part = np.arange(lo, hi)
    ranks = np.empty((of, n), np.int16 if n < 1 << 15 else np.int32)
    windows = []
    for line in range(of):  # rows in order of their projections, and where each row's window starts and ends
        order = np.argsort(p[:, line], kind="stable")
        ranks[line, order] = np.arange(n, dtype=ranks.dtype)
        placed, own = p[order, line].astype(np.int16), p[lo:hi, line].astype(np.int16)
        windows.append((np.searchsorted(placed, own - reach).astype(ranks.dtype), np.searchsorted(placed, own + reach, "right").astype(ranks.dtype)))
    first = min(of, max(of - count + 1, of // 4))
    met = np.zeros((hi - lo, n), np.uint8)
    for line in range(first):
        a, b = windows[line]
        met += (ranks[line] >= a[:, None]) & (ranks[line] < b[:, None])
    live = met >= count - (of - first)
    live &= part[:, None] < np.arange(n)
    if split is not None:
        live &= split[lo:hi][:, None] != split
    i, j = np.nonzero(live)
    met = met[i, j].astype(np.int16)
    for line in range(first, of):
        a, b = windows[line]
        at = ranks[line, j]
        met += (at >= a[i]) & (at < b[i])
        if line % 8 == 7:
            keep = met >= count - (of - 1 - line)
            i, j, met = i[keep], j[keep], met[keep]
    keep = met >= count
    return i[keep] + lo, j[keep]


def links(u: np.ndarray, keys: np.ndarray, table: int, weights: np.ndarray, split: np.ndarray | None, threshold: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of a bucket: the weight of the rows linked to it, and the first row of its local component."""
    n = len(u)
    out, root = np.zeros(n, np.int64), np.arange(n)
    p, reach = projected(u), window(threshold)
    tied = []
    for lo in range(0, n, 256):
        i, j = colliding(p, lo, min(lo + 256, n), reach, count, split)
        for t in range(table):  # met before
            apart = keys[i, t] != keys[j, t]
            i, j = i[apart], j[apart]
        same = np.concatenate([np.einsum("ij,ij->i", u[i[at : at + 4096]], u[j[at : at + 4096]]) for at in range(0, len(i), 4096)] or [np.empty(0)]) >= threshold
        i, j = i[same].astype(np.int32), j[same].astype(np.int32)
        if len(i):
            out += (np.bincount(i, weights[j], n) + np.bincount(j, weights[i], n)).astype(np.int64)
            tied.append((i, j))
    while tied:  # the smallest row spreads
        before = root.copy()
        for i, j in tied:
            np.minimum.at(root, i, root[j])
            np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            break
    return out, root


def vectors_of(column: pa.Array):
    """(rows, matrix) for each length that occurs."""
    values, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    ends = sizes.cumsum()
    for dims in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == dims)
        yield own, values[ends[own][:, None] + np.arange(-dims, 0)]


def grouped(rows: DataFrame) -> DataFrame:
    """Rows of one task in a row."""
    return rows.repartition(max(8, shuffle_parts(rows.sparkSession)), *TASK).sortWithinPartitions(*TASK)


def bucket_tasks(batches):
    """(values of TASK, rows) of each task of several rows."""
    for group in whole_groups(batches, len(TASK)):
        at = np.stack([group.column(i).to_numpy() for i in range(len(TASK))])
        starts = np.flatnonzero(np.r_[True, (at[:, 1:] != at[:, :-1]).any(0)])
        for a, b in zip(starts, np.r_[starts[1:], at.shape[1]], strict=True):
            if b - a > 1:
                yield at[:, a].tolist(), group.slice(a, b - a)


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    spark = df.sparkSession
    rows = only(df, **{id_col: "long", vec_col: "array<double>"}).toDF("vec_id", "v")
    good = F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    v = F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))  # 0.0 and -0.0 are one value
    rows = rows.select("vec_id", F.when(F.coalesce(good, F.lit(False)) & F.col("vec_id").isNotNull(), v).alias("v"))
    found = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    classes, classes_path = written(found.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    width, tables = parting(classes.count(), threshold)
    count, reach = least(), window(threshold)

    def index(batches):
        for batch in batches:
            for own, x in vectors_of(batch.column(0)):
                u = unit(x)
                keys, raw = sides(u, width, tables), projected(u)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t)), pa.array(keys[:, t]), pa.array(np.full(len(own), x.shape[1], np.int64)), batch.column(1).take(pa.array(own)), pa.array([r.tobytes() for r in raw], pa.binary())], [*KEY, "class", "p"])

    indexed = classes.select("v", "class").mapInArrow(index, "t long, key long, dims long, class long, p binary")
    sizes = indexed.groupBy(*KEY).count().where(F.col("count") > BLOCK)
    large, large_path = written(sizes.select(*KEY, F.ceil(F.col("count") / BLOCK).cast("long").alias("blocks")), "large-buckets")
    if n_large := large.count():
        dealt = indexed.join(F.broadcast(large) if n_large <= FEW else large, KEY, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)).cast("long"))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks"))).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1L)")))
        dealt = dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    else:
        zero = F.lit(0).cast("long")
        dealt = indexed.withColumns({"own": zero, "lo": zero, "hi": zero})

    def meet(batches):
        for task, part in bucket_tasks(batches):
            p = np.frombuffer(b"".join(part["p"].to_pylist()), np.int8).reshape(part.num_rows, -1)
            own = part["own"].to_numpy()
            split = own if task[3] != task[4] else None
            hit = np.zeros(len(p), bool)
            for lo in range(0, len(p), 256):
                for side in colliding(p, lo, min(lo + 256, len(p)), reach, count, split):
                    hit[side] = True
            if hit.any():
                yield from part.drop_columns(["p"]).filter(pa.array(hit)).combine_chunks().to_batches()

    kind = ", ".join(f"{c} long" for c in [*TASK, "own", "class"])
    met, met_path = written(grouped(dealt.select(*TASK, "own", "class", "p")).mapInArrow(meet, kind), "colliding")

    def verify(batches):
        for task, part in bucket_tasks(batches):
            whole = part["v"].combine_chunks()
            u = next(unit(x) for _, x in vectors_of(pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole))
            ids, weights, own = (part[c].to_numpy() for c in ("class", "weight", "own"))
            n_links, root = links(u, sides(u, width, tables), task[0], weights, own if task[3] != task[4] else None, threshold, count)
            hit = np.flatnonzero(n_links)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[hit], n_links[hit], ids[root[hit]])], ["class", "links", "low"])

    shipped = met.join(classes.select("class", "weight", "v"), "class").select(*TASK, "own", "class", "weight", "v")
    found, found_path = written(grouped(shipped).mapInArrow(verify, "class long, links long, low long"), "vector-links")
    label = components(found.select("class", "low")).toDF("class", "label")
    per_class = classes.join(found.groupBy("class").agg(F.sum("links").alias("links")), "class", "left").join(label, "class", "left")
    per_class, per_class_path = written(per_class.select("v", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("label", "class").alias("label")), "vector-labels")
    smallest = per_class.groupBy("label").agg(F.min("least").alias("component_id"))
    out = rows.where("v is not null").join(per_class.join(smallest, "label").select("v", "n_links", "component_id"), "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out, _ = written(out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "vector-components")
    dropped(spark, classes_path, large_path, met_path, found_path, per_class_path)
    return out
