"""Near-duplicate documents by improved consistent weighted sampling.

A text is the bag of its five-word shingles (lower case, letters and digits), each weighing its count times a
clipped inverse document frequency: idf = 1 + ln(N / max(df, N / RARE)) / ln(RARE), at any N, from 1 for a shingle that
all N documents hold to 2 for those in less than one of RARE. Only frequencies above the clip matter; a sketch
of fixed size over all documents names the cells that can hold such shingles, and those are counted exactly.
Samples of the bag, BANDS times ROWS of them, are consistent weighted samples; texts that agree on a band share
a bucket.

Links are verified by weighted Jaccard similarity of at least THRESHOLD, in two steps. Each bucket's members
are compared with the bucket's least text, by tasks of bounded size. Buckets that still hold several components
are compared further, in pairs of blocks: a text that failed is compared with the other failures and, if its
similarity s to the least text allows it, with those that passed: weighted Jaccard distance is a metric, so a
text with s < 2 * THRESHOLD - 1 links with none of them. Pairs that are connected already are not compared, no
pair leaves a task but as a link that joins two components, and no bucket is capped.

Texts are told by two hashes of 64 bits.

Defined results: equal texts are one class, null text counts as empty, texts without a word are linked by
equality alone; texts of fewer than five words have one shingle of all their words; ties and repeated rows go to
the smallest doc_id; a null doc_id is a class's id only if it has no other; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import blocks
from .common import components, dropped, free_names, only, quoted, shuffle_parts, whole_groups, written
from .suffix import buffers

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 4
#: Document frequencies below one in so many documents weigh the same.
RARE = 1000
#: Cells of the frequency sketch, and cells of one row that it is handed on in.
CELLS, PART = 1 << 20, 1 << 14
#: Texts that a task compares with one other, and texts of a block; and the bytes that they have on average at most.
STAR, BLOCK = 2000, 512
STAR_BYTES, BLOCK_BYTES = 16 << 20, 4 << 20
#: Hashes that two texts share which may be broadcast; more are joined by a shuffle.
FEW = 100_000
#: Bytes of text that are made into shingles at a time.
BYTES = 1 << 20
MULT = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def word_bytes() -> np.ndarray:
    """By byte: its value in a word, or 0 for a boundary. Bytes of letters beyond ASCII belong to words."""
    out = np.zeros(256, np.uint64)
    for b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
        out[b] = (b + 1) * MULT & MASK
    return out


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of MULT and of its inverse modulo 2**64."""

    def table(base: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        step = 1
        while step < n:
            out[step : 2 * step] = out[: min(step, n - step)] * np.uint64(pow(base, step, 1 << 64))
            step *= 2
        return out

    return table(MULT), table(pow(MULT, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingles(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle of a string column of about BYTES bytes, or one long text."""
    data, starts, ends = buffers(pc.utf8_lower(column.cast(pa.large_string())))
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    value = word_bytes()[data]
    inside = np.concatenate([[False], value != 0, [False]])
    cuts = np.unique(starts[(starts > 0) & (starts < len(data))])
    step = np.diff(inside.astype(np.int8))
    first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(cuts):  # a word ends where its text does
        joined_ = cuts[inside[cuts] & inside[cuts + 1]]
        first, last = np.sort(np.concatenate([first, joined_])), np.sort(np.concatenate([last, joined_]))
    if not len(first):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    size = max(len(data) + 1, BYTES)
    up, down = powers(1 << (size - 1).bit_length())
    total = np.concatenate([[np.uint64(0)], np.cumsum(value * up[: len(data)], dtype=np.uint64)])
    word = mix((total[last] - total[first]) * down[first])
    of = np.searchsorted(starts, first, "right") - 1
    # texts without bytes share their start with the next one; the last of equals is the one that holds the word
    n = np.bincount(of, minlength=len(starts))
    begin = np.concatenate([[0], np.cumsum(n)])
    h = np.zeros(len(word), np.uint64)
    for i in range(words):
        part = word[i:] * np.uint64(pow(0xC2B2AE3D27D4EB4F, i + 1, 1 << 64))
        h[: len(part)] += part
    whole = np.arange(len(word)) + words <= begin[of + 1]
    rows, out = of[whole], mix(h[whole])
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        at = np.concatenate([np.arange(begin[s], begin[s + 1]) for s in short])
        salt = np.array([pow(0xC2B2AE3D27D4EB4F, int(i - begin[of[i]]) + 1, 1 << 64) for i in at], np.uint64)
        sums = np.add.reduceat(word[at] * salt, np.concatenate([[0], np.cumsum(n[short])[:-1]]))
        rows, out = np.concatenate([rows, short]), np.concatenate([out, mix(sums)])
    return rows, out


def bags(column: pa.Array, heavy: tuple[np.ndarray, np.ndarray, float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, hash, weight): the shingles of text i are begin[i]:begin[i + 1], sorted by hash."""
    text, h = shingles(column)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    fresh = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.empty(0, np.int64)
    tf = np.diff(np.r_[fresh, len(h)]).astype(np.float64)
    text, h = text[fresh], h[fresh]
    begin = np.searchsorted(text, np.arange(len(column) + 1))
    if heavy is not None:
        tf *= idf_of(h, heavy)
    return begin, h, tf


def bags_of(column: pa.Array, heavy: tuple[np.ndarray, np.ndarray, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bags() of a column of any size, some BYTES at a time."""
    parts = [bags(column.slice(lo, hi - lo), heavy) for lo, hi in blocks(column, BYTES)]
    if not parts:
        return np.zeros(1, np.int64), np.empty(0, np.uint64), np.empty(0)
    sizes = np.concatenate([np.diff(begin) for begin, _, _ in parts])
    return np.concatenate([[0], sizes.cumsum()]), np.concatenate([h for _, h, _ in parts]), np.concatenate([w for _, _, w in parts])


def idf_of(h: np.ndarray, heavy: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    keys, idf, others = heavy
    if not len(keys):
        return np.full(len(h), others)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, idf[at], others)


@lru_cache(maxsize=1)
def gamma_table() -> np.ndarray:
    """Quantiles of the gamma distribution with shape 2, in 2**16 steps."""
    u = (np.arange(1 << 16) + 0.5) / (1 << 16)
    lo, hi = np.zeros(1 << 16), np.full(1 << 16, 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < u
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def samples(begin: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """Per text with shingles, n consistent weighted samples, each as the least value of ln a. That value depends
    on the shingle and on its rounded weight alone, so that two texts have it in common if the sample is one."""
    g = gamma_table()
    r_of, inverse_of, lnc_of = g.astype(np.float32), (1 / g).astype(np.float32), np.log(g).astype(np.float32)
    log_weight = np.log(weight).astype(np.float32)
    filled = np.flatnonzero(begin[1:] > begin[:-1])
    out = np.empty((len(filled), n), np.float32)
    low = np.uint64(0xFFFF)
    at = 0
    while at < len(filled):  # texts with about 2**15 shingles at a time stay in the cache
        end = max(at + 1, int(np.searchsorted(begin[filled], begin[filled[at]] + (1 << 15))))
        a, b = begin[filled[at]], begin[filled[end - 1] + 1]
        x, s, starts = h[a:b], log_weight[a:b], begin[filled[at:end]] - a
        for k in range(n):
            z = mix(x * np.uint64(2 * k + 1) + np.uint64((k + 1) * MULT & MASK))
            z ^= z >> np.uint64(31)
            z *= np.uint64(0x9FB21C651E98DF25)
            i = ((z >> np.uint64(48)) & low).astype(np.int32)
            r = r_of[i]
            beta = ((z >> np.uint64(32)) & low).astype(np.float32) / np.float32(65536)
            t = np.floor(s * inverse_of[i] + beta)
            value = lnc_of[((z >> np.uint64(16)) & low).astype(np.int32)] - r * (t - beta + np.float32(1))
            out[at:end, k] = np.minimum.reduceat(value, starts)
        at = end
    return out


def band_hashes(sampled: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    bits = sampled.view(np.uint32).astype(np.uint64).reshape(len(sampled), bands, rows)
    out = np.zeros((len(sampled), bands), np.uint64)
    for i in range(rows):
        out = mix(out * np.uint64(MULT) + bits[:, :, i] + np.uint64(1))
    return out.view(np.int64)


def whole(column: pa.ChunkedArray) -> pa.Array:
    found = column.combine_chunks()
    return pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found


def similarity(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags sorted by hash."""
    if not len(h1) or not len(h2):
        return 0.0
    at = np.minimum(np.searchsorted(h2, h1), len(h2) - 1)
    both = float(np.minimum(w1, w2[at])[h2[at] == h1].sum())
    return both / (float(w1.sum()) + float(w2.sum()) - both)


def keys_of(doc_id: Column, text: Column) -> tuple[Column, Column, Column]:
    """node (the text), node2 (another hash of it), k (the row)."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(3), text), F.xxhash64(doc_id.cast("long"), text)


def keyed(docs: DataFrame) -> DataFrame:
    """node, node2, k, doc_id, text."""
    docs = only(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    node, node2, k = keys_of(F.col("doc_id"), F.col("text"))
    return docs.select(node.alias("node"), node2.alias("node2"), k.alias("k"), "doc_id", "text")


def told_apart(held: DataFrame) -> DataFrame:
    """held with other nodes where two texts share one. Two hashes of 64 bits tell texts apart; among some billions of
    texts a few share the first one, and only theirs is replaced by a hash of both."""
    shared = held.groupBy("node").agg(F.min("node2").alias("low"), F.max("node2").alias("high")).where("low != high").select("node", F.lit(True).alias("shared"))
    shared, _ = written(shared, "shared-nodes")
    n = shared.count()
    if not n:
        return held
    rows = held.join(F.broadcast(shared) if n <= FEW else shared, "node", "left")
    return rows.withColumn("node", F.when(F.col("shared"), F.xxhash64("node2", "node")).otherwise(F.col("node"))).drop("shared")


def heavy_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashes of the shingles whose document frequency is above the clip, sorted, and their idf. There are at most
    RARE times as many as a document has on average, and the sketch has CELLS cells whatever the input."""

    def sketch(batches):
        total, n = np.zeros(CELLS, np.uint32), 0
        for batch in batches:
            n += batch.num_rows
            for lo, hi in blocks(batch.column(0), BYTES):
                _, h, _ = bags(batch.column(0).slice(lo, hi - lo))
                total += np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=CELLS).astype(np.uint32)
        parts = [zlib.compress(total[i : i + PART].tobytes(), 1) for i in range(0, CELLS, PART)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array([n] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["part", "n", "cells"])

    def add(got: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(PART, np.int64)
        for c in got["cells"]:
            total += np.frombuffer(zlib.decompress(c), np.uint32)
        n = int(got["n"].sum())
        full = np.flatnonzero(total > max(n / RARE, 1))
        return pd.DataFrame({"part": int(got["part"].iloc[0]), "n": n, "cell": [full.astype(np.int64)]})

    texts = docs.select("text")
    found = texts.mapInArrow(sketch, "part long, n long, cells binary").groupBy("part").applyInPandas(add, "part long, n long, cell array<long>").collect()  # CELLS bits at most
    n = max((r["n"] for r in found), default=0)
    others = 1 + math.log(min(max(n, 1), RARE)) / math.log(RARE)  # of what one document holds, or too few
    cells = np.zeros(CELLS, bool)
    for r in found:
        cells[np.array(r["cell"], np.int64) + r["part"] * PART] = True
    if not cells.any():
        return np.empty(0, np.uint64), np.empty(0), others
    chosen = np.packbits(cells)

    def count(batches):
        wanted = np.unpackbits(chosen).astype(bool)
        held: list[np.ndarray] = []
        size = 0

        def out():
            key, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(times)], ["h", "df"])

        for batch in batches:
            for lo, hi in blocks(batch.column(0), BYTES):
                _, h, _ = bags(batch.column(0).slice(lo, hi - lo))
                held.append(h[wanted[(h >> np.uint64(44)).astype(np.int64)]])
                size += len(held[-1])
                if size > 1 << 20:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    rows = texts.mapInArrow(count, "h long, df long").groupBy("h").agg(F.sum("df").alias("df")).where(F.col("df") > max(n / RARE, 1)).collect()
    h, df = np.array([r["h"] for r in rows], np.int64).view(np.uint64), np.array([r["df"] for r in rows], float)
    order = np.argsort(h)
    return h[order], 1 + np.log(n / np.minimum(df[order], n)) / math.log(RARE), others


def signed(docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """node, node2, k, doc_id, bytes of the text, bands (empty for texts without a word)."""

    def run(batches):
        for batch in batches:
            for lo, hi in blocks(batch.column(4), BYTES):
                part = batch.slice(lo, hi - lo)
                begin, h, w = bags(part.column(4), heavy)
                bands = band_hashes(samples(begin, h, w))
                has = begin[1:] > begin[:-1]
                flat = pa.array(bands.ravel())
                offsets = np.concatenate([[0], np.cumsum(has)]) * BANDS
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat)
                size = pc.cast(pc.binary_length(part.column(4)), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:4], size, lists], ["node", "node2", "k", "doc_id", "bytes", "bands"])

    return docs.select("node", "node2", "k", "doc_id", "text").mapInArrow(run, "node long, node2 long, k long, doc_id long, bytes long, bands array<long>")


def star(pairs: DataFrame, texts: DataFrame, heavy: tuple[np.ndarray, np.ndarray, float], least: float) -> DataFrame:
    """a, b, s for pairs (a, b) with a similarity of at least `least`. Texts of one b are dealt by salts, so that each
    task compares about STAR of them, or STAR_BYTES, with it."""
    spark = pairs.sparkSession
    salts = F.ceil(F.greatest(F.count("*") / STAR, F.sum("bytes") / STAR_BYTES)).cast("long").alias("salts")
    hot, _ = written(pairs.groupBy("b").agg(salts).where("salts > 1"), "hot-stars")
    dealt = pairs.join(hot, "b", "left").withColumn("salt", F.pmod(F.xxhash64("a"), F.coalesce("salts", F.lit(1)))).select("a", "b", "salt")
    roles = dealt.select(F.col("a").alias("node"), "b", "salt", F.lit(1).alias("side")).union(dealt.select(F.col("b").alias("node"), "b", "salt", F.lit(0).alias("side")).distinct())
    task = ["b", "salt"]
    rows = roles.join(texts, "node").select(*task, "side", "node", "text").repartition(max(8, shuffle_parts(spark)), *task).sortWithinPartitions(*task, "side")

    def run(batches):
        for group in whole_groups(batches, 2):
            b, salt, side, node = (group.column(i).to_numpy() for i in range(4))
            centre: tuple | None = None
            out: list[tuple] = []
            column = whole(group.column("text"))
            for lo, hi in blocks(column, BYTES):
                begin, h, w = bags(column.slice(lo, hi - lo), heavy)
                for i in range(lo, hi):
                    x, y = begin[i - lo], begin[i - lo + 1]
                    if side[i] == 0:
                        centre = (h[x:y].copy(), w[x:y].copy(), b[i], salt[i])
                    elif centre is not None and centre[2:] == (b[i], salt[i]) and (s := similarity(h[x:y], w[x:y], *centre[:2])) >= least:
                        out.append((node[i], b[i], s))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "s"])

    return rows.mapInArrow(run, "a long, b long, s double")


def rest(members: DataFrame, tested: DataFrame, label: DataFrame, texts: DataFrame, heavy: tuple[np.ndarray, np.ndarray, float], threshold: float) -> DataFrame:
    """a, b: links between components within buckets that star() has left apart."""
    spark = members.sparkSession
    s = tested.select(F.col("a").alias("node"), F.col("b").alias("rep"), "s")
    rows = members.join(s, ["node", "rep"], "left").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    passed = (F.col("node") == F.col("rep")) | (F.coalesce("s", F.lit(0.0)) >= threshold)
    near = ~passed & (F.coalesce("s", F.lit(0.0)) >= 2 * threshold - 1)
    rows = rows.select("band", "h", "node", "bytes", "label", passed.alias("passed"), near.alias("near"), F.when(F.col("node") == F.col("rep"), F.col("label")).alias("rep_label"))
    buckets = rows.groupBy("band", "h").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES)).cast("long").alias("blocks"), F.min("label").alias("low"), F.max("label").alias("high"), F.max("rep_label").alias("of_rep"),
        F.min(F.when(~F.col("passed"), F.col("label"))).alias("low_failed"), F.max(F.when(~F.col("passed"), F.col("label"))).alias("high_failed"),
        F.min(F.when(F.col("near"), F.col("label"))).alias("low_near"), F.max(F.when(F.col("near"), F.col("label"))).alias("high_near"),
    ).where("low != high")
    has_near = "low_near is not null and (low_near != of_rep or high_near != of_rep)"
    buckets = buckets.withColumn("near_any", F.expr(has_near)).where("near_any or low_failed != high_failed").select("band", "h", "near_any", "blocks")
    left = rows.join(buckets, ["band", "h"]).where("not passed or near_any")
    left = left.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1L)")))
    left = left.select("band", "h", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "label", "passed", "near")
    task = ["band", "h", "lo", "hi"]
    shipped = left.join(texts, "node").select(*task, "own", "node", "label", "passed", "near", "text").repartition(max(8, shuffle_parts(spark)), *task).sortWithinPartitions(*task)

    def run(batches):
        for group in whole_groups(batches, 4):
            at = np.stack([group.column(i).to_numpy() for i in range(4)])
            starts = np.flatnonzero(np.r_[True, (at[:, 1:] != at[:, :-1]).any(0)])
            for first, stop in zip(starts, np.r_[starts[1:], at.shape[1]], strict=True):
                part = group.slice(first, stop - first)
                own, node, label, passed, near = (part.column(c).to_numpy() for c in ("own", "node", "label", "passed", "near"))
                begin, h, w = bags_of(whole(part.column("text")), heavy)
                across = at[2, first] != at[3, first]
                parent = {x: x for x in label.tolist()}

                def root(x, parent=parent):
                    while parent[x] != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                links = []
                for i in np.flatnonzero(~passed):
                    for j in range(len(node)):
                        if j == i or (not passed[j] and j < i) or (passed[j] and not near[i]) or across and own[i] == own[j] or root(label[i]) == root(label[j]):
                            continue
                        if similarity(h[begin[i] : begin[i + 1]], w[begin[i] : begin[i + 1]], h[begin[j] : begin[j + 1]], w[begin[j] : begin[j + 1]]) >= threshold:
                            parent[root(label[i])] = root(label[j])
                            links.append((node[i], node[j]))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

    return shipped.mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, k and node2 (which tell rows apart), class_id, the smallest doc_id of the class, and whether the row
    stays. A table in the shared folder; what led to it is deleted."""
    spark = docs.sparkSession
    rows, scratch = keyed(docs), []

    def table(df: DataFrame, name: str) -> DataFrame:
        out, path = written(df, name)
        scratch.append(path)
        return out

    heavy = heavy_shingles(rows)
    held = told_apart(table(signed(rows, heavy), "signatures"))
    nodes = held.groupBy("node").agg(F.min(F.struct("k", "node2")).alias("row"), F.max("bands").alias("bands"), F.max("bytes").alias("bytes"))
    banded = nodes.where(F.size("bands") > 0).select("node", "row.k", "row.node2", "bytes", F.posexplode("bands").alias("band", "h"))
    shared = banded.groupBy("band", "h").agg(F.count("*").alias("m"), F.min("node").alias("rep")).where("m > 1").drop("m")
    members = table(banded.join(shared, ["band", "h"]).select("band", "h", "node", "k", "node2", "bytes", "rep"), "members")
    involved = rows.select("k", "node2", "text").join(members.select("node", "k", "node2").distinct(), ["k", "node2"]).select("node", "text")
    texts = table(involved.dropDuplicates(["node"]) if repeats(held) else involved, "involved-texts")
    pairs = members.where("node != rep").select(F.col("node").alias("a"), F.col("rep").alias("b"), "bytes").distinct()
    tested = table(star(pairs, texts, heavy, 2 * threshold - 1), "stars")
    label = table(components(tested.where(F.col("s") >= threshold).select("a", "b")), "labels")
    more = table(rest(members.drop("k", "node2"), tested, label, texts, heavy, threshold), "more-links")
    if more.limit(1).count():
        joined = more.join(label.toDF("a", "la"), "a", "left").join(label.toDF("b", "lb"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        # labels of labels: a node follows its first label to the last
        over = components(joined).toDF("label", "last")
        label = label.union(joined.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(label, "node", "left_anti").select("node", F.col("node").alias("label")))
        label = label.join(over, "label", "left").select("node", F.coalesce("last", "label").alias("label"))
    # both sides of the last join are tables, so that the rows of a large class can be split
    labelled = table(held.select("node", "node2", "k", "doc_id").join(label, "node", "left").select("doc_id", "k", "node2", F.coalesce("label", "node").alias("label")), "labelled")
    least = table(labelled.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k", "node2")).alias("first")), "least")
    out, _ = written(labelled.join(least, "label").select("doc_id", "k", "node2", F.col("first.doc_id").alias("class_id"), ((F.col("k") == F.col("first.k")) & (F.col("node2") == F.col("first.node2"))).alias("kept")), "classes")
    dropped(spark, *scratch)
    return out


def repeats(held: DataFrame) -> bool:
    """Whether some row occurs twice."""
    return bool(held.groupBy("k", "node2").count().where("count > 1").limit(1).count())


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that stay, one of each class, with their columns."""
    keys = classes(docs, threshold)
    one, two = free_names(docs, "k", "node2")
    stay = keys.where("kept").select(F.col("k").alias(one), F.col("node2").alias(two)).distinct()
    _, node2, k = keys_of(F.col("doc_id"), F.col("text"))
    kept = docs.withColumns({one: k, two: node2}).join(stay, [one, two], "left_semi")
    return (kept.dropDuplicates([one, two]) if repeats(keys) else kept).select(*quoted(docs))
