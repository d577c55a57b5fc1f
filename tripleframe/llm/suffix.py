"""Removal of long repeated strings with suffix arrays.

Every window of `LENGTH` bytes has an anchor: the leftmost position in it whose following `GRAM` bytes hash
lowest. Equal windows have equal anchors at equal places, so each run of windows that share an anchor (their
*context*: some hundred bytes) need only be compared with the contexts of anchors that hash alike. Contexts
that occur twice as a whole are repeats throughout, which counting shows. The rest, one of each text, goes to
shards by anchor: a shard sorts the suffixes of its contexts (Larsson-Sadakane refinement), finds common
prefixes (Kasai, many lanes in step), and marks windows that share LENGTH bytes with a neighbour. An anchor
with more bytes than a shard may hold is split into blocks, and each pair of blocks is a task that looks the
windows of one up in the other's suffix array by binary search.

Most contexts share no more than the anchor's bytes, so a context's windows are dealt into *runs* of STEP by where the
anchor stands in them. Windows of a run all hold the same core of LENGTH - STEP + 1 bytes, so a run whose core no other
context of the task has drops out, and only bytes from a context's first run that is left to its last one are sorted.

Pairs of blocks grow with the square of their number, so an anchor of more than PAIRED blocks, a passage that very
many texts share in different surroundings, is *refined* instead, in work that grows with its contexts alone: runs
whose core no other context has drop out there too, runs that are equal as a whole are repeats throughout, and where
cores are equal and runs are not, the windows of each different run are counted one by one.

Nothing is dropped or capped. Shards compare bytes; whole contexts, cores, runs and windows of refined anchors go by
128-bit hashes, and so do the texts that rows belong to. Cores of other anchors go by 64-bit ones: equal hashes of
different cores only leave more to be sorted.

Defined results: null text is empty; texts shorter than LENGTH bytes keep all; very long texts are searched for
anchors a part at a time; rows that repeat count as other documents, so that repeated long texts go wholly; an empty
table gives an empty result; other columns are not read, and cleaned() hands them on whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import blocks, words_of
from .common import dropped, free_names, mapped, only, quoted, shuffle_parts, whole_groups, written

LENGTH = 400
GRAM = 32
#: Bytes of contexts that one suffix array holds.
SHARD = 1 << 20
#: Bytes of a text that are searched for anchors at a time.
PART = 1 << 20
SEED = np.uint64(0x9E3779B97F4A7C15)
SEPARATOR = 0xFF  # no byte of UTF-8
#: Blocks of an anchor whose pairs are compared, one with more is refined; windows of a run.
PAIRED, STEP = 4, 24
ANCHORS = "k1 long, k2 long, lo long, size long, p long, a long, ctx binary"


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the `gram` (a power of two) bytes from each position; data has `gram` bytes of padding."""
    h = (data.astype(np.uint64) + np.uint64(1)) * SEED
    step, mult = 1, int(SEED)
    while step < gram:
        h[:-step] = h[:-step] * np.uint64(mult) + h[step:]
        step *= 2
        mult = mult * mult & 0xFFFFFFFFFFFFFFFF
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows, from prefix and suffix minima of blocks."""
    n = len(x)
    pad = np.full(-n % width + width, np.iinfo(x.dtype).max, x.dtype)
    grid = np.concatenate([x, pad]).reshape(-1, width)
    prefix = np.minimum.accumulate(grid, 1).ravel()
    suffix = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(suffix[:n], prefix[width - 1 : n + width - 1])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For texts data[starts:ends]: (text, first window, last window, anchor, its hash) of each run of windows."""
    size = ends - starts
    long = np.flatnonzero(size >= length)
    if not len(long):
        return tuple(np.empty(0, np.int64) for _ in range(5))
    hashes = gram_hashes(np.concatenate([data, np.zeros(gram, np.uint8)]), gram)[: len(data)]
    key = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(data), dtype=np.uint64)
    at = (sliding_minimum(key, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    live = np.zeros(len(data) + 1, np.int8)  # where a whole window starts
    np.add.at(live, starts[long], 1)
    np.add.at(live, ends[long] - length + 1, -1)
    live = live.cumsum()[:-1] > 0
    fresh = live.copy()
    fresh[1:] &= (at[1:] != at[:-1]) | ~live[:-1]
    fresh[starts[long]] = True
    first = np.flatnonzero(fresh)
    stop = live.copy()
    stop[:-1] &= fresh[1:] | ~live[1:]
    last = np.flatnonzero(stop)
    return np.searchsorted(starts, first, "right") - 1, first, last, at[first], hashes[at[first]].view(np.int64)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Larsson and Sadakane's refinement: suffixes are sorted by eight bytes; then only groups that are not sorted
    yet are refined, by the ranks that stand as far to the right as is sorted so far, which doubles each time."""
    n = len(data)
    first = words_of(data)
    sa = (n - 1 - np.argsort(first[::-1], kind="stable")).astype(np.int32)  # of equal words the shorter suffix comes first
    fresh = np.r_[True, (np.diff(first[sa]) != 0) | (sa[1:] > n - 8) | (sa[:-1] > n - 8)]
    del first
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=np.int32), 0))
    h = 8
    while h < n:
        open_ = np.flatnonzero(~(fresh & np.r_[fresh[1:], True])).astype(np.int32)
        if not len(open_):
            break
        index = sa[open_]
        key = rank[index].astype(np.int64) << 32
        key |= np.where(index < n - h, rank[np.minimum(index, n - h - 1) + h] + 1, 0)
        order = np.argsort(key, kind="stable")
        index, key = index[order], key[order]
        sa[open_] = index
        fresh[open_] = np.r_[True, key[1:] != key[:-1]]
        rank[index] = np.maximum.accumulate(np.where(fresh[open_], open_, 0))
        h *= 2
    return sa


def kasai(data: np.ndarray, sa: np.ndarray, cap: int = LENGTH, lanes: int = 4096) -> np.ndarray:
    """By position: bytes shared with the suffix before it in sa, at most cap. Kasai's pass runs over many lanes in
    step, eight bytes a comparison; in a lane, a position shares at least what the one before it did, less one."""
    n = len(data)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    w = words_of(np.concatenate([data, np.zeros(cap + 16, np.uint8)]))
    out = np.zeros(n, np.int32)
    run = -(-n // min(lanes, max(1, n // 64)))
    begin = np.arange(0, n, run)
    h = np.zeros(len(begin), np.int64)
    for t in range(run):
        i = begin[begin + t < n] + t
        j = before[i]
        got = np.maximum(h[: len(i)] - 1, 0)
        got[j < 0] = 0
        active = np.flatnonzero((j >= 0) & (got < cap))
        while len(active):
            x = w[i[active] + got[active]] ^ w[j[active] + got[active]]
            same = x == 0
            step = np.full(len(active), 8)
            if not same.all():
                step[~same] = sum((x[~same] < np.uint64(1 << bits)).astype(np.int64) for bits in range(8, 64, 8))
            got[active] += step
            active = active[same & (got[active] < cap)]
        got = np.minimum(got, np.minimum(cap, n - np.maximum(i, np.maximum(j, 0))))
        h[: len(i)] = got
        out[i] = got
    return out


def repeated(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether the `length` bytes from each position occur at another one too."""
    if len(data) < 2:
        return np.zeros(len(data), bool)
    sa = suffix_array(data)
    shared = kasai(data, sa, length) >= length
    out = shared.copy()
    in_order = shared[sa]
    out[sa[:-1]] |= in_order[1:]
    return out


def found_in(data: np.ndarray, other: np.ndarray, other_sa: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether the `length` bytes from each position of data occur in other, by binary search in its suffix array."""
    out = np.zeros(len(data), bool)
    if not len(other) or len(data) < length:
        return out
    q = np.arange(len(data) - length + 1)
    a, b = (words_of(np.concatenate([x, np.zeros(length + 16, np.uint8)])) for x in (data, other))
    steps = [*range(0, length - 8, 8), length - 8]

    def compare(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        sign, open_ = np.zeros(len(rows), np.int8), np.arange(len(rows))
        for s in steps:
            x, y = a[rows[open_] + s], b[at[open_] + s]
            sign[open_] = np.where(x < y, -1, np.where(x > y, 1, 0))
            open_ = open_[x == y]
            if not len(open_):
                break
        return sign

    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(other_sa))
    while (live := np.flatnonzero(lo < hi)).size:
        mid = (lo[live] + hi[live]) // 2
        above = compare(q[live], other_sa[mid]) > 0
        lo[live] = np.where(above, mid + 1, lo[live])
        hi[live] = np.where(above, hi[live], mid)
    inside = np.flatnonzero(lo < len(other_sa))
    at = other_sa[lo[inside]]
    fits = at + length <= len(other)
    inside, at = inside[fits], at[fits]
    out[inside] = compare(q[inside], at) == 0
    return out


def keyed(docs: DataFrame) -> DataFrame:
    docs = only(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    return docs.select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(7), "doc_id", "text").alias("k2"), "doc_id", "text")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each text starts and ends."""
    column = column.cast(pa.large_binary())
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], np.uint8)[offsets[0] : offsets[-1]] if raw[2] is not None and raw[2].size else np.empty(0, np.uint8)
    return data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0]


def find_anchors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, part: int = PART) -> DataFrame:
    """The runs of windows that share an anchor, and a hash of the bytes that they cover."""

    def run(batches):
        for batch in batches:
            for lo, hi in blocks(batch.column(2)):
                data, starts, ends = buffers(batch.column(2).slice(lo, hi - lo))
                for at in range(0, max(len(data) - length + 1, 1), part) if hi - lo == 1 else [0]:  # windows of a very long text, some at a time
                    piece = data[at : at + part + length - 1] if hi - lo == 1 else data
                    text, first, last, p, a = anchors(piece, starts, np.minimum(ends, len(piece)) if hi - lo == 1 else ends, length, gram)
                    if len(text):
                        raw = piece.tobytes()
                        ctx = [xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(first.tolist(), (last + length).tolist(), strict=True)]
                        rows = pa.array(text + lo)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first - starts[text] + at), pa.array(last - first + length), pa.array(p - starts[text] + at), pa.array(a), pa.array(ctx, pa.binary())], ["k1", "k2", "lo", "size", "p", "a", "ctx"])

    return docs.select("k1", "k2", "text").mapInArrow(run, ANCHORS)


def with_parts(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """k1, k2, text and the list of its parts (the other columns of `parts`); a text has no more of them than bytes."""
    wanted = parts.groupBy("k1", "k2").agg(F.collect_list(F.struct(*(c for c in parts.columns if c not in ("k1", "k2")))).alias("parts"))
    return docs.select("k1", "k2", "text").join(wanted, ["k1", "k2"])


def cut_by(make, names: list[str], kinds: list[pa.DataType]):
    """A function for mapInArrow over with_parts(): make(text's bytes, k1, k2, part) gives rows of each part."""

    def run(batches):
        for batch in batches:
            for lo, hi in blocks(batch.column(2)):
                out = []
                for k1, k2, text, parts in zip(*(c.slice(lo, hi - lo).to_pylist() for c in batch.columns), strict=True):
                    raw = text.encode()
                    for p in parts:
                        out += make(raw, k1, k2, p)
                        if len(out) >= 50_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def runs_of(p: int, lo: int, size: int, length: int, step: int) -> list[tuple[int, int, int]]:
    """The runs of a context with its anchor at p: windows that begin near to far bytes before it, c * step at least."""
    first, last = p - lo - size + length, p - lo  # bytes before the anchor, in the last and the first window
    return [(c, max(first, c * step), min(last, c * step + step - 1)) for c in range(first // step, last // step + 1)]


def refined(docs: DataFrame, hot: DataFrame, length: int, step: int = STEP) -> tuple[DataFrame, list[str]]:
    """Intervals of repeats of very common anchors' contexts (a, k1, k2, lo, size, p, n), and the tables behind them."""

    def runs(raw: bytes, k1: int, k2: int, part: dict) -> list[tuple]:
        out, p = [], part["p"]
        for c, near, far in runs_of(p, part["lo"], part["size"], length, step):
            core = xxhash.xxh3_128_digest(raw[p - c * step : p - c * step - step + 1 + length])
            out.append((part["a"], c, core, xxhash.xxh3_128_digest(raw[p - far : p - near + length]), near, far, k1, k2, p - far, p - near + length, part["n"]))
        return out

    names = ["a", "c", "core", "run", "near", "far", "k1", "k2", "lo", "hi", "n"]
    kinds = [pa.binary() if x in ("core", "run") else pa.int64() for x in names]
    schema = ", ".join(f"{x} {'binary' if t == pa.binary() else 'long'}" for x, t in zip(names, kinds, strict=True))
    every, a = written(with_parts(docs, hot).mapInArrow(cut_by(runs, names, kinds), schema), "runs")
    key = ["a", "c", "core"]
    # runs that are equal as a whole, of each the least row stands for all
    kinds_, b = written(every.groupBy(*key, "run", "near", "far").agg(F.sum("n").alias("times"), F.min(F.struct("k1", "k2", "lo")).alias("at")), "kinds-of-runs")
    several, c = written(kinds_.groupBy(*key).agg(F.count("*").alias("kinds"), F.min("times").alias("least")).where("kinds > 1 and least = 1").select(*key), "cores-of-runs")
    same = every.where("n = 1").join(kinds_.where("times > 1").select(*key, "run", "near", "far"), [*key, "run", "near", "far"]).select("k1", "k2", "lo", "hi")

    def windows(raw: bytes, k1: int, k2: int, part: dict) -> list[tuple]:
        return [(part["a"], x, xxhash.xxh3_128_digest(raw[at : at + length]), min(part["times"], 2), k1, k2, at) for x, at in zip(range(part["far"], part["near"] - 1, -1), range(part["lo"], part["lo"] + step), strict=False)]

    names = ["a", "place", "window", "times", "k1", "k2", "lo"]
    kinds = [pa.binary() if x == "window" else pa.int64() for x in names]
    schema = ", ".join(f"{x} {'binary' if t == pa.binary() else 'long'}" for x, t in zip(names, kinds, strict=True))
    wanted = kinds_.join(several, key, "left_semi").select("a", "near", "far", "times", "at.k1", "at.k2", "at.lo")
    single, d = written(with_parts(docs, wanted).mapInArrow(cut_by(windows, names, kinds), schema), "windows")
    key = ["a", "place", "window"]
    again = single.groupBy(*key).agg(F.sum("times").alias("all"), F.min("times").alias("least")).where("all > 1 and least = 1").select(*key)
    alone = single.where("times = 1").join(again, key).select("k1", "k2", "lo", (F.col("lo") + length).alias("hi"))
    return same.unionByName(alone), [a, b, c, d]


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """k1, k2 and intervals [lo, hi) of bytes to remove, of the texts of keyed(), as a table."""
    spark = docs.sparkSession
    found, found_path = written(find_anchors(docs, length, gram), "anchors")
    met, met_path = written(found.groupBy("a").agg(F.count("*").alias("times")).where("times > 1").select("a"), "met-anchors")  # a table, so that a very common anchor's rows can be split in the join
    shared, shared_path = written(found.join(met, "a", "left_semi"), "shared-anchors")
    dropped(spark, found_path, met_path)
    contexts = shared.groupBy("a", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "lo", "size", "p")).alias("at"))
    contexts, contexts_path = written(contexts.select("a", "ctx", "n", "at.*"), "contexts")
    whole = shared.join(contexts.where("n > 1").select("a", "ctx"), ["a", "ctx"]).select("k1", "k2", "lo", (F.col("lo") + F.col("size")).alias("hi"))
    groups = contexts.groupBy("a").agg(F.count("*").alias("kinds"), F.min("n").alias("least"), F.ceil(F.sum("size") / shard).cast("long").alias("blocks"))
    groups, groups_path = written(groups.where("kinds > 1 and least = 1").select("a", "blocks"), "anchor-groups")
    common, common_paths = refined(docs, contexts.join(groups.where(F.col("blocks") > PAIRED).select("a"), "a").drop("ctx"), length)
    wanted = contexts.join(groups.where(F.col("blocks") <= PAIRED), "a").select("k1", "k2", "lo", "size", "p", "a", "n", "blocks")

    def cut(raw: bytes, k1: int, k2: int, p: dict) -> list[tuple]:
        own = xxhash.xxh64_intdigest(f"{k1} {p['lo']}") % p["blocks"]
        return [(p["a"], min(own, other), max(own, other), own, p["n"], k1, k2, p["lo"], p["p"], raw[p["lo"] : p["lo"] + p["size"]]) for other in range(p["blocks"])]

    names = ["a", "b1", "b2", "own", "n", "k1", "k2", "lo", "p", "raw"]
    task = ["a", "b1", "b2"]
    rows = with_parts(docs, wanted).mapInArrow(cut_by(cut, names, [*[pa.int64()] * 9, pa.binary()]), "a long, b1 long, b2 long, own long, n long, k1 long, k2 long, lo long, p long, raw binary")
    rows = rows.repartition(max(8, shuffle_parts(spark)), *task).sortWithinPartitions(*task)

    def compare(batches):
        held: list[pa.Table] = []
        size = 0
        for group in whole_groups(batches, 3):
            for part in tasks(group, shard):
                pair = part["b1"][0].as_py() != part["b2"][0].as_py()
                part = thinned(part, length)
                if not part.num_rows:
                    continue
                if pair:
                    yield from marked(part, True, length)
                    continue
                if held and size + part["raw"].nbytes > shard:
                    yield from marked(pa.concat_tables(held), False, length)
                    held, size = [], 0
                held.append(part)
                size += part["raw"].nbytes
        if held:
            yield from marked(pa.concat_tables(held), False, length)

    partly = rows.mapInArrow(compare, "k1 long, k2 long, lo long, hi long")
    out, _ = written(whole.unionByName(common).unionByName(partly), "spans")
    dropped(spark, shared_path, contexts_path, groups_path, *common_paths)
    return out


def tasks(group: pa.Table, shard: int) -> list[pa.Table]:
    """Whole tasks of a table that is sorted by task; small tasks of single blocks stay together up to the shard's size."""
    at = np.stack([group.column(i).to_numpy() for i in range(3)])
    starts = np.flatnonzero(np.r_[True, (at[:, 1:] != at[:, :-1]).any(0)])
    sizes = np.add.reduceat(np.asarray(pc.binary_length(group["raw"])), starts)
    ends = np.r_[starts[1:], group.num_rows]
    out, first, size = [], 0, 0
    for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
        if at[1, a] != at[2, a]:
            if starts[first] < a:
                out.append(group.slice(starts[first], a - starts[first]))
            out.append(group.slice(a, b - a))
            first, size = i + 1, 0
            continue
        if size and size + sizes[i] > shard:
            out.append(group.slice(starts[first], a - starts[first]))
            first, size = i, 0
        size += sizes[i]
    if first < len(starts) and size:
        out.append(group.slice(starts[first], group.num_rows - starts[first]))
    return out


def thinned(part: pa.Table, length: int, step: int = STEP) -> pa.Table:
    """What may hold repeats of whole tasks' contexts: from the first to the last run whose core another context has
    too (of a pair of blocks: one of the other block), and which is not in contexts alone that occur twice as a whole."""
    a, b1, b2, own, n, lo, p, raw = (part[c].to_pylist() for c in ("a", "b1", "b2", "own", "n", "lo", "p", "raw"))
    seen: dict[tuple, int] = {}  # 1 and 2: in a first and in another context, or on the two sides; 4: in one that occurs once
    cores = []
    for i, bytes_ in enumerate(raw):
        at = p[i] - lo[i]
        keys = [(c, a[i], b1[i], b2[i], xxhash.xxh3_64_intdigest(bytes_[at - c * step : at - c * step - step + 1 + length])) for c, _, _ in runs_of(at, 0, len(bytes_), length, step)]
        for key in keys:
            was = seen.get(key, 0)
            side = (2 if was else 1) if b1[i] == b2[i] else 1 if own[i] == b1[i] else 2
            seen[key] = was | side | (4 if n[i] == 1 else 0)
        cores.append(keys)
    rows, starts, left = [], [], []
    for i, keys in enumerate(cores):
        if met := [key[0] for key in keys if seen[key] == 7]:
            at = p[i] - lo[i]
            x = max(0, at - met[-1] * step - step + 1)
            rows.append(i)
            starts.append(lo[i] + x)
            left.append(raw[i][x : at - met[0] * step + length])
    out = part.take(pa.array(rows, pa.int64()))
    for name, values in (("lo", pa.array(starts, pa.int64())), ("raw", pa.array(left, pa.binary()))):
        out = out.set_column(out.schema.get_field_index(name), name, values)
    return out


def joined(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Contexts in a row, a separator behind each, and where each begins."""
    sep = bytes([SEPARATOR])
    data = np.frombuffer(sep.join(raws) + sep, np.uint8)
    return data, np.r_[0, np.cumsum([len(r) + 1 for r in raws])[:-1]]


def marked(part: pa.Table, pair: bool, length: int):
    """Runs of repeated windows, of contexts that occur once as a whole."""
    raws = part["raw"].to_pylist()
    if pair:
        own = part["own"].to_numpy() == part["b1"].to_numpy()
        sides = [np.flatnonzero(own), np.flatnonzero(~own)]
        made = [joined([raws[i] for i in side]) for side in sides]
        sas = [suffix_array(d) for d, _ in made]
        results = [(sides[s], made[s][1], found_in(made[s][0], made[1 - s][0], sas[1 - s], length)) for s in (0, 1) if len(sides[s]) and len(sides[1 - s])]
    else:
        data, begin = joined(raws)
        results = [(np.arange(len(raws)), begin, repeated(data, length))]
    k1, k2, lo, n = (part[c].to_numpy() for c in ("k1", "k2", "lo", "n"))
    for rows, begin, hit in results:
        sizes = np.array([len(raws[i]) for i in rows])
        crosses = np.zeros(len(hit) + 1, np.int8)  # windows that hold a separator
        np.add.at(crosses, begin + sizes - length + 1, 1)
        np.add.at(crosses, np.r_[begin[1:], len(hit)], -1)
        hit = hit & (crosses.cumsum()[:-1] == 0)
        edge = np.diff(np.r_[0, hit.astype(np.int8), 0])
        first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        of = np.searchsorted(begin, first, "right") - 1
        row = rows[of]
        keep = n[row] == 1
        row, start = row[keep], (first - begin[of])[keep] + lo[rows[of]][keep]
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(k1[row]), pa.array(k2[row]), pa.array(start), pa.array(start + (stop - first)[keep] - 1 + length)], ["k1", "k2", "lo", "hi"])


def merged(parts: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted((p["lo"], p["hi"]) for p in parts or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def kept_bytes(text: str, parts: list[dict] | None) -> tuple[bytes, int, int]:
    """(remaining bytes, removed bytes, removed runs)."""
    raw, runs = text.encode(), merged(parts)
    out, at = [], 0
    for lo, hi in runs:
        out.append(raw[at:lo])
        at = hi
    out.append(raw[at:])
    return b"".join(out), sum(hi - lo for lo, hi in runs), len(runs)


def with_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """doc_id, text, parts (null if nothing is removed)."""
    rows = keyed(docs)
    found = spans(rows, length, gram, shard)
    per_text = found.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))
    return rows.join(per_text, ["k1", "k2"], "left").select("doc_id", "text", "parts")


def digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the text that is left (without characters cut apart)."""

    def run(batches):
        for batch in batches:
            for lo, hi in blocks(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                out = []
                for text, parts in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    kept, removed, n = kept_bytes(text, parts)
                    out.append((len(kept) + removed, removed, n, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
                n_bytes, n_removed, n_spans, sha, left = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()), pa.array(left, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    return with_spans(docs, length, gram, shard).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def cleaned(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """The rows of docs with what is left of their texts (a character that was cut apart goes), and n_chars to match."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = spans(keyed(docs), length, gram, shard)
    one, two, parts_ = free_names(docs, "k1", "k2", "parts")
    per_text = found.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias(parts_)).withColumnsRenamed({"k1": one, "k2": two})
    keyed_ = docs.withColumns({one: F.xxhash64(F.col("doc_id").cast("long"), text), two: F.xxhash64(F.lit(7), F.col("doc_id").cast("long"), text)})
    rows = keyed_.join(per_text, [one, two], "left").select(*quoted(docs), parts_)
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            for lo, hi in blocks(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                columns, names = part.columns[:-1], part.schema.names[:-1]
                if part.column(part.num_columns - 1).null_count < part.num_rows:
                    new = [t if p is None or t is None else kept_bytes(t, p)[0].decode("utf-8", "ignore") for t, p in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True)]
                    columns[at] = pa.array(new, pa.string())
                    if chars is not None:
                        columns[chars] = pa.array([None if t is None else len(t) for t in new], pa.int64()).cast(columns[chars].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return mapped(rows, run, docs)
