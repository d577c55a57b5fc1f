"""Analytics of bucket maintenance: sizes, split and merge plans, danger scores, history, and the batch tuner.

`now` is always an argument, so that results can be repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Thresholds of the engine.
SPLIT, MERGE, FLOOR = 128, 8, 64
DATASET_ABOVE, SHARDED_ABOVE, SHARD_ENTRIES = 1_000, 50_000, 50_000
HISTORY, STAMPS, RECENT, LATEST = 1_000, 100, 100, 50


@dataclass(frozen=True)
class MaintenanceConfig:
    gc_interval: float = 60.0
    maintenance_interval: float = 30.0
    sort_threshold: int = 16
    merge_threshold: int = MERGE
    analysis_interval: float = 120.0

    @classmethod
    def for_tests(cls) -> MaintenanceConfig:
        return cls(gc_interval=1.0, maintenance_interval=1.0, analysis_interval=1.0)


def bucket_stats(kv: DataFrame, bucket: Column) -> DataFrame:
    return kv.groupBy(bucket.cast("long").alias("bucket_id")).agg(F.count("*").alias("entry_count"), F.countDistinct("key").alias("n_keys"))


def split_plan(stats: DataFrame, depth: int, split: int = SPLIT) -> DataFrame:
    """Buckets of a split; they become two of one more bit."""
    return stats.where(F.col("entry_count") >= split).select("bucket_id", "entry_count", (F.col("bucket_id") * 2).alias("left_id"), (F.col("bucket_id") * 2 + 1).alias("right_id"), F.lit(depth + 1).alias("new_depth"))


def redistributed(kv: DataFrame, key_high: Column, depth: int) -> DataFrame:
    """Each entry's side after a split on bit 64 - depth of its key's high word."""
    return kv.withColumn("side", F.shiftrightunsigned(key_high, 64 - depth).bitwiseAND(F.lit(1).cast("long")))


def merge_plan(stats: DataFrame, depth: int, most: int = MERGE) -> DataFrame:
    """Buddies, which differ in the last bit, with few entries each."""
    small = stats.where(F.col("entry_count") <= most).select("bucket_id", "entry_count")
    pair = small.groupBy(F.shiftright("bucket_id", 1).alias("merged_id")).agg(F.count("*").alias("n"), F.min("bucket_id").alias("bucket_id"), F.max("bucket_id").alias("buddy_id"), F.sum("entry_count").alias("entry_count"))
    return pair.where((F.col("n") == 2) & F.lit(depth > 1)).drop("n")


def doubled(directory: DataFrame) -> DataFrame:
    """A directory (index, bucket_id) of one more bit; indices are prefixes, so each pointer is repeated in place."""
    bits = directory.select("index", "bucket_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("bit"))
    return bits.select((F.col("index") * 2 + F.col("bit")).alias("index"), "bucket_id")


def directory_mode(size: Column) -> Column:
    return F.when(size > SHARDED_ABOVE, "sharded").when(size > DATASET_ABOVE, "dataset").otherwise("attribute")


def trimmed(history: DataFrame, most: int = HISTORY) -> DataFrame:
    """The last operations (seq, bucket_id, op, ts); the window's group limit keeps the sort short."""
    return history.orderBy(F.desc("seq")).limit(most)


def frequency_score(n: Column) -> Column:
    return F.least(n / 100, F.lit(5.0))


def recency_score(last: Column, now: float) -> Column:
    gap = F.lit(now) - last
    return F.when(last.isNull() | (gap >= 300), 0.0).otherwise((300 - gap) / 300 * 2)


def insert_rate_score(n: Column, recent: Column) -> Column:
    return F.when(n < 10, 0.0).otherwise(recent / 60 * 10)


def sequential_share(history: DataFrame) -> DataFrame:
    """One row: the share of the latest operations next to the one before them, over at most LATEST rows."""
    latest = trimmed(history, LATEST)
    step = F.abs(F.col("bucket_id") - F.lag("bucket_id").over(W.orderBy("seq")))
    return latest.select((step <= 1).alias("near"), "bucket_id").agg(F.coalesce(F.count_if("near") / F.count("*"), F.lit(0.0)).alias("share"), F.count("*").alias("n"), F.countDistinct("bucket_id").alias("buckets"))


def danger(history: DataFrame, now: float) -> DataFrame:
    """bucket_id, operations and the four scores with their sum, at most 20."""
    kept = trimmed(history)
    inserts = kept.where("op = 'INSERT'").withColumn("r", F.row_number().over(W.partitionBy("bucket_id").orderBy(F.desc("seq")))).where(F.col("r") <= STAMPS)
    rates = inserts.groupBy("bucket_id").agg(F.count("*").alias("stamps"), F.count_if(F.lit(now) - F.col("ts") < 60).alias("recent"))
    hits = trimmed(history, RECENT).groupBy("bucket_id").agg(F.count("*").alias("hits"))
    base = kept.groupBy("bucket_id").agg(F.count("*").alias("operations"), F.max("ts").alias("last"))
    rows = base.join(rates, "bucket_id", "left").join(hits, "bucket_id", "left").crossJoin(F.broadcast(sequential_share(history)))  # one row
    scored = rows.select(
        "bucket_id", "operations", frequency_score(F.col("operations")).alias("frequency"), insert_rate_score(F.coalesce("stamps", F.lit(0)), F.coalesce("recent", F.lit(0))).alias("insert_rate"),
        recency_score(F.col("last"), now).alias("recency"), F.when(F.coalesce("hits", F.lit(0)) < 5, 0.0).otherwise(F.col("share") * 3).alias("sequential"),
    )
    return scored.withColumn("danger", F.least(F.col("frequency") + F.col("insert_rate") + F.col("recency") + F.col("sequential"), F.lit(20.0)))


def split_threshold(score: Column) -> Column:
    return F.when(score >= 0.8, 64).when(score >= 0.6, 80).when(score >= 0.4, 96).when(score >= 0.2, 112).otherwise(SPLIT)


def should_split(size: Column, score: Column) -> Column:
    return size >= split_threshold(score)


def merge_decisions(scores: DataFrame, sizes: DataFrame) -> DataFrame:
    """Buddies (bucket_id even, buddy_id) and whether their scores and sizes let them merge."""
    both = sizes.join(scores, "bucket_id", "left").select("bucket_id", "entry_count", F.coalesce("danger", F.lit(0.0)).alias("danger"))
    pair = both.groupBy((F.shiftright("bucket_id", 1) * 2).alias("first")).agg(F.count("*").alias("n"), F.max("danger").alias("most"), F.avg("danger").alias("average"), F.max("entry_count").alias("size")).where("n = 2")
    threshold = F.greatest(F.lit(4), F.lit(MERGE) + F.floor(F.col("average") / 5 * 4).cast("int"))
    return pair.select(F.col("first").alias("bucket_id"), (F.col("first") + 1).alias("buddy_id"), threshold.alias("threshold"), ((F.col("most") <= 8) & (F.col("size") <= threshold)).alias("merges"))


def insights(scores: DataFrame, least: float = 0.5) -> DataFrame:
    """Buckets in danger with what to do about them."""
    # fixed values: the advice of each tier
    score = F.format_string("%.1f", "danger")
    what = (
        F.when(F.col("danger") > 10, F.concat(F.lit("Critical danger (score: "), score, F.lit(") - immediate split recommended")))
        .when(F.col("danger") > 5, F.concat(F.lit("High danger (score: "), score, F.lit(") - consider preemptive split")))
        .otherwise(F.concat(F.lit("Moderate activity (score: "), score, F.lit(") - monitor closely")))
    )
    return scores.where(F.col("danger") >= least).select("bucket_id", "operations", what.alias("suggestion"))


def is_sequential(history: DataFrame) -> DataFrame:
    """Whether the latest operations stay in few buckets."""
    return sequential_share(history).select(((F.col("n") > 10) & (F.col("buckets") < F.col("n") * 0.3)).alias("sequential"))


def summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("buckets"), F.coalesce(F.sum("operations"), F.lit(0)).alias("operations"), F.coalesce(F.avg("danger"), F.lit(0.0)).alias("avg_danger"), F.coalesce(F.max("danger"), F.lit(0.0)).alias("max_danger"))


def reset(stats: DataFrame, now: float, idle: float = 3600, fresh: float = 300) -> DataFrame:
    """Bucket statistics (bucket_id, operations, last, stamps) after a reset: idle ones go, counts halve."""
    return stats.where(F.lit(now) - F.col("last") <= idle).select("bucket_id", F.floor(F.col("operations") / 2).alias("operations"), "last", F.filter("stamps", lambda t: F.lit(now) - t < fresh).alias("stamps"))


def sorted_regions(kv: DataFrame, sorted_count: int) -> DataFrame:
    """Entries of a bucket in arrival order, the first of them its sorted region."""
    return kv.withColumn("sorted", F.row_number().over(W.partitionBy("bucket_id").orderBy("ht")) <= sorted_count)


# Fixed values of the batch tuner: weights of its terms, targets, limits and steps.
WEIGHTS = {"error": 0.5, "sum": 0.1, "change": 0.3}
TARGET, TOO_SLOW, SLOW_TICKS = 0.0001, 0.00015, 5
SOME_ERRORS, MANY_ERRORS, BAD_TICKS = 0.01, 0.05, 3
START_BATCH, LEAST_BATCH, MOST_BATCH, STEP_BATCH, FULL_BUFFER = 64, 32, 1024, 32, 0.8
START_FLUSH, LEAST_FLUSH, MOST_FLUSH, LONGER, SHORTER = 1.0, 0.1, 2.0, 1.1, 0.95
#: Halvings that leave at most two sizes of all between the limits, as 2**10 > 1024 - 32.
TWO_LEFT = 10


def tuner_events(metrics: DataFrame) -> DataFrame:
    """What each tick (series, tick, latency, errors, buffered) does to the batch size, by windows: halve, grow, or
    start over. A third bad tick in a row halves and begins a new row of them, as does one with many errors; a fifth
    slow one in a row starts over. Rows are told apart by running counts of what ends them."""
    time = W.partitionBy("series").orderBy("tick")
    before = time.rowsBetween(W.unboundedPreceding, -1)
    error = F.col("latency") - TARGET
    push = WEIGHTS["error"] * error + WEIGHTS["sum"] * F.sum(error).over(time.rowsBetween(W.unboundedPreceding, 0)) + WEIGHTS["change"] * (error - F.coalesce(F.lag(error).over(time), F.lit(0.0)))
    many, bad, slow = F.col("errors") > MANY_ERRORS, (error > 0) | (F.col("errors") > SOME_ERRORS), F.col("latency") > TOO_SLOW
    rows = metrics.withColumns({"late": error > 0, "push": push, "many": many, "bad": bad, "slow": slow})
    rows = rows.withColumns({"bad_row": F.coalesce(F.sum((~F.col("bad") | F.col("many")).cast("int")).over(before), F.lit(0)), "slow_row": F.coalesce(F.sum((~F.col("slow")).cast("int")).over(before), F.lit(0))})
    nth = lambda row: F.row_number().over(W.partitionBy("series", row).orderBy("tick"))
    halves = F.col("many") | F.col("bad") & (nth("bad_row") % BAD_TICKS == 0)
    rows = rows.withColumns({"halves": halves, "over": F.col("slow") & (nth("slow_row") % SLOW_TICKS == 0)})
    return rows.select("series", "tick", "late", "halves", (~F.col("halves") & (F.col("push") < 0) & (F.col("buffered") > FULL_BUFFER)).alias("grows"), "over")


#: Ticks of a series that are folded as one array.
PIECE = 512


def batch_after(batch: Column, tick: Column) -> Column:
    changed = F.when(tick["halves"], F.greatest(F.lit(LEAST_BATCH), F.floor(batch / 2).cast("int"))).when(tick["grows"], F.least(F.lit(MOST_BATCH), batch + STEP_BATCH)).otherwise(batch)
    return F.when(tick["over"], START_BATCH).otherwise(changed)


def flush_after(flush: Column, tick: Column) -> Column:
    changed = F.when(tick["late"], F.least(F.lit(MOST_FLUSH), flush * LONGER)).otherwise(F.greatest(F.lit(LEAST_FLUSH), flush * SHORTER))
    return F.when(tick["over"], START_FLUSH).otherwise(changed)


def tuned(metrics: DataFrame) -> DataFrame:
    """series, tick, batch, flush after each tick. A series is cut into pieces of PIECE ticks. What a piece does to any
    state is found first, pieces side by side; then a series is folded piece by piece, a row of one entry a piece; last,
    each piece is folded tick by tick from its own start.

    A piece's steps never change the order of two states, so its batch is the start's, grown and halved without limits
    (floor((batch + grown) / 2**halved)), cut to what it makes of the least and the most batch; ten halvings leave two
    results. Its flush is what both limits end at, which nearly always agree; a piece where they do not keeps its ticks."""
    rows = tuner_events(metrics)
    place = F.row_number().over(W.partitionBy("series").orderBy("tick")) - 1
    ticks = rows.withColumn("piece", F.floor(place / PIECE)).groupBy("series", "piece").agg(F.sort_array(F.collect_list(F.struct("tick", "late", "halves", "grows", "over"))).alias("ticks"))
    whole = F.struct(*(F.lit(x).alias(name) for name, x in (("low", LEAST_BATCH), ("high", MOST_BATCH), ("short", LEAST_FLUSH), ("long", MOST_FLUSH), ("halved", 0))), F.lit(0).cast("long").alias("grown"))

    def widen(state, tick):
        few = state["halved"] < TWO_LEFT
        return F.struct(
            batch_after(state["low"], tick).alias("low"), batch_after(state["high"], tick).alias("high"), flush_after(state["short"], tick).alias("short"), flush_after(state["long"], tick).alias("long"),
            (state["halved"] + F.when(few & tick["halves"], 1).otherwise(0)).alias("halved"),
            (state["grown"] + F.when(few & tick["grows"], F.expr(f"{STEP_BATCH}L") * F.pow(F.lit(2.0), state["halved"]).cast("long")).otherwise(0)).alias("grown"),
        )

    effect = F.aggregate("ticks", whole, widen)
    open_ = F.when(F.col("effect.short") != F.col("effect.long"), F.col("ticks"))
    effects = ticks.withColumn("effect", effect).select("series", "piece", "effect.*", open_.alias("ticks"))
    series = effects.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("piece", "low", "high", "short", "long", "halved", "grown", "ticks"))).alias("pieces"))

    def through(state, piece):
        made = lambda batch: F.floor((batch + piece["grown"]) / F.pow(F.lit(2.0), piece["halved"])).cast("int")  # noqa: E731  exact below 2**53
        between = F.greatest(piece["low"], F.least(piece["high"], made(state["batch"])))
        two = F.when(made(state["batch"]) == made(F.lit(LEAST_BATCH)), piece["low"]).otherwise(piece["high"])
        batch = F.when(piece["halved"] < TWO_LEFT, between).otherwise(two)
        flush = F.when(piece["ticks"].isNull(), piece["short"]).otherwise(F.aggregate(piece["ticks"], state["flush"], flush_after))
        start = F.struct(piece["piece"].alias("piece"), state["batch"].alias("batch"), state["flush"].alias("flush"))
        return F.struct(batch.alias("batch"), flush.alias("flush"), F.array_append(state["out"], start).alias("out"))

    begin = F.struct(F.lit(START_BATCH).alias("batch"), F.lit(START_FLUSH).alias("flush"), F.expr("cast(array() as array<struct<piece: bigint, batch: int, flush: double>>)").alias("out"))
    starts = series.select("series", F.explode(F.aggregate("pieces", begin, through, lambda s: s["out"])).alias("b")).select("series", "b.piece", "b.batch", "b.flush")

    def step(state, tick):
        batch, flush = batch_after(state["batch"], tick), flush_after(state["flush"], tick)
        return F.struct(batch.alias("batch"), flush.alias("flush"), F.array_append(state["out"], F.struct(tick["tick"].alias("tick"), batch.alias("batch"), flush.alias("flush"))).alias("out"))

    start = F.struct("batch", "flush", F.expr("cast(array() as array<struct<tick: bigint, batch: int, flush: double>>)").alias("out"))
    out = ticks.join(starts.withColumnRenamed("series", "of"), F.col("series").eqNullSafe(F.col("of")) & (ticks["piece"] == starts["piece"]))
    return out.select("series", F.explode(F.aggregate("ticks", start, step, lambda s: s["out"])).alias("t")).select("series", "t.tick", "t.batch", "t.flush")


def pointers_after_split(directory: DataFrame, depth: int, old: int, new: int, local_depth: int) -> DataFrame:
    """The directory (index, bucket_id) of 2**depth pointers after bucket `old` was split to `local_depth` bits: pointers
    whose next bit is set go to `new`."""
    bit = F.shiftright("index", depth - local_depth).bitwiseAND(F.lit(1).cast("long")) if depth >= local_depth else F.lit(0)
    return directory.select("index", F.when((F.col("bucket_id") == old) & (bit == 1), new).otherwise(F.col("bucket_id")).cast("long").alias("bucket_id"))


def adaptive_trigger(scores: DataFrame, stats: DataFrame, least: float = 0.5) -> DataFrame:
    """Buckets that insights name and that hold half a split's entries: they are tried for a split, which still needs
    all of them."""
    named = scores.where(F.col("danger") >= least).select("bucket_id", "danger")
    return stats.join(named, "bucket_id").where(F.col("entry_count") >= max(SPLIT // 2, FLOOR)).select("bucket_id", "entry_count", (F.col("entry_count") >= SPLIT).alias("splits"))


def maintenance_cycle(kv: DataFrame, scores: DataFrame, bucket: Column, depth: int, config: MaintenanceConfig | None = None) -> DataFrame:
    """step, action, bucket_id, entry_count of one cycle over entries (key, sorted): sort buckets with more unsorted
    entries than the threshold, split those that the adaptive trigger finds full, merge buddies with few."""
    config = config or MaintenanceConfig()
    entries = kv.withColumn("bucket_id", bucket.cast("long")).groupBy("bucket_id").agg(F.count("*").alias("entry_count"), F.count_if(~F.col("sorted")).alias("unsorted"))
    sort = entries.where(F.col("unsorted") > config.sort_threshold).select(F.lit(1).alias("step"), F.lit("sort").alias("action"), "bucket_id", "entry_count")
    split = adaptive_trigger(scores, entries).where("splits").select(F.lit(2).alias("step"), F.lit("split").alias("action"), "bucket_id", "entry_count")
    merge = merge_plan(entries, depth, config.merge_threshold).select(F.lit(3).alias("step"), F.lit("merge").alias("action"), "bucket_id", "entry_count")
    return sort.unionByName(split).unionByName(merge)


def recommendations(scores: DataFrame, history: DataFrame, least: float = 0.5) -> DataFrame:
    """One row: buckets in high danger (the first five by name), whether to run, and whether operations are sequential."""
    high = scores.where(F.col("danger") > least).agg(F.count("*").alias("buckets"), F.slice(F.sort_array(F.collect_list(F.col("bucket_id").cast("string"))), 1, 5).alias("first"))
    return high.crossJoin(F.broadcast(is_sequential(history))).select("buckets", F.concat_ws(",", "first").alias("first"), (F.col("buckets") > 0).alias("should_run"), "sequential")
