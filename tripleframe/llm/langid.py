"""Language identification by rank-order profiles.

A profile is the `PROFILE` most frequent n-grams (one to three letters, word boundaries included) of a
language, ranked; a document's own most frequent n-grams are compared with each profile by the sum of the
differences in rank ("out of place"), an n-gram that a profile lacks counting `PROFILE`. N-grams are hashes of
their code points, whatever the script. The nearest language wins; ties go to the smaller name. Profiles are
learned from at most `SAMPLE` training rows of each language, those with the smallest hash of their id.

accepted() also learns from that sample how far a text may be from its language: for texts with about as many
different n-grams, as far as a sampled text typically is from languages that are not its own, and at least `MARGIN`
farther than any sampled text is from its own.

Defined results: `und`, score 0 and distance 1 for texts that are null, empty or without letters, and for
all texts if nothing could be learned; a null id is never held out and never trained on; rows without lang
are predicted but not trained on; rows that repeat count once in a profile and get the same result; an empty
table gives an empty result; texts of any length are read whole; other columns are not read, and accepted()
hands them on.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import blocks
from .common import dropped, mapped, only, written

#: Ids of the sample that may be broadcast; with more languages than that they are joined by a shuffle.
FEW = 200_000
#: Training documents of each language; a bound on the sample, not on what is predicted.
SAMPLE = 2000
SALTS = 16
#: N-grams of a profile.
PROFILE = 400
FOLDS = 5
#: Hashes of n-grams; two n-grams that share one count as the same.
SPACE = 1 << 18
#: accepted() keeps documents whose distance is above the largest of their kind in the sample by less than this.
MARGIN = 0.1
#: Distance that counts where the sample has fewer than so many texts of a size.
REJECT, ENOUGH = 0.9, 20


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def hashed(n: int, *parts: np.ndarray) -> np.ndarray:
    """A number below SPACE for each n-gram."""
    h = np.full(len(parts[0]), n, np.uint32)
    for part in parts:
        h = (h + part) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0x85EBCA77) >> np.uint32(14)).astype(np.int32)


def grams(text: str) -> np.ndarray:
    """The hashes of all n-grams of a text; none if it has no letter. 0 stands for a word's boundary."""
    p = points(text)
    c = np.where(letters()[p], p, np.uint32(0))
    if not c.any():
        return np.empty(0, np.int32)
    c = np.concatenate([[0], c, [0]]).astype(np.uint32)
    c = c[(c != 0) | (np.concatenate([[1], c[:-1]]) != 0)]
    middle = c[1:-1] != 0
    return np.concatenate([hashed(1, c[c != 0]), hashed(2, c[:-1], c[1:]), hashed(3, c[:-2][middle], c[1:-1][middle], c[2:][middle])])


def most_frequent(found: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent codes, by count and then by code."""
    code, n = np.unique(found, return_counts=True)
    key = ((1 << 40) - n.astype(np.int64)) << 20 | code
    if len(key) > k:
        key = np.partition(key, k - 1)[:k]
    key.sort()
    return key & ((1 << 20) - 1)


def held_out(c: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(c.cast("string")) % folds == 0, F.lit(False))


def sampled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """lang and text of at most `sample` rows a language of the training folds, as a table."""
    text = F.xxhash64("text").alias("of_text")
    train = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # the smallest hashes of each salt, then of these: no task ranks more rows of a language than SALTS times the sample
    ranked = train.select("lang", "doc_id", text, F.xxhash64("doc_id").alias("h")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "of_text"), F.lit(SALTS)))
    for by in (["lang", "salt"], ["lang"]):
        ranked = ranked.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy("h", "doc_id", "of_text"))).where(F.col("r") <= sample)
    key = ["lang", "doc_id", "of_text"]
    chosen, path = written(ranked.select(*key).distinct(), "language-sample-ids")
    chosen = F.broadcast(chosen) if chosen.count() <= FEW else chosen
    out, _ = written(train.withColumn("of_text", text).join(chosen, key, "left_semi").dropDuplicates(key).select("lang", "text"), "language-sample")
    dropped(docs.sparkSession, path)
    return out


def profiles(held: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's ranked n-grams, of a bounded sample."""

    def count(batches):
        of: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                of[lang] = of.get(lang, 0) + np.bincount(grams(text), minlength=SPACE)
        for lang, n in of.items():
            code = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code, pa.int64()), pa.array(n[code], pa.int64())], ["lang", "code", "n"])

    total = held.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    ranked = total.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("r") <= size)
    out: dict[str, list[int]] = {}
    for row in ranked.orderBy("lang", "r").collect():  # `size` rows a language
        out.setdefault(row["lang"], []).append(row["code"])
    return {k: np.array(v) for k, v in out.items()}


def limits(held: DataFrame, learned: dict[str, np.ndarray], margin: float = MARGIN) -> list[float]:
    """By the bit length of a text's number of different n-grams: the largest distance that accepted() keeps."""

    def run(batches):
        score = scorer(learned)
        for batch in batches:
            out = [(kind, far[lang], others(lang, far)) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for _, _, _, kind, far in [score(text)] if lang in far]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.float64(), pa.float64()), strict=True)], ["kind", "own", "other"])

    def others(lang: str, far: dict[str, float]) -> float:
        rest = [d for name, d in far.items() if name != lang]
        return sum(rest) / len(rest) if rest else REJECT

    found = held.mapInArrow(run, "kind long, own double, other double").groupBy("kind").agg(F.count("*").alias("n"), F.max("own").alias("most"), F.median("other").alias("typical")).collect()  # a few rows
    out = [REJECT] * (PROFILE.bit_length() + 1)
    for r in found:
        if r["n"] >= ENOUGH:
            out[r["kind"]] = min(REJECT, max(r["most"] + margin, r["typical"]))
    return out


def scorer(learned: dict[str, np.ndarray], size: int = PROFILE):
    """A function that gives (lang_pred, score, distance, bit length of the different n-grams, all distances) of a text."""
    names = sorted(learned)
    table = np.full((len(names), SPACE), size, np.int16)
    for i, name in enumerate(names):
        table[i, learned[name]] = np.arange(len(learned[name]))
    far = np.arange(size)

    def score(text: str | None) -> tuple[str, float, float, int, dict[str, float]]:
        found = grams(text) if text and names else ()
        if not len(found):
            return "und", 0.0, 1.0, 0, {}
        top = most_frequent(found, size)
        rank = table[:, top]
        out = np.where(rank == size, size, np.abs(rank - far[: len(top)])).sum(1) / (size * len(top))
        near = np.sort(out)[:2]
        sure = float(1 - near[0] / near[1]) if len(near) > 1 and near[1] else float(1 - near[0])
        return names[int(out.argmin())], sure, float(near[0]), len(top).bit_length(), dict(zip(names, out.tolist(), strict=True))

    return score


def predict(docs: DataFrame, learned: dict[str, np.ndarray], size: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred, score (1 - nearest / second distance) and distance (0 to 1, to the nearest)."""

    def run(batches):
        score = scorer(learned, size)
        for batch in batches:
            out = [score(t)[:3] for lo, hi in blocks(batch.column(1)) for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.float64(), pa.float64()), strict=True))], ["doc_id", "lang_pred", "score", "distance"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, distance double")


def accepted(docs: DataFrame, sample: int = SAMPLE, margin: float = MARGIN) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a letter and is as near to some learned language as
    that language's own texts are."""
    held = sampled(only(docs, doc_id="long", text="string", lang="string"), sample)
    learned = profiles(held)
    most, place = limits(held, learned, margin), docs.columns.index("text")

    def run(batches):
        score = scorer(learned)
        for batch in batches:
            for lo, hi in blocks(batch.column(place)):
                part = batch.slice(lo, hi - lo)
                kept = [lang != "und" and distance <= most[kind] for lang, _, distance, kind, _ in map(score, part.column(place).to_pylist())]
                yield part.filter(pa.array(kept, pa.bool_()))

    return mapped(docs, run, docs)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    docs = only(docs, doc_id="long", text="string", lang="string")
    found = predict(docs, profiles(sampled(docs, sample)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "distance")
