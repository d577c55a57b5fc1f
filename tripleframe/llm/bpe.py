"""Byte-pair encoding as a bounded-lookahead streaming transducer, and incremental decoding.

A merge list has a *sufficient lookahead*: what stands further right than so many symbols never changes a
token. `Merges.lookahead` is an upper bound of it, found by one pass over the merges in rank order: a merge
can come out differently in two texts that agree on their left part only if the boundary lies in it, or if
one of its operands came out differently at a lower rank. The transducer buffers symbols, merges the buffer
once it holds more than the lookahead, emits the tokens that end before the lookahead, and keeps the rest.
Tokens without their left neighbours merge as before, so the left context can be dropped.

Texts come in slices. The end of a word makes all its tokens stable, so a word that a slice holds whole is merged
at once, many in step, and kept in a table of bounded size; a word that goes on behind its slice runs through
the transducer, which emits while it reads. Ids leave slice by slice, are hashed, and are decoded incrementally.

Defined results: null or empty text has no tokens; texts of any length, with or without white space, use memory
for a slice, a buffer and the table; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import only

#: Words whose tokens a Python worker keeps; beyond this the table starts anew.
WORD_TABLE = 600_000
#: Bytes of the longest word that the table keeps.
SHORT = 15
#: Words beyond SHORT whose tokens are kept.
LONG_TABLE = 20_000
#: Bytes of short texts that are encoded together.
BYTES = 1 << 20
#: Symbols merged at a time beyond the lookahead.
BLOCK = 1024
#: Characters of a slice; shorter texts are one.
SLICE = 1 << 16
NEVER = 1 << 62

# The characters that the tokenizer files' \s stands for.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"


# What the split pattern of the word-end tokenizer file tells apart in lower-case text below U+0250.
LATIN_LETTERS = "a-zªµºß-öø-ɏ"
LATIN_DIGITS = "0-9²³¹¼½¾"
LATIN_SPACE = "\\t-\\r \\x85\\xa0"
# Endings behind an apostrophe that are words of their own.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
# Letters and digits that are younger than the split pattern's character tables.
YOUNG = (
    r"\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    r"\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    r"\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    r"\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
# Lower case of letters that Python's tables do not know yet, as first letter, last letter, distance.
LOWER = [(0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B)]
LOWERED = {c: c + d for a, b, d in LOWER for c in range(a, b + 1)} | {ord("Σ"): "σ"}
BEYOND_LATIN = re.compile("[^\x00-ɏ]").search
#: Letters without case that neither compose nor decompose.
SYLLABLES = re.compile("[ぁ-ゔァ-ヴ㐀-䶿一-鿿]{2}").fullmatch


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(keep) else chr(next(rest)) for b in range(256)]


class Merges:
    """A merge list over symbol ids: pair -> (rank, product), and its lookahead in symbols."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], lengths: dict[int, int]):
        self.longest = max(lengths.values(), default=1)
        reach: dict[int, int] = {}  # of each token: how far left of a boundary its fate can still differ
        most = 0
        for (a, b), (_, c) in sorted(pairs.items(), key=lambda x: x[1][0]):
            left = max(lengths[c] - 1, reach.get(b, 0) + lengths[a], reach.get(a, 0))
            reach[a] = max(reach.get(a, 0), left)
            reach[b] = max(reach.get(b, 0), left - lengths[a])
            reach[c] = max(reach.get(c, 0), left)
            most = max(most, left)
        self.lookahead = most
        self.packed = {p: rank << 32 | c for p, (rank, c) in pairs.items()}

    def merge(self, symbols: list[int]) -> list[int]:
        """Merges a whole list by rank, then from the left."""
        get = self.packed.get
        symbols = list(symbols)
        ranks = [get(p, NEVER) for p in zip(symbols, symbols[1:], strict=False)]
        while ranks and (best := min(ranks)) != NEVER:
            at = ranks.index(best)
            symbols[at : at + 2] = [best & 0xFFFFFFFF]
            del ranks[at]
            if at:
                ranks[at - 1] = get((symbols[at - 1], symbols[at]), NEVER)
            if at < len(ranks):
                ranks[at] = get((symbols[at], symbols[at + 1]), NEVER)
        return symbols


class Transducer:
    """push() takes symbols and gives the tokens that have become stable; finish() gives the rest."""

    def __init__(self, merges: Merges, lengths: dict[int, int], block: int = BLOCK):
        self.merges, self.lengths, self.block = merges, lengths, block
        self.buffer: list[int] = []

    def push(self, symbols: Iterable[int]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            self.buffer.append(s)
            if len(self.buffer) >= self.merges.lookahead + self.merges.longest + self.block:
                out += self._emit()
        return out

    def _emit(self) -> list[int]:
        out, used, stable = [], 0, len(self.buffer) - self.merges.lookahead
        for t in self.merges.merge(self.buffer):
            if used + self.lengths[t] > stable:
                break
            out.append(t)
            used += self.lengths[t]
        self.buffer = self.buffer[used:]
        return out

    def finish(self) -> list[int]:
        out, self.buffer = self.merges.merge(self.buffer), []
        return out


class Grid:
    """Merges many short words at once, a word per row; a word that fits in the lookahead is wholly unstable until it ends."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], inner: list[int], last: list[int]):
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        order = keys.argsort()
        self.keys = keys[order]
        self.values = np.array([rank << 32 | c for rank, c in pairs.values()], np.int64)[order]
        self.inner, self.last = np.array(inner, np.int64), np.array(last, np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.values[at], NEVER)

    def merge(self, raw: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids padded with -1, and how many each row has; raw holds a word's bytes in each row."""
        width, counts = raw.shape[1], counts.astype(np.int64)
        words = raw
        columns = np.arange(width + 1)
        ids = np.full((len(words), width + 1), -1, np.int64)
        ids[:, :width] = np.where(columns[:-1] < counts[:, None], self.inner[raw], -1)
        rows = np.arange(len(words))
        ids[rows, counts - 1] = self.last[raw[rows, counts - 1]]
        ranks = np.full(ids.shape, NEVER, np.int64)
        ranks[:, :-1] = self.ranks(ids[:, :-1], ids[:, 1:])
        live = rows
        while len(live):
            now = ranks[live]
            at = now.argmin(1)
            best = now[np.arange(len(live)), at]
            keep = best != NEVER
            live, at, best = live[keep], at[keep], best[keep]
            if not len(live):
                break
            moved = np.minimum(columns + (columns > at[:, None]), width)
            now = np.take_along_axis(ids[live], moved, 1)
            row = np.arange(len(live))
            now[row, at] = best & 0xFFFFFFFF
            now[:, width] = -1
            rank = np.take_along_axis(ranks[live], moved, 1)
            rank[row, at] = self.ranks(now[row, at], now[row, np.minimum(at + 1, width)])
            before = np.maximum(at - 1, 0)
            rank[row, before] = np.where(at > 0, self.ranks(now[row, before], now[row, at]), rank[row, before])
            ids[live], ranks[live] = now, rank
            counts[live] -= 1
        return ids[:, :width], counts


class WordTable:
    """Words of at most SHORT bytes and their ids, by open addressing: a word's bytes and length are its two keys."""

    def __init__(self, grid: Grid, most: int = WORD_TABLE):
        self.grid, self.most = grid, most
        self.mask = (1 << (2 * most - 1).bit_length() - 1) - 1
        self.key1, self.key2 = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.uint64)
        self.row = np.full(self.mask + 1, -1, np.int32)
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.key2[:] = 0
        self.row[:] = -1
        self.begin, self.count, self.pool, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words data[start:end], and how many each word has."""
        if not len(starts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        size = ends - starts
        first = words_of(np.concatenate([data, np.zeros(16, np.uint8)]))
        key1 = first[starts] & KEEP[np.minimum(size, 8)]
        key2 = first[starts + 8] & KEEP[np.maximum(size - 8, 0)] | size.astype(np.uint64)
        slot = self.slots(key1, key2)
        row = self.find(key1, key2, slot)
        new = np.flatnonzero(row < 0)
        if len(new):
            if not self.learn(data, starts[new], size[new], key1[new], key2[new], slot[new]):
                self.clear()
                self.learn(data, starts, size, key1, key2, slot)
            row = self.find(key1, key2, slot)
        n = self.count[row]
        stop = n.cumsum()
        at = np.repeat(self.begin[row] - stop + n, n)
        at += np.arange(len(at))
        return self.pool[at], n

    def slots(self, key1: np.ndarray, key2: np.ndarray) -> np.ndarray:
        h = key1 * np.uint64(0x9E3779B97F4A7C15) + key2 * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(40)).astype(np.int64) & self.mask

    def find(self, key1: np.ndarray, key2: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Rows, or -1."""
        there = self.key2[slot]
        row = np.where((there == key2) & (self.key1[slot] == key1), self.row[slot], -1)
        open_ = np.flatnonzero((row < 0) & (there != 0))
        at = slot[open_]
        while len(open_):
            at = (at + 1) & self.mask
            there = self.key2[at]
            hit = (there == key2[open_]) & (self.key1[at] == key1[open_])
            row[open_[hit]] = self.row[at[hit]]
            more = ~hit & (there != 0)
            open_, at = open_[more], at[more]
        return row

    def learn(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, key1: np.ndarray, key2: np.ndarray, slot: np.ndarray) -> bool:
        """Merges the words and keeps them, if there is room."""
        order = np.lexsort((key2, key1))
        order = order[np.r_[True, (key1[order[1:]] != key1[order[:-1]]) | (key2[order[1:]] != key2[order[:-1]])]]
        if self.n and self.n + len(order) > self.most:
            return False
        for lo in range(0, len(order), 20_000):
            self._add(data, *(x[order[lo : lo + 20_000]] for x in (starts, size, key1, key2, slot)))
        return True

    def _add(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, key1: np.ndarray, key2: np.ndarray, slot: np.ndarray) -> None:
        for width in range(4, SHORT + 4, 4):
            own = np.flatnonzero((size <= width) & (size > width - 4))
            if not len(own):
                continue
            columns = np.arange(width)
            raw = np.where(columns < size[own][:, None], data[np.minimum(starts[own][:, None] + columns, len(data) - 1)], 0)
            ids, n = self.grid.merge(raw, size[own])
            flat = ids[columns < n[:, None]].astype(np.uint32)
            rows = np.arange(self.n, self.n + len(own))
            self.begin, self.count, self.pool = grown(self.begin, rows[-1] + 1), grown(self.count, rows[-1] + 1), grown(self.pool, self.used + len(flat))
            self.begin[rows], self.count[rows], self.pool[self.used : self.used + len(flat)] = self.used + n.cumsum() - n, n, flat
            self.used += len(flat)
            self.n += len(own)
            at = slot[own]
            while len(own):  # the last of those that want a free slot gets it
                free = self.row[at] < 0
                self.row[at[free]] = rows[free]
                got = self.row[at] == rows
                self.key1[at[got]], self.key2[at[got]] = key1[own[got]], key2[own[got]]
                own, rows, at = own[~got], rows[~got], (at[~got] + 1) & self.mask


#: Masks that keep so many leading bytes.
KEEP = np.array([(1 << 64) - (1 << 64 - 8 * n) for n in range(9)], np.uint64)


def grown(x: np.ndarray, size: int) -> np.ndarray:
    """x, with room for so many entries."""
    return x if size <= len(x) else np.concatenate([x, np.zeros(max(size, 3 * len(x) // 2) - len(x), x.dtype)])


def words_of(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each position as a big-endian number."""
    w = np.zeros(len(data) + 8, np.uint64)
    w[: len(data)] = data
    for step in (1, 2, 4):
        w[:-step] = (w[:-step] << np.uint64(8 * step)) | w[step:]
    return w[: len(data)]


SPACE, LETTER, DIGIT, OTHER = range(4)


@lru_cache(maxsize=1)
def latin_kinds() -> np.ndarray:
    """The kind of each code point below U+0250."""
    out = np.full(0x250, OTHER, np.uint8)
    for kind, inside in ((SPACE, LATIN_SPACE), (LETTER, LATIN_LETTERS), (DIGIT, LATIN_DIGITS)):
        out[[c for c in range(0x250) if re.fullmatch(f"[{inside}]", chr(c))]] = kind
    return out


def latin_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words of lower-case text below U+0250 start and end: endings behind an apostrophe, runs of letters,
    single digits, and runs of other characters."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kinds = np.zeros(256, np.uint8)
    kinds[:128] = latin_kinds()[:128]
    kind = kinds[data]
    inner = data & 0xC0 == 0x80
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        kind[lead] = kind[lead + 1] = latin_kinds()[(data[lead] & 0x1F).astype(np.int64) << 6 | data[lead + 1] & 0x3F]
    start = kind != SPACE
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) & ~inner[1:]
    stop = np.empty(n, bool)
    stop[:-1] = (kind[:-1] != SPACE) & ((kind[1:] == SPACE) | start[1:])
    stop[-1] = kind[-1] != SPACE
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    at = np.flatnonzero((data[starts] == ord("'")) & (ends - starts == 1))
    at = at[at + 1 < len(starts)]
    at = at[(starts[at + 1] == ends[at]) & (kind[starts[at + 1]] == LETTER)]
    if len(at):
        takes = np.zeros(len(at), np.int64)
        for x in ENDINGS:
            here = starts[at + 1]
            fits = here + len(x) <= ends[at + 1]
            for i, c in enumerate(x):
                fits &= data[np.minimum(here + i, n - 1)] == ord(c)
            takes[fits] = len(x)
        at, takes = at[takes > 0], takes[takes > 0]
        ends[at] += takes
        starts[at + 1] += takes
        keep = starts < ends
        starts, ends = starts[keep], ends[keep]
    return starts, ends


def slices(text: str) -> Iterator[tuple[str, bool]]:
    """A text in parts of about SLICE characters, and whether the last word goes on behind the part. Parts end behind
    white space if there is some, else between characters that no composition and no ending joins."""
    at = 0
    while len(text) - at > SLICE:
        end = max(text.rfind(" ", at + SLICE // 2, at + SLICE), text.rfind("\n", at + SLICE // 2, at + SLICE)) + 1
        goes_on = False
        if not end:
            end = at + SLICE
            while end < len(text) and (joint := joins(text, end)) is None:
                end += 1
            goes_on = end < len(text) and joint
        yield text[at:end], goes_on
        at = end
    yield text[at:], False


def joins(text: str, at: int) -> bool | None:
    """Whether a word goes on across a place in a text; None if the text must not be cut there."""
    a, b = text[at - 1], text[at]
    if "'" in text[max(at - 4, 0) : at + 4]:
        return None
    if a.isascii() and b.isascii():
        if a.isalpha() or b.isalpha():
            return a.isalpha() and b.isalpha()
        return not (a.isdigit() or b.isdigit() or a in WHITE_SPACE or b in WHITE_SPACE)
    return True if SYLLABLES(a + b) else None


class Codec:
    """Encoder and decoder of a tokenizer file of the kind BPE with a byte-level alphabet and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.texts: list[str] = [""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.texts[i] = t
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for t, i in self.special.items():
            self.texts += [""] * (i + 1 - len(self.texts))
            self.texts[i] = t
        self.byte_level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        letters = byte_alphabet()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.suffix] for c in letters]
        self.back = {c: b for b, c in enumerate(letters)}
        end = len(self.suffix)
        self.lengths = {i: len(t) - end if end and t.endswith(self.suffix) else len(t) for t, i in vocab.items()}
        pairs = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.merges = Merges(pairs, self.lengths)
        split = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        for name in ("\\p{L}", "\\p{N}"):
            inside = f"[{name}--[{YOUNG}]]"
            split = split.replace(f"[{name}]", inside).replace(f"{name}+", f"{inside}+") if f"[{name}]" in split else split
        split = split.replace("[^\\s\\p{L}\\p{N}]", f"[^{re.escape(WHITE_SPACE)}[\\p{{L}}\\p{{N}}--[{YOUNG}]]]")
        self.find = regex.compile(split, regex.V1).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        self.grid = Grid(pairs, self.inner, self.last)
        self.table = WordTable(self.grid)
        self.long: dict[bytes, np.ndarray] = {}

    def word(self, raw: bytes) -> np.ndarray:
        """Tokens of a long word, by the transducer."""
        found = self.long.get(raw)
        if found is None:
            symbols = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
            machine = Transducer(self.merges, self.lengths)
            found = np.array(machine.push(symbols) + machine.finish(), np.uint32)
            if len(raw) <= self.merges.lookahead:
                if len(self.long) >= LONG_TABLE:
                    self.long.clear()
                self.long[raw] = found
        return found

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words data[start:end], and how many each word has."""
        short = ends - starts <= SHORT
        if short.all():
            return self.table.ids(data, starts, ends)
        late = np.flatnonzero(~short)
        raw = data.tobytes()
        found = [self.word(raw[a:b]) for a, b in zip(starts[late].tolist(), ends[late].tolist(), strict=True)]
        ids, n = self.table.ids(data, starts[short], ends[short])
        counts = np.zeros(len(starts), np.int64)
        counts[short] = n
        counts[late] = [len(x) for x in found]
        of_short = np.repeat(short, counts)
        out = np.empty(len(of_short), np.uint32)
        out[of_short] = ids
        out[~of_short] = np.concatenate(found)
        return out, counts

    def normal(self, part: str) -> tuple[str, bool]:
        """Lower case in composed form, and whether all of it is Latin."""
        if not part.isascii() and not unicodedata.is_normalized("NFC", part):
            part = unicodedata.normalize("NFC", part)
        if BEYOND_LATIN(part):
            return part.translate(LOWERED).lower(), False
        part = part.lower()  # some capitals of the Latin block have a small letter beyond it
        return part, not BEYOND_LATIN(part)

    def split(self, part: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A slice as bytes, and where its words start and end in them."""
        part, latin = self.normal(part)
        if latin:
            data = np.frombuffer(part.encode(), np.uint8)
            return data, *latin_words(data)
        found = [w.encode("utf-8", "surrogatepass") for w in self.find(part)]
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        return np.frombuffer(b"".join(found), np.uint8), np.r_[0, ends[:-1]] if len(ends) else ends, ends

    def stream(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a text, slice by slice."""
        for piece in self.cut(text) if self.special and "<|" in text else [text]:
            if piece in self.special:
                yield np.array([self.special[piece]], np.uint32)
                continue
            machine, held = None, -1  # of a word that goes on: its transducer, and its last byte so far
            for part, goes_on in slices(piece):
                data, starts, ends = self.split(part)
                if not len(starts):
                    continue
                if machine is not None:
                    raw = data[: ends[0]].tolist()
                    if goes_on and len(starts) == 1:
                        yield np.array(machine.push([self.inner[held], *(self.inner[b] for b in raw[:-1])]), np.uint32)
                        held = raw[-1]
                        continue
                    yield np.array(machine.push([self.inner[held], *(self.inner[b] for b in raw[:-1]), self.last[raw[-1]]]) + machine.finish(), np.uint32)
                    machine, starts, ends = None, starts[1:], ends[1:]
                if goes_on:
                    yield self.words(data, starts[:-1], ends[:-1])[0]
                    raw = data[starts[-1] :].tolist()
                    machine, held = Transducer(self.merges, self.lengths), raw[-1]
                    yield np.array(machine.push(self.inner[b] for b in raw[:-1]), np.uint32)
                else:
                    yield self.words(data, starts, ends)[0]

    def streams(self, texts: list[str | None]) -> Iterator[Iterable[np.ndarray]]:
        """For each text its ids in parts, in order; each is to be read before the next. Short texts are encoded together."""
        made: list[np.ndarray | None] = [None] * len(texts)
        held: list[str] = []
        of: list[int] = []
        for i, text in enumerate(texts):
            if text and len(text) <= SLICE and not (self.special and "<|" in text):
                part, latin = self.normal(text)
                if latin:
                    held.append(part)
                    of.append(i)
        if held:
            raw = [x.encode() for x in held]
            data = np.frombuffer(b"\n".join(raw), np.uint8)
            starts, ends = latin_words(data)
            ids, n = self.words(data, starts, ends)
            begin = np.cumsum([0, *(len(x) + 1 for x in raw)])
            at = np.concatenate([[0], n.cumsum()])[np.searchsorted(starts, begin)].tolist()
            for i, a, b in zip(of, at, at[1:], strict=False):
                made[i] = ids[a:b]
        for text, ids in zip(texts, made, strict=True):
            yield [ids] if ids is not None else self.stream(text) if text else []

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for part in next(iter(self.streams([text]))) for i in part]

    def decoder(self) -> Decoder:
        return Decoder(self)

    def decode(self, ids: Iterable[int]) -> str:
        machine = Decoder(self)
        return machine.push(ids) + machine.finish()


class Decoder:
    """Ids to text, a block at a time. Its state is whether a token came before and, for files with a
    byte-level decoder, the bytes of a character that is not complete yet; broken ones become U+FFFD."""

    def __init__(self, codec: Codec):
        self.codec, self.begun = codec, False
        self.bytes = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        texts = list(map(self.codec.texts.__getitem__, ids))
        if not texts:
            return ""
        if self.codec.byte_level:
            back = self.codec.back
            return self.bytes.decode(bytes(back[c] for t in texts for c in t))
        text = " ".join(texts)
        out = " " + text if self.begun else text
        self.begun = True
        return out

    def finish(self) -> str:
        return self.bytes.decode(b"", True) if self.codec.byte_level else ""


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec for each worker process and file."""
    return Codec(path)


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, n_tokens, ids (binary, little-endian unsigned 32-bit) and the decoded text."""

    def run(batches):
        c = codec(tokenizer)
        for batch in batches:
            keys = batch.column(0)
            for lo, hi in blocks(batch.column(1), BYTES):
                ids, texts = [], []
                for parts in c.streams(batch.column(1).slice(lo, hi - lo).to_pylist()):
                    found = np.concatenate([np.empty(0, np.uint32), *parts])
                    ids.append(found.astype("<u4").tobytes())
                    texts.append(c.decode(found.tolist()))
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["id", "n_tokens", "ids", "decoded"])

    rows = only(docs, **{id_col: "long", text_col: "string"})
    return rows.mapInArrow(run, "id long, n_tokens long, ids binary, decoded string").withColumnRenamed("id", id_col)


def blocks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column with about so many bytes each, so that a batch of very long texts is done in parts."""
    n = len(column)
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).cumsum()
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + most, "right"))
        hi = max(hi, lo + 1)
        yield lo, hi
        lo = hi


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", step: int = 1 << 14) -> DataFrame:
    """As encode_decode, with digests in place of ids and text; both stream through their hash part by part."""

    def run(batches):
        c = codec(tokenizer)
        for batch in batches:
            for lo, hi in blocks(batch.column(1), BYTES):
                n, ids_hex, text_hex = array("q"), [], []
                for parts in c.streams(batch.column(1).slice(lo, hi - lo).to_pylist()):
                    size, of_ids, of_text, machine = 0, hashlib.sha256(), hashlib.sha256(), c.decoder()
                    for part in parts:
                        size += len(part)
                        of_ids.update(part.astype("<u4", copy=False).data)
                        for at in range(0, len(part), step):
                            of_text.update(machine.push(part[at : at + step].tolist()).encode())
                    of_text.update(machine.finish().encode())
                    n.append(size)
                    ids_hex.append(of_ids.hexdigest())
                    text_hex.append(of_text.hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = only(docs, **{id_col: "long", text_col: "string"})
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
