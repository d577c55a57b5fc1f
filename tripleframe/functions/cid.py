"""Column functions over 256-bit content identifiers (32-byte big-endian binaries).

Bytes and hex only: 64-bit words exceed BIGINT and 256-bit numbers exceed DECIMAL. Binaries compare like the
numbers they hold and push down to Parquet.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 32


@dataclass(frozen=True, order=True)
class Cid:
    """An identifier on the driver."""

    raw: bytes

    def __post_init__(self):
        if len(self.raw) != WIDTH:
            raise ValueError("an identifier has 32 bytes")

    @classmethod
    def of(cls, text: str) -> Cid:
        return cls(hashlib.sha256(text.encode()).digest())

    @classmethod
    def of_int(cls, value: int) -> Cid:
        if not 0 <= value < 1 << 256:
            raise ValueError("value out of range for 256 bits")
        return cls(value.to_bytes(WIDTH, "big"))

    @classmethod
    def of_words(cls, *words: int) -> Cid:
        """Four 64-bit words, or the two low ones of the older width."""
        if len(words) not in (2, 4) or any(not 0 <= w < 1 << 64 for w in words):
            raise ValueError("two or four 64-bit words are needed")
        return cls(b"".join(w.to_bytes(8, "big") for w in words).rjust(WIDTH, b"\0"))

    @classmethod
    def of_hex(cls, text: str) -> Cid:
        return cls(bytes.fromhex(text))

    @classmethod
    def predicate(cls, name: str) -> Cid:
        return cls(hashlib.sha256(name.encode()).digest()[:16].rjust(WIDTH, b"\0"))

    @property
    def hex(self) -> str:
        return self.raw.hex()

    @property
    def words(self) -> tuple[int, ...]:
        return tuple(int.from_bytes(self.raw[i : i + 8], "big") for i in range(0, WIDTH, 8))

    @property
    def lit(self) -> Column:
        return F.lit(bytearray(self.raw))


def cid(text: Column) -> Column:
    """Identifier of a text: SHA-256 of its UTF-8."""
    return F.unhex(F.sha2(text, 256))


def predicate_cid(name: Column) -> Column:
    """Identifier of a predicate term: the first 128 bits of its hash, with zeros before them."""
    return F.unhex(F.lpad(F.substring(F.sha2(name, 256), 1, 32), 64, "0"))


def hexed(c: Column) -> Column:
    return F.lower(F.hex(c))


def word(c: Column, i: int) -> Column:
    """The i-th 64-bit word (0 is the highest) as a decimal string."""
    return F.conv(F.substring(F.hex(c), 1 + 16 * i, 16), 16, 10)


def words(c: Column) -> list[Column]:
    return [word(c, i) for i in range(4)]


def word_number(c: Column, i: int) -> Column:
    return word(c, i).cast("decimal(20,0)")


def from_words(*parts: Column) -> Column:
    """Identifier of two or four words given as decimal strings."""
    return F.unhex(F.lpad(F.concat(*(F.lpad(F.conv(p, 10, 16), 16, "0") for p in parts)), 64, "0"))


def of_entry(columns: list[str], prefix: str = "") -> Column:
    """Identifier of an entry's words, whose columns may have the prefix key_ or value_: four of them, or the high and
    the low one of the older width."""
    four, two = ([f"{prefix}{x}" for x in names] for names in (("high", "high_mid", "low_mid", "low"), ("high", "low")))
    return from_words(*(F.col(c).cast("string") for c in (four if set(four) <= set(columns) else two)))


def entry_words(c: Column, prefix: str = "") -> list[Column]:
    """The inverse of of_entry: four columns of decimal words."""
    return [word(c, i).alias(f"{prefix}{name}") for i, name in enumerate(("high", "high_mid", "low_mid", "low"))]


def checked(c: Column) -> Column:
    """The identifier itself; an error if it has not 32 bytes."""
    return F.when(F.length(c) == WIDTH, c).otherwise(F.raise_error(F.lit("an identifier has 32 bytes")).cast("binary"))


def composite_key(s: Column, p: Column, o: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws(":", *words(s), *words(p), *words(o)), 256))


def composite_text(p: Column, o: Column) -> Column:
    return F.concat_ws(":", *words(p), *words(o))


def composite_value(p: Column, o: Column) -> Column:
    return F.unhex(F.sha2(composite_text(p, o), 256))


def decode_composite(values: DataFrame, dictionary: DataFrame, column: str = "value") -> DataFrame:
    """Adds p and o of composite values that the dictionary knows; valid says whether the text has eight words."""
    parts = F.split("text", ":")
    ok = F.coalesce(F.size(parts) == 8, F.lit(False))
    found = values.join(dictionary.withColumnRenamed("cid", column), column, "left")
    return found.select("*", F.when(ok, from_words(*(parts[i] for i in range(4)))).alias("p"), F.when(ok, from_words(*(parts[i] for i in range(4, 8)))).alias("o"), ok.alias("valid")).drop("text")


def parse_wire(text: Column) -> Column:
    """`E(a,b,c,d)`, `E(high,low)` or 64 hex digits; anything else is null."""
    four = r"^E\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)$"
    two = r"^E\(\s*(\d+)\s*,\s*(\d+)\s*\)$"
    return (
        F.when(text.rlike(four), from_words(*(F.regexp_extract(text, four, i) for i in range(1, 5))))
        .when(text.rlike(two), from_words(*(F.regexp_extract(text, two, i) for i in range(1, 3))))
        .when(text.rlike("^[0-9a-fA-F]{64}$"), F.unhex(text))
    )


def canonical_object(o_cid: Column, o_text: Column) -> Column:
    """Object of an unregistered predicate: an identifier stays, anything else is hashed as text."""
    return F.coalesce(o_cid, cid(o_text))


def first_composite(dictionary: DataFrame) -> DataFrame:
    """A dictionary with one text for each identifier, the first that was written (by `ord` if there is one)."""
    order = F.col("ord") if "ord" in dictionary.columns else F.col("text")
    return dictionary.groupBy("cid").agg(F.min_by("text", order).alias("text"))


def bucket(c: Column, depth: int) -> Column:
    """Index in a directory of 2**depth pointers, from the identifier's top bits."""
    if depth == 0:
        return F.lit(0).cast("long")
    top = F.conv(F.substring(F.hex(c), 1, 16), 16, -10).cast("long")
    return F.shiftrightunsigned(top, 64 - depth)


def bucket_name(bucket_id: Column) -> Column:
    return F.format_string("bucket_%04d", bucket_id)


def bucket_of_name(name: Column) -> Column:
    return F.regexp_extract(name, r"^bucket_(\d+)$", 1).try_cast("int")


# Constants of the 64-bit composite key.
PERTURB = (13287301680950405831, 17097557497788204703, 17772150785748878159)
KNUTH = 0x9E3779B97F4A7C15
EVEN, ODD = 0xAAAAAAAAAAAAAAAA, 0x5555555555555555


def rotated_key_words(ah: np.ndarray, al: np.ndarray, bh: np.ndarray, bl: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """High and low word of the order-sensitive 128-bit key of two identifiers; turn is 0, 1 or 2 for SPO, OSP, POS."""

    def stir(x: np.ndarray) -> np.ndarray:
        for factor in PERTURB[:2]:
            x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
        return x ^ (x >> np.uint64(33)) ^ np.uint64(PERTURB[2])

    def turned(x: np.ndarray) -> np.ndarray:
        return x if turn == 0 else (x << np.uint64(turn)) | (x >> np.uint64(64 - turn))

    high, low = (stir(a) + stir(b) * np.uint64(KNUTH) for a, b in ((ah, bh), (al, bl)))
    return stir(turned(high) ^ (low & np.uint64(EVEN))), stir(turned(low) ^ (high & np.uint64(ODD)))


def rotated_key(turn: int):
    """Pandas UDF of two identifiers: the rotated key as an identifier."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(bytes(v) for v in c), ">u8").reshape(-1, 4).astype(np.uint64) for c in (a, b))
        high, low = rotated_key_words(x[:, 0], x[:, 3], y[:, 0], y[:, 3], turn)
        out = np.zeros((len(a), 4), ">u8")
        out[:, 2], out[:, 3] = high, low
        raw = out.tobytes()
        return pd.Series([raw[i : i + WIDTH] for i in range(0, len(raw), WIDTH)])

    return F.pandas_udf(run, "binary")


def to_base(value: int, alphabet: str) -> str:
    """A number in the positional system of an alphabet's sorted characters."""
    digits = sorted(set(alphabet))
    out = []
    while value:
        value, d = divmod(value, len(digits))
        out.append(digits[d])
    return "".join(reversed(out)) or digits[0]


def from_base(text: str, alphabet: str) -> int:
    """The inverse of to_base; white space is skipped."""
    place = {c: i for i, c in enumerate(sorted(set(alphabet)))}
    value = 0
    for c in "".join(text.split()):
        value = value * len(place) + place[c]
    return value


def encode_text(alphabet: str):
    return F.pandas_udf(lambda c: c.map(lambda v: None if v is None else to_base(int.from_bytes(bytes(v), "big"), alphabet)), "string")


def decode_text(alphabet: str):
    return F.pandas_udf(lambda c: c.map(lambda v: None if v is None else from_base(v, alphabet).to_bytes(WIDTH, "big")), "binary")


def is_hex(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))
