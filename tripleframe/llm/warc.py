"""Web archives: writing, reading back, and the merged index of all captures.

Records are written by Spark's text sink, whose line separator is the blank lines that end a record, so that
archives appear through Spark's commit protocol on any file system; payloads that were seen before become
revisit records. Digests come first, as a table without payloads; what is joined to the pages is only the first page
of each repeated payload, so payloads are not shuffled while that list is short. Digests are taken again when records
are written: reading a payload twice costs less than moving it.

Reading parses each archive by its content lengths, record by record, and writes sorted runs of at most RUN captures
to a table. The index is an external merge of these runs: boundaries of (URL key, timestamp, record id) that part
all captures into ranges of about RANGE, drawn from a sample, cut each run into segments, which stay in order as they
are shipped; a range merges its segments with a loser tree, a cursor each. So a task holds one range, whatever the
number of captures and however common a URL, and the output, in partition order, is the capture history of all URLs.

Defined results: a null html is an empty payload; a null url has the empty key; a null page_id counts as larger than
all others, and among rows without any other id each is a response; rows that repeat a page_id are records of their
own, and both responses if theirs is the smallest page_id of the payload; very long payloads share an archive with
fewer others; an empty table gives no archive and an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import islice
from typing import BinaryIO
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, only, scratch, whole_groups, written

#: Records of one archive at most, and bytes of payload that it has on average at most.
RECORDS, ARCHIVE = 2000, 64 << 20
#: Repeated payloads that may be broadcast; more are joined by a shuffle.
FEW = 100_000
#: Captures of a run, captures of a range of the merge, and sampled keys for each range.
RUN, RANGE, SAMPLE = 20_000, 50_000, 20
EPOCH = "2020-01-01T00:00:00Z"
END = "\r\n\r\n"
INDEX = "url_key string, ts string, record_id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, place long"

KEY = ["url_key", "ts", "record_id"]
SCHEMA = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (x.split() for x in INDEX.split(", "))])
RUN_SCHEMA = pa.schema([("run", pa.string()), *SCHEMA])


def url_key(url: str | None) -> str:
    """Host labels from the right, then path and query in lower case, without scheme, www., port and fragment."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return (url or "").lower()
    if not host:
        return (url or "").lower()
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")


def with_digests(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes and the payload's bare base32 SHA-1."""

    def run(batches):
        for batch in batches:
            html = batch.column(2)
            raw = [b"" if x is None else x for x in html.cast(pa.binary()).to_pylist()]
            digest = [base64.b32encode(hashlib.sha1(x).digest()).decode() for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, raw), pa.int64()), pa.array(digest, pa.string()), html], ["page_id", "url", "payload_bytes", "payload_digest", "html"])

    return only(pages, page_id="long", url="string", html="string").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, html string")


def first_pages(digests: DataFrame, least: int = 0) -> DataFrame:
    """payload_digest and the smallest page_id of payloads of at least `least` bytes that occur twice."""
    seen = digests.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    return seen.where((F.col("n") > 1) & (F.col("payload_bytes") >= least) & F.col("first").isNotNull()).select("payload_digest", "first")


def records(pages: DataFrame, first: DataFrame) -> DataFrame:
    """One record per page, as text without its closing blank lines."""
    rows = with_digests(pages).join(first, "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    record_id = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    ts = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH), "yyyy-MM-dd'T'HH:mm:ssX") + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id),
        F.concat(F.lit("WARC-Date: "), ts),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(again, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    )
    return rows.select(F.concat(head, F.lit(END), F.when(again, F.lit("")).otherwise(F.coalesce("html", F.lit("")))).alias("value"))


def write(pages: DataFrame, path: str, least: int = 0, per_archive: int = RECORDS) -> None:
    spark = pages.sparkSession
    digests, digests_path = written(with_digests(pages).drop("html", "url"), "digests")
    first, first_path = written(first_pages(digests, least), "first-pages")
    mean = digests.agg(F.avg("payload_bytes")).first()[0] or 0
    per_archive = max(1, min(per_archive, int(ARCHIVE / max(mean, 1))))
    made = records(pages, F.broadcast(first) if first.count() <= FEW else first)
    made.write.option("lineSep", END).option("maxRecordsPerFile", per_archive).option("compression", "gzip").text(path)
    dropped(spark, digests_path, first_path)


def parse(data: BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, header and content of each record; content lengths alone say where one ends, and one is held at a time."""
    at = 0
    while line := data.readline():
        start, head = at, {}
        at += len(line)
        while (line := data.readline()) not in (b"\r\n", b""):
            at += len(line)
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name] = value
        size = int(head["Content-Length"])
        yield start, head, data.read(size)
        data.read(4)
        at += 2 + size + 4


def page_of(record_id: str | None) -> int | None:
    found = (record_id or "")[10:-1]
    return int(found) if found else None


def runs(spark, path: str, most: int = RUN) -> DataFrame:
    """The captures of the archives, in sorted runs. Digests of responses are taken from the payload read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("path", "content")

    def run(batches):
        out: list[tuple] = []

        def sorted_run():
            out.sort(key=lambda x: x[:3])
            name = f"{out[0][9]}#{out[0][10]}"  # a record stands in one run only
            yield from batches_of(((name, *x) for x in out), RUN_SCHEMA)
            out.clear()

        for batch in batches:
            for i, name in enumerate(batch.column(0).to_pylist()):
                for place, head, payload in parse(gzip.GzipFile(fileobj=io.BytesIO(batch.column(1)[i].as_py()))):
                    kind, digest, size = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["WARC-Payload-Length"])
                    if kind == "response":
                        digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                    url = head.get("WARC-Target-URI")
                    out.append((url_key(url), head["WARC-Date"], head["WARC-Record-ID"], page_of(head["WARC-Record-ID"]), url, kind, size, digest, page_of(head.get("WARC-Refers-To")), name, place))
                    if len(out) >= most:
                        yield from sorted_run()
        if out:
            yield from sorted_run()

    return files.mapInArrow(run, "run string, " + INDEX)


class LoserTree:
    """Merges sorted sequences of keys: each inner node holds the loser of its match, the winner moves on. Iterating
    gives (sequence, place in it)."""

    def __init__(self, runs: Sequence[Sequence]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.tree = [-1] * max(self.k, 1)
        for leaf in range(self.k):
            self._play(leaf)

    def _key(self, leaf: int):
        i = self.at[leaf]
        return None if i >= len(self.runs[leaf]) else self.runs[leaf][i]

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._key(a), self._key(b)
        return y is None or (x is not None and (x, a) <= (y, b))

    def _play(self, leaf: int) -> None:
        node = (leaf + self.k) // 2
        while node:
            other = self.tree[node]
            if other < 0:  # the first to come here waits for its rival
                self.tree[node] = leaf
                return
            if self._beats(other, leaf):
                self.tree[node], leaf = leaf, other
            node //= 2
        self.tree[0] = leaf

    def __iter__(self) -> Iterator[tuple[int, int]]:
        while self.k and self._key(leaf := self.tree[0]) is not None:
            yield leaf, self.at[leaf]
            self.at[leaf] += 1
            self._play(leaf)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def keys_of(batch: pa.RecordBatch | pa.Table) -> list[tuple]:
    return list(zip(*(batch[c].to_pylist() for c in KEY), strict=True))


def boundaries(index: DataFrame, size: int = RANGE) -> list[tuple]:
    """Keys that part the captures into ranges of about `size`, from SAMPLE sampled keys for each range."""
    n = index.count()
    ranges = -(-n // size)
    if ranges < 2:
        return []
    share = min(1.0, SAMPLE * ranges / n)
    drawn = sorted(tuple(r) for r in index.where(F.abs(F.xxhash64("record_id", F.lit(5))) < int(share * ((1 << 63) - 1))).select(*KEY).collect())  # about SAMPLE * ranges rows
    return [drawn[i * len(drawn) // ranges] for i in range(1, ranges)] if drawn else []


def segments(index: DataFrame, cuts: list[tuple]) -> DataFrame:
    """range, run, place and the rows of each run in a range, in order."""

    def run(batches):
        for batch in batches:
            keys, names = keys_of(batch), batch["run"].to_pylist()
            rows = batch.select([f.name for f in SCHEMA])
            of = [bisect_right(cuts, k) for k in keys]
            starts = [i for i in range(len(keys)) if not i or names[i] != names[i - 1] or of[i] != of[i - 1] or keys[i] < keys[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, SCHEMA) as out:
                    out.write_batch(pa.RecordBatch.from_arrays(rows.slice(a, b - a).columns, schema=SCHEMA))
                yield pa.RecordBatch.from_arrays([pa.array([of[a]], pa.int64()), pa.array([names[a]]), pa.array([str(keys[a])]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["range", "run", "first", "rows"])

    return index.mapInArrow(run, "range long, run string, first string, rows binary")


def merged_index(index: DataFrame, size: int = RANGE) -> DataFrame:
    """All captures by (url_key, ts, record_id): the segments of each range, merged."""
    cuts = boundaries(index, size)
    dealt = segments(index, cuts).repartitionByRange(len(cuts) + 1, "range").sortWithinPartitions("range", "run", "first")

    def run(batches):
        for group in whole_groups(batches, 1):
            of = np.concatenate(([0], np.cumsum(np.diff(group["range"].to_numpy()) != 0)))
            for r in range(of[-1] + 1):
                parts = [pa.ipc.open_stream(x.as_buffer()).read_all() for x, own in zip(group["rows"], of, strict=True) if own == r]
                begin = np.cumsum([0, *(p.num_rows for p in parts)])
                order = np.fromiter((begin[leaf] + at for leaf, at in LoserTree([keys_of(p) for p in parts])), np.int64, begin[-1])
                yield from pa.concat_tables(parts).take(order).combine_chunks().to_batches()

    return dealt.mapInArrow(run, INDEX)


def archive_and_index(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes all pages to archives in the shared folder, reads them back and gives the merged index."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(pages, path, least)
    index, _ = written(runs(spark, path), "captures")
    return merged_index(index)
