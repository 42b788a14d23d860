"""WARC archives of captures, and their index merged from sorted runs.

Writing: a record for each capture, compressed by itself, through Spark's text sink, so the committer guards
against lost tasks and any store will do. The last byte of a gzip member of less than 16 MiB is always 0: it is left
to the sink as its line separator, so that a file is nothing but members, and ``offset`` and ``length`` of the index
cut one record out of the stored file. Longer records take several members. Of captures with equal payloads the
one with the smallest id is a response and the others are revisits without payload.
Reading: archives are parsed whole records at a time; every archive's index entries form a run, sorted by
(URL key, timestamp, id). Merging: the runs are dealt by range of that key, and within each
range a loser tree merges the run segments, so the index is globally ordered.

A null payload is empty. A null URL has an empty key. Captures with a null id are written without one; they never
stand for a group that has ids. Several rows with the smallest id are all responses.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, slices, stored

END = "\r\n\r\n"
#: Smaller payloads are never revisits.
LEAST_SHARED = 100
#: Bytes of a record in one gzip member, below 16 MiB.
MEMBER = 8 << 20
#: Index entries of one range; more entries make more ranges.
RANGE_ENTRIES = 200_000
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
RECORD = "page_id long, url string, url_key string, captured string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def url_key(url: Column) -> Column:
    """Host labels in reverse, then path and query, lower case: captures of one site sort together."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, r"#.*$", "")
    host = F.regexp_replace(F.regexp_extract(bare, r"^([^/?]*)", 1), r"^(www\d*|m)\.|:\d+$", "")
    rest = F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def plan_records(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", captured: Column | None = None) -> DataFrame:
    """(page_id, url, captured, body, payload_bytes, payload_digest, refers_to): which captures repeat which.

    One partial aggregation by digest; only digests of two or more captures come back, so a payload with
    many copies is summed up before it moves, and Spark splits its part of the join.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    when = captured if captured is not None else F.lit(EPOCH.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.coalesce(F.col(id), F.lit(0)) % 100_000_000)
    rows = pages.select(
        F.col(id).cast("long").alias("page_id"),
        F.coalesce(F.col(url), F.lit("")).alias("url"),
        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
        body.alias("body"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        F.sha2(body.cast("binary"), 256).alias("payload_digest"),
    )
    shared = (
        rows.where(F.col("payload_bytes") >= LEAST_SHARED).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first_id")
    )
    found = rows.join(shared, "payload_digest", "left")
    repeats = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")))
    return found.withColumn("refers_to", F.when(repeats, F.col("first_id"))).drop("first_id")


def write_archives(planned: DataFrame, path: str, per_file: int = 20_000) -> None:
    """Write the planned captures as WARC 1.1 files under ``path``."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    clean = F.regexp_replace("url", r"[\r\n]+", "")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:capture:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Date", F.coalesce("captured", F.lit("1970-01-01T00:00:00Z"))),
        line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        optional("WARC-Refers-To", F.concat(F.lit("<urn:capture:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(""),
        F.lit("Content-Type: application/octet-stream\r\n"),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
    )
    record = F.concat(head, F.when(revisit, "").otherwise(F.col("body")))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "value"):
                yield pa.RecordBatch.from_arrays([pa.array([members(x.as_py())[:-1] for x in piece.column("value")], pa.binary())], names=["value"])

    packed = planned.select(F.concat(record, F.lit(END)).cast("binary").alias("value")).mapInArrow(compress, "value binary")
    packed.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(path)


def members(record: bytes) -> bytes:
    """A record as gzip members of at most MEMBER bytes each."""
    out = []
    for i in range(0, len(record), MEMBER):
        coder = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(coder.compress(record[i : i + MEMBER]) + coder.flush())
    return b"".join(out)


def read_members(content: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(bytes, offset, length) of each gzip member."""
    view, at = memoryview(content), 0
    while at < len(view):
        coder, parts, to, step = zlib.decompressobj(31), [], at, 1 << 12
        while not coder.eof:
            if to >= len(view):
                raise ValueError("an archive ends within a record")
            parts.append(coder.decompress(view[to : to + step]))
            to, step = min(to + step, len(view)), min(step * 2, 1 << 20)
        end = to - len(coder.unused_data)
        yield b"".join(parts), at, end - at
        at = end


HEADER = re.compile(rb"([A-Za-z-]+): ?([^\r\n]*)\r\n")


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, payload, offset, length) of each record; offset and length are of the compressed bytes."""
    found = read_members(content)
    for first, offset, length in found:
        body = first.index(b"\r\n\r\n") + 4
        headers = {k.decode(): v.decode("utf-8", "replace") for k, v in HEADER.findall(first, 0, body)}
        n = int(headers["Content-Length"])
        parts, have = [first], len(first)
        while have < body + n + 4:
            more, _, longer = next(found)
            parts.append(more)
            have, length = have + len(more), length + longer
        yield headers, b"".join(parts)[body : body + n], offset, length


def capture_id(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:capture:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """A run for each archive: its index entries, sorted. Payloads are checked against their digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                archive = name.rsplit("/", 1)[-1]
                for h, payload, offset, length in parse_archive(content.as_py()):
                    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                    if h["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{archive} at {offset}: the payload does not match its digest")
                    bytes_ = len(payload) if h["WARC-Type"] == "response" else int(h["WARC-Payload-Length"])
                    rows.append((capture_id(h.get("WARC-Record-ID")), h["WARC-Target-URI"], h["WARC-Date"], bytes_, digest, h["WARC-Type"], capture_id(h.get("WARC-Refers-To")), archive, offset, length))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                    names = ["page_id", "url", "captured", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "length"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    entries = files.mapInArrow(run, "page_id long, url string, captured string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long")
    entries = entries.withColumn("url_key", url_key(F.col("url")))
    return entries.sortWithinPartitions("url_key", "captured", "page_id", "archive", "offset")


class LoserTree:
    """k-way merge of sorted iterators: each inner node holds the loser of its match, so the next item costs one path to the root."""

    def __init__(self, runs: list[Iterator]) -> None:
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and x is not None
        return (x, a) < (y, b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:  # while the tree fills, the first to arrive waits
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while True:
            winner = self.losers[0]
            head = self.heads[winner]
            if head is None:
                return
            yield head
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


def merge_runs(runs: DataFrame, partitions: int | None = None) -> DataFrame:
    """The runs' entries in global order of (url_key, captured, page_id), range after range.

    A shuffle fetches blocks in any order, but within a block a run's entries stay sorted: where the order
    breaks, another segment begins. ``segment`` 's number and the place in the merged range follow.
    Memory of a task is one range's entries (a few hundred bytes each); more partitions make ranges smaller.
    """
    spark = runs.sparkSession
    kept = stored(runs, "runs")  # range bounds are sampled from it, without parsing archives twice
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), kept.count() // RANGE_ENTRIES)
    dealt = kept.repartitionByRange(n, "url_key", "captured", "page_id", "archive", "offset")
    names = dealt.columns
    order = [names.index(c) for c in ("url_key", "captured", "page_id", "archive", "offset")]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, segments, previous, row = [], [[]], None, 0
        for batch in batches:
            tables.append(batch)
            keys = zip(*[batch.column(i).to_pylist() for i in order], strict=True)
            for key, captured, page, archive, offset in keys:
                item = (key, captured, page is not None, page or 0, archive, offset, row)
                if previous is not None and item < previous:
                    segments.append([])
                segments[-1].append(item)
                previous = item
                row += 1
        if not row:
            return
        table = pa.Table.from_batches(tables)
        merged = [item[-1] for item in LoserTree([iter(s) for s in segments])]
        yield from table.take(pa.array(merged)).combine_chunks().to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(merge, dealt.schema)


def capture_index(pages: DataFrame, path: str | None = None, **names: str) -> DataFrame:
    """Write archives of ``pages`` under ``path`` (a new scratch folder if none is given), read them back and merge their index."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(plan_records(pages, **names), path)
    return merge_runs(read_runs(spark, path))
