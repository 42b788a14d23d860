"""Token ids in training order: fixed-stride binary shards under a keyed permutation.

Texts are encoded once, packed into sequences of ``length`` ids within each input partition (an
end-of-text id closes each text; the last sequence of a partition is filled up with it), and written to
the shared folder. With ``buckets`` they are dealt by hash of id and text first and sorted, so that the same table and
key give the same order however the input is split; without, the order follows the input's splits, and a shuffle
of the texts is saved. One total a partition gives every sequence its global number; a keyed Feistel network
over the next power of four, walked until it lands inside, permutes the numbers into slots. Partition s of
the output holds the slots of shard s in order and becomes one file: every sequence takes
``length + 1`` ids of two (or four) bytes, the last one being the end mark ``\\r\\n``, so slot i of a shard starts
at byte i * stride and a reader resumes anywhere by arithmetic.

Null and empty texts make no ids and no sequence. An empty table writes no shard. Repeated rows are
encoded again; ``doc_id`` may be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, read_ranks, text_ranges
from .common import forget, release, scratch_path, slices, stored
from .textarrays import mix, texts

END = "\r\n"
ROUNDS = 6
#: Bytes of text encoded at once, so that their new pieces are replayed together, and ids that are packed at once.
STEP, PACKED = 4 << 20, 1 << 18
#: Sequences compressed together in the written table.
BLOCK = 512
#: Level of compression, and bytes of ids that the compression of single sequences may refer to.
LEVEL = 6
SHARED_BYTES = 110 << 10


def _domain(total: int) -> int:
    """Half the bits of the smallest even-width domain that holds ``total`` numbers."""
    bits = 1
    while 1 << (2 * bits) < total:
        bits += 1
    return bits


def _round(half: np.ndarray, key: int, i: int, bits: int) -> np.ndarray:
    return mix(half + mix(np.array([(key * ROUNDS + i) & (2**64 - 1)], dtype=np.uint64))) & np.uint64((1 << bits) - 1)


def _network(x: np.ndarray, key: int, bits: int, back: bool) -> np.ndarray:
    low = np.uint64((1 << bits) - 1)
    left, right = x >> np.uint64(bits), x & low
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if back:
            left, right = right ^ _round(left, key, i, bits), left
        else:
            left, right = right, left ^ _round(right, key, i, bits)
    return left << np.uint64(bits) | right


def permute(numbers: np.ndarray, total: int, key: int, back: bool = False) -> np.ndarray:
    """The slots of numbers below ``total``, a bijection of 0..total-1; ``back`` inverts it."""
    bits = _domain(total)
    x = np.asarray(numbers).astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        x[todo] = _network(x[todo], key, bits, back)
        todo = todo[x[todo] >= total]
    return x.astype(np.int64)


def sequences(docs: DataFrame, rank_path: str, length: int, end_id: int, buckets: int | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, place, counts, doc_ids, tokens): blocks of sequences packed within each input partition.

    ``place`` numbers a block's first sequence; the ids of a block are compressed together, as repeated words
    then cost little in the written table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    width = "<u2" if end_id < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, place, coder = encoder(shared.value), TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=LEVEL)
        held, held_ids = np.zeros(0, np.uint32), np.zeros(0, np.int64)  # ids not yet in a sequence, and their rows' doc_id

        def emit(block: np.ndarray, owners: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal place
            change = np.ones_like(owners, dtype=bool)
            change[:, 1:] = owners[:, 1:] != owners[:, :-1]
            change &= np.arange(length)[None, :] < counts[:, None]
            for i in range(0, len(block), BLOCK):
                here = change[i : i + BLOCK]
                flat, n = owners[i : i + BLOCK][here], len(here)
                names = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(here.sum(axis=1))], pa.int32()), pa.array(flat, pa.int64(), mask=flat == np.iinfo(np.int64).min))
                whole = pa.array([0, n], pa.int32())
                tokens = pa.array([coder.compress(block[i : i + BLOCK].astype(width).tobytes())], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([place], pa.int64()), pa.ListArray.from_arrays(whole, pa.array(counts[i : i + BLOCK].astype(np.int32))), pa.ListArray.from_arrays(whole, names), tokens],
                    names=["part", "place", "counts", "doc_ids", "tokens"],
                )
                place += n

        for batch in batches:
            for piece in slices(batch, text, STEP):
                ids, bounds = own.encode(*texts(piece.column(text)))
                names = piece.column(id).cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                for a, b in text_ranges(bounds, PACKED):
                    sizes = np.diff(bounds[a : b + 1])
                    some = sizes > 0
                    # an end mark behind each text that has ids
                    grown = np.insert(ids[bounds[a] : bounds[b]], bounds[a + 1 : b + 1][some] - bounds[a], end_id)
                    held = np.concatenate([held, grown])
                    held_ids = np.concatenate([held_ids, np.repeat(names[a:b][some], sizes[some] + 1)])
                    full = len(held) // length
                    del grown
                    if full:
                        yield from emit(held[: full * length].reshape(full, length), held_ids[: full * length].reshape(full, length), np.full(full, length))
                        held, held_ids = held[full * length :].copy(), held_ids[full * length :].copy()
                del ids, names
            del batch, piece
            release()
        own.forget()
        release()
        if len(held):
            fill = length - len(held)
            yield from emit(np.r_[held, np.full(fill, end_id, np.uint32)][None, :], np.r_[held_ids, np.full(fill, held_ids[-1])][None, :], np.array([len(held)]))

    narrow = docs.select(id, text)
    if buckets:
        digest = F.xxhash64(id, text)
        narrow = narrow.repartition(buckets, digest).sortWithinPartitions(digest, id, text)
    return narrow.mapInArrow(run, "part int, place long, counts array<int>, doc_ids array<array<long>>, tokens binary")


def write_shards(docs: DataFrame, path: str, rank_path: str, length: int = 512, end_id: int = 50256, key: int = 1, shard_bytes: int = 16 << 20, buckets: int | None = None) -> DataFrame:
    """Write shards under ``path`` and return the index: (sequence, slot, shard, row, n_tokens, doc_ids)."""
    spark = docs.sparkSession
    made = stored(sequences(docs, rank_path, length, end_id, buckets), "sequences")
    index = stored(made.drop("tokens"), "index")
    totals = index.groupBy("part").agg(F.sum(F.size("counts")).alias("n")).orderBy("part").collect()  # a row for each input partition
    start, total = {}, 0
    for row in totals:
        start[row["part"]] = total
        total += row["n"]
    width = 2 if end_id < 1 << 16 else 4
    per_shard = max(1, shard_bytes // ((length + 1) * width))
    shards = max(1, -(-total // per_shard))

    def numbers(part: int, place: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of a block's sequences, and their slots."""
        sequence = start[part] + place + np.arange(n, dtype=np.int64)
        return sequence, permute(sequence, total, key)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                counts, names = (batch.column(c)[i].values for c in ("counts", "doc_ids"))
                sequence, slot = numbers(batch.column("part")[i].as_py(), batch.column("place")[i].as_py(), len(counts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sequence), pa.array(slot), pa.array((slot // per_shard).astype(np.int32)), pa.array(slot % per_shard), counts, names], names=["sequence", "slot", "shard", "row", "n_tokens", "doc_ids"]
                )
        release()

    # one block of ids, whichever comes first, only makes the shuffle smaller: reading gives the same ids with any
    some = made.select("tokens").limit(1).collect()
    common = zstandard.ZstdDecompressor().decompress(some[0]["tokens"])[:SHARED_BYTES] if some else b""

    def dictionary() -> zstandard.ZstdCompressionDict:
        return zstandard.ZstdCompressionDict(common, dict_type=zstandard.DICT_TYPE_RAWCONTENT)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small, large = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary()), zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                block = np.frombuffer(large.decompress(batch.column("tokens")[i].as_py()), np.uint8).reshape(-1, length * width)
                slot = numbers(batch.column("part")[i].as_py(), batch.column("place")[i].as_py(), len(block))[1]
                tokens = pa.array([small.compress(row.tobytes()) for row in block], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array((slot // per_shard).astype(np.int32)), pa.array(slot), tokens], names=["shard", "slot", "tokens"])
        release()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, mark = zstandard.ZstdDecompressor(dict_data=dictionary()), b"\0" * (width - 2)
        for batch in batches:
            values = [coder.decompress(x) + mark for x in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("slot"), pa.array(values, pa.binary())], names=["shard", "slot", "value"])
        release()

    # a range of slots is a partition: its number is the shard's, so each shard is one file
    dealt = made.select("part", "place", "tokens").mapInArrow(deal, "shard int, slot long, tokens binary").repartitionById(shards, F.col("shard"))
    ordered = dealt.mapInArrow(unpack, "shard int, slot long, value binary").sortWithinPartitions("shard", "slot")
    ordered.select("shard", F.col("value").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", END).text(path)
    forget(made)  # the shards have the ids now
    return index.mapInArrow(listed, "sequence long, slot long, shard int, row long, n_tokens int, doc_ids array<long>")


def read_shards(spark: SparkSession, path: str, length: int = 512, end_id: int = 50256, shard_bytes: int = 16 << 20, first_slot: int = 0) -> DataFrame:
    """(slot, shard, row, tokens) in shard order from ``first_slot`` on; shards before it are not read."""
    width = 2 if end_id < 1 << 16 else 4
    stride = (length + 1) * width
    per_shard = max(1, shard_bytes // stride)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    if "shard" not in files.columns:  # no sequence, no folder of a shard
        files = files.withColumn("shard", F.lit(0)).limit(0)
    files = files.where(F.col("shard") >= first_slot // per_shard).select("shard", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                raw = content.as_buffer()
                n = raw.size // stride
                if raw.size % stride:
                    raise ValueError(f"shard {shard}: {raw.size} bytes are no multiple of the stride {stride}")
                grid = np.frombuffer(raw, dtype=np.uint8).reshape(n, stride)
                if not (grid[:, -2:] == list(END.encode())).all():
                    raise ValueError(f"shard {shard}: a record does not end where the stride says")
                body = grid[:, : length * width]
                for i in range(0, n, 4096):
                    rows = np.arange(i, min(n, i + 4096))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard * per_shard + rows), pa.array(np.full(len(rows), shard, np.int32)), pa.array(rows), pa.array([body[r].tobytes() for r in rows], pa.binary())],
                        names=["slot", "shard", "row", "tokens"],
                    )
                del raw, grid, body
            del batch, content
        release()

    return files.mapInArrow(run, "slot long, shard int, row long, tokens binary").where(F.col("slot") >= first_slot)


def materialise(docs: DataFrame, rank_path: str, path: str | None = None, **options: int) -> tuple[DataFrame, DataFrame]:
    """Write the shards and return (index, what is read back from them)."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "shards")
    index = write_shards(docs, path, rank_path, **options)
    reading = {k: v for k, v in options.items() if k in ("length", "end_id", "shard_bytes")}
    return index, read_shards(spark, path, **reading)
