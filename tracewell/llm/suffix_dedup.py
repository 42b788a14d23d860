"""Removal of byte strings that occur more than once, by suffix arrays of what may repeat.

A byte goes if it is covered by a string of ``length`` bytes that also starts elsewhere in the texts
(UTF-8 bytes; null is empty; strings never cross texts; all strings are judged on the input).

1. Every window of ``length`` bytes picks an anchor: the half-length block in it with the smallest hash. Equal windows
   pick equal anchors, so only windows whose anchor block occurs twice can repeat. A run of windows with one
   anchor is one row of fixed size.
2. Runs with equal bytes repeat as a whole; counting them needs a partial aggregation, however many copies there are.
   One run of each kind is looked at further if other kinds share its anchor.
3. Runs that share an anchor meet in one bucket; the bucket's text gets a suffix array and its Burrows-Wheeler
   transform. Intervals of suffixes grow by one character to the left, breadth first: level l fixes the common
   prefixes of length l, each once, and expansion stops at ``length``. Neighbours whose prefix was not fixed
   by then share ``length`` bytes or more: those windows repeat.
   Anchors with very many kinds of runs (``HOT``) do not meet: their windows' hashes are counted instead.

Rows that repeat id and text are different documents whose strings repeat. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEY, append_columns, forget, release, row_keys, slices, stored, unused
from .textarrays import Rolling, texts

#: Kinds of runs of one anchor beyond which window hashes are counted.
HOT = 2_000
SPAN = "row_key long, row_check long, first int, last int"
#: Bytes of text whose windows are hashed at once: anchors take some 60 bytes of memory for each.
RUN_BYTES = 1 << 20
#: Bytes of one suffix array.
BUCKET_BYTES = 2 << 20


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every window of ``width`` values, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchor_runs(data: np.ndarray, bounds: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: text, first window, last window (from the text's start), anchor and run hashes."""
    block = length // 2
    blocks = length - block + 1  # block positions in a window
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < length:
        return {"text": empty, "first": empty, "last": empty, "anchor": empty, "run": empty}
    rolling = Rolling(data)
    at = np.arange(n - block + 1)
    hashes = rolling.spans(at, at + block)
    bits = np.uint64(max(1, int(n).bit_length()))
    # the position in the low bits: the leftmost of equal blocks wins
    key = hashes >> bits
    key <<= bits
    key |= at.view(np.uint64)
    del at
    chosen = sliding_min(key, blocks)
    del key
    chosen &= (np.uint64(1) << bits) - np.uint64(1)
    chosen = chosen.view(np.int64)
    start = np.arange(len(chosen))
    text = np.searchsorted(bounds, start, side="right") - 1
    inside = start + length <= bounds[text + 1]
    fresh = np.ones(len(chosen), dtype=bool)
    fresh[1:] = (chosen[1:] != chosen[:-1]) | ~inside[:-1] | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh & inside)
    closing = np.ones(len(chosen), dtype=bool)
    closing[:-1] = fresh[1:] | ~inside[1:]
    last = np.flatnonzero(closing & inside)
    return {
        "text": text[first],
        "first": first - bounds[text[first]],
        "last": last - bounds[text[first]],
        "anchor": hashes[chosen[first]].view(np.int64),
        "run": rolling.spans(first, last + length).view(np.int64),
    }


def runs(docs: DataFrame, length: int, text: str = "text") -> DataFrame:
    """(row_key, row_check, first, last, anchor, run) of every run of the whole texts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text, RUN_BYTES):
                found = anchor_runs(*texts(piece.column(text)), length)
                owner = pa.array(found["text"])
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(c).take(owner) for c in KEY], *[pa.array(found[c].astype(np.int32)) for c in ("first", "last")], *[pa.array(found[c]) for c in ("anchor", "run")]], names=[*KEY, "first", "last", "anchor", "run"]
                )
        release()

    return docs.select(*KEY, text).mapInArrow(find, f"{SPAN}, anchor long, run long")


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols at least (symbols below 512), by prefix doubling of what is still tied."""
    n = len(symbols)
    padded = np.zeros(n + 8, dtype=np.int64)
    padded[:n] = symbols
    key = np.zeros(n, dtype=np.int64)
    for j in range(7):
        key = key << 9 | padded[j : n + j]
    del padded
    order = np.argsort(key, kind="stable").astype(np.int32)
    have = 7
    edge = np.ones(n + 1, dtype=bool)
    key = key[order]
    edge[1:n] = key[1:] != key[:-1]
    del key
    group = np.flatnonzero(edge[:n])
    rank = np.empty(n + 1, dtype=np.int32)
    rank[order] = np.repeat((group + 1).astype(np.int32), np.diff(np.r_[group, n]))
    rank[n] = 0
    while have < depth:
        tied = np.flatnonzero(~(edge[:n] & edge[1:])).astype(np.int32)  # places in groups of two or more
        if not len(tied):
            break
        suffix = order[tied]
        behind = rank[np.minimum(suffix + have, n)]
        base = rank[suffix]
        by = np.argsort(base.astype(np.int64) << 32 | behind, kind="stable")
        order[tied] = suffix = suffix[by]
        base, behind = base[by], behind[by]
        del by
        new = np.ones(len(tied), dtype=bool)
        new[1:] = (base[1:] != base[:-1]) | (behind[1:] != behind[:-1])
        edge[tied] = new
        heads = np.flatnonzero(new)
        rank[suffix] = np.repeat(tied[heads], np.diff(np.r_[heads, len(tied)])) + 1
        have *= 2
    return order


def repeated_starts(symbols: np.ndarray, length: int) -> np.ndarray:
    """For each position whether the ``length`` symbols from it also start elsewhere.

    Breadth-first expansion of intervals over the Burrows-Wheeler transform: the interval of a string of l symbols is
    extended to the left by every symbol before its suffixes; where the new interval's end has no common
    prefix yet, that prefix is l long, and the interval is expanded at the next level. Each boundary is fixed once.
    """
    symbols = np.r_[symbols.astype(np.int16) + 1, 0].astype(np.int16)  # a last symbol of its own, so that the transform closes
    n = len(symbols)
    order = suffix_array(symbols, length)
    place = np.empty(n, dtype=np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    before = symbols[order - 1]  # the transform; the first suffix takes the last symbol
    step = place[order - 1]  # where the suffix one symbol longer stands
    del symbols, order
    fixed = np.zeros(n + 1, dtype=bool)
    fixed[0] = fixed[n] = True
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(length):
        size = high - low
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        if not total:
            break
        at = np.arange(total, dtype=np.int32)
        at += np.repeat((low - ends + size).astype(np.int32), size)
        key = np.repeat(np.arange(len(low)) << 9, size)
        key |= before[at]
        by = np.argsort(key, kind="stable")
        key, to = key[by], step[at[by]]
        del by
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        begin = np.minimum.reduceat(to, heads).astype(np.int64)
        end = begin + np.diff(np.r_[heads, total])
        new = ~fixed[end]
        fixed[end[new]] = True
        low, high = begin[new], end[new]
    open_ = ~fixed
    return (open_[:n] | open_[1:])[place[:-1]]


def bucket_spans(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows in runs that come sorted by anchor."""

    def solve(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        parts = []
        for *_, body in rows:
            parts += [np.frombuffer(body, dtype=np.uint8).astype(np.int16) + 1, np.zeros(1, np.int16)]
        hit = repeated_starts(np.concatenate(parts), length)
        found, at = [], 0
        for *key, first, body in rows:
            own = hit[at : at + len(body) - length + 1]
            change = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
            for a, b in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
                found.append((*key, first + a, first + b - 1))
            at += len(body) + 1
        columns = list(zip(*found, strict=True)) if found else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=[*KEY, "first", "last"])

    held: list[tuple[int, int, int, bytes]] = []
    size, previous = 0, None
    for batch in batches:
        for anchor, *row in zip(*[batch.column(c).to_pylist() for c in ("anchor", *KEY, "first", "body")], strict=True):
            if anchor != previous and size > BUCKET_BYTES:
                yield solve(held)
                held, size = [], 0
            previous = anchor
            held.append(tuple(row))
            size += len(row[-1])
    if held:
        yield solve(held)
    release()


def repeats(docs: DataFrame, length: int, hot: int = HOT) -> DataFrame:
    """(row_key, row_check, first, last): windows first to last of a text occur elsewhere too; ``docs`` has the keys and text.

    What is joined back is written first, so that both sides of a join are shuffled for it alone and adaptive
    execution may split the rows of a frequent anchor or run.
    """
    every = stored(runs(docs, length), "runs")
    seen = stored(every.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "anchors")
    some = stored(every.join(seen, "anchor"), "repeated-runs")
    forget(every, seen)
    # equal runs have equal anchors: two hashes tell kinds apart
    place = [*KEY, "first", "last"]
    kinds = stored(some.groupBy("anchor", "run").agg(F.count("*").alias("copies"), F.min(F.struct(*place)).alias("r")), "kinds")
    whole = some.join(kinds.where("copies > 1").select("anchor", "run"), ["anchor", "run"], "left_semi").select(*place)
    mixed = stored(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "mixed")
    open_ = kinds.join(mixed, "anchor").select("anchor", "kinds", "r.*")
    # the bytes of those runs
    wanted = open_.groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "kinds", "first", "last")).alias("runs"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                data, bounds = texts(piece.column("text"))
                rows = []
                raw = data.tobytes()
                for i, (key, check, found) in enumerate(zip(*[piece.column(c).to_pylist() for c in (*KEY, "runs")], strict=True)):
                    rows += [(x["anchor"], x["kinds"], key, check, x["first"], raw[bounds[i] + x["first"] : bounds[i] + x["last"] + length]) for x in found]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds_of = (*[pa.int64()] * 4, pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds_of, strict=True)], names=["anchor", "kinds", *KEY, "first", "body"])

    # rows that repeat id and text share their keys: one of them is enough here
    bodies = docs.join(wanted, KEY).select(*KEY, "text", "runs").mapInArrow(fetch, "anchor long, kinds long, row_key long, row_check long, first int, body binary").dropDuplicates([*KEY, "first"])
    bodies = stored(bodies, "bodies")
    usual = bodies.where(F.col("kinds") <= hot).select("anchor", *KEY, "first", "body").repartition("anchor").sortWithinPartitions("anchor", *KEY, "first")
    found = usual.mapInArrow(lambda b: bucket_spans(b, length), SPAN)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "body"):
                data, bounds = texts(piece.column("body"))
                counts = np.maximum(np.diff(bounds) - length + 1, 0)
                offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                at = np.repeat(bounds[:-1], counts) + offset
                hashes = Rolling(data).spans(at, at + length).view(np.int64)
                owner = np.repeat(np.arange(len(counts)), counts)
                at = pa.array((piece.column("first").to_numpy(zero_copy_only=False)[owner] + offset).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*[piece.column(c).take(pa.array(owner)) for c in (*KEY, "anchor")], at, pa.array(hashes)], names=[*KEY, "anchor", "first", "window"])

    many = bodies.where(F.col("kinds") > hot).select("anchor", *KEY, "first", "body").mapInArrow(windows, "row_key long, row_check long, anchor long, first int, window long")
    many = stored(many, "windows")
    twice = stored(many.groupBy("anchor", "window").agg(F.count("*").alias("c")).where("c > 1").select("anchor", "window"), "repeated-windows")
    counted = many.join(twice, ["anchor", "window"], "left_semi").select(*KEY, "first", F.col("first").alias("last"))
    return whole.union(found).union(counted)


SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))


def merged(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Byte ranges covered by windows first..last, in order and disjoint."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["first"], x["last"] + length) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = 400, id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """Add ``kept_bytes`` (what is left, binary), ``n_removed`` and ``removed`` (disjoint byte ranges) to every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(*row_keys(id, text), body.alias("text"))
    mine, theirs, held, whole_text = ([unused(docs, f"tracewell_{name}_{i}") for i in range(n)] for name, n in (("row", 2), ("key", 2), ("spans", 1), ("text", 1)))
    (held,), (whole_text,) = held, whole_text
    spans = repeats(narrow, length, hot).groupBy(*KEY).agg(F.collect_set(F.struct("first", "last")).alias(held))
    spans = spans.withColumnsRenamed(dict(zip(KEY, theirs, strict=True)))
    rows = docs.withColumns(dict(zip(mine, row_keys(id, text), strict=True)))
    rows = rows.join(spans, [F.col(a) == F.col(b) for a, b in zip(mine, theirs, strict=True)], "left").drop(*mine, *theirs).withColumn(whole_text, body)
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    fields = [
        T.StructField("kept_bytes", T.BinaryType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]

    def make() -> Callable[[pa.RecordBatch], list]:
        def step(piece: pa.RecordBatch) -> list:
            data, bounds = texts(piece.column(whole_text))
            raw = data.tobytes()
            kept, counts, removed = [], [], []
            for i, found in enumerate(piece.column(held).to_pylist()):
                own = raw[bounds[i] : bounds[i + 1]]
                gone = merged(found, length)
                edges = [0, *[x for pair in gone for x in pair], len(own)]
                kept.append(b"".join(own[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if gone else own)
                counts.append(sum(b - a for a, b in gone))
                removed.append([{"start": a, "end": b} for a, b in gone])
            return [pa.array(kept, pa.binary()), pa.array(counts, pa.int64()), pa.array(removed, ranges)]

        return step

    return append_columns(rows, make, fields, whole_text).drop(whole_text, held)


def text_of(column: str) -> Column:
    """Bytes as text, without what a cut has left of a character (continuation bytes in front, an unfinished one at the end of a part)."""
    # bytes that form no character become U+FFFD; texts hold none of their own unless they did before
    return F.regexp_replace(F.make_valid_utf8(F.col(column).cast("string")), "\ufffd", "")
