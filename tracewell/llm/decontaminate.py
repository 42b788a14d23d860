"""Benchmark decontamination by SimHash of item-sized windows.

Texts and items are words of letters and digits in lower case; their shingles are five words (a shorter item is
one shingle of all its words). Every window of an item's length whose shingles meet the benchmark at all gets
a 64-bit SimHash, weighted by shingle counts. Eight blocks of eight bits are looked up with up to two bits off in each,
which by the pigeonhole principle finds every item within 23 bits; those within ``radius`` are verified by
the exact weighted Jaccard similarity of shingle counts (sum of minima over sum of maxima).
Windows that share no shingle with any item have similarity 0, so leaving them out loses nothing.
A text with fewer words than an item is its one window, with the same fingerprint, radius and exact check.

A benchmark larger than one block of items is taken block by block, each a job of its own over all texts: what it finds is
written, by text, and its broadcast goes before the next begins, so a task holds one block however many there are. Null and empty texts and items match nothing; repeated items match each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, stored, unused
from .textarrays import PLAIN_BYTES, shingles, span_hashes, texts, words

WORDS = 5
RADIUS = 23
BLOCK_BITS, BLOCKS, BITS_OFF = 8, 8, 2
#: Items of one pass, and bytes of their texts.
PASS_ITEMS, PASS_BYTES = 20_000, 32 << 20


def simhash(signs: np.ndarray, width: int) -> np.ndarray:
    """SimHash of every window of ``width`` shingles; ``signs`` has a row of -1 and 1 for each shingle."""
    sums = np.zeros((len(signs) + 1, 64), dtype=np.int32)
    np.cumsum(signs, axis=0, out=sums[1:])
    votes = sums[width:] - sums[:-width] >= 0
    return np.packbits(votes, axis=1, bitorder="little").view("<u8").ravel()


def signs(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    keys, which = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(which[: len(a)], minlength=len(keys)), np.bincount(which[len(a) :], minlength=len(keys))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class Benchmark:
    """Items of one pass: shingles, fingerprints and block tables."""

    def __init__(self, ids: list[int], items: list[str], k: int) -> None:
        self.k, self.ids, self.items = k, [], []
        data, bounds = texts(pa.array([x or "" for x in items], pa.string()))
        starts, ends, first = words(data, bounds, PLAIN_BYTES)
        hashes = span_hashes(data, starts, ends)
        for i, name in enumerate(ids):
            s = shingles(hashes[first[i] : first[i + 1]], k)
            if len(s):
                self.ids.append(name)
                self.items.append((int(first[i + 1] - first[i]), s))
        self.short = sorted({n for n, _ in self.items if n < k})
        self.known = np.unique(np.concatenate([s for _, s in self.items])) if self.items else np.zeros(0, np.uint64)
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(self.known >> np.uint64(44)).astype(np.int64)] = True
        self.prints = np.array([simhash(signs(s), len(s))[0] for _, s in self.items], dtype=np.uint64)
        # for each number of words: the items, and which of them each value of each block may mean
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :]) <= BITS_OFF
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({n for n, _ in self.items}):
            rows = np.array([i for i, (m, _) in enumerate(self.items) if m == n])
            blocks = self.prints[rows].astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
            lists = [np.flatnonzero(near[v][blocks[:, b]]) for b in range(BLOCKS) for v in range(256)]
            self.by_length[n] = rows, np.concatenate(lists), np.r_[0, np.cumsum([len(x) for x in lists])]

    def met(self, hashes: np.ndarray) -> np.ndarray:
        """Which shingles occur in any item."""
        hit = self.filter[(hashes >> np.uint64(44)).astype(np.int64)]
        at = np.flatnonzero(hit)
        i = np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)
        hit[at] = self.known[i] == hashes[at]
        return hit

    def search(self, word_hashes: np.ndarray, radius: int, least: float) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window for each item found in one text."""
        best: dict[int, tuple[float, int, int]] = {}
        families = [(self.k, [n for n in self.by_length if n >= self.k])] + [(n, [n]) for n in self.short]
        for k, lengths in families:
            if not len(word_hashes) or not lengths:
                continue
            s = shingles(word_hashes, k)  # of fewer than k words one shingle, which is no item's of k or more
            hits = np.flatnonzero(self.met(s))
            if not len(hits):
                continue
            for n in lengths:
                if n > len(word_hashes):
                    self._look_up(s, simhash(signs(s), len(s)), np.zeros(1, dtype=np.int64), len(s), 0, n, radius, least, best, len(word_hashes))
            lengths = [n for n in lengths if n <= len(word_hashes)]
            if not lengths:
                continue
            widest = max(lengths) - k + 1
            # stretches of the text that windows with a hit can reach
            cuts = np.flatnonzero(np.diff(hits) > 2 * widest)
            for a, b in zip(np.r_[0, cuts + 1], np.r_[cuts, len(hits) - 1], strict=True):
                low, high = max(0, hits[a] - widest + 1), min(len(s), hits[b] + widest)
                part = s[low:high]
                turned = signs(part)
                mark = np.zeros(high - low + 1, dtype=np.int64)
                mark[1:] = np.cumsum(np.isin(np.arange(low, high), hits[a : b + 1]))
                for n in lengths:
                    width = n - k + 1
                    if len(part) < width:
                        continue
                    live = np.flatnonzero(mark[width:] - mark[:-width])
                    if len(live):
                        self._look_up(part, simhash(turned, width)[live], live, width, low, n, radius, least, best, n)
        return [(i, *found) for i, found in sorted(best.items())]

    def _look_up(self, part, prints, at, width, low, n, radius, least, best, length) -> None:  # noqa: ANN001
        rows, listed, offsets = self.by_length[n]
        # every block of every window opens one list of items
        entry = (prints.astype("<u8").view(np.uint8).reshape(-1, BLOCKS) + np.arange(BLOCKS) * 256).ravel()
        size = offsets[entry + 1] - offsets[entry]
        ends = np.cumsum(size)
        item = listed[np.repeat(offsets[entry] - (ends - size), size) + np.arange(ends[-1])]
        window = np.repeat(np.arange(len(entry)) // BLOCKS, size)
        close = np.flatnonzero(np.bitwise_count(prints[window] ^ self.prints[rows[item]]) <= radius)
        close = close[np.unique(window[close] * len(rows) + item[close], return_index=True)[1]]  # several blocks may agree
        for w, j in zip(window[close].tolist(), rows[item[close]].tolist(), strict=True):
            start = int(at[w])
            score = similarity(part[start : start + width], self.items[j][1])
            if score >= least and (j not in best or score > best[j][0]):
                best[j] = score, low + start, length


def benchmark_passes(benchmark: DataFrame, id: str = "item_id", text: str = "text") -> Iterator[tuple[list[int], list[str]]]:
    """The items in blocks of bounded size, fetched partition by partition; the driver holds one block."""
    ids, items, held = [], [], 0
    for row in benchmark.select(F.col(id).cast("long").alias("i"), F.lower(text).alias("t")).where("i is not null and t is not null").orderBy("i", "t").toLocalIterator():
        if ids and (len(ids) >= PASS_ITEMS or held + len(row["t"]) > PASS_BYTES):
            yield ids, items
            ids, items, held = [], [], 0
        ids.append(row["i"])
        items.append(row["t"])
        held += len(row["t"])
    if ids:
        yield ids, items


FOUND = T.ArrayType(
    T.StructType([T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())])
)
_FOUND_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", radius: int = RADIUS, least: float = 0.8, k: int = WORDS) -> DataFrame:
    """Add ``leaks``: for each benchmark item found in the whole text its best window, the first of several; empty if there is none.

    An input column of that name is replaced; all others stay. Items with a null id are left out.
    """
    folded = unused(docs, "folded_text")
    passes = benchmark_passes(benchmark)
    first, second = next(passes, ([], [])), next(passes, None)
    base = docs.drop("leaks").withColumn(folded, F.lower(text))
    if second is None:  # nothing to gather: the rows themselves get the column
        return _searched(base, folded, first, radius, least, k)[0].withColumn("leaks", F.coalesce("leaks", F.array().cast(FOUND))).drop(folded)
    # leaks follow from the text alone: what passes find meets the rows by two hashes of it
    key = [unused(docs, f"leaks_key_{i}") for i in range(2)]
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = base.withColumns({key[0]: F.xxhash64(body), key[1]: F.xxhash64(body, F.lit(1))})
    parts = []
    for items in chain((first, second), passes):
        found, shared = _searched(keyed.select(*key, folded), folded, items, radius, least, k)
        parts.append(stored(found.where(F.size("leaks") > 0).drop(folded).dropDuplicates(key), "leaks"))
        shared.destroy()
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = every.groupBy(*key).agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"))  # as many as items in one text
    return keyed.join(merged, key, "left").withColumn("leaks", F.coalesce("leaks", F.array().cast(FOUND))).drop(folded, *key)


def _searched(docs: DataFrame, folded: str, items: tuple[list[int], list[str]], radius: int, least: float, k: int) -> tuple[DataFrame, Broadcast]:
    """``docs`` with the leaks of one pass, and what was broadcast for it."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def make() -> Callable[[pa.RecordBatch], list]:
        own = Benchmark(*shared.value, k)

        def step(piece: pa.RecordBatch) -> list:
            data, bounds = texts(piece.column(folded))
            starts, ends, first = words(data, bounds, PLAIN_BYTES)
            hashes = span_hashes(data, starts, ends)
            rows = []
            for i in range(piece.num_rows):
                found = own.search(hashes[first[i] : first[i + 1]], radius, least) if own.items else []
                rows.append([{"item_id": own.ids[j], "similarity": s, "first_word": at, "n_words": n} for j, s, at, n in found])
            return [pa.array(rows, _FOUND_ARROW)]

        return step

    return append_columns(docs, make, [T.StructField("leaks", FOUND)], folded), shared


def leak_pairs(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", **options) -> DataFrame:  # noqa: ANN003
    """(doc_id, item_id, similarity, first_word, n_words): a row for each text and item found in it."""
    found = find_leaks(docs.select(F.col(id).alias("doc_id"), F.col(options.pop("text", "text")).alias("text")), benchmark, **options)
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")
