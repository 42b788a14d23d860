"""Ranked lexical search over a forward index in blocks, with block-max pruning.

Terms are maximal runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case. A first pass counts documents
and terms (they set the length norm m), a second writes the index: a row for each block of successive documents that have a
term, with their norms, their terms with frequencies, the block's own dictionary, and for each of its terms the number of
documents and the largest impact (1000000000 tf) div (1000 tf + 8 m). The index has all terms of whole texts and serves any
query. A query's score is the sum of weight times impact over its distinct terms, all in whole numbers, so a block's
maxima give a true upper bound.

Search takes queries in passes of bounded size. The blocks with the highest bounds of all are scored first, which gives each
query a threshold; then every task takes its blocks in groups, sorts each group's blocks by the query's bound and scores them
until the bound drops below the threshold (its own best rows raise it on the way). A bound equal to the threshold is
still scored, as ties go by id. Each task returns the best rows it has met for each query, and a window ranks those.

A document's id may have any type that Spark orders; null ids come last among ties. Null texts and texts without terms are
no documents, queries without terms find nothing, repeated rows are documents (and queries) of their own. Empty tables
give no rows. Terms of over eight bytes meet in one block only if no two of them share a 64-bit hash; a query's
terms are compared byte for byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, release, slices, stored
from .textarrays import LOWER, PLAIN_BYTES, U64, span_hashes, texts, words

TOP = 10
#: Documents of a block; a block also ends after SLICE_BYTES of text.
BLOCK_DOCS = 128
#: Queries of one pass, and bytes of their texts.
PASS_QUERIES, PASS_BYTES = 2_000, 4 << 20
#: Blocks that are sorted together, and bytes of them; blocks scored first for each query.
GROUP_BLOCKS, GROUP_BYTES, FIRST = 64, 64 << 20, 2


@dataclass
class Index:
    """``blocks``: written rows of the index. ``documents`` that have a term, and ``terms`` in all."""

    blocks: DataFrame
    documents: int
    terms: int


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in the narrowest type that holds them; the first byte is its width."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(values.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpacked(held: bytes) -> np.ndarray:
    return np.frombuffer(held, dtype=f"<u{held[0]}", offset=1).astype(np.int64)


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, starts and ends of terms, and each text's first term."""
    data, bounds = texts(column)
    data = LOWER[data]
    return data, *words(data, bounds, PLAIN_BYTES)


def counts(docs: DataFrame, text: str) -> tuple[int, int]:
    """Documents with a term, and all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            for piece in slices(batch, "text"):
                each = np.diff(terms_of(piece.column("text"))[3])
                n, total = n + int((each > 0).sum()), total + int(each.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "total"])
        release()

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return found[0] or 0, found[1] or 0


#: A block's dictionary is in order of hashes, which are not stored: they follow from the spelling.
_DICTIONARY = ["spelled", "lengths"]
_BINARY = ["norms", "owners", "terms", "frequencies", *_DICTIONARY, "best", "holders"]


def build(docs: DataFrame, id: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS) -> Index:
    """Write the index of all texts to the shared folder."""
    n_docs, n_terms = counts(docs, text)
    source = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(source.schema["doc_id"].dataType)), *[T.StructField(c, T.BinaryType()) for c in _BINARY]])

    def block_of(piece: pa.RecordBatch) -> list | None:
        data, starts, ends, first = terms_of(piece.column("text"))
        each = np.diff(first)
        kept = np.flatnonzero(each)
        if not len(kept):
            return None
        keys, at, local = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        owner = np.repeat(np.arange(len(kept)), each[kept])
        pairs, tf = np.unique(owner * len(keys) + local, return_counts=True)
        owner, local = pairs // len(keys), pairs % len(keys)
        norms = np.array([10 + 90 * n * n_docs // n_terms for n in each[kept].tolist()], dtype=np.int64)
        best = np.zeros(len(keys), dtype=np.int64)
        np.maximum.at(best, local, impact(tf, norms[owner]))
        lengths = ends[at] - starts[at]
        stops = np.cumsum(lengths)
        spelled = data[np.repeat(starts[at] - (stops - lengths), lengths) + np.arange(stops[-1])]
        ids = piece.column("doc_id").take(pa.array(kept))
        held = [packed(norms), packed(owner), packed(local), packed(tf), spelled.tobytes(), packed(lengths), packed(best), packed(np.bincount(local, minlength=len(keys)))]
        return [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *[pa.array([x], pa.binary()) for x in held]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start in range(0, batch.num_rows, block_docs):
                for piece in slices(batch.slice(start, block_docs), "text", SLICE_BYTES):
                    row = block_of(piece)
                    if row:
                        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *row], names=schema.names)
                        number += 1
        release()

    return Index(stored(source.mapInArrow(run, schema), "lexical"), n_docs, n_terms)


def impact(tf: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * norms)


class Queries:
    """The queries of one pass: their terms in order of hash, and for each query which of them it has."""

    def __init__(self, items: list[str]) -> None:
        data, starts, ends, first = terms_of(pa.array(items, pa.string()))
        hashes = span_hashes(data, starts, ends)
        spelled = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        order = sorted({(int(h), s) for h, s in zip(hashes, spelled, strict=True)})
        place = {s: i for i, (_, s) in enumerate(order)}
        self.hashes = np.array([h for h, _ in order], dtype=U64)
        self.spelled = [s for _, s in order]
        self.lengths = np.array([len(s) for s in self.spelled], dtype=np.int64)
        self.long = self.lengths > 8  # shorter ones are told apart by hash and length
        sets = [sorted({place[s] for s in spelled[first[i] : first[i + 1]]}) for i in range(len(items))]
        self.numbers = [i for i, s in enumerate(sets) if s]
        self.sets = [np.array(s, dtype=np.int64) for s in sets if s]
        self.flat = np.concatenate(self.sets) if self.sets else np.zeros(0, np.int64)
        self.starts = np.cumsum([0, *[len(s) for s in self.sets[:-1]]]) if self.sets else np.zeros(0, np.int64)
        self.weights = np.zeros(len(order), dtype=np.int64)
        self.least = np.ones(len(self.sets), dtype=np.int64)  # scores that a row must reach

    def places(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        """Which terms of the pass a block's dictionary has, and where; kept with the block while it is held."""
        if "places" in row:
            return row["places"]
        lengths = unpacked(row["lengths"])
        ends = np.cumsum(lengths)
        begins = ends - lengths
        known = span_hashes(np.frombuffer(row["spelled"], dtype=np.uint8), begins, ends)
        at = np.minimum(np.searchsorted(known, self.hashes), len(known) - 1)
        same = (known[at] == self.hashes) & (lengths[at] == self.lengths)
        for i in np.flatnonzero(same & self.long).tolist():
            same[i] = row["spelled"][begins[at[i]] : ends[at[i]]] == self.spelled[i]
        mine = np.flatnonzero(same)
        row["places"] = mine, at[mine]
        return row["places"]

    def bounds(self, row: dict) -> np.ndarray:
        """For each query the highest score that a document of the block can have."""
        mine, at = self.places(row)
        value = np.zeros(len(self.hashes), dtype=np.int64)
        value[mine] = self.weights[mine] * unpacked(row["best"])[at]
        return np.add.reduceat(value[self.flat], self.starts)

    def scores(self, row: dict, which: np.ndarray) -> np.ndarray:
        """Scores of all documents of a block for some queries, a row for each query."""
        mine, at = self.places(row)
        norms, local = unpacked(row["norms"]), unpacked(row["terms"])
        line = np.full(len(unpacked(row["best"])), -1, dtype=np.int64)
        line[at] = np.arange(len(mine))
        line = line[local]
        hit = np.flatnonzero(line >= 0)
        owner = unpacked(row["owners"])[hit]
        table = np.zeros((len(mine) + 1, len(norms)), dtype=np.int64)  # the last line stands for terms that the block has not
        table[line[hit], owner] = self.weights[mine][line[hit]] * impact(unpacked(row["frequencies"])[hit], norms[owner])
        of_term = np.full(len(self.hashes), len(mine), dtype=np.int64)
        of_term[mine] = np.arange(len(mine))
        return np.array([table[of_term[self.sets[q]]].sum(axis=0) for q in which.tolist()])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


class Best:
    """The best rows of each query met so far: score, then id."""

    def __init__(self, queries: Queries, top: int) -> None:
        self.top, self.rows = top, [[] for _ in queries.sets]
        self.least = queries.least.copy()

    def add(self, q: int, scores: np.ndarray, ids: list) -> None:
        at = np.flatnonzero(scores >= self.least[q])
        if not len(at):
            return
        new = [(-int(scores[i]), ids[i] is None, ids[i]) for i in at.tolist()]
        rows = self.rows[q] = sorted([*self.rows[q], *new], key=lambda x: x if x[2] is not None else x[:2])[: self.top]
        if len(rows) == self.top:
            self.least[q] = max(self.least[q], -rows[-1][0])


def scan(rows: Iterator[dict], queries: Queries, top: int) -> Best:
    """The best documents of a task's blocks: in each group by falling bound, until it drops below the threshold."""
    best = Best(queries, top)

    def settle(group: list[dict]) -> None:
        bounds = np.array([queries.bounds(row) for row in group])
        order = np.argsort(-bounds, axis=0, kind="stable")
        at, step = 0, 1
        while at < len(group):
            todo = np.zeros(bounds.shape, dtype=bool)
            np.put_along_axis(todo, order[at : at + step], True, axis=0)
            todo &= bounds >= best.least
            if not todo.any():
                return  # bounds only fall from here, and thresholds only rise
            for b in np.flatnonzero(todo.any(axis=1)).tolist():
                which = np.flatnonzero(todo[b])
                for q, found in zip(which.tolist(), queries.scores(group[b], which), strict=True):
                    best.add(q, found, group[b]["ids"])
            at, step = at + step, 2 * step

    group, held = [], 0
    for row in rows:
        size = sum(len(row[c]) for c in _BINARY)
        if group and (len(group) == GROUP_BLOCKS or held + size > GROUP_BYTES):
            settle(group)
            group, held = [], 0
        group.append(row)
        held += size
    if group:
        settle(group)
    return best


def weigh(index: Index, queries: Queries) -> None:
    """Sets the weights of the pass's terms by the number of documents that hold them."""
    shared = index.blocks.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.hashes), dtype=np.int64)
        for row in _rows(batches):
            mine, at = shared.value.places(row)
            total[mine] += unpacked(row["holders"])[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])
        release()

    rows = index.blocks.select(*_DICTIONARY, "holders").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # terms of one pass
    df = dict(map(tuple, rows))
    queries.weights = np.array([math.floor(1000 * math.log((2 * index.documents + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(queries.hashes))], dtype=np.int64)
    shared.destroy()


def first_blocks(index: Index, queries: Queries) -> list[int]:
    """The blocks with the highest bounds, FIRST for each query."""
    shared = index.blocks.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, numbers = shared.value, np.zeros((0, len(shared.value.sets)), dtype=np.int64)
        bounds = numbers
        for row in _rows(batches):
            numbers = np.vstack([numbers, np.full((1, numbers.shape[1]), row["block"])])
            bounds = np.vstack([bounds, queries.bounds(row)[None]])
            if len(bounds) > FIRST:
                keep = np.argsort(-bounds, axis=0, kind="stable")[:FIRST]
                numbers, bounds = np.take_along_axis(numbers, keep, 0), np.take_along_axis(bounds, keep, 0)
        query = np.broadcast_to(np.arange(numbers.shape[1]), numbers.shape)
        yield pa.RecordBatch.from_arrays([pa.array(query.ravel()), pa.array(numbers.ravel()), pa.array(bounds.ravel())], names=["query", "block", "bound"])
        release()

    rows = index.blocks.select("block", *_DICTIONARY, "best").mapInArrow(run, "query long, block long, bound long").where("bound > 0")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "block"))
    found = rows.withColumn("place", place).where(F.col("place") <= FIRST).select("block").distinct().collect()  # FIRST for each query of the pass at most
    shared.destroy()
    return [row["block"] for row in found]


def found_in(blocks: DataFrame, queries: Queries, top: int) -> DataFrame:
    """(query, doc_id, score): the best rows of each task."""
    kind = blocks.schema["ids"].dataType.elementType
    shared = blocks.sparkSession.sparkContext.broadcast(queries)
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        best = scan(_rows(batches), shared.value, top)
        flat = [(shared.value.numbers[q], key, -score) for q, rows in enumerate(best.rows) for score, _, key in rows]
        columns = zip(*flat, strict=True) if flat else ([], [], [])
        kinds = [pa.int64(), to_arrow_type(kind), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=schema.names)
        release()

    rows = blocks.mapInArrow(run, schema)
    line = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= top)


def passes(queries: DataFrame, id: str, text: str) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts in blocks of bounded size, fetched partition by partition; the driver holds one block."""
    ids, items, held = [], [], 0
    for row in queries.select(F.col(id).alias("i"), F.col(text).alias("t")).where("t is not null").toLocalIterator():
        if ids and (len(ids) >= PASS_QUERIES or held + len(row["t"]) > PASS_BYTES):
            yield ids, items
            ids, items, held = [], [], 0
        ids.append(row["i"])
        items.append(row["t"])
        held += len(row["t"])
    if ids:
        yield ids, items


def search(index: Index, queries: DataFrame, id: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each row of ``queries`` with a score above 0."""
    spark = queries.sparkSession
    kinds = [T.StructField("query", T.LongType()), T.StructField("item_id", queries.schema[id].dataType)]
    key = index.blocks.schema["ids"].dataType.elementType
    out = spark.createDataFrame([], T.StructType([kinds[1], T.StructField("rank", T.IntegerType()), T.StructField("doc_id", key), T.StructField("score", T.LongType())]))
    if not index.documents:
        return out
    for ids, items in passes(queries, id, text):
        asked = Queries(items)
        if not asked.sets:
            continue
        weigh(index, asked)
        first = spark.createDataFrame([(b,) for b in first_blocks(index, asked)], "block long")
        place = {number: i for i, number in enumerate(asked.numbers)}
        for row in found_in(index.blocks.join(F.broadcast(first), "block", "left_semi"), asked, top).where(F.col("rank") == top).collect():
            asked.least[place[row["query"]]] = max(1, row["score"])
        names = spark.createDataFrame(list(enumerate(ids)), T.StructType(kinds))
        made = stored(found_in(index.blocks, asked, top).join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"), "ranked")
        out = out.union(made)
    return out
