"""Ordinal quality classifier: cumulative links over shared hashed-text weights.

P(grade >= k) = logistic(w . x - threshold_k) with ordered thresholds; one weight for each hashed feature
serves all thresholds. Features of a whole text: words, word shapes (classes of characters with
runs collapsed) and a mark for words that repeat the one before them.

The model is fitted on a bounded sample of graded rows (``sample``), the rows with the lowest hash of their id;
prediction covers every row. Null and empty texts have no features and get the prior grade of the
thresholds alone; ``keep`` is true for them only if that prior says so. With fewer than two grades nothing
can be learnt and every row is kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, slices
from .textarrays import LOWER, PLAIN_BYTES, mix, span_hashes, texts, words

BITS = 18
SAMPLE = 20_000
#: Features of fewer sampled texts carry no weight.
LEAST_TEXTS = 8
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) triples of a slice."""
    n, size = len(bounds) - 1, np.uint64(1 << BITS)
    low = LOWER[data]
    out_text, out_key = [], []

    def add(owner: np.ndarray, hashes: np.ndarray, family: int) -> None:
        out_text.append(owner)
        out_key.append((mix(hashes + np.uint64(family)) % size).astype(np.int64))

    starts, ends, first = words(low, bounds, PLAIN_BYTES)
    owner = np.repeat(np.arange(n), np.diff(first))
    hashes = span_hashes(low, starts, ends)
    add(owner, hashes, 1)
    if len(starts) > 1:
        same = (owner[1:] == owner[:-1]) & (hashes[1:] == hashes[:-1])
        add(owner[1:][same], np.zeros(int(same.sum()), np.uint64), 3)
    starts, ends, first = words(data, bounds)
    owner = np.repeat(np.arange(n), np.diff(first))
    shape = _SHAPE[data]
    fresh = np.ones(len(data), dtype=bool)
    fresh[1:] = shape[1:] != shape[:-1]
    fresh[starts] = True
    kept = np.r_[0, np.cumsum(fresh)]
    add(owner, span_hashes(shape[fresh], kept[starts], kept[ends]), 4)
    n_words = np.bincount(owner, minlength=n)
    # a word counts once, however long the text, so that one insult shows; shapes and repeats count by their share
    is_word = np.repeat([True, *[False] * (len(out_key) - 1)], [len(k) for k in out_key])
    key = np.concatenate(out_text).astype(np.int64) << (BITS + 1) | np.concatenate(out_key) << 1 | is_word
    unique, counts = np.unique(key, return_counts=True)
    text = unique >> (BITS + 1)
    return text, (unique >> 1) & ((1 << BITS) - 1), np.where(unique & 1, 1.0, np.log1p(counts) / np.log1p(n_words[text] + 1))


@dataclass
class Model:
    weights: np.ndarray  # float32, one a feature
    thresholds: np.ndarray  # ascending, one less than grades

    def tails(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each text and k from 1."""
        text, feature, value = features(data, bounds)
        score = np.bincount(text, weights=self.weights[feature] * value, minlength=len(bounds) - 1)
        return logistic(score[:, None] - self.thresholds[None, :])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(offsets: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, steps: int = 150, prior: float = 2.0, block: int = 1000) -> Model:
    """Full-batch Adam on the cumulative-link likelihood; the thresholds stay ordered as a first one plus positive gaps.

    Text i has the features ``offsets[i]`` to ``offsets[i + 1]``, without repeats. Gradients are summed over blocks of
    texts, so that besides the features only one block's values are in memory.
    """
    n = len(grade)
    l2 = prior / n  # the same prior on the weights for any number of rows
    active = np.flatnonzero(np.bincount(feature, minlength=1 << BITS) >= LEAST_TEXTS)
    d = len(active)
    place = np.full(1 << BITS, d, dtype=np.int32)  # what is rare goes to a last weight that stays 0
    place[active] = np.arange(d, dtype=np.int32)
    share = np.array([(grade >= k).mean() for k in range(1, grades)])
    start = -np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    p = np.concatenate([np.zeros(d), start[:1], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        cuts = np.r_[p[d], p[d] + np.cumsum(np.exp(p[d + 1 :]))]
        weights = np.r_[p[:d], 0.0]
        g_weights, g_cuts = np.zeros(d + 1), np.zeros(grades + 1)
        for i in range(0, n, block):
            own = grade[i : i + block]
            rows = np.arange(len(own))
            a, b = offsets[i], offsets[i + len(own)]
            text = np.repeat(rows, np.diff(offsets[i : i + len(own) + 1]))
            f, x = place[feature[a:b]], value[a:b]
            score = np.bincount(text, weights=weights[f] * x, minlength=len(own))
            edges = np.concatenate([np.full((len(own), 1), 1.0), logistic(score[:, None] - cuts), np.zeros((len(own), 1))], axis=1)
            high, low = edges[rows, own], edges[rows, own + 1]
            chance = np.maximum(high - low, 1e-9)
            slope_high, slope_low = high * (1 - high), low * (1 - low)
            g_score = -(slope_high - slope_low) / chance / n
            g_cuts += np.bincount(own, weights=slope_high / chance / n, minlength=grades + 1)
            g_cuts -= np.bincount(own + 1, weights=slope_low / chance / n, minlength=grades + 1)
            g_weights += np.bincount(f, weights=g_score[text] * x, minlength=d + 1)
        inner = g_cuts[1:grades]
        steps_down = np.cumsum(inner[::-1])[::-1]
        g = np.concatenate([g_weights[:d] + l2 * p[:d], steps_down[:1], steps_down[1:] * np.exp(p[d + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * (1 - t / (steps + 1)) ** 0.5
    weights = np.zeros(1 << BITS, dtype=np.float32)
    weights[active] = p[:d]
    return Model(weights, np.r_[p[d], p[d] + np.cumsum(np.exp(p[d + 1 :]))])


def fit(graded: DataFrame, docs: DataFrame, grade: str = "grade", id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` graded rows; None if they have fewer than two grades.

    Grades are small integers from 0. An id with several grades counts with its lowest, an id with several texts with
    one of them, the first by hash. The sample is bounded, so it is broadcast to the documents, and its
    sparse features, 16-bit values, are all that reaches the driver, partition by partition.
    """
    rows = graded.where(F.col(grade).isNotNull()).groupBy(F.col(id).alias("graded_id")).agg(F.min(F.col(grade).cast("int")).alias("graded_as"))
    rows = rows.where("graded_id is not null").orderBy(F.xxhash64("graded_id"), "graded_id").limit(sample)
    chosen = docs.select(F.col(id).alias("graded_id"), F.col(text).alias("text")).join(F.broadcast(rows), "graded_id")
    one = Window.partitionBy("graded_id").orderBy(F.xxhash64("text"), "text")
    chosen = chosen.withColumn("nth", F.row_number().over(one)).where("nth = 1")

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for piece in slices(batch, "text"):
                owner, feature, value = features(*texts(piece.column("text")))
                cut = np.searchsorted(owner, np.arange(piece.num_rows + 1))
                parts = [piece.column("graded_as").to_numpy(zero_copy_only=False).astype("<i4"), np.diff(cut).astype("<i4"), feature.astype("<i4"), value.astype("<f2")]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["grades", "counts", "features", "shares"])

    found = chosen.select("graded_as", "text").mapInArrow(run, "grades binary, counts binary, features binary, shares binary")
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for row in found.toLocalIterator():
        for held, content, kind in zip(parts, row, ("<i4", "<i4", "<i4", "<f2"), strict=True):
            held.append(np.frombuffer(bytes(content), dtype=kind))
    if not parts[0]:
        return None
    grade_of, counts, feature, value = (np.concatenate(parts.pop(0)) for _ in range(4))
    if len(np.unique(grade_of)) < 2:
        return None
    return fit_ordinal(np.r_[0, np.cumsum(counts)], feature, value, grade_of, int(grade_of.max()) + 1)


def classify(docs: DataFrame, model: Model | None, grade: int = 2, least: float = 0.5, text: str = "text") -> DataFrame:
    """Add ``expected_grade``, ``tail`` (the chance of at least ``grade``) and ``keep`` (tail at least ``least``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType()), T.StructField("keep", T.BooleanType())]

    def make() -> Callable[[pa.RecordBatch], list]:
        own = shared.value

        def step(piece: pa.RecordBatch) -> list:
            if own is None:
                n = piece.num_rows
                return [pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.array([True] * n)]
            chances = own.tails(*texts(piece.column(text)))
            tail = chances[:, min(grade, chances.shape[1]) - 1]
            return [pa.array(chances.sum(axis=1)), pa.array(tail), pa.array(tail >= least)]

        return step

    return append_columns(docs, make, fields, text)


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of quality and toxicity marks: 0 toxic, 1 of low quality, 2 good; null marks give no grade."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))
