"""Quality rules with thresholds that follow the data.

Each text gets whole counts; their ratios, as integers of a ten-thousandth, go into a mergeable
quantile sketch for each (language, source): counts of integer buckets with 1/128 relative width,
so that sketches of parts add up to the sketch of the whole, in any order. Fences from the sketch's
quantiles replace fixed cutoffs, and a join on (language, source) applies them. No number in them has a metric's unit.
A sketch has two parts: all values, and the present ones, which are above 0. Of all values an upper quantile plus a
multiple of its distance from the lower quartile makes a fence (for word lengths the lower quartile less as much as well),
and so does a quantile of the present ones, times a factor or plus a multiple of their distance from their lower quartile: where
most texts have nothing of a metric, only those that have some tell how much is usual. The higher of both
holds, and never less than what a tenth of the group exceeds. Sketches hold the rows that pass the base rule, as fences judge no others.

Null and empty texts count zero words and fail the base rule. Null languages and sources form groups of
their own. A group's quantiles are drawn towards those of its language (the first key), with the weight of
``prior_rows`` rows against its own: a small group leans on its language, and no row count changes the rule.
Quantiles of present values count the rows that have some, and a language's are drawn to those of all rows in the
same way; those of all values are drawn to nothing. Ties and repeated rows are judged alike, row by row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, stored, unused
from .textarrays import mix, shingles, span_hashes, texts, words

#: The symbol characters counted.
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
REPEAT_WINDOW = 8
POINTS = {"q1": 0.25, "q3": 0.75, "q90": 0.9, "q95": 0.95}
PRESENT = {"p05": 0.05, "p25": 0.25, "p75": 0.75}
#: metric: (upper quantile of all values, multiple of its distance from q1), (quantile of present values, factor, multiple of its
#: distance from p25), least distance as a share of the upper quantile, whether there is a lower fence. Symbols are judged from the low end of
#: the present ones, as in prose it is unusual to have any; lines and words repeat now and then, so only the far end counts.
METRICS = {
    "symbol_rate": (("q3", 6), ("p05", 0.5, 0), 2 / 3, False), "dup_line_rate": (("q95", 1), ("p75", 1, 2), 2 / 3, False), "repeat_rate": (("q95", 1), ("p75", 1, 2), 2 / 3, False), "word_length": (("q3", 6), None, 0.125, True),
}
#: Weight of the language's quantiles in a group's, in rows.
PRIOR_ROWS = 200


def count_text(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text of a slice."""
    n = len(bounds) - 1
    starts, ends, first = words(data, bounds)
    out = {"n_words": np.diff(first)}
    lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    chars = np.r_[0, np.cumsum(lead[ends] - lead[starts])]
    out["word_chars"] = chars[first[1:]] - chars[first[:-1]]
    marks = np.zeros(256, dtype=bool)
    marks[list(SYMBOLS)] = True
    symbols = np.r_[0, np.cumsum(marks[data])]
    out["n_symbols"] = symbols[bounds[1:]] - symbols[bounds[:-1]]
    hashes = span_hashes(data, starts, ends)
    text_of = np.repeat(np.arange(n), out["n_words"])
    # lines with a word, keyed by text
    breaks = np.flatnonzero(data == 10)
    opens = np.unique(np.r_[bounds[:-1][bounds[:-1] < len(data)], breaks + 1]) if len(data) else np.zeros(0, np.int64)
    opens = opens[opens < len(data)]
    closes = np.minimum(np.r_[opens[1:], len(data)], len(data))
    owner = np.searchsorted(bounds, opens, side="right") - 1
    closes = np.minimum(closes, bounds[owner + 1]) if len(opens) else closes
    closes = closes - ((closes > opens) & (data[np.maximum(closes - 1, 0)] == 10)) if len(opens) else closes
    has_word = np.searchsorted(starts, closes) > np.searchsorted(ends, opens, side="right")
    opens, closes, owner = opens[has_word], closes[has_word], owner[has_word]
    key = mix(span_hashes(data, opens, closes) + mix(owner.astype(np.uint64)))
    _, index = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(owner, minlength=n) - np.bincount(owner[index], minlength=n)
    # words in windows found twice or more in their text
    k, covered = REPEAT_WINDOW, np.zeros(len(starts) + 1, dtype=np.int64)
    if len(starts) >= k:
        window = shingles(hashes, k)
        whole = text_of[: len(window)] == text_of[k - 1 :]
        at = np.flatnonzero(whole)
        _, inverse, times = np.unique(mix(window[at] + mix(text_of[at].astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)
        twice = at[times[inverse] > 1]
        np.add.at(covered, twice, 1)
        np.subtract.at(covered, twice + k, 1)
    hit = np.r_[0, np.cumsum(np.cumsum(covered)[:-1] > 0)]
    out["n_repeat_words"] = hit[first[1:]] - hit[first[:-1]]
    return out


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of each whole text."""

    def make() -> Callable[[pa.RecordBatch], list]:
        def step(piece: pa.RecordBatch) -> list:
            found = count_text(*texts(piece.column(text)))
            return [pa.array(found[c].astype(np.int64)) for c in COUNTS]

        return step

    return append_columns(docs, make, [T.StructField(c, T.LongType()) for c in COUNTS], text)


def with_rates(counted: DataFrame) -> DataFrame:
    """Add the metrics as integers; without words they are 0."""
    rate = lambda top, bottom, unit: F.when(F.col(bottom) > 0, F.floor(F.col(top) * unit / F.col(bottom))).otherwise(0).cast("long")
    return counted.withColumns(
        {
            "symbol_rate": rate("n_symbols", "n_words", 10_000),
            "dup_line_rate": F.when(F.col("n_dup_lines") > 0, F.floor(F.col("n_dup_lines") * 10_000 / (F.col("n_dup_lines") + F.floor(F.col("n_words") / 8) + 1))).otherwise(0).cast("long"),
            "repeat_rate": rate("n_repeat_words", "n_words", 10_000),
            "word_length": rate("word_chars", "n_words", 100),
        }
    )


def bucket(value) -> F.Column:
    """The sketch's bucket of a non-negative integer: itself below 128, else its seven leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0)).cast("int")
    unit = F.pow(F.lit(2.0), shift)
    return (F.floor(value / unit) * unit).cast("long")


def sketches(rated: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One mergeable sketch for each group and metric, as rows (keys, metric, bucket, n)."""
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in metrics]))
    return rated.select(*keys, stacked.alias("x")).select(*keys, "x.metric", "x.bucket").groupBy(*keys, "metric", "bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], points: dict[str, float]) -> DataFrame:
    """The named quantiles of each sketch (lower value of the bucket that reaches the share), and its row count."""
    by = [*keys, "metric"]
    upto = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*by)
    run = sketch.withColumns({"upto": F.sum("n").over(upto), "rows": F.sum("n").over(total)})
    return run.groupBy(*by).agg(F.max("rows").alias("rows"), *[F.min(F.when(F.col("upto") >= F.col("rows") * q, F.col("bucket"))).alias(name) for name, q in points.items()])


def fences(rated: DataFrame, keys: list[str], prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """For each group one row with ``<metric>_high`` and ``<metric>_low`` and the group's row count."""
    metrics = list(METRICS)
    own = sketches(rated, keys, metrics)
    first = keys[0]
    merged = own.groupBy(first, "metric", "bucket").agg(F.sum("n").alias("n"))  # sketches merge by adding
    total = merged.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    same = F.col("metric") == F.col("wide_metric")
    renamed = lambda df, **more: df.select(F.col("metric").alias("wide_metric"), *[F.col(c).alias(f"wide_{c}") for c in df.columns if c not in (first, *keys, "metric", "rows")], *[F.col(c).alias(n) for n, c in more.items()])

    def drawn(rows: str, p: str) -> Column:
        """A quantile with the weight of its rows, and the wider one with the weight of the prior; where one is missing the other."""
        blend = (F.col(rows) * F.col(p) + prior_rows * F.col(f"wide_{p}")) / (F.col(rows) + prior_rows)
        return F.coalesce(blend, F.col(f"wide_{p}"), F.col(p))

    mine, wide = quantiles(own, keys, POINTS), quantiles(merged, [first], POINTS)
    both = mine.join(renamed(wide, wide_key=first), F.col(first).eqNullSafe(F.col("wide_key")) & same)
    both = both.select(*keys, "metric", "rows", *[drawn("rows", p).alias(p) for p in POINTS])

    some = lambda sketch, by: quantiles(sketch.where("bucket > 0"), by, PRESENT)
    every = renamed(some(total, []))
    languages = merged.select(first, "metric").distinct().join(some(merged, [first]).withColumnsRenamed({first: "key", "metric": "m"}), F.col(first).eqNullSafe(F.col("key")) & (F.col("metric") == F.col("m")), "left").drop("key", "m")
    languages = languages.join(every, same, "left").select(first, "metric", *[drawn("rows", p).alias(p) for p in PRESENT])
    of_group = some(own, keys).select(*[F.col(k).alias(f"of_{i}") for i, k in enumerate(keys)], F.col("metric").alias("m"), F.col("rows").alias("present_rows"), *PRESENT)
    met = F.col("metric") == F.col("m")
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"of_{i}"))
    both = both.join(of_group, met, "left").join(renamed(languages, wide_key=first), F.col(first).eqNullSafe(F.col("wide_key")) & same, "left")
    both = both.withColumns({p: drawn("present_rows", p) for p in PRESENT})
    out = []
    for m, ((top, times), present, least, lower) in METRICS.items():
        here = F.col("metric") == m
        distance = F.greatest((F.col(top) - F.col("q1")) * times, F.col(top) * least)
        high = F.greatest(F.col(top) + distance, F.col("q90"))
        if present:
            point, factor, spread = present
            high = F.greatest(high, F.col(point) * factor + (F.col(point) - F.col("p25")) * spread)
        out.append(F.max(F.when(here, high)).alias(f"{m}_high"))
        out.append(F.max(F.when(here, F.col("q1") - distance if lower else F.lit(-1))).alias(f"{m}_low"))
    return both.groupBy(*keys).agg(F.max("rows").alias("group_rows"), *out)


def judge(docs: DataFrame, keys: tuple[str, ...] = ("lang", "source"), text: str = "text") -> DataFrame:
    """Counts, metrics, ``base_failed`` and ``kept`` of every row; the text is left out.

    Input columns with the names of counts, metrics or verdicts are replaced; all others stay. Texts are read
    once: the counted rows, which are narrow, are written and used for the sketches and for the verdicts.
    """
    names = [unused(docs, f"tracewell_group_{i}") for i in range(len(keys))]
    named = docs.withColumns(dict(zip(names, [F.col(k) for k in keys], strict=True)))
    rated = stored(with_rates(text_counts(named.drop(*METRICS, "base_failed", "kept"), text).drop(text)), "counted")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    limits = fences(rated.where(~base), names)
    bound = {c: unused(rated, f"tracewell_limit_{c}") for c in limits.columns}
    joined = rated.join(limits.select(*[F.col(c).alias(b) for c, b in bound.items()]), on=[F.col(n).eqNullSafe(F.col(bound[n])) for n in names], how="left")
    inside = F.lit(True)
    for m in METRICS:
        inside = inside & (F.col(m) <= F.coalesce(bound[f"{m}_high"], F.col(m))) & (F.col(m) >= F.coalesce(bound[f"{m}_low"], F.col(m)))
    return joined.withColumns({"base_failed": base, "kept": ~base & inside}).drop(*bound.values(), *names)
