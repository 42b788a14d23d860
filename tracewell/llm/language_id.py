"""Language identification by compression.

Each language has a raw-content zstandard dictionary, a bounded sample of its training texts: of each text at most
``size // shares`` characters, in pieces from hashed positions all over it, so some 40 long texts fill a dictionary.
A text is compressed with every dictionary, block by block over its whole length; the smallest
output names the language, and the margin to the second is the score. A narrow margin marks the
prediction as not reliable.

Null texts and texts without a letter get ``und`` and score 0. Ties go to the language first in
alphabetical order. Without training rows every text gets ``und``.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

DICTIONARY_BYTES = 110 * 1024
#: Texts taken a language for its dictionary, those with the lowest hash of their id.
SAMPLE_TEXTS = 150
#: A text gives at most this fraction of a dictionary, in so many pieces, one from each stretch of the text.
SHARES, PIECES = 40, 8
#: Compressed at once; a later block does not see the earlier ones, so the dictionary counts throughout.
BLOCK = 4096
#: Level 1 finds too few short matches: it takes English for other languages.
LEVEL = 6
LETTER = regex.compile(r"\p{L}")
#: ASCII bytes other than letters become blanks: punctuation and digits say nothing of the language.
FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def plain(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(FOLD).split())


def dictionaries(training: DataFrame, lang: str = "lang", text: str = "text", id: str = "doc_id", sample: int = SAMPLE_TEXTS, size: int = DICTIONARY_BYTES, shares: int = SHARES) -> dict[str, bytes]:
    """A dictionary for each language; the sample is bounded a language, by window ranks that Spark limits before the shuffle."""
    piece = max(size // shares // PIECES, 1)
    long = F.floor(F.length(text) / PIECES)  # characters of a stretch
    start = lambda i: i * long + F.pmod(F.xxhash64(F.col(id).cast("string"), i), long - piece + 1) + 1
    pieces = F.concat_ws(" ", *[F.col(text).substr(start(F.lit(i)).cast("int"), F.lit(piece)) for i in range(PIECES)])
    taken = F.when(long < piece, F.col(text)).otherwise(pieces)
    order = Window.partitionBy(lang).orderBy(F.xxhash64(F.col(id).cast("string")), F.col(id))
    rows = (
        training.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
        .select(lang, id, text)
        .withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= sample)
        .select(F.col(lang).alias("lang"), taken.alias("text"), "nth")
        .orderBy("lang", "nth")
        .toLocalIterator()
    )
    parts: dict[str, list[bytes]] = {}
    held: dict[str, int] = {}
    for row in rows:
        content = plain(row["text"])
        room = size - held.get(row["lang"], 0)
        if room > 0:
            parts.setdefault(row["lang"], []).append(content[:room])
            held[row["lang"]] = held.get(row["lang"], 0) + len(parts[row["lang"]][-1])
    return {k: b" ".join(v) for k, v in sorted(parts.items()) if b"".join(v).strip()}


def identify(docs: DataFrame, languages: dict[str, bytes], text: str = "text", margin: float = 0.02) -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1) and ``reliable`` (score at least ``margin``)."""
    shared = docs.sparkSession.sparkContext.broadcast(languages)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("reliable", T.BooleanType())]

    def make() -> Callable[[pa.RecordBatch], list]:
        coders = []
        for name, content in shared.value.items():
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            coders.append((name, zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False)))

        def one(value: str | None) -> tuple[str, float, bool]:
            if value is None or not coders or not LETTER.search(value):
                return "und", 0.0, False
            content = plain(value) or value.encode("utf-8", "replace")
            blocks = [content[i : i + BLOCK] for i in range(0, len(content), BLOCK)]
            sizes = sorted((sum(len(c.compress(b)) for b in blocks), name) for name, c in coders)
            score = 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
            return sizes[0][1], score, score >= margin

        def step(piece: pa.RecordBatch) -> list:
            found = [one(v) for v in piece.column(text).to_pylist()]
            return [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]

        return step

    return append_columns(docs, make, fields, text)


def held_out(id: Column) -> Column:
    """Whether a row is kept from training: the checksum of its id, as text, leaves 2 on division by 4."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
