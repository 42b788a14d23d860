"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written and read
again before the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, decontaminate, ngram_join, quality_model, suffix_dedup
from tracewell.llm.common import forget, stored
from tracewell.llm.queries import rank_path, table

#: Passages of over 50 words are removed wherever they repeat: 50 short words have some 250 bytes.
PASSAGE_BYTES = 250


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose chance of the best grade is below one half; learnt from the labels of documents present."""
    model = quality_model.fit(quality_model.grades(table(spark, sf_dir, "labels")), docs)
    return quality_model.classify(docs, model).where("keep").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each component at five words and a similarity of 0.8."""
    return ngram_join.keep_one(docs).select(*docs.columns)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings of PASSAGE_BYTES bytes that occur more than once; a character cut in part goes whole.

    ``n_chars`` follows the text. A document of which nothing is left is dropped.
    """
    found = suffix_dedup.remove_repeats(docs, PASSAGE_BYTES)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(suffix_dedup.text_of("kept_bytes"))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.where((F.col("n_removed") == 0) | (F.length("text") > 0)).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item is found."""
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids): the ids of every document left, as little-endian unsigned 32-bit integers."""
    coded = bpe.encode(docs.select("doc_id", "text"), rank_path())
    return coded.select("doc_id", F.floor(F.octet_length("token_ids") / 4).alias("n_tokens"), "token_ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", passage_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", token_stage),
]

#: The classifier, the passages and the token ids have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has read goes once its rows are written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage{k}")
        forget(before)
    return docs
