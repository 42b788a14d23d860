"""The registered query of each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, language_id, lexical_search, mixing, ngram_join, quality_model, quality_rules, sharding, suffix_dedup, token_shards, warc, whitening
from .common import forget

SHARDS = 24


def rank_path() -> str:
    """The place of the public rank file that the queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written, read back and merged into one index; a row for each page."""
    index = warc.capture_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item that is found in it, with the best window."""
    return decontaminate.leak_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and chance of the best grade of every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality_model.fit(quality_model.grades(table(spark, sf_dir, "labels")), docs)
    return quality_model.classify(docs.select("doc_id", "text"), model).drop("text")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those not held out."""
    docs = table(spark, sf_dir, "documents")
    known = language_id.dictionaries(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.identify(docs.select("doc_id", "text"), known)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "reliable")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without repeated 400-byte strings, also as text."""
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        "n_removed",
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
        F.when(F.col("n_removed") == 0, F.col("text")).otherwise(suffix_dedup.text_of("kept_bytes")).alias("text"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, with fences of its language and source."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence as read back from the shards, with the documents it holds."""
    index, read = token_shards.materialise(table(spark, sf_dir, "documents"), rank_path())
    rows = read.select("slot", "shard", "row", F.sha2("tokens", 256).alias("tokens_sha256"))
    return index.select("slot", "sequence", "n_tokens", "doc_ids").join(rows, "slot")


def op9_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document, by bytes."""
    placed = sharding.cut(sharding.weighed(table(spark, sf_dir, "documents")), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and what they decode to, as digests."""
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), rank_path(), decoded="decoded")
    return coded.select("doc_id", F.floor(F.octet_length("token_ids") / 4).alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened coordinates of every embedding, a row for each."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows, "embedding")
    explained = F.array(*[F.lit(x).cast("double") for x in model.explained or [None]])
    out = whitening.transform(rows, "embedding", model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "coordinate"))
    return out.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        F.col("coordinate").alias("whitened"),
        F.element_at(explained, F.col("place") + 1).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes, with the target of its source."""
    return mixing.mix(table(spark, sf_dir, "documents")).documents.select("doc_id", "size", "source_size", "target", "taken")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    index = lexical_search.build(table(spark, sf_dir, "documents"))
    found = lexical_search.search(index, table(spark, sf_dir, "benchmark"))
    forget(index.blocks)
    return found


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc_index_merge,
        op2_benchmark_decontamination,
        op3_quality_classifier,
        op4_ngram_jaccard_join,
        op5_language_id,
        op6_suffix_array_dedup,
        op7_quality_rules,
        op8_training_order,
        op9_prefix_sum_shards,
        op10_byte_bpe,
        op11_embedding_whitening,
        op12_source_mix,
        op13_lexical_search,
    )
}

ORACLES = {
    "op1_warc_index_merge": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), g AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN p.page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id > first_id THEN first_id END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
""",
    "op7_quality_rules": None,
    "op13_lexical_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), docs AS (SELECT r, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0
), all_docs AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM docs
), tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
), q AS (
  SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms FROM benchmark
), qt AS (SELECT q, item_id, unnest(terms) AS term FROM q
), scored AS (
  SELECT q, item_id, docs.r, doc_id, sum(CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
  FROM qt JOIN df USING (term) JOIN tf USING (term) JOIN docs ON docs.r = tf.r, all_docs GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
""",
    "op12_source_mix": rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), t AS (SELECT sum(source_size)::BIGINT AS total, greatest(1, ceil(1.5::DOUBLE * sum(source_size) / {mixing.RESOLUTION}))::BIGINT AS b FROM s0
), s1 AS (
  SELECT source, source_size, b, total, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place, CAST(ceil(source_size::DOUBLE / b) AS BIGINT) AS n FROM s0, t
), s2 AS (SELECT *, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s1
), s3 AS (
  SELECT *, row_number() OVER w AS k, coalesce(sum(2 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_before,
    coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS weight_before, sum(weight) OVER ()::BIGINT AS weights
  FROM s2 WINDOW w AS (ORDER BY 2 * source_size::DOUBLE / weight, place)
), s4 AS (SELECT *, (1.5::DOUBLE * total - full_before) / (weights - weight_before) AS level FROM s3
), s5 AS (SELECT arg_min(level, k) AS level FROM s4 WHERE level * weight <= 2 * source_size
), s AS (SELECT source, source_size, b, total, place, n, least(2::DOUBLE * source_size, coalesce(s5.level * weight, 2::DOUBLE * source_size)) AS target FROM s4, s5
), chairs AS (SELECT place, target, b, total, unnest(range(0, 2 * n)) AS award FROM s
), won AS (
  SELECT place, award FROM (SELECT *, row_number() OVER (ORDER BY target / (2 * award + 1) DESC, place, award) AS r FROM chairs) WHERE r <= (3 * total + b) // (2 * b)
), turns AS (SELECT place, n, unnest(range(0, 2 * n)) AS x FROM s
), drawn AS (
  SELECT place, x % n AS block, row_number() OVER (PARTITION BY place ORDER BY x // n, substr(md5('{mixing.SEED}:' || place || ':' || (x // n) || ':' || (x % n)), 1, 15), x % n) - 1 AS award FROM turns
), times AS (SELECT place, block, count(*) AS times FROM drawn JOIN won USING (place, award) GROUP BY place, block
), blocks AS (
  SELECT place, block, coalesce(times, 0) AS times, sum(coalesce(times, 0) * least(b, source_size - block * b)) OVER (PARTITION BY place ORDER BY block)::BIGINT - coalesce(times, 0) * least(b, source_size - block * b) AS before
  FROM (SELECT place, b, source_size, unnest(range(0, n)) AS block FROM s) LEFT JOIN times USING (place, block)
), laid AS (
  SELECT doc_id, size, place, source_size, target, b, sum(size) OVER (PARTITION BY place ORDER BY substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size), 1, 15), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
)
SELECT l.doc_id, l.size, l.source_size, l.target,
  CAST(CASE WHEN l.size = 0 THEN 0 ELSE z.before + (start + size - z.block * b) * z.times - a.before - (start - a.block * b) * a.times END AS BIGINT) AS taken
FROM laid l LEFT JOIN blocks a ON a.place = l.place AND a.block = start // b LEFT JOIN blocks z ON z.place = l.place AND z.block = (start + size - 1) // b
""",
}
ORACLES = {k: v for k, v in ORACLES.items() if v}
