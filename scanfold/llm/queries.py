"""The queries of this subpackage: (spark, sf_dir) -> DataFrame, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, durable, mixing, negatives, packing, pii, quality, suffixes, urlfilter, warc
from .fingerprint import edited_fingerprints
from .minhash import minhash_components
from .neighbours import similar_vectors
from .passages import repeated_passages

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, links at 100 * intersection >= 85 * union."""
    return minhash_components(_table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(_table(spark, sf_dir, "embeddings"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    pieces = packing.tokenize_pieces(docs, tokenizer_path(), carry=("row",))
    light = durable.write(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "row"), "pieces")
    return packing.place_pieces(light, packing.shard_count(light), row_col="row")


def _base_counts(found: DataFrame) -> DataFrame:
    counts = [F.col("n_base").getItem(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, "base_sha256", "spans")


def op4_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of base spans, which the contract fixes; ``spans`` holds all."""
    docs = _table(spark, sf_dir, "documents")
    return _base_counts(pii.find_pii(docs, pii.train(docs)))


def op5_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"))


def op7_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_table(spark, sf_dir, "documents"))


def op8_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, model)
    return scored.select("doc_id", quality.is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sized = durable.write(docs.select(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), mixing.word_count(F.col("text")).alias("mix_size")), "sized")
    sizes = sized.groupBy(F.col("mix_source").alias("source")).agg(F.sum("mix_size").alias("source_size"), F.count("*").alias("n_docs"))
    mixed = mixing.systematic_copies(sized, mixing.source_targets(sizes))
    return mixed.select(F.col("mix_id").alias("doc_id"), F.col("mix_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("mix_size")).alias("taken"))


def op11_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.drop_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_distance_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(negatives.prepared(_table(spark, sf_dir, "embeddings")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(conversations.damaged(_table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_dedup, op2_nn_descent, op3_best_fit_packing, op4_pii_boosting, op5_warc_normaliser, op6_url_vocabulary, op7_bottom_k_fingerprints, op8_chained_passages, op9_quality_rules, op10_systematic_mixing, op11_difference_cover, op12_distance_keys, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op6_url_vocabulary": urlfilter.oracle_sql(), "op10_systematic_mixing": mixing.ORACLE_SQL, "op5_warc_normaliser": WARC_SQL, "op11_difference_cover": suffixes.ORACLE_SQL, "op12_distance_keys": negatives.ORACLE_SQL, "op13_conversation_repair": conversations.ORACLE_SQL}


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to FROM f
"""
