"""A corpus pipeline over ``documents``: quality, near-duplicates, personal data, source mix and packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that the stage before kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.llm import durable, minhash, mixing, packing, pii, quality
from scanfold.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the sparse rule ensemble does not reject."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a similarity of 0.8 over five-word shingles."""
    return minhash.one_of_each_group(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return pii.redact_documents(docs, pii.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.taken_documents(mixing.mix_sources(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in sequences of 2048.

    ``copy`` numbers the rows of ``docs``, so copies of a document stay apart. Only lengths are packed; the ids join
    their places by copy and piece, row by row.
    """
    numbered = docs.withColumn("copy", F.monotonically_increasing_id())
    pieces = durable.write(packing.tokenize_pieces(numbered, tokenizer_path(), carry=("copy",)), "pieces")
    placed = packing.place_pieces(pieces.drop("ids").withColumn("row", F.col("copy")), packing.shard_count(pieces), row_col="row")
    whole = placed.join(pieces.select("copy", "piece", "ids"), ["copy", "piece"])
    return whole.select("doc_id", "copy", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "ids", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("redact_pii", redact_pii),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Trained models and tokens are beyond SQL; tests check each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
