"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; the stages up to the last return
the columns of documents. Nulls, empty texts and tables are as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import byte_bpe, decontaminate, jaccard_join, pii, quality_rules
from canopy.llm.base import discard, scratch, stored
from canopy.llm.queries import small_batches, tokenizer_path


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that break a base rule or an adaptive threshold go."""
    small_batches(spark)
    return quality_rules.keep_good(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row stays."""
    small_batches(spark)
    return jaccard_join.one_of_each(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a passage of a benchmark item go."""
    small_batches(spark)
    return decontaminate.without_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; spans of personal data are masked, and n_chars is that of the new text."""
    masked = pii.mask_personal_data(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and whether the ids decode to the text's bytes."""
    import public_tokenizers

    small_batches(spark)
    coded = byte_bpe.encode(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", reject_low_quality),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", remove_contaminated),
    ("PII", mask_private),
    ("byte-level BPE encoding and decoding", encode_ids),
]

#: Neither sampled coordinates nor edit distances nor merges are expressible; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written and read again.

    What a stage stores on its way is deleted when its rows are written, and these when the next stage's are.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), lasting=True)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
