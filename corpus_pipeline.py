"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and reads all that the one before kept.

All stages but the last return the rows of ``documents`` that they keep, with
their columns. Rows without doc_id pass the near-duplicate stage; null texts count
as empty in every stage.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neumes.llm.bpe import bpe_encode
from neumes.llm.common import table, written
from neumes.llm.decontamination import drop_contaminated
from neumes.llm.exact_dedup import drop_copies
from neumes.llm.near_dedup import drop_near_copies
from neumes.llm.quality import drop_low_quality
from neumes.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the digest of the decoded text."""
    return bpe_encode(docs, tokenizer_path()).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontamination", decontamination), ("bpe", bpe)]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
