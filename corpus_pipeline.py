"""The training-corpus pipeline: toxicity filter, SimHash near-dedup, benchmark
decontamination, secret redaction, byte-level BPE.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its
predecessor kept; ``run`` writes every stage's result as Parquet under the
shared checkpoint folder and reads it back, so a lost executor never costs more
than the running stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm import bpe, decontamination, secrets, simhash, toxicity
from meridian.llm.common import stored, table
from meridian.llm.queries import held_out, tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the CRF model does not predict as toxic; it learns from labels that are not held out."""
    labels = table(spark, sf_dir, "labels")
    return toxicity.clean(docs, toxicity.fit(docs, labels.where(~held_out(F.col("doc_id")))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of every group of documents linked by SimHash."""
    return simhash.one_of_each(docs, words=3, radius=3)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window similar to a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), words=5, similarity=0.8)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked and ``n_chars`` kept in step."""
    return secrets.redact(docs, length="n_chars")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text, encoded and decoded."""
    return bpe.digests(docs, tokenizer("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scan", mask_secrets),
    ("byte_bpe", tokenize),
]
#: Fitted models, fingerprints and merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
