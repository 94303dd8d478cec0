"""Registered queries of the training-data operators.

Each ``opN_*`` applies its operator with production parameters to its whole
table and derives the digest columns from the operator's output.
"""

from __future__ import annotations

import os
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, counting, decontamination, embedding_dedup, manifest, oracles, packing, resampling, secrets, sharding, simhash, substring_dedup, suffix_dedup, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file: the folder in MERIDIAN_TOKENIZERS, else the installed package's."""
    folder = os.environ.get("MERIDIAN_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    if public_tokenizers.PATTERN != packing.PATTERN:
        raise ValueError("the operators' pre-tokenisation is written for another split pattern")
    return public_tokenizers.path(name)


def held_out(doc_id) -> Column:
    """Rows kept from learning: those whose CRC-32 of the id as text is divisible by five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return toxicity.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.links(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"), words=3, radius=3)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=13)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), words=5, similarity=0.8)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=400)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.kind.isin(*secrets.KINDS[:3]))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, secrets.KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), capacity=2048, end=0)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), buckets=10_000, grams=1, least_words=20, percent=10, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return manifest.build(docs, tampered=tampered, tamper={"text": lower})


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_toxicity, op2_embedding_dedup, op3_byte_bpe, op4_token_counts, op5_simhash, op6_substring_dedup, op7_decontamination, op8_suffix_dedup, op9_secret_scan, op10_sharding, op11_best_fit_packing, op12_importance_resampling, op13_merkle_manifest)}
#: DuckDB twins, for those that SQL can express.
ORACLE: dict[str, str] = oracles.ORACLE
