"""Importance resampling towards a target distribution by bit-sliced aggregation.

Words (or runs of words) fall into hash buckets.  Two passes over the corpus:
the first counts buckets over all documents and all target texts, which fixes
one integer gain per bucket; the second weighs every document.  A document's
bucket counts become bit planes of one bit per bucket, the gains two's-complement
planes of the same shape; ``AND``, popcount and sums with powers of two give the
exact integer dot product of counts and gains, without a floating-point sum.
Scores are integers of a bounded range, so a histogram of them finds the score
below which nothing is drawn, and only the rows above it are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, id_text, numbered, stored

#: Words whose bucket a worker remembers, and documents whose planes it holds at once.
MEMORY, DOCS_AT_ONCE = 500_000, 128

#: Byte to byte: A-Z lower-cased; of ASCII, all but digits and letters separate words.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Buckets:
    """Hash buckets of a text's features: all runs of 1 to ``grams`` words."""

    def __init__(self, buckets: int, grams: int):
        self.buckets, self.grams, self._known = buckets, grams, {}

    def __getstate__(self):
        return {"buckets": self.buckets, "grams": self.grams, "_known": {}}

    def of(self, raw: bytes) -> tuple[int, list[int]]:
        """Number of words, and the bucket of every feature, repeats included."""
        words, known, n = raw.translate(_WORD).split(), self._known, self.buckets
        if len(known) > MEMORY:
            known.clear()
        for w in set(words).difference(known):
            known[w] = zlib.crc32(w) % n
        out = list(map(known.__getitem__, words))
        for k in range(2, self.grams + 1):
            out += [zlib.crc32(b" ".join(words[i:i + k])) % n for i in range(len(words) - k + 1)]
        return len(words), out


def bucket_counts(docs: DataFrame, features: Buckets, text: str = "text") -> DataFrame:
    """``bucket, n`` over all texts: a task sums its own, then one row per task and bucket is added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(features.buckets, np.int64)
        for _, raw in chunks(batches, "text"):
            for body in raw:
                total += np.bincount(np.array(features.of(body)[1], np.int64), minlength=features.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = docs.select(docs[text].cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """Integer gain of every bucket: a thousand times the log ratio of smoothed shares, floored."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    ratio = (float(target.get(b, 0) + 1) * s_all / (float(source.get(b, 0) + 1) * t_all) for b in range(buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def planes(values: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of non-negative or two's-complement integers: ``(..., bits, words of 64)``."""
    width = -(-values.shape[-1] // 64) * 8
    out = np.zeros((*values.shape[:-1], bits, width), np.uint8)
    for k in range(bits):
        packed = np.packbits((values >> k & 1).astype(bool), axis=-1, bitorder="little")
        out[..., k, :packed.shape[-1]] = packed
    return out.view(np.uint64)


def weigh(counts: np.ndarray, gain_planes: np.ndarray) -> np.ndarray:
    """Exact ``counts @ gains`` of a block of documents; the last gain plane is the sign's."""
    mine = planes(counts, max(1, int(counts.max(initial=0)).bit_length()))
    power = np.left_shift(1, np.arange(mine.shape[1], dtype=np.int64))
    out = np.zeros(len(counts), np.int64)
    for j, plane in enumerate(gain_planes):
        found = np.bitwise_count(mine & plane).sum(-1, dtype=np.int64) @ power << j
        out += -found if j == len(gain_planes) - 1 else found
    return out


def weights(docs: DataFrame, gain: np.ndarray, features: Buckets, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the floored mean gain of a document's features (none: 0)."""
    signed = planes(gain, int(np.abs(gain).max(initial=0)).bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in chunks(batches, "text"):
            for at in range(0, len(raw), DOCS_AT_ONCE):
                words, found = zip(*map(features.of, raw[at:at + DOCS_AT_ONCE]), strict=True)
                n = np.array([len(f) for f in found], np.int64)
                counts = np.stack([np.bincount(np.array(f, np.int64), minlength=features.buckets) for f in found])
                mean = weigh(counts, signed) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").slice(at, len(n)), pa.array(words, pa.int64()), pa.array(n), pa.array(mean)],
                    ["doc_id", "n_words", "n_features", "weight"])

    return id_text(docs, doc_id, text).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, grams: int = 1, least_words: int = 20, percent: int = 10, seed: int = 2024,
             doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """Draw ``percent`` of the documents of ``least_words`` or more towards the target's word distribution.

    Returns every document's ``doc_id, n_words, n_features, weight, score,
    rank``; ``rank`` counts the drawn ones from 1 by falling score, ties to the
    smaller id (null first; rows with equal ids by ``n_features`` and
    ``weight``), and is null for the others.  ``score`` adds to the weight a
    Gumbel draw that only the id and the seed decide, so that the highest
    scores are a sample without replacement.  Null and empty texts have no
    features and weight 0; a null id is hashed as the empty text; repeated rows
    are documents of their own; further columns are ignored; an empty table
    gives no rows, an empty target pulls nowhere.
    """
    features = Buckets(buckets, grams)
    count = lambda df, col: {r["bucket"]: r["n"] for r in bucket_counts(df, features, col).collect()}  # noqa: E731  at most ``buckets`` rows
    gain = gains(count(docs, text), count(target, target_text), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(weights(docs, gain, features, doc_id, text).withColumn("score", F.col("weight") + gumbel), "resampling-scores")
    able = F.col("n_words") >= least_words
    # Scores lie within a few ten thousand integers of 0, whatever the number of documents.
    histogram = {r["score"]: r["n"] for r in scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()}
    quota = sum(histogram.values()) * percent // 100
    taken, lowest = 0, None
    for score in sorted(histogram, reverse=True):
        if taken >= quota:
            break
        taken, lowest = taken + histogram[score], score
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if lowest is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    above = able & (F.col("score") >= lowest)
    # A range-partitioned sort; the row's place in the stored table splits even equal keys.
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("row")]
    ordered, _ = numbered(scored.where(above).withColumn("row", F.monotonically_increasing_id()), order, "resampling-drawn")
    rank = F.col("nth") + 1
    drawn = ordered.select(*columns, F.when(rank <= quota, rank).alias("rank"))
    return drawn.unionByName(scored.where(~above).select(*columns, F.lit(None).cast("long").alias("rank")))
