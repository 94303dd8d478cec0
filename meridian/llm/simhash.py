"""SimHash near-duplicates found by pigeonring filtering.

A 64-bit fingerprint is a ring of eight 8-bit segments.  If two fingerprints
differ in at most ``radius`` bits, then some position of the ring starts a
chain whose first ``l`` segments differ in at most ``l * radius / 8`` bits, for
every ``l`` up to the whole ring.  The early budgets leave no difference (0)
or one segment with a difference, so a chain's start can be looked up by equal
bits: for three bits, two exact segments and two exact of the next three, 32
bits in all.  Every further budget of the chain, the last of which is the full
Hamming distance, is checked before a pair leaves the join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, components, id_text, stored

SEGMENTS, WIDTH = 8, 8


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Unsigned SimHash of one text's word shingles; 0 without words."""
    parts = text.lower().split()  # bytes: lowers A-Z only, splits on ASCII white space
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) < words:
        spans = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = [joined[a:b] for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in spans), np.uint64, len(spans))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounds the unpacked bits of a very long text
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """``doc_id, fp`` with the fingerprint as a signed long and, if wanted, the text's MD5 as ``body``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text"):
            fps = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            bodies = [pa.array([hashlib.md5(t).digest() for t in texts], pa.binary())] if digest else []
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps, pa.int64()), *bodies], ["doc_id", "fp"] + ["body"] * digest)

    return id_text(docs, doc_id, text).mapInArrow(run, "doc_id long, fp long" + ", body binary" * digest)


def chain_budgets(radius: int) -> list[int]:
    """Most differing bits allowed in the first 1, 2, ... segments of a chain."""
    return [(n + 1) * radius // SEGMENTS for n in range(SEGMENTS)]


def _masks(radius: int) -> list[tuple[int, ...]]:
    """Segments (relative to the chain's start) that a lookup takes as equal.

    All without a budget; of those that share a budget of one, all but one.
    """
    budgets = chain_budgets(radius)
    exact = sum(b == 0 for b in budgets)
    one = [n for n in range(exact, SEGMENTS) if budgets[n] == 1]
    head = tuple(range(exact))
    return [head + rest for rest in combinations(one, len(one) - 1)] if one else [head]


def near(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """Links ``(a, b)`` between the ids of distinct fingerprints within ``radius`` bits.

    ``nodes``: ``id, fp``, one row per fingerprint.  The radius is 0 to 7, for
    which a chain's first segment is without a difference.  A pair that several
    chains find may come more than once.
    """
    if not 0 <= radius < SEGMENTS:
        raise ValueError("radius must be 0 to 7")
    if radius == 0:
        return nodes.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    rotated = lambda i: F.expr(f"shiftrightunsigned(fp, {i * WIDTH}) | shiftleft(fp, {64 - i * WIDTH})") if i else F.col("fp")
    keys = []
    for i in range(SEGMENTS):
        for v, kept in enumerate(_masks(radius)):
            mask = _signed(sum(0xFF << (WIDTH * n) for n in kept))
            keys.append(F.struct(F.lit(i * 64 + v).cast("short").alias("slot"), rotated(i).bitwiseAND(F.lit(mask)).alias("key"), rotated(i).alias("ring")))
    probe = nodes.select("id", F.explode(F.array(*keys)).alias("k")).select("id", "k.*")
    x, y = probe.alias("x"), probe.alias("y")
    differ = F.col("x.ring").bitwiseXOR(F.col("y.ring"))
    viable = F.lit(True)
    for n, budget in enumerate(chain_budgets(radius)):
        viable &= F.bit_count(differ.bitwiseAND(F.lit(_signed((1 << (WIDTH * (n + 1))) - 1)))) <= budget
    same = (F.col("x.slot") == F.col("y.slot")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id"))
    return x.join(y, same & viable).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _rooted(nodes: DataFrame, radius: int) -> DataFrame:
    """``nodes`` (one row per ``fp``) with ``root``, the smallest fingerprint reachable by links."""
    found = components(near(nodes.select(F.col("fp").alias("id"), "fp"), radius))
    return nodes.join(found, nodes["fp"] == found["node"], "left").select(nodes["*"], F.coalesce("component", "fp").alias("root"))


def groups(docs: DataFrame, words: int = 3, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document.

    The nodes of the link graph are the distinct fingerprints, so copies never
    meet pairwise, and an id that several texts carry links nothing; a
    fingerprint has a bounded number of others within the radius.  Empty and
    null texts share the fingerprint zero.  ``component_id`` is the smallest id
    reachable; a fingerprint that only rows without an id have takes part in
    no component, and its rows get null.
    """
    rows = stored(fingerprints(docs, words, doc_id, text), "simhash")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-nodes")
    rooted = stored(_rooted(nodes.where("id is not null"), radius), "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 3, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input rows, with one document kept of each group of linked fingerprints.

    It is the one of the smallest id, of several texts with that id the one of
    the smallest MD5, of several rows with that text the one of the smallest
    hash over all columns: a fixed choice, whatever ids repeat.  Rows without
    an id come last.
    """
    rows = stored(fingerprints(docs, words, doc_id, text, digest=True), "simhash-texts")
    rooted = _rooted(rows.select("fp").distinct(), radius)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "body")
    texts = rows.groupBy("fp").agg(F.min(order).alias("o"))  # one row a fingerprint before groups meet
    keep = texts.join(rooted, "fp").groupBy("root").agg(F.min("o").alias("o")).select(F.col("o.doc_id").alias("_id"), F.col("o.body").alias("_body"))
    body = F.unhex(F.md5(F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary")))
    held = docs.withColumn("_text_md5", body)
    held = held.join(keep, held[doc_id].cast("long").eqNullSafe(F.col("_id")) & (F.col("_text_md5") == F.col("_body")), "left_semi")
    row = F.struct(*[F.col(c) for c in docs.columns])
    one = held.groupBy("_text_md5").agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("r"))
    return one.select(*[F.col(f"r.{c}").alias(c) for c in docs.columns])
