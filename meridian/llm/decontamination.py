"""Benchmark decontamination: item-sized SimHash windows, a multi-index Hamming
search and an exact weighted-shingle check.

A window as long as a benchmark item slides over a document wherever the
document shares a shingle with an item of that length (a window without one
cannot be similar); a document shorter than the item is one window as a whole.
The window's 64-bit SimHash is looked up in blocks: fingerprints
within ``radius`` bits differ in at most ``radius // blocks`` bits in some
block, so tables that list, per block value, the items that near find all of
them.  Candidates within the radius are then compared exactly, by the weighted
Jaccard similarity of their shingle counts.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, id_text

#: Bytes of benchmark text indexed at once; a larger benchmark goes in several passes over the documents.
INDEX_BYTES = 8 << 20
#: Distinct raw words whose hashes a worker remembers.
MEMORY = 400_000
BLOCKS = 8
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """64-bit hashes of a text's words, lower-cased, without punctuation at their ends."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        raw = text.split()
        for w in set(raw).difference(known):
            # Plain ASCII words need no decoding.
            core = w.lower() if w.isalnum() else _EDGE.sub("", w.decode("utf-8", "replace").lower()).encode()
            known[w] = xxhash.xxh64_intdigest(core, 1) | 1 if core else 0
        h = np.fromiter(map(known.__getitem__, raw), np.uint64, len(raw))
        return h[h != 0]  # punctuation alone is no word


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; shorter sequences are one run."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ words[i : i + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _bits(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each hash."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


class Index:
    """Benchmark items by length, with their block tables."""

    def __init__(self, items: list[tuple[int, bytes]], k: int, radius: int):
        words, self.k, self.radius = Words(), k, radius
        by_size = defaultdict(list)
        self.sizes_of: dict[int, set[int]] = defaultdict(set)
        for item, text in items:
            w = words(text)
            if len(w):
                s = shingles(w, k)
                by_size[len(w)].append((item, s))
                for h in s.tolist():
                    self.sizes_of[h].add(len(w))
        self.all = np.array(sorted(self.sizes_of), np.uint64)
        # A bitmap over the hashes' low bits dismisses nearly every shingle of a clean text.
        self.bits = max(16, (64 * max(1, len(self.all)) - 1).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.all & np.uint64((1 << self.bits) - 1)] = True
        self.widths = sorted({min(k, n) for n in by_size})
        self.by_size = {}
        few = radius // BLOCKS
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)) <= few
        for n, group in by_size.items():
            fps = np.concatenate([_pack(_bits(s).sum(0, keepdims=True)) for _, s in group])
            blocks = fps.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
            tables = [near[:, blocks[:, b]] for b in range(BLOCKS)]  # [value, item]
            self.by_size[n] = ([i for i, _ in group], fps, tables, [Counter(s.tolist()) for _, s in group])

    def hits(self, s: np.ndarray) -> np.ndarray:
        """Positions of the shingles that some item has."""
        maybe = np.flatnonzero(self.seen[s & np.uint64((1 << self.bits) - 1)])
        if not len(maybe):
            return maybe
        at = np.minimum(np.searchsorted(self.all, s[maybe]), len(self.all) - 1)
        return maybe[self.all[at] == s[maybe]]

    def search(self, words: np.ndarray, similarity: float) -> dict[int, tuple[float, int, int, int]]:
        """Best window of each matching item: ``item -> (similarity, -distance, start, words)``."""
        best: dict[int, tuple[float, int, int, int]] = {}
        for width in self.widths:
            if len(words) < width:
                continue
            s = shingles(words, width)
            at = self.hits(s)
            if not len(at):
                continue
            near = defaultdict(list)
            for p in at.tolist():
                for n in self.sizes_of[int(s[p])]:
                    # With all its m shingles shared, a window is m / m_item similar to a longer item.
                    if min(self.k, n) == width and len(s) >= similarity * (n - width + 1) - 1e-6:
                        near[n].append(p)
            for n, where in near.items():
                self._windows(s, n, n - width + 1, min(n, len(words)), np.array(where), similarity, best)
        return best

    def _windows(self, s, n, m_item, size, where, similarity, best) -> None:
        m = min(m_item, len(s))
        # Starts of windows of m shingles that hold a hit, in maximal runs.
        starts = np.zeros(len(s) - m + 2, np.int32)
        np.add.at(starts, np.maximum(0, where - m + 1), 1)
        np.add.at(starts, np.minimum(where, len(s) - m) + 1, -1)
        covered = np.flatnonzero(np.cumsum(starts[:-1]) > 0)
        ids, fps, tables, counts = self.by_size[n]
        for run in np.split(covered, np.flatnonzero(np.diff(covered) > 1) + 1):
            for lo in range(0, len(run), 4096):  # bounds the bit sums held at once
                part = run[lo : lo + 4096]
                bits = _bits(s[part[0] : part[-1] + m])
                sums = np.cumsum(np.vstack([np.zeros((1, 64), np.int32), bits]), axis=0)
                fp = _pack(sums[m:] - sums[:-m])
                blocks = fp.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
                found = tables[0][blocks[:, 0]].copy()
                for b in range(1, BLOCKS):
                    found |= tables[b][blocks[:, b]]
                w, i = np.nonzero(found)
                d = np.bitwise_count(fp[w] ^ fps[i])
                for w, i, d in zip(*(x[d <= self.radius].tolist() for x in (w, i, d)), strict=True):
                    here = Counter(s[part[0] + w : part[0] + w + m].tolist())
                    both = sum((here & counts[i]).values())
                    value = both / (m + m_item - both)
                    if value >= similarity:
                        best[ids[i]] = max(best.get(ids[i], (0.0, 0, 0, 0)), (value, -d, -int(part[0] + w), size))


def _indexes(bench: DataFrame, k: int, radius: int, item_id: str, text: str) -> list[Index]:
    """One index per ``INDEX_BYTES`` of benchmark; what the driver holds at once is so bounded."""
    items = id_text(bench, item_id, text).where("text is not null").select(F.col("doc_id").alias("item"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(total) // INDEX_BYTES))
    for p in range(parts):
        held = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == p)
        yield Index([(r["item"], r["text"].encode()) for r in held.distinct().toLocalIterator()], k, radius)


def find(docs: DataFrame, bench: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 20,
         doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, similarity, distance, word_start, n_words``: the best window of each document and item.

    Items and documents are lower-cased words without punctuation at their
    ends; an item of fewer than ``words`` words is one shingle.  A window of
    the item's length (the whole document if that is shorter) is reported when
    its fingerprint lies within ``radius`` bits of the item's and the weighted
    Jaccard similarity is ``similarity`` or more; ties go to the nearer fingerprint, then the earlier window.  Null and
    empty texts and items match nothing; repeated rows repeat their result.
    """
    docs, out = id_text(docs, doc_id, text), None
    for index in _indexes(bench, words, radius, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            words_of = Words()
            for part, texts in chunks(batches, "text"):
                rows = [(d, i, v[0], -v[1], -v[2], v[3]) for d, t in zip(part.column("doc_id").to_pylist(), texts, strict=True) for i, v in sorted(index.search(words_of(t), similarity).items(), key=lambda x: (x[0] is None, x[0]))]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], _NAMES)

        found = docs.mapInArrow(run, "doc_id long, item_id long, similarity double, distance int, word_start int, n_words int")
        out = found if out is None else out.unionByName(found)
    return out


_NAMES = ["doc_id", "item_id", "similarity", "distance", "word_start", "n_words"]
_TYPES = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]


def clean(docs: DataFrame, bench: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 20, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The input rows whose text holds no window similar to a benchmark item."""
    for index in _indexes(bench, words, radius, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            words_of = Words()
            for part, texts in chunks(batches, text):
                yield part.filter(pa.array([not index.search(words_of(t), similarity) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
