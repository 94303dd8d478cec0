"""Substring dedup by a fixed-length search in FM-indexes.

Passages that share an anchor with another document (see ``repeats``) are dealt
to shards.  A shard builds an FM-index over its passages: the
Burrows-Wheeler transform of their words in a wavelet matrix of bit-packed
levels with popcount ranks, and the full suffix array beside it.  The same
passages are then searched in it.  No match lengths are computed and no
documents are streamed through the shards, as only windows of the threshold's
length decide: for the window ending at each word a backward search extends the match to the left, all
windows in lockstep, and drops those whose interval has shrunk to one
occurrence.  Windows that reach the threshold report the smallest document of
their interval, from a sparse table over the suffix order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import repeats
from .common import chunks

GRAM = 5
#: Bytes up to which words are hashed together; longer ones one by one.
LONG = 64

#: Which bytes are ASCII white space, the bytes of a word's last step that belong to it, and an odd factor between steps.
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_HEAD = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_STEP = np.uint64(0x9FB21C651E98DF25)
#: Masks of the bits below each bit of a word.
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class FMIndex:
    """FM-index of a sequence of small integers, for patterns of at most ``depth`` symbols."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        rank, width = text.astype(np.int64), 1
        top = int(rank.max(initial=0)) + 1
        while True:  # doubles the sorted prefix
            key = rank * (top + 1)
            key[:-width] += rank[width:] + 1
            order = np.argsort(key)
            sorted_ = key[order]
            width *= 2
            fresh = sorted_[1:] != sorted_[:-1]
            if width >= depth or fresh.all():
                break
            rank = np.empty(n, np.int64)
            rank[order[:1]], rank[order[1:]] = 0, np.cumsum(fresh)
            top = n
        self.suffixes = order
        bwt = text[self.suffixes - 1]
        self.levels = max(1, int(text.max(initial=0)).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.levels))]).astype(np.int64)
        self.words, self.counts, self.zeros = [], [], []
        cur = bwt
        for level in range(self.levels - 1, -1, -1):
            bits = (cur >> level) & 1 == 1
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            raw = np.packbits(bits, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view("<u8")
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(n - int(bits.sum()))
            cur = np.concatenate([cur[~bits], cur[bits]])
        symbols = np.arange(1 << self.levels)
        self.origin = self._walk(symbols, np.zeros(len(symbols), np.int64))

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            words, counts, zeros = self.words[level], self.counts[level], self.zeros[level]
            w = i >> 6
            ones = counts[w] + np.bitwise_count(words[w] & _BELOW[i & 63])
            bit = (symbol >> (self.levels - 1 - level)) & 1 == 1
            i = np.where(bit, zeros + ones, i - ones)
        return i

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after putting ``symbol`` before the patterns of ``[lo, hi)``."""
        base = self.before[symbol] - self.origin[symbol]
        both = self._walk(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return base + both[: len(lo)], base + both[len(lo) :]


def least_in(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Smallest value of every non-empty range, by a sparse table."""
    out, size = np.empty(len(lo), values.dtype), hi - lo
    level, have = 0, values
    top = np.frexp(size.astype(float))[1] - 1
    for k in range(int(top.max(initial=0)) + 1):
        here = top == k
        out[here] = np.minimum(have[lo[here]], have[hi[here] - (1 << k)])
        have = np.minimum(have[: len(have) - (1 << k)], have[1 << k :]) if len(have) > 1 << k else have
        level += 1
    return out


def _decide(window: int):
    def decide(rows: pa.Table) -> tuple[np.ndarray, ...]:
        bodies, m = rows.column("body").to_pylist(), rows.column("n").to_numpy().astype(np.int64)
        least = rows.column("least").to_numpy()
        lens = np.fromiter((b.count(b" ") for b in bodies), np.int64, len(bodies)) + 1
        flat = pd.factorize(np.array(b" ".join(bodies).split(b" "), object))[0].astype(np.int64) + 1
        base = np.cumsum(lens + 1) - lens - 1
        text = np.zeros(len(flat) + len(bodies), np.int64)  # 0 ends a passage
        owner = np.repeat(np.arange(len(bodies)), lens + 1)
        inside = np.ones(len(text), bool)
        inside[base + lens] = False
        text[inside] = flat
        index = FMIndex(text, window)
        last = np.repeat(base + window - 1, m) + (np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m))
        result = np.full(len(last), repeats.NO_ID)
        live = np.arange(len(last))
        lo, hi = index.before[text[last]], index.before[text[last] + 1]  # suffixes that begin with the last word
        for step in range(window):
            if step:
                lo, hi = index.extend(text[last[live] - step], lo, hi)
            many = hi - lo > 1
            live, lo, hi = live[many], lo[many], hi[many]
            if not len(live):
                break
        if len(live):
            result[live] = least_in(least[owner[index.suffixes]], lo, hi)
        alone = np.repeat(least, m)  # an interval of one: the passage itself, in its smallest document
        result = np.minimum(result, alone)
        owner, first, stop, best = repeats.runs(result, m)
        # The only document of a passage has nothing to lose to itself.
        some = (best < least[owner]) | (rows.column("copies").to_numpy()[owner] > 1)
        return owner[some], first[some], stop[some], best[some]

    return decide


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of the words of every text, all words of all texts at once, eight bytes a step."""
    starts = np.cumsum([1, *(len(t) + 1 for t in texts)])
    laid = np.frombuffer(b" " + b" ".join([*texts, b" " * 8]), np.uint8)  # read in words of eight bytes
    space = _SPACE[laid]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    first, size = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray(len(laid) - 7, "<u8", laid, strides=(1,))
    out = size.astype(np.uint64)
    live = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        live = live[size[live] > k]
        out[live] = repeats.mix(out[live] * _STEP + (eight[first[live] + k] & _HEAD[np.minimum(size[live] - k, 8)]))
    for i in np.flatnonzero(size > LONG):
        out[i] = xxhash.xxh64_intdigest(laid[first[i] : first[i] + size[i]], 3)
    at = np.searchsorted(first, starts)
    return [out[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _units(text: bytes) -> np.ndarray:
    return word_hashes([text])[0]


def remove_repeats(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept``) of every row.

    Words are runs of bytes other than ASCII white space.  Removes each word
    covered by a run of ``window`` words that also starts in a document with a
    smaller id.  Rows of one id never remove each other's words; a null id is
    greater than any other.  Null and empty texts have no words.
    """
    if window <= GRAM:
        raise ValueError(f"window must be over {GRAM} words")
    kind = repeats.Kind("words", window, GRAM, _units, bytes.split, lambda words, a, b: b" ".join(words[a:b]), across=True, all_units=word_hashes)
    found = repeats.spans(docs, kind, _decide(window), False, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text"):
            cols = [[], [], [], []]
            for t, s in zip(texts, part.column("spans").to_pylist(), strict=True):
                words, left = t.split(), []
                total, upto = len(words), 0
                for a, b in repeats.merged(s):
                    left += words[upto:a]
                    upto = b
                left = left + words[upto:] if upto else words
                kept = b" ".join(left)
                for c, v in zip(cols, (total, total - len(left), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            names = ["n_words", "n_removed", "kept_sha256", "kept"]
            upto = 4 if with_text else 3
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays[:upto]], ["doc_id", *names[:upto]])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    return found.select("doc_id", "text", "spans").mapInArrow(run, schema)
