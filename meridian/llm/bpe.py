"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

Pre-tokenisation runs on arrays, without regular expressions.  Every code point
becomes a symbol (letter, number, other, spaces by what follows them,
apostrophes that can open a contraction).  A small automaton over those symbols
says where a slice begins; its transition functions form a finite monoid, so
the state before every position comes from an associative scan that composes
functions pairwise over doubling distances and stops where they have become
constant, after two doublings at most.  The slices feed a cache of merged
words; unknown slices are merged together, one lowest-ranked pair per word and
round, from a sorted table of mergeable pairs.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, id_text

#: Slices whose ids a worker remembers, and the longest of them in bytes.
MEMORY, LONG_SLICE = 300_000, 64
#: Slices beyond so many bytes are merged by themselves with a queue of pairs: rounds over
#: the whole slice would cost the square of its length.
QUEUED_SLICE = 256

# Symbols.  SPACE stands before something that absorbs it; BLANK is other white
# space; END separates texts.  OPEN1 and OPEN2 are apostrophes followed by a
# contraction of one or two letters.
LETTER, NUMBER, OTHER, SPACE, BLANK, OPEN1, OPEN2, END = range(8)
# States: what the slice before the next position looks like.  LEFT1 and LEFT2
# count letters of a contraction still to come; FRESH: the next position begins a slice.
FRESH, IN_LETTER, IN_NUMBER, IN_OTHER, AFTER_SPACE, LEFT1, LEFT2 = range(7)
_NEXT = {
    LETTER: [IN_LETTER, IN_LETTER, IN_LETTER, IN_LETTER, IN_LETTER, FRESH, LEFT1],
    NUMBER: [IN_NUMBER] * 7,
    OTHER: [IN_OTHER] * 7,
    SPACE: [AFTER_SPACE] * 7,
    BLANK: [FRESH] * 7,
    OPEN1: [LEFT1, LEFT1, LEFT1, IN_OTHER, IN_OTHER, LEFT1, LEFT1],
    OPEN2: [LEFT2, LEFT2, LEFT2, IN_OTHER, IN_OTHER, LEFT2, LEFT2],
    END: [FRESH] * 7,
}
_JOINS = {  # states in which a symbol continues the slice before it
    LETTER: (IN_LETTER, AFTER_SPACE, LEFT1, LEFT2), NUMBER: (IN_NUMBER, AFTER_SPACE), OTHER: (IN_OTHER, AFTER_SPACE),
    OPEN1: (IN_OTHER, AFTER_SPACE), OPEN2: (IN_OTHER, AFTER_SPACE),
}


def _monoid():
    """Codes of all compositions of the transition functions, and their product table."""
    codes: dict[tuple, int] = {}
    for s in range(8):
        codes.setdefault(tuple(_NEXT[s]), len(codes))
    while True:
        known = list(codes)
        for f in known:
            for g in known:
                codes.setdefault(tuple(g[x] for x in f), len(codes))
        if len(codes) == len(known):
            break
    n = len(codes)
    product = np.zeros((n, n), np.uint8)
    for f, i in codes.items():
        for g, j in codes.items():
            product[i, j] = codes[tuple(g[x] for x in f)]
    first = np.array([codes[tuple(_NEXT[s])] for s in range(8)], np.uint8)
    constant = np.array([len(set(f)) == 1 for f in codes])
    state = np.array([f[FRESH] for f in codes], np.uint8)
    return product, first, constant, state


_PRODUCT, _FIRST, _CONSTANT, _STATE = _monoid()
_BEGINS = np.ones((8, 7), bool)
for _s, _in in _JOINS.items():
    _BEGINS[_s, list(_in)] = False
_END_MARK = 0x110000


def class_table() -> np.ndarray:
    """Class of every code point, as the encoding library's own expressions see it.

    The library's Unicode tables are probed once, on the driver, with
    one-class patterns over all code points.
    """
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    table = np.full(_END_MARK + 1, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        hit = probe.decode_bytes(probe.encode_ordinary(every)).decode()
        table[np.frombuffer(hit.encode("utf-32-le"), np.uint32)] = kind
    table[_END_MARK] = END
    return table


def scan_states(symbols: np.ndarray) -> np.ndarray:
    """State before every position, by an associative scan over transition functions."""
    f = _FIRST[symbols]
    step, n = 1, len(f)
    open_ = np.flatnonzero(~_CONSTANT[f])
    while len(open_) and step < n:
        open_ = open_[open_ >= step]
        f[open_] = _PRODUCT[f[open_ - step], f[open_]]  # right sides are read before any is written
        open_ = open_[~_CONSTANT[f[open_]]]
        step *= 2
    before = np.empty(n, np.uint8)
    if n:
        before[0] = FRESH
        before[1:] = _STATE[f[:-1]]
    return before


def begins(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether a slice begins at each code point; texts end in ``_END_MARK``."""
    symbols = classes[points]
    blank = symbols == BLANK
    n = len(points)
    solid_next = np.zeros(n, bool)
    solid_next[:-1] = ~blank[1:] & (symbols[1:] != END)
    begin_run = blank.copy()
    begin_run[1:] &= ~blank[:-1]
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        padded = np.concatenate([points, np.full(2, _END_MARK, points.dtype)])
        a, b = padded[quotes + 1], padded[quotes + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        symbols[quotes[one]], symbols[quotes[two]] = OPEN1, OPEN2
    symbols[solid_next & blank & (points == 0x20)] = SPACE
    out = _BEGINS[symbols, scan_states(symbols)]
    # White space: a run's first, and its last before something solid.
    out[blank] = (begin_run | solid_next)[blank]
    return out


class Merges:
    """Ranks of a vocabulary with the tables that merge and decode need."""

    def __init__(self, ranks: dict[bytes, int], classes: np.ndarray):
        self.ranks, self.classes = ranks, classes
        self._ready = False

    def __getstate__(self):
        return {"ranks": self.ranks, "classes": self.classes, "_ready": False}

    @classmethod
    def load(cls, path: str) -> Merges:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, filter(None, f.read().splitlines()))}
        return cls(ranks, class_table())

    def prepare(self) -> Merges:
        if not self._ready:
            ranks = self.ranks
            pairs = {}
            for word, rank in ranks.items():
                for i in range(1, len(word)):
                    a, b = ranks.get(word[:i]), ranks.get(word[i:])
                    if a is not None and b is not None:
                        pairs[a << 32 | b] = rank
            self.keys = np.array(sorted(pairs), np.int64)
            self.merged = np.array([pairs[k] for k in self.keys.tolist()] + [0], np.int64)
            self.pairs = pairs
            self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
            self.words = [b""] * (max(ranks.values()) + 1)
            for word, rank in ranks.items():
                self.words[rank] = word
            self.decimal = [str(i) for i in range(len(self.words))]
            self.known: dict[bytes, bytes] = {}
            self._ready = True
        return self

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.merged[at], _NONE) if len(self.keys) else np.full(len(key), _NONE)

    def merge_queued(self, word: bytes) -> bytes:
        """Ids of one long word in n log n: neighbours in a linked list, their ranked pairs in a heap.

        A pair taken from the heap counts only if both its ends still are what
        they were when it was put there.
        """
        pairs, n = self.pairs, len(word)
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rank := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j == n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (new := pairs.get(rank << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (new, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (new := pairs.get(ids[h] << 32 | rank)) is not None:
                heapq.heappush(heap, (new, h, ids[h], rank))
        return np.array([x for x in ids if x >= 0], np.uint32).tobytes()

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids (uint32 bytes) of each word: the lowest-ranked pair first, leftmost among equals."""
        out: list[bytes] = [b""] * len(words)
        for i, word in enumerate(words):
            if len(word) > QUEUED_SLICE:
                out[i] = self.merge_queued(word)
        words = [b"" if len(w) > QUEUED_SLICE else w for w in words]
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)]
        name = np.flatnonzero(lens)
        lens = lens[name]
        while len(name):
            start = np.cumsum(lens) - lens
            rank = np.full(len(ids), _NONE)
            if len(ids) > 1:
                rank[:-1] = self._rank(ids[:-1], ids[1:])
            rank[start + lens - 1] = _NONE  # pairs do not cross words
            least = np.minimum.reduceat(rank, start)
            done = least == _NONE
            if done.any():
                flat = ids.astype(np.uint32).tobytes()
                for i, s, n in zip(name[done].tolist(), start[done].tolist(), lens[done].tolist(), strict=True):
                    out[i] = flat[4 * s : 4 * (s + n)]
                keep = np.repeat(~done, lens)
                ids, rank, name, lens, least = ids[keep], rank[keep], name[~done], lens[~done], least[~done]
                if not len(name):
                    break
                start = np.cumsum(lens) - lens
            hit = np.flatnonzero(rank == np.repeat(least, lens))
            owner = np.repeat(np.arange(len(name)), lens)[hit]
            hit = hit[np.concatenate([[True], owner[1:] != owner[:-1]])]  # leftmost of each word
            ids[hit] = least
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids, lens = ids[keep], lens - 1
        return out

    def encode(self, texts: list[bytes], with_starts: bool = False) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """Ids of every text and, if wanted, the byte offset at which each token begins."""
        self.prepare()
        decoded = [t.decode("utf-8", "replace") for t in texts]
        mark = np.array([_END_MARK], np.uint32)
        points = np.concatenate([x for t in decoded for x in (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), mark)] or [mark[:0]])
        flags = begins(points, self.classes)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        width[points == _END_MARK] = 0
        offset = np.cumsum(width) - width
        ends = np.flatnonzero(points == _END_MARK)
        slices = np.flatnonzero(flags | (points == _END_MARK))
        raw = b"".join(t.encode("utf-8", "surrogatepass") for t in decoded)
        cuts = offset[slices].tolist()
        parts = [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]  # an end mark's slice is empty
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        here = {b"": b""}
        new = [w for w in set(parts) if w and w not in known]
        here.update(zip(new, self.merge(new), strict=True))
        known.update((w, v) for w, v in here.items() if len(w) <= LONG_SLICE)
        look = known.__getitem__ if all(len(w) <= LONG_SLICE for w in new) else lambda w: known[w] if w in known else here[w]
        found = list(map(look, parts))
        stops = np.searchsorted(slices, ends).tolist()
        out, at = [], 0
        for stop in stops:
            ids = np.frombuffer(b"".join(found[at:stop]), np.uint32)
            starts = None
            if with_starts:
                sizes = np.fromiter((len(self.words[i]) for i in ids.tolist()), np.int64, len(ids))
                starts = np.cumsum(sizes) - sizes
            out.append((ids, starts))
            at = stop + 1
        return out

    def decode(self, ids) -> bytes:
        self.prepare()
        return b"".join(map(self.words.__getitem__, ids))


_NONE = np.iinfo(np.int64).max


def encode(docs: DataFrame, ranks: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, token_ids, token_starts`` (byte offsets) of every text.

    ``ranks`` is the vocabulary's path, read on the driver; the function
    carries its ranks (a few MB, fixed by the file).  Null and empty texts have
    no tokens.
    """
    merges = Merges.load(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text"):
            got = merges.encode(texts, with_starts=True)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([x.astype(np.int32) for x, _ in got], pa.list_(pa.int32())), pa.array([s.astype(np.int32) for _, s in got], pa.list_(pa.int32()))],
                ["doc_id", "token_ids", "token_starts"])

    return id_text(docs, doc_id, text).mapInArrow(run, "doc_id long, token_ids array<int>, token_starts array<int>")


def decode(encoded: DataFrame, ranks: str, doc_id: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """``doc_id, decoded`` (binary) from arrays of ids; null arrays decode to nothing."""
    merges = Merges.load(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([merges.decode(x or ()) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "decoded"])

    return encoded.select(encoded[doc_id].cast("long").alias("doc_id"), encoded[ids].alias("ids")).mapInArrow(run, "doc_id long, decoded binary")


def digests(docs: DataFrame, ranks: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text in one pass and return ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    merges = Merges.load(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text"):
            n, a, b = [], [], []
            for ids, _ in merges.encode(texts):
                ids = ids.tolist()
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(merges.decimal.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(merges.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs, doc_id, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
