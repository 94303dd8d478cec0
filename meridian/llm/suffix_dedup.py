"""Suffix-array dedup: every byte covered by a string that starts elsewhere too.

This stands in for a suffix array; no order of suffixes exists.  Passages are
dealt out by ranges of their anchor's hash (see ``repeats``) with Spark's
sampled splitters.  Inside a range, windows are grouped piece by piece: sort by
the 64-bit hash of one piece, split into runs of equal hashes, go on with the
next piece inside the runs of two or more.  Windows still together after
``window`` bytes are repeats, up to collisions of hashes; bytes are never
compared.  Equal strings have equal anchors, so a border never falls between
them.  Only windows whose anchor repeats are grouped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats
from .common import chunks

GRAM = 32
#: One unit per byte value.
_BYTE = repeats.mix(np.arange(1, 257, dtype=np.uint64))


def multikey_runs(tokens: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
    """Which of the suffixes at ``starts`` are equal to another in all tokens.

    ``tokens[j]`` has, for every position, the j-th token of the suffix there.
    """
    repeated = np.zeros(len(starts), bool)
    live, run = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for token in tokens:
        key = token[starts[live]]
        order = np.lexsort((key, run))
        live, run, key = live[order], run[order], key[order]
        fresh = np.ones(len(live), bool)
        fresh[1:] = (run[1:] != run[:-1]) | (key[1:] != key[:-1])
        run = np.cumsum(fresh) - 1
        many = (np.bincount(run, minlength=1) > 1)[run] if len(run) else np.zeros(0, bool)
        live, run = live[many], run[many]  # a run of one is sorted
        if not len(live):
            return repeated
    repeated[live] = True
    return repeated


def _token_size(window: int) -> int:
    return next(b for b in range(min(64, window), 0, -1) if window % b == 0)


def _decide(window: int):
    size = _token_size(window)

    def decide(rows: pa.Table) -> tuple[np.ndarray, ...]:
        bodies, m = rows.column("body").to_pylist(), rows.column("n").to_numpy().astype(np.int64)
        copies = rows.column("copies").to_numpy()
        lens = np.fromiter(map(len, bodies), np.int64, len(bodies))
        units = _BYTE[np.frombuffer(b"".join(bodies), np.uint8)]
        token = repeats.grams(units, size)
        base = np.cumsum(lens) - lens
        starts = np.repeat(base, m) + (np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m))
        tokens = [token[j:] for j in range(0, window, size)]
        flags = multikey_runs(tokens, starts) | np.repeat(copies > 1, m)
        owner, first, last, hit = repeats.runs(flags, m)
        return owner[hit], first[hit], last[hit], np.full(int(hit.sum()), -(2**63))  # whatever the document

    return decide


def remove_repeats(docs: DataFrame, window: int = 400, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, binary) of every row.

    Removes every byte covered by a string of ``window`` bytes that also starts
    at another place of any row, the same one included; repeated rows are
    different places.  Null and empty texts have no bytes.  Cuts may fall
    inside a character, so the kept text is binary.
    """
    if window < 2 * GRAM:
        raise ValueError(f"window must be {2 * GRAM} bytes or more")
    kind = repeats.Kind("suffixes", window, GRAM, _units, lambda t: t, lambda t, a, b: t[a:b], across=False)
    found = repeats.spans(docs, kind, _decide(window), True, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text"):
            cols = [[], [], [], [], []]
            for t, s in zip(texts, part.column("spans"), strict=True):
                cut = repeats.merged(s.as_py())
                ends = [0, *(b for _, b in cut)]
                kept = b"".join(t[a:b] for a, b in zip(ends, [*(a for a, _ in cut), len(t)], strict=True))
                for c, v in zip(cols, (len(t), len(t) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            upto = 5 if with_text else 4
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays[:upto]], ["doc_id", *names[:upto]])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return found.select("doc_id", "text", "spans").mapInArrow(run, schema)


def _units(text: bytes) -> np.ndarray:
    return _BYTE[np.frombuffer(text, np.uint8)]
