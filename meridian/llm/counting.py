"""Token counts: Arrow functions that encode batches and return lengths only.

A text is cut at safe boundaries: a single space between two other characters,
neither of them the model's own space mark.  The model adds that mark before
each piece it is given, in place of the dropped space, and no vocabulary entry
has the mark behind another character (checked when the model is loaded), so no
merge can cross such a cut and the pieces' lengths add up to the text's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, id_text

#: Bytes given to the model at once, and distinct pieces whose lengths a worker remembers.
BATCH_BYTES, MEMORY = 1 << 20, 400_000
#: Longer pieces are not remembered.
LONG_PIECE = 64

_MARK = "▁"
_SAFE = re.compile(f"(?<=[^ {_MARK}]) (?=[^ {_MARK}])")


class Counting:
    """Counts tokens with a sentencepiece model given as its serialised bytes."""

    def __init__(self, model: bytes):
        self.model, self._sp, self._known = model, None, {}

    def __getstate__(self):
        return {"model": self.model, "_sp": None, "_known": {}}

    def _load(self):
        if self._sp is None:
            import sentencepiece

            self._sp = sentencepiece.SentencePieceProcessor(model_proto=self.model)
            words = (self._sp.id_to_piece(i) for i in range(self._sp.get_piece_size()))
            plain = self._sp.encode("a  b", out_type=str) == [_MARK + "a", _MARK, _MARK + "b"]
            self._cut = plain and not any(_MARK in w.lstrip(_MARK) for w in words)
        return self._sp

    def pieces(self, text: str) -> list[str]:
        if not self._cut:
            return [text]
        if "  " in text or _MARK in text or text[:1] == " " or text[-1:] == " ":
            return _SAFE.split(text)
        return text.split(" ")

    def count(self, texts: list[str]) -> list[int]:
        sp, known = self._load(), self._known
        if len(known) > MEMORY:
            known.clear()
        cut = [self.pieces(t) for t in texts]
        new = {p for ps in cut for p in ps if p not in known}
        here, batch, held = {}, [], 0
        for p in new:
            batch.append(p)
            held += len(p)
            if held >= BATCH_BYTES:
                self._encode(sp, batch, here)
                batch, held = [], 0
        self._encode(sp, batch, here)
        known.update((p, n) for p, n in here.items() if len(p) <= LONG_PIECE)
        if any(len(p) > LONG_PIECE for p in here):
            look = lambda p: known[p] if p in known else here[p]
            return [sum(map(look, ps)) for ps in cut]
        return [sum(map(known.__getitem__, ps)) for ps in cut]

    @staticmethod
    def _encode(sp, batch: list[str], out: dict[str, int]) -> None:
        if batch:
            out.update(zip(batch, map(len, sp.encode(batch, num_threads=1)), strict=True))


def count_tokens(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every text under the model file ``model``.

    The driver reads the file (about half a MB) and sends it with the
    function, so executors need no copy.  Whole texts are counted, without
    begin, end or added special tokens; null and empty texts have no tokens.
    Rows are handled in slices of bounded bytes whatever their number.
    """
    with open(model, "rb") as f:
        counting = Counting(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in chunks(batches, "text"):
            n = counting.count([t.decode("utf-8", "replace") for t in raw])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(n, pa.int64()), pa.array((x > limit for x in n), pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_text(docs, doc_id, text).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
