"""Best-fit packing with exact-complement hashing.

A packing depends on nothing but how many pieces there are of each length, and
lengths end at the capacity.  The plan is therefore made once from a histogram
of at most ``capacity`` counts, however many documents there are: for every
length, longest first, the gap left by its copies is looked up among single
lengths, pair sums and triple sums; a combination that fills it exactly is
consumed as often as the availability counts allow.  What fills nothing exactly
is placed best-fit, whole groups of equal open sequences at a time.  The plan
says of each length which ordinals go where, so that placing the pieces is a
look-up per row: tasks number their pieces of a length while encoding, and the
tasks' counts give the ordinals, without gathering a length anywhere.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, id_text, stored

#: The one split pattern for which both libraries are known to find the same matches, given equal character classes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoding:
    """Ids of whole texts as the tokenizers library gives them for a serialised model.

    That library spends its time on offsets nobody asked for.  A byte-level
    BPE model therefore runs on tiktoken with the model's own vocabulary as
    ranks, once ``same_merges`` has shown on the driver that both merge alike;
    texts with a character that the two libraries class differently, texts on
    which tiktoken gives up (very long runs of white space) and all other
    models go to tokenizers itself.  Ids come as little-endian unsigned 32-bit
    bytes.
    """

    def __init__(self, model: str):
        self.model, self._lib, self._fast = model, None, None
        self.differ = odd_characters() if same_merges(model) else None

    def __getstate__(self):
        return {"model": self.model, "differ": self.differ, "_lib": None, "_fast": None}

    def _load(self):
        if self._lib is None:
            from tokenizers import Tokenizer

            self._lib = Tokenizer.from_str(self.model)
            self._lib.no_truncation()
            self._lib.no_padding()
            if self.differ is not None:
                import tiktoken

                spec = json.loads(self.model)
                self._fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=byte_ranks(spec), special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})
                self._odd = re.compile("[" + "".join(map(re.escape, self.differ)) + "]") if self.differ else None

    def ids(self, text: str) -> bytes:
        """The ids of a text, without added special tokens."""
        self._load()
        if self._fast is not None and not (self._odd and self._odd.search(text)):
            try:
                return self._fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
            except ValueError:  # its expression engine ran out of stack
                pass
        return array("I", self._lib.encode(text, add_special_tokens=False).ids).tobytes()


def byte_ranks(spec: dict) -> dict[bytes, int]:
    """The vocabulary of a byte-level model by the bytes its characters stand for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes written as themselves; the others follow from 256
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    added = {t["content"] for t in spec["added_tokens"]}
    return {bytes(map(byte.__getitem__, word)): i for word, i in spec["model"]["vocab"].items() if word not in added}


def same_merges(model: str) -> bool:
    """Whether ranks alone reproduce a tokenizers model: a plain byte-level BPE whose
    merges are in the order of the ids they make, and whose whole entries encode to themselves."""
    from tokenizers import Tokenizer

    spec = json.loads(model)
    bpe, before = spec["model"], spec.get("pre_tokenizer") or {}
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if bpe["type"] != "BPE" or any(map(bpe.get, options)) or spec.get("normalizer") or spec.get("truncation") or spec.get("padding"):
        return False
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return False
    added = spec["added_tokens"]
    if len(added) > 1 or any(t[k] for t in added for k in ("lstrip", "rstrip", "single_word")):
        return False
    made = [bpe["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in bpe["merges"]]
    if made != sorted(set(made)):
        return False
    lib, ranks, whole = Tokenizer.from_str(model), byte_ranks(spec), []
    for word, i in ranks.items():
        try:
            whole.append((word.decode(), i))
        except UnicodeDecodeError:  # never a whole match
            continue
    found = lib.encode_batch_fast([w for w, _ in whole], add_special_tokens=False)
    # Several ids are right where the pattern splits the entry; one id must be the entry's.
    split = lib.pre_tokenizer.pre_tokenize_str
    return all(e.ids == [i] or len(split(w)) > 1 for (w, i), e in zip(whole, found, strict=True)) and len(ranks) == max(ranks.values()) + 1


def odd_characters() -> str:
    """Characters that the two libraries do not put into the same class."""
    import tiktoken
    from tokenizers import Regex
    from tokenizers.normalizers import Replace

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    odd = set()
    for pattern in (r"\p{L}", r"\p{N}", r"\s"):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        odd |= set(probe.decode_bytes(probe.encode_ordinary(every)).decode()) ^ (set(every) - set(Replace(Regex(f"(?:{pattern})+"), "").normalize_str(every)))
    return "".join(sorted(odd))


def lengths(total: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: whole ones, the shorter one first."""
    rest = total % capacity
    return [rest] * (rest > 0) + [capacity] * (total // capacity)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int = 0, keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts and cut them into pieces of at most ``capacity`` ids.

    ``doc_id, piece, start, length, ids_crc32, task, nth`` and, if wanted,
    ``ids``.  ``nth`` numbers a task's pieces of one length.  The file
    ``tokenizer`` is read by the driver and sent with the function.
    """
    with open(tokenizer, encoding="utf-8") as f:
        encoding = Encoding(f.read())
    last = array("I", [end]).tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for part, raw in chunks(batches, "text"):
            rows = []
            for key, body in zip(part.column("doc_id").to_pylist(), raw, strict=True):
                body = encoding.ids(body.decode("utf-8", "replace")) + last
                start = 0
                for i, n in enumerate(lengths(len(body) // 4, capacity)):
                    own = body[4 * start:4 * (start + n)]
                    rows.append((key, i, start, n, zlib.crc32(own), task, seen[n]) + ((np.frombuffer(own, "<u4").astype(np.int32),) if keep_ids else ()))
                    seen[n] += 1
                    start += n
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names)

    schema = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, nth long" + ", ids array<int>" * keep_ids
    return id_text(docs, doc_id, text).mapInArrow(run, schema)


class Plan:
    """Which combinations of lengths make up the sequences, and how often each occurs.

    ``counts[n]`` is the number of pieces of length ``n``.  ``patterns`` holds
    ``(times, {length: copies})``.  Work and size depend on the capacity, not on
    the counts: a step uses up a length or a group of equal open sequences.
    ``rounds`` bounds, pass by pass, the lengths looked up for a gap, and
    ``repeats`` says whether sequences begin with several copies of a length;
    ``best`` tries a few of both.
    """

    def __init__(self, counts: dict[int, int], capacity: int, rounds: tuple[int, ...] = (3,), repeats: bool = True):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for n, c in counts.items():
            self.left[n] = c
        self.patterns: list[tuple[int, dict[int, int]]] = []
        self._support = self._sums = None
        for most in rounds:
            for n in range(capacity, 0, -1):
                for copies in range(capacity // n if repeats else 1, 0, -1):
                    self._consume(n, copies, most)
        self._best_fit({n: int(self.left[n]) for n in np.flatnonzero(self.left).tolist()})

    def _consume(self, n: int, copies: int, most: int) -> None:
        """Fill sequences exactly around copies of ``n`` while there are combinations."""
        while self.left[n] >= copies and (found := self._exact(n, copies, most)):
            times = min(int(self.left[m]) // k for m, k in found.items())
            self.patterns.append((times, found))
            for m, k in found.items():
                self.left[m] -= k * times
            self._support = None

    def _index(self):
        """Available lengths, and for every sum whether two of them (one twice, too) have it."""
        if self._support is None:
            self._support, self._sums = self.left > 0, None
        return self._support

    def _pair_sums(self):
        have = self._index()
        if self._sums is None:
            bits = sum(1 << int(n) for n in np.flatnonzero(have))
            sums = 0
            for n in np.flatnonzero(have).tolist():
                sums |= bits << n
            raw = (sums & ((1 << (self.capacity + 1)) - 1)).to_bytes(self.capacity // 8 + 1, "little")
            self._sums = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: self.capacity + 1].astype(bool)
        return self._sums

    def _exact(self, n: int, copies: int, most: int) -> dict[int, int] | None:
        """``copies`` of ``n`` and at most ``most`` other lengths that fill a sequence exactly."""
        gap = self.capacity - n * copies
        own = Counter({n: copies})
        if gap == 0:
            return dict(own)
        if gap < n and not self._index()[1:gap + 1].any():
            return None
        for found in self._fills(gap, most):
            whole = own + Counter(found)
            if all(self.left[m] >= k for m, k in whole.items()):
                return dict(whole)
        return None

    def _fills(self, gap: int, most: int) -> Iterator[tuple[int, ...]]:
        """Single, pair and triple of available lengths with the sum ``gap``, long ones first."""
        have = self._index()
        if have[gap]:
            yield (gap,)
        if most > 1:
            yield from self._pairs(gap, gap)
        if most < 3:
            return
        sums = self._pair_sums()
        longest = np.arange(gap - 2, 0, -1)
        for a in longest[have[longest] & sums[gap - longest]].tolist():
            yield from ((a, *pair) for pair in self._pairs(gap - a, a))

    def _pairs(self, total: int, most: int) -> Iterator[tuple[int, int]]:
        have = self._index()
        a = np.arange(min(most, total - 1), (total - 1) // 2, -1)
        for x in a[have[a] & have[total - a]].tolist():
            yield x, total - x

    def _best_fit(self, rest: dict[int, int]) -> None:
        """Longest first into the open sequences of the smallest sufficient gap, else into new ones."""
        by_gap: dict[int, list[tuple[int, dict[int, int]]]] = {}
        for n in sorted(rest, reverse=True):
            count = rest[n]
            for gap in sorted(g for g in by_gap if g >= n):
                while count and by_gap[gap]:
                    times, held = by_gap[gap].pop()
                    fits = min(gap // n, -(-count // times))  # one copy in each, further ones while they fit
                    used = min(times, count // fits)
                    if used < times:
                        by_gap[gap].append((times - used, held))
                    if used:
                        by_gap.setdefault(gap - fits * n, []).append((used, dict(Counter(held) + Counter({n: fits}))))
                        count -= used * fits
                if not count:
                    break
            each = self.capacity // n
            for copies, times in ((each, count // each), (count % each, 1)):
                if copies and times:
                    by_gap.setdefault(self.capacity - copies * n, []).append((times, {n: copies}))
        self.patterns += [p for group in by_gap.values() for p in group]

    @classmethod
    def best(cls, counts: dict[int, int], capacity: int) -> Plan:
        """The plan with the fewest sequences: pairs and triples spend short pieces that longer ones may need."""
        tried = (((3,), True), ((1, 2, 3), True), ((3,), False), ((1,), False), ((), False))
        return min((cls(counts, capacity, *how) for how in tried), key=lambda plan: plan.sequences)

    @property
    def sequences(self) -> int:
        return sum(times for times, _ in self.patterns)

    def segments(self) -> np.ndarray:
        """Rows ``length, first ordinal, copies, offset, first sequence``, ordered by the first two."""
        used, rows, base = Counter(), [], 0
        for times, held in self.patterns:
            at = 0
            for n in sorted(held, reverse=True):
                rows.append((n, used[n], held[n], at, base))
                used[n] += times * held[n]
                at += n * held[n]
            base += times
        return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` ids.

    A document is its text's ids and then ``end``; a null or empty text is
    ``end`` alone.  Only documents longer than ``capacity`` are cut, into whole
    pieces of which the first may be shorter.  Returns per piece ``doc_id,
    piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids`` with
    ``keep_ids``; see ``assemble``).  Repeated rows, and rows without an id, are
    documents of their own; further columns are ignored; an empty table gives
    no rows.
    """
    cut = stored(pieces(docs, tokenizer, capacity, end, keep_ids, doc_id, text), "packing-pieces")
    counted = stored(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    ahead = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("length", "task", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    numbered = cut.join(before, ["length", "task"]).withColumn("ordinal", F.col("before") + F.col("nth"))
    wanted = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    table = Plan.best(histogram, capacity).segments()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            n, ordinal = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "ordinal"))
            _, first, copies, at, base = table[np.searchsorted(keys, n << 48 | ordinal, "right") - 1].T
            nth = ordinal - first
            columns = [batch.column(c) for c in wanted] + [pa.array(base + nth // copies), pa.array(at + nth % copies * n)]
            yield pa.RecordBatch.from_arrays(columns, [*wanted, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids array<int>" * keep_ids + ", sequence_id long, offset long"
    return numbered.select(*wanted, "ordinal").mapInArrow(place, schema)


def assemble(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids, offsets`` of ``pack(..., keep_ids=True)``: one row per sequence."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most ``capacity`` ids
    return packed.groupBy("sequence_id").agg(inside.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))
