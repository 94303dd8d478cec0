"""Finding windows that repeat somewhere in a corpus, without pairing documents.

A window is ``window`` consecutive units (words or bytes) of one text.  Every
window names an anchor: the run of ``gram`` units inside it whose hash is
smallest, the leftmost among equals.  Equal windows name equal anchors at the
same place, so only texts that share an anchor need comparing, and one anchor
serves many neighbouring windows: together they are a passage, the windows'
common stretch.

1. Anchor hashes are counted; those of one occurrence are dropped.
2. Occurrences of the others are kept, equal passages are pre-aggregated, and
   one text of each different passage is fetched.
3. Passages of one anchor meet in one shard, where the caller's index decides
   about every window.  An anchor with very many different passages goes to no
   shard: blocks of its windows, and single windows where blocks don't tell,
   are counted by their digests, and the counts decide.
4. The decisions go back to the occurrences and become spans of the documents.

Everything that travels is an anchor, a passage or a span; no group of
documents is gathered, and the join sides that can be skewed are plain
sort-merge joins that AQE splits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, id_text, stored

#: Units of a text handled at once; longer texts go in overlapping blocks.
BLOCK = 1 << 20
#: An anchor with more different passages than this is cut into windows that are counted.
HOT_ANCHOR = 2000
#: Windows of a hot anchor counted together, then those left undecided; each divides the one before.
BLOCKS = (64, 8, 1)
#: Bytes of passages a shard's index should hold.
SHARD_BYTES = 2 << 20
#: Stands for a null id; greater than every other.
NO_ID = 2**63 - 1

_A, _B, _ORDER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(31)
_BASE = 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def grams(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` units from every position at which they all exist."""
    have, size, done, out = units, 1, 0, None
    while True:
        if k & size:
            part = have[done : len(units) - k + done + 1]
            out = part if out is None else mix(out * _A + part)
            done += size
        if done == k:
            return out
        have = mix(have[:-size] * _B + have[size:])
        size *= 2


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of the ``width`` values from every position."""
    have, size = values, 1
    while size * 2 <= width:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    rest = width - size
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, n.bit_length())
    if size not in _powers:
        _powers.clear()
        steps = []
        for base in (_BASE, _BACK):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            steps.append(np.multiply.accumulate(x))
        _powers[size] = tuple(steps)
    return _powers[size]


def anchors(units: np.ndarray, lens: np.ndarray, window: int, gram: int):
    """Anchors of texts laid end to end: ``(text, hash, passage hash, first window, windows, offset)``.

    ``first window`` counts from the text's start; ``offset`` is the anchor's
    place in the passage.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if len(units) < window:
        return none
    hashed = grams(units, gram)
    key = (hashed >> _ORDER << _ORDER) | np.arange(len(hashed), dtype=np.uint64)
    at = (smallest(key, window - gram + 1) & np.uint64((1 << 31) - 1)).astype(np.int64)
    start = np.cumsum(lens) - lens
    inside = np.zeros(len(units) + 1, np.int32)
    fits = lens >= window
    np.add.at(inside, start[fits], 1)
    np.add.at(inside, (start + lens - window + 1)[fits], -1)
    ok = np.cumsum(inside[: len(at)]) > 0
    first = ok.copy()
    first[1:] &= ~ok[:-1] | (at[1:] != at[:-1])
    # A text's first window always begins a passage, whatever stands before it.
    first[start[fits]] = True
    lo = np.flatnonzero(first)
    ends = np.flatnonzero(ok & np.concatenate([first[1:] | ~ok[1:], [True]]))
    n = ends - lo + 1
    text = np.searchsorted(start, lo, side="right") - 1
    while True:  # empty texts share their start with the next one
        empty = lens[text] == 0
        if not empty.any():
            break
        text[empty] -= 1
    up, down = _power(len(units) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(units * up[: len(units)], dtype=np.uint64)])
    stop = lo + n - 1 + window
    passage = mix((total[stop] - total[lo]) * down[lo])
    return text, hashed[at[lo]], passage, lo - start[text], n, at[lo] - lo


@dataclass(frozen=True)
class Kind:
    """How texts become units and passages.

    ``units`` gives one text's units as uint64; ``cut`` returns the bytes of
    units ``a`` to ``b`` of a text prepared by ``prepare``.
    """

    name: str
    window: int
    gram: int
    units: Callable[[bytes], np.ndarray]
    prepare: Callable[[bytes], object]
    cut: Callable[[object, int, int], bytes]
    #: Windows of one document only never matter.
    across: bool
    #: ``units`` of many texts at once, where that costs less.
    all_units: Callable[[list[bytes]], Iterable[np.ndarray]] | None = None


def _occurrences(kind: Kind, texts: list[bytes]):
    """Anchors of a slice of texts, long texts in overlapping blocks."""
    units, lens, owner, shift, held = [], [], [], [], 0
    for i, u in enumerate(kind.all_units(texts) if kind.all_units else map(kind.units, texts)):
        for a in range(0, max(1, len(u) - kind.window + 1), BLOCK):
            part = u[a : a + BLOCK + kind.window - 1]
            units.append(part)
            lens.append(len(part))
            owner.append(i)
            shift.append(a)
            held += len(part)
            if held > BLOCK:
                yield from _batch(kind, units, lens, owner, shift)
                units, lens, owner, shift, held = [], [], [], [], 0
    if units:
        yield from _batch(kind, units, lens, owner, shift)


def _batch(kind, units, lens, owner, shift):
    text, h, ph, lo, n, off = anchors(np.concatenate(units), np.array(lens, np.int64), kind.window, kind.gram)
    yield np.array(owner)[text], h.view(np.int64), ph.view(np.int64), lo + np.array(shift)[text], n, off


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = id_text(docs, doc_id, text)
    return rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("doc_id").isNull().alias("anonymous"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))


#: Bits of the bitmap that dismisses most anchors of one occurrence before they are shuffled: 8 MB whatever the input.
_BITS = 26
_LOW = (1 << _BITS) - 1


def _likely(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """Rows whose ``h`` is in a bitmap over the low bits of ``hashes``.

    The bitmap is a broadcast table of 2^20 words at most, whatever the input;
    the join that follows is exact whatever it lets pass.
    """
    word = F.shiftright(F.col("h").bitwiseAND(F.lit(_LOW)), 6)
    words = hashes.groupBy(word.alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("v"))
    return rows.join(F.broadcast(words), (word == F.col("w")) & F.expr("shiftright(v, cast(h & 63 as int)) & 1 = 1")).select(*rows.columns)


def spans(docs: DataFrame, kind: Kind, decide: Callable[[pa.Table], tuple[np.ndarray, ...]], ranged: bool, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, th, text, spans`` of every row: where ``decide`` found repeated windows.

    ``decide`` gets all passages of a shard (``n`` windows, ``least`` document,
    ``copies``, ``body``) and returns runs of windows ``(passage, first, last,
    least)``: they are spans of every document that holds the passage and has an
    id above ``least``.  ``th`` is a hash of the text; equal rows share their
    spans.  ``ranged`` deals passages to shards by sampled ranges instead of
    hashes.
    """
    rows = _keyed(docs, doc_id, text)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text"):
            ids, ths = part.column("doc_id").to_numpy(), part.column("th").to_numpy()
            for owner, h, ph, lo, n, off in _occurrences(kind, texts):
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ph), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(ids[owner]), pa.array(ths[owner]), pa.array(lo.astype(np.int32))], _OCC)

    # The texts are hashed once; what follows reads these rows.
    every = stored(rows.mapInArrow(occurrences, _OCC_SCHEMA), f"{kind.name}-every")
    counts = every.groupBy("h")
    if kind.across:
        repeated = counts.agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("h")
    else:
        repeated = counts.agg(F.count(F.lit(1)).alias("x")).where("x > 1").select("h")
    repeated = stored(repeated, f"{kind.name}-anchors")
    found = stored(_likely(every, repeated).join(repeated, "h", "left_semi"), f"{kind.name}-occurrences")
    passage = ["h", "ph", "n", "off"]
    # One occurrence, whichever: its three columns are never null, so they come from the same row.
    different = stored(found.groupBy(*passage).agg(*[F.first(c).alias(c) for c in ("doc_id", "th", "lo")], F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), f"{kind.name}-passages")
    # Stored, as AQE splits a skewed join only between plain shuffles.
    hot = stored(different.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > HOT_ANCHOR).select("h", F.lit(True).alias("hot")), f"{kind.name}-hot")
    wanted = different.join(hot, "h", "left").groupBy("doc_id", "th").agg(
        F.collect_list(F.struct(*passage, "lo", "least", "copies", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted"))
    once = rows.groupBy("doc_id", "th").agg(F.first("text").alias("text"))  # equal rows are one text

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text"):
            lists = part.column("wanted")
            asked = pa.RecordBatch.from_struct_array(lists.flatten())
            ends = np.cumsum(lists.value_lengths().to_numpy()).tolist()
            lo, n = (asked.column(c).to_pylist() for c in ("lo", "n"))
            at, body, i = [], [], 0
            for t, end in zip(texts, ends, strict=True):
                ready = kind.prepare(t)
                for i in range(i, end):
                    at.append(i)
                    body.append(kind.cut(ready, lo[i], lo[i] + n[i] - 1 + kind.window))
                    if len(at) > 5000:
                        yield _passages(asked, at, body)
                        at, body = [], []
                i = end
            if at:
                yield _passages(asked, at, body)

    bodies = stored(once.join(wanted, ["doc_id", "th"]).select("text", "wanted").mapInArrow(fetch, "h long, ph long, n int, off int, least long, copies long, body binary, hot binary"), f"{kind.name}-bodies")
    whole = bodies.where("body is not null")
    size = whole.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    shards = max(1, -(-int(size) // SHARD_BYTES))
    dealt = whole.repartitionByRange(shards, "h") if ranged else whole.repartition(shards, "h")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # one shard: about SHARD_BYTES, at most HOT_ANCHOR passages of an anchor
        if not held:
            return
        rows_ = pa.Table.from_batches(held)
        at, a, b, least = decide(rows_)
        runs_of = rows_.select(passage).take(pa.array(at, pa.int64())).combine_chunks()
        for name, values in (("a", a), ("b", b), ("least", least)):
            runs_of = runs_of.append_column(name, pa.array(values.astype(np.int64)))
        yield from runs_of.to_batches()

    judged = dealt.mapInArrow(judge, "h long, ph long, n int, off int, a long, b long, least long")
    if not hot.isEmpty():
        judged = judged.unionByName(_counted(kind, bodies.where("hot is not null"), passage))
    judged = stored(judged, f"{kind.name}-runs")
    picked = found.join(judged, passage).where("least < doc_id").select("doc_id", "th", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b") + kind.window).alias("b"))
    per = stored(picked.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans")), f"{kind.name}-spans")
    return rows.join(per, ["doc_id", "th"], "left").withColumn("doc_id", F.when(~F.col("anonymous"), F.col("doc_id"))).drop("anonymous")


def _counted(kind: Kind, passages: DataFrame, key: list[str]) -> DataFrame:
    """Runs of the repeated windows of hot anchors, as ``judge`` gives them.

    Equal windows have equal anchors and digests.  They are aggregated before
    they are shuffled, so their number does not matter.  Unless documents
    matter, neighbouring windows are first decided together, in blocks of equal
    places from the anchor.  A block whose stretch (all bytes under its windows)
    occurs twice has repeated windows only; one whose core (the bytes in each of
    its windows) occurs once has none.  What is left is cut into smaller blocks
    and meets one passage for each other stretch of the same core, so few
    windows are looked at one by one: those near a border of what repeats.
    """
    sizes = [s for s in BLOCKS if s == 1 or not kind.across and 2 * s <= kind.window - kind.gram + 1]
    asked = passages.select(*key, "least", "copies", "hot", F.lit(None).cast("array<struct<k: int, copies: bigint>>").alias("blocks"))
    whatever, n, runs_of = F.lit(-(2**63)), F.col("n"), []
    if not kind.across:  # every window of a passage that occurs twice
        runs_of.append(passages.where("copies > 1").select(*key, F.lit(0).alias("a"), (n - 1).alias("b"), whatever.alias("best")))
    for size, coarser in zip(sizes, [0, *sizes]):
        blocks = stored(asked.mapInArrow(_blocks(kind, size, coarser), "h long, ph long, n int, off int, least long, copies long, k int, a int, b int, core long, stretch long"), f"{kind.name}-blocks")
        at = ["h", "k", "core", "stretch"]
        seen = stored(blocks.groupBy(*at).agg(F.min("least").alias("best"), F.sum("copies").alias("total"), F.min(F.struct(*key)).alias("one")), f"{kind.name}-windows")
        twice = seen.where("total > 1").select(*at, "best")
        if kind.across:
            # The only document of a passage has nothing to lose to itself.
            met = blocks.join(twice, at).where("best < least or copies > 1")
        else:
            met = blocks.where("copies = 1").join(twice, at).withColumn("best", whatever)
        runs_of.append(met.select(*key, "a", "b", "best"))
        if size > 1:
            # Stored, as AQE splits a skewed join only between plain shuffles.
            cores = stored(seen.groupBy("h", "k", "core").agg(F.sum("total").alias("all"), F.min("total").alias("fewest")).where("all > 1 and fewest = 1").select("h", "k", "core"), f"{kind.name}-cores")
            left = seen.drop("h").select("one.*", "k", "core", "total").join(cores, ["h", "k", "core"], "left_semi").groupBy(*key).agg(F.collect_list(F.struct("k", F.col("total").alias("copies"))).alias("blocks"))
            asked = passages.join(left, key).select(*asked.columns)
    found = stored(reduce(DataFrame.unionByName, runs_of), f"{kind.name}-counted")
    # Runs that touch become one; a passage has no more of them than windows.
    group, before = [*key, "best"], Window.partitionBy(*key, "best").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    island = F.col("a") - F.coalesce(F.sum(F.col("b") - F.col("a") + 1).over(before), F.lit(0))
    one = found.withColumn("run", island).groupBy(*group, "run").agg(F.min("a").cast("long").alias("a"), F.max("b").cast("long").alias("b"))
    return one.select(*key, "a", "b", F.col("best").alias("least"))


def _blocks(kind: Kind, size: int, coarser: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts passages, or their ``blocks`` of ``coarser`` windows, into blocks of ``size``.

    Block ``k`` has the windows in which ``k * size`` and more units stand
    before the anchor: ``a`` to ``b`` of the passage, which may lack some.
    """

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, made = [], {c: [] for c in ("copies", "k", "a", "b", "core", "stretch")}

            def block() -> pa.RecordBatch:
                taken = batch.select(["h", "ph", "n", "off", "least"]).take(pa.array(rows, pa.int64()))
                kinds = {"k": pa.int32(), "a": pa.int32(), "b": pa.int32()}
                return pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(v, kinds.get(c, pa.int64())) for c, v in made.items())], [*taken.schema.names, *made])

            for i, (n, off, copies, body, blocks) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "off", "copies", "hot", "blocks")), strict=True)):
                ready, low = kind.prepare(body), off - n + 1
                parts = [(b["k"] * coarser, (b["k"] + 1) * coarser - 1, b["copies"]) for b in blocks] if blocks is not None else [(low, off, copies)]
                for least, most, count in parts:
                    for k in range(max(least, low) // size, min(most, off) // size + 1):
                        near, far = k * size, min(k * size + size - 1, kind.window - kind.gram)
                        a, b = off - min(far, off), off - max(near, low)
                        core = _digest(kind.cut(ready, off - near, off - far + kind.window))
                        stretch = _digest(kind.cut(ready, a, b + kind.window)) if size > 1 else core
                        rows.append(i)
                        for c, v in zip(made.values(), (count, k, a, b, core, stretch), strict=True):
                            c.append(v)
                if len(rows) > 5000:
                    yield block()
                    rows.clear()
                    for c in made.values():
                        c.clear()
            if rows:
                yield block()

    return lay


_OCC = ["h", "ph", "n", "off", "doc_id", "th", "lo"]
_OCC_SCHEMA = "h long, ph long, n int, off int, doc_id long, th long, lo int"
_BODY = pa.schema([("h", pa.int64()), ("ph", pa.int64()), ("n", pa.int32()), ("off", pa.int32()), ("least", pa.int64()), ("copies", pa.int64()), ("body", pa.binary()), ("hot", pa.binary())])


def _passages(asked: pa.RecordBatch, at: list[int], body: list[bytes]) -> pa.RecordBatch:
    """Passages of the ``asked`` rows ``at``, under the columns of ``_BODY``; those of hot anchors have their bytes in ``hot``, not in ``body``."""
    rows, bytes_, none = asked.take(pa.array(at, pa.int64())), pa.array(body, pa.binary()), pa.scalar(None, pa.binary())
    made = {"body": pc.if_else(rows.column("hot"), none, bytes_), "hot": pc.if_else(rows.column("hot"), bytes_, none)}
    return pa.RecordBatch.from_arrays([made[c] if c in made else rows.column(c) for c in _BODY.names], schema=_BODY)


def _digest(body: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(body, 7) - (1 << 63)


def merged(found: list[dict] | None) -> list[tuple[int, int]]:
    """Overlapping or touching spans as maximal ones; input in order of start."""
    out: list[tuple[int, int]] = []
    for s in found or ():
        a, b = s["a"], s["b"]
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def runs(values: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of equal values inside stretches of the given lengths: ``(stretch, first, last, value)``."""
    start = np.cumsum(lens) - lens
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[start[lens > 0]] = True
    at = np.flatnonzero(fresh)
    owner = np.repeat(np.arange(len(lens)), lens)[at]
    last = np.append(at[1:], len(values)) - 1
    return owner, at - start[owner], last - start[owner], values[at]
