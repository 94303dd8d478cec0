"""Toxic spans and document scores from a linear-chain CRF.

Token labels come from document labels: a word or word beginning that occurs
in many different contexts of toxic documents and hardly in clean ones marks
its tokens in toxic documents as toxic; all other tokens are clean.  A
two-state CRF over word and word-beginning features is fitted to those labels
by its exact gradient (forward-backward), on a bounded sample.  Its marginals,
summed and maximised over a document, go through a calibrated logistic score;
tokens whose marginal reaches one half are the offending spans.

A chain is a stretch of at most ``CHAIN`` words of one document, so long texts
need no more memory than short ones, and every word of every text is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import chunks, id_text, stored

#: Most labelled documents of each kind that fitting reads, and most features kept.
TOXIC_DOCS, CLEAN_DOCS, FEATURES = 3000, 9000, 20_000
#: Labelled documents of each kind whose tokens train the CRF itself.
CRF_DOCS = 2000
#: Support a feature needs: different contexts and documents of the toxic kind, and its odds against the clean kind.
CONTEXTS, DOCUMENTS, ODDS = 6, 4, 15.0
#: Words of a chain, letters of the word beginnings, distinct words a worker remembers.
CHAIN, BEGINNINGS, MEMORY = 64, (4, 5, 6, 7), 400_000
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_TOKEN = re.compile(r"\S+")


def features(word: str) -> list[str]:
    """Features of a raw token: the bare word and its beginnings, lower-cased."""
    bare = _EDGE.sub("", word.lower())
    return ["=" + bare, *(bare[:n] for n in BEGINNINGS if len(bare) >= n)] if bare else []


@dataclass
class Model:
    """Fitted weights; with no features every text gets the constant score ``base``."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    moves: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))
    logit: tuple[float, ...] | None = None
    base: float = 0.0

    def tag(self, texts: list[str], memory: dict[str, float]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Score, positions of words with a marginal of one half or more, and those marginals."""
        if len(memory) > MEMORY:
            memory.clear()
        weights = self.weights
        words = [t.split() for t in texts]
        for w in {w for ws in words for w in ws if w not in memory}:
            memory[w] = sum(weights.get(f, 0.0) for f in features(w))
        lens = [len(ws) for ws in words]
        flat = np.fromiter((memory[w] for ws in words for w in ws), float, sum(lens))
        stats, hits = document_stats(flat, np.array(lens, np.int64), self.bias, np.array(self.moves))
        if self.logit is None:
            scores = np.full(len(texts), self.base)
        else:
            scores = 1 / (1 + np.exp(-np.clip(design(stats) @ np.array(self.logit), -40, 40)))
        return [(float(s), *h) for s, h in zip(scores, hits, strict=True)]


def chain_marginals(gain: np.ndarray, lens: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over padded chains of a two-state CRF.

    ``gain[c, t]`` is the log weight of state 1 against state 0.  Returns the
    marginal of state 1 per position, the expected number of each move per
    chain and the log partition sums.
    """
    n, width = gain.shape
    e = np.stack([np.zeros_like(gain), gain], axis=2)
    inside = np.arange(width) < lens[:, None]
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[:, 0] = e[:, 0]
    for t in range(1, width):
        step = np.logaddexp(alpha[:, t - 1, None, 0] + moves[0], alpha[:, t - 1, None, 1] + moves[1]) + e[:, t]
        alpha[:, t] = np.where(inside[:, t, None], step, alpha[:, t - 1])
    for t in range(width - 2, -1, -1):
        after = beta[:, t + 1] + e[:, t + 1]
        step = np.logaddexp(after[:, None, 0] + moves[:, 0], after[:, None, 1] + moves[:, 1])
        beta[:, t] = np.where(inside[:, t + 1, None], step, 0.0)
    total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    one = np.where(inside, np.exp(alpha[..., 1] + beta[..., 1] - total[:, None]), 0.0)
    pairs = np.exp(alpha[:, :-1, :, None] + moves + (e + beta)[:, 1:, None, :] - total[:, None, None, None])
    return one, (pairs * inside[:, 1:, None, None]).sum(1), total


def document_stats(flat: np.ndarray, lens: np.ndarray, bias: float, moves: np.ndarray):
    """Per document: sum and maximum of marginals and number of words, and the words over one half.

    Chains without any feature have the same marginals at the same length, so
    they are looked up; only chains with a feature are computed.
    """
    plain_sum, plain_max = np.zeros(CHAIN + 1), np.zeros(CHAIN + 1)
    m, _, _ = chain_marginals(np.full((CHAIN, CHAIN), bias), np.arange(1, CHAIN + 1), moves)
    plain_sum[1:], plain_max[1:] = m.sum(1), m.max(1)
    per = -(-lens // CHAIN)
    doc = np.repeat(np.arange(len(lens)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    size = np.minimum(CHAIN, np.repeat(lens, per) - nth * CHAIN)
    start = np.repeat(np.cumsum(lens) - lens, per) + nth * CHAIN
    sums, tops = plain_sum[size], plain_max[size]
    marked = np.unique(np.searchsorted(start, np.flatnonzero(flat), side="right") - 1)
    found_doc, found_at, found_m = [], [], []
    for lo in range(0, len(marked), 4096):  # bounds the padded arrays
        some = marked[lo : lo + 4096]
        at = start[some, None] + np.arange(CHAIN)
        inside = np.arange(CHAIN) < size[some, None]
        gain = np.where(inside, bias + flat[np.minimum(at, len(flat) - 1)], 0.0)
        one, _, _ = chain_marginals(gain, size[some], moves)
        sums[some], tops[some] = one.sum(1), one.max(1)
        c, t = np.nonzero(one >= 0.5)
        found_doc.append(doc[some[c]])
        found_at.append(nth[some[c]] * CHAIN + t)
        found_m.append(one[c, t])
    stats = np.zeros((len(lens), 3))
    stats[:, 0] = np.bincount(doc, sums, len(lens))
    np.maximum.at(stats[:, 1], doc, tops)
    stats[:, 2] = lens
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    fd, fa, fm = join(found_doc, np.int64), join(found_at, np.int64), join(found_m, float)
    cuts = np.searchsorted(fd, np.arange(len(lens) + 1))
    return stats, [(fa[a:b], fm[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def design(stats: np.ndarray) -> np.ndarray:
    """Logistic inputs: one, summed marginals (log), largest marginal, share of toxic words."""
    n, top, words = stats.T
    return np.stack([np.ones(len(n)), np.log1p(n), top, np.sqrt(n / np.maximum(words, 1))], axis=1)


# Fitting


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on at most ``TOXIC_DOCS`` and ``CLEAN_DOCS`` labelled documents, drawn by a hash of their id.

    ``labels``: ids with a 0/1 label; null labels and ids are left out, and an
    id labelled twice counts as toxic if any label is.  Without documents of
    both kinds the model is the constant share of toxic ones.
    """
    known = labels.select(labels[doc_id].cast("long").alias("doc_id"), labels[label].cast("int").alias("toxic")).na.drop().groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    size = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        return Model(base=float(bool(size.get(1))))
    most = {1: TOXIC_DOCS, 0: CLEAN_DOCS}
    draw = F.xxhash64(F.lit("toxicity"), "doc_id")
    picked = [known.where(F.col("toxic") == t).orderBy(draw, "doc_id").limit(n) for t, n in most.items()]
    sample = stored(id_text(docs, doc_id, text).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id"), "toxicity-sample")  # bounded ids
    lexicon = _lexicon(sample)
    few = sample.where(F.col("toxic") == 1).orderBy(draw, "doc_id").limit(CRF_DOCS).unionByName(sample.where(F.col("toxic") == 0).orderBy(draw, "doc_id").limit(CRF_DOCS))
    return _train(((r["text"] or "", r["toxic"]) for r in few.toLocalIterator()), lexicon, size[1] / size[0])


def _lexicon(sample: DataFrame) -> list[str]:
    """Features of toxic documents: counted over different (before, word, after) contexts, so copies count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in chunks(batches, "text"):
            rows = []
            for d, t, y in zip(part.column("doc_id").to_pylist(), raw, part.column("toxic").to_pylist(), strict=True):
                bare = [b for w in t.decode("utf-8", "replace").lower().split() if (b := _EDGE.sub("", w))]
                rows += [(b[:64], xxh64_intdigest(f"{x} {b} {z}") - (1 << 63), y, d) for x, b, z in set(zip(["", *bare], bare, [*bare[1:], ""]))]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["word", "context", "toxic", "doc_id"])

    seen = sample.select("doc_id", "text", "toxic").mapInArrow(run, "word string, context long, toxic int, doc_id long")
    once = seen.groupBy("word", "context").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    words = once.groupBy("word", "toxic", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    named = F.array(F.concat(F.lit("="), "word"), *[F.when(F.length("word") >= n, F.substring("word", 1, n)) for n in BEGINNINGS])
    per = words.select(F.explode(F.array_compact(named)).alias("f"), "toxic", "doc_id", "n").groupBy("f").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"),
        F.count_distinct(F.when(F.col("toxic") == 1, F.col("doc_id"))).alias("docs"))
    total = once.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).first()
    odds = (F.col("a") + 0.5) / (F.col("b") + 0.5) * ((total["b"] or 0) + 1.0) / ((total["a"] or 0) + 1.0)
    kept = per.where((F.col("a") >= CONTEXTS) & (F.col("docs") >= DOCUMENTS)).withColumn("odds", odds).where(F.col("odds") >= ODDS)
    return [r["f"] for r in kept.orderBy(F.desc("a"), "f").limit(FEATURES).collect()]


def _train(docs: Iterator[tuple[str, int]], lexicon: list[str], ratio: float) -> Model:
    ids = {f: i for i, f in enumerate(lexicon)}
    memory: dict[str, tuple[int, ...]] = {}
    lens, kinds, where, which, marked = [], [], [], [], []
    at = 0
    for text, toxic in docs:
        words = text.split()
        lens.append(len(words))
        kinds.append(toxic)
        for i, w in enumerate(words):
            got = memory.get(w)
            if got is None:
                got = memory[w] = tuple(ids[f] for f in features(w) if f in ids)
            if got:
                where += [at + i] * len(got)
                which += got
                if toxic:
                    marked.append(at + i)
        at += len(words)
    lens, kinds = np.array(lens, np.int64), np.array(kinds)
    if not len(set(kinds.tolist())) == 2:
        return Model(base=float(kinds.mean()) if len(kinds) else 0.0)
    model = _crf(lens, np.array(where, np.int64), np.array(which, np.int64), np.array(marked, np.int64), at, lexicon)
    flat = np.zeros(at)
    np.add.at(flat, np.array(where, np.int64), np.array([model.weights.get(lexicon[i], 0.0) for i in which]))
    stats, _ = document_stats(flat, lens, model.bias, np.array(model.moves))
    # Documents weigh as in the whole set of labels, not as in the sample.
    weight = np.where(kinds == 1, 1.0, (kinds == 1).sum() / max(1, (kinds == 0).sum()) / ratio)
    model.logit = tuple(_logistic(design(stats), kinds, weight).tolist())
    return model


def _crf(lens, where, which, marked, total, lexicon, rounds: int = 120) -> Model:
    """Adam on the exact gradient of the penalised log likelihood; equal featureless chains are one weighted chain."""
    per = -(-lens // CHAIN)
    nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    size = np.minimum(CHAIN, np.repeat(lens, per) - nth * CHAIN)
    start = np.repeat(np.cumsum(lens) - lens, per) + nth * CHAIN
    owner = np.searchsorted(start, where, side="right") - 1
    rich = np.unique(owner)
    plain = np.bincount(np.delete(size, rich), minlength=CHAIN + 1)[1:]
    long = np.concatenate([size[rich], np.arange(1, CHAIN + 1)])
    weight = np.concatenate([np.ones(len(rich)), plain]).astype(float)
    row, col = np.searchsorted(rich, owner), where - start[owner]
    y = np.zeros((len(long), CHAIN))
    if len(marked):
        mine = np.searchsorted(start, marked, side="right") - 1
        y[np.searchsorted(rich, mine), marked - start[mine]] = 1
    true_moves = np.zeros((2, 2))
    a, b = y[:, :-1], y[:, 1:]
    pair_in = np.arange(1, CHAIN) < long[:, None]
    for i in range(2):
        for j in range(2):
            true_moves[i, j] = (((a == i) & (b == j) & pair_in) * weight[:, None]).sum()
    n_f = len(lexicon)
    x = np.zeros(n_f + 5)
    x[n_f] = -4.0
    m, v, scale = np.zeros_like(x), np.zeros_like(x), max(1.0, len(rich))
    for r in range(1, rounds + 1):
        gain = np.full((len(long), CHAIN), x[n_f])
        np.add.at(gain, (row, col), x[which])
        one, moved, _ = chain_marginals(gain, long, x[n_f + 1 :].reshape(2, 2))
        miss = (y - one) * (np.arange(CHAIN) < long[:, None]) * weight[:, None]
        g = np.concatenate([np.bincount(which, miss[row, col], n_f)[:n_f] if n_f else [], [miss.sum()], (true_moves - (moved * weight[:, None, None]).sum(0)).ravel()]) / scale - 1e-4 * x
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x += 0.15 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-9)
    moves = x[n_f + 1 :].reshape(2, 2)
    return Model(dict(zip(lexicon, x[:n_f].tolist(), strict=True)), float(x[n_f]), tuple(map(tuple, moves.tolist())))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-2 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


SPANS = "array<struct<start:int,end:int,probability:double>>"


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, predicted, spans`` of every text; spans are offending tokens in code points.

    Null and empty texts get the score of a text without words and no spans.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, float] = {}
        for part, raw in chunks(batches, "text"):
            texts = [t.decode("utf-8", "replace") for t in raw]
            tagged = model.tag(texts, memory)
            spans = []
            for t, (_, at, p) in zip(texts, tagged, strict=True):
                own = []
                if len(at):
                    tokens = [m.span() for m in _TOKEN.finditer(t)]
                    own = [{"start": tokens[i][0], "end": tokens[i][1], "probability": x} for i, x in zip(at.tolist(), p.tolist(), strict=True)]
                spans.append(own)
            s = [x[0] for x in tagged]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32()), pa.array(spans, kind)], ["doc_id", "score", "predicted", "spans"])

    return id_text(docs, doc_id, text).mapInArrow(run, f"doc_id long, score double, predicted int, spans {SPANS}")


def clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The input rows that the model does not predict as toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, float] = {}
        for part, raw in chunks(batches, text):
            tagged = model.tag([t.decode("utf-8", "replace") for t in raw], memory)
            yield part.filter(pa.array([x[0] < 0.5 for x in tagged], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
