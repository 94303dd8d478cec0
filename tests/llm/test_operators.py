"""Every operator against a brute-force version on a small hostile fixture:
nulls, empty texts, one long text, ties, repeated rows, clashing extra columns."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from meridian.llm import bpe, counting, decontamination, embedding_dedup, secrets, sharding, simhash, substring_dedup, suffix_dedup, toxicity
from meridian.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, h long, fp long, size long, b long"


def make_docs(seed=5):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéßñ日") for _ in range(r.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    shared, long_one = say(90), say(4000)
    rows = [(None, "no id " + shared), (None, None), (0, None), (1, ""), (2, "   \t\n"), (3, "one"), (4, "one"), (5, "a" * 3000), (6, long_one)]
    for i in range(10, 40):
        rows.append((i, say(r.randint(1, 60)) + " " + (shared if i % 3 == 0 else say(30)) + "\n" + say(r.randint(0, 40))))
    for i in range(40, 60):
        words = rows[12][1].split(" ")
        if i % 2:
            words[r.randrange(len(words))] = r.choice(vocab)
        rows.append((i, " ".join(words)))
    rows += [rows[15], rows[15], (70, long_one), (71, "Don't  'S 's't we'll \u0085x　y  "), (72, "password = hunter22 token:abc secret='q9/8+7=.-_' AKIA" + "Z9" * 10 + " " + "ab12" * 8)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "l", "s", 3, "x", 1, 2, 3, 4) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def raw(text):
    return (text or "").encode()


def keyed(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_bpe_matches_the_library_and_round_trips(docs, rows, none):
    import public_tokenizers as P
    import tiktoken

    path = tokenizer("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.Merges.load(path).ranks
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = keyed(bpe.digests(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, t in rows:
        ids = lib.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw(t)).hexdigest()))
    assert got == sorted(want, key=repr)
    encoded = bpe.encode(docs, path)
    assert all(len(r["token_ids"]) == len(r["token_starts"]) and sorted(r["token_starts"]) == r["token_starts"] for r in encoded.collect())
    assert keyed(bpe.decode(encoded, path), "doc_id", "decoded") == sorted(((i, bytearray(raw(t))) for i, t in rows), key=repr)
    assert bpe.digests(none, path).count() == 0


def test_bpe_merges_a_megabyte_without_spaces_like_the_library():
    import time

    import public_tokenizers as P
    import tiktoken

    merges = bpe.Merges.load(tokenizer("byte_bpe_multi_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=merges.ranks, special_tokens={})
    r = random.Random(4)
    letters = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    texts = [letters, "a" * 300_000, "日本語" * 30_000, "".join(r.choices("ACGT", k=100_000)), "!?" * 50_000]
    texts += ["".join(r.choices("aeiorst", k=n)) for n in (1, 255, 256, 257, 258, 600)]
    start = time.monotonic()
    got = merges.encode([t.encode() for t in texts])
    assert time.monotonic() - start < 60
    for t, (ids, _) in zip(texts, got, strict=True):
        assert ids.tolist() == lib.encode_ordinary(t)


def test_bpe_slices_match_the_pattern_on_random_texts():
    import public_tokenizers as P
    import tiktoken

    merges = bpe.Merges.load(tokenizer("byte_bpe_multi_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=merges.ranks, special_tokens={})
    r = random.Random(2)
    texts = ["".join(r.choice(" \t\n 'strevlmdXé9½日!.") for _ in range(r.randint(0, 16))) for _ in range(2000)]
    assert [x.tolist() for x, _ in merges.encode([t.encode() for t in texts])] == [lib.encode_ordinary(t) for t in texts]


def test_state_scan_equals_a_step_by_step_run():
    r = np.random.default_rng(0)
    symbols = r.integers(0, 8, 5000).astype(np.uint8)
    state, want = bpe.FRESH, []
    for s in symbols.tolist():
        want.append(state)
        state = bpe._NEXT[s][state]
    assert bpe.scan_states(symbols).tolist() == want


def test_counts_match_the_library(docs, rows, none):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted(((i, len(raw(t)), len(sp.encode(t or "")), len(sp.encode(t or "")) > 100) for i, t in rows), key=repr)
    assert keyed(counting.count_tokens(docs, path, limit=100), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert counting.count_tokens(none, path).count() == 0
    r = random.Random(3)
    odd = ["".join(r.choice("  \t\n▁astré日<s>/") for _ in range(r.randint(0, 14))) for _ in range(2000)]
    with open(path, "rb") as f:
        assert counting.Counting(f.read()).count(odd) == [len(sp.encode(t)) for t in odd]


def brute_fp(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw(text).lower())
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def labels_of(n, pairs):
    lab = list(range(n))
    for a, b in pairs:
        x, y = lab[a], lab[b]
        lab = [min(x, y) if v in (x, y) else v for v in lab]
    return lab


def test_simhash_groups(docs, rows, none):
    got = keyed(simhash.groups(docs), "doc_id", "fingerprint", "component_id")
    fps = sorted({brute_fp(t) for _, t in rows})
    lab = labels_of(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 3])
    least = {}
    for i, t in rows:
        if i is not None:
            c = lab[fps.index(brute_fp(t))]
            least[c] = min(i, least.get(c, i))
    want = [(i, f"{brute_fp(t):016x}", least.get(lab[fps.index(brute_fp(t))])) for i, t in rows]
    assert got == sorted(want, key=repr)
    assert simhash.groups(none).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(set(least.values()))


def test_one_of_each_with_repeated_ids(spark):
    say = lambda seed: " ".join(random.Random(seed).choices("alpha beta gamma delta epsilon zeta eta theta iota".split(), k=60))
    texts = [(1, say(1)), (1, say(2)), (2, say(3)), (3, say(1)), (None, say(2)), (None, say(4)), (2, say(3)), (2, say(3))]
    docs = frame(spark, texts)
    kept = sorted(((r.doc_id, r.text) for r in simhash.one_of_each(docs).collect()), key=repr)
    assert kept == sorted([(1, say(1)), (1, say(2)), (2, say(3)), (None, say(4))], key=repr)
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.groups(docs).collect()}
    fp = lambda t: f"{brute_fp(t):016x}"
    assert got == {(1, fp(say(1))): 1, (1, fp(say(2))): 1, (2, fp(say(3))): 2, (3, fp(say(1))): 1, (None, fp(say(2))): 1, (None, fp(say(4))): None}


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 7])
def test_pigeonring_finds_every_pair(spark, radius):
    r = random.Random(radius)
    fps = {r.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(4):
            fps.add(f ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 9))))
    fps = sorted(fps)
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "id long, fp long")
    want = {(a, b) for b in range(len(fps)) for a in range(b) if bin(fps[a] ^ fps[b]).count("1") <= radius}
    assert {(x["a"], x["b"]) for x in simhash.near(nodes, radius).collect()} == want


def test_substring_dedup(docs, rows, none):
    least = {}
    key = lambda i: 2**63 if i is None else i
    for i, t in rows:
        w = raw(t).split()
        for k in range(len(w) - 12):
            x = tuple(w[k : k + 13])
            least[x] = min(key(i), least.get(x, key(i)))
    want = []
    for i, t in rows:
        w = raw(t).split()
        cut = [False] * len(w)
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < key(i):
                cut[k : k + 13] = [True] * 13
        want.append((i, len(w), sum(cut), hashlib.sha256(b" ".join(a for a, c in zip(w, cut, strict=True) if not c)).hexdigest()))
    assert sum(x[2] for x in want) > 1000
    assert keyed(substring_dedup.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup(docs, rows, none, window=100):
    from collections import Counter

    seen = Counter(raw(t)[k : k + window] for _, t in rows for k in range(len(raw(t)) - window + 1))
    want = []
    for i, t in rows:
        b = raw(t)
        cut = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                cut[k : k + window] = b"\1" * window
        kept = bytes(x for x, c in zip(b, cut, strict=True) if not c)
        want.append((i, len(b), sum(cut), sum(c and (j == 0 or not cut[j - 1]) for j, c in enumerate(cut)), hashlib.sha256(kept).hexdigest()))
    assert sum(x[2] for x in want) > 10_000
    assert keyed(suffix_dedup.remove_repeats(docs, window), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    assert suffix_dedup.remove_repeats(none, window).count() == 0


def test_the_largest_id_is_not_taken_for_null(spark):
    docs = frame(spark, [((1 << 63) - 1, "some words"), (None, "other words"), (1, None)])
    for out in (substring_dedup.remove_repeats(docs), suffix_dedup.remove_repeats(docs)):
        assert {r["doc_id"] for r in out.collect()} == {(1 << 63) - 1, None, 1}


def test_hot_anchors_are_cut_without_changing_results(docs, monkeypatch):
    from meridian.llm import repeats

    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    whole = keyed(suffix_dedup.remove_repeats(docs, 100), *cols)
    words = keyed(substring_dedup.remove_repeats(docs), "doc_id", "n_removed", "kept_sha256")
    monkeypatch.setattr(repeats, "HOT_ANCHOR", 1)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 1 << 12)
    assert keyed(suffix_dedup.remove_repeats(docs, 100), *cols) == whole
    assert keyed(substring_dedup.remove_repeats(docs), "doc_id", "n_removed", "kept_sha256") == words


@pytest.mark.parametrize("words", [True, False])
def test_equal_windows_of_a_hot_anchor_never_meet_in_a_shard(spark, monkeypatch, words):
    from collections import Counter

    from meridian.llm import repeats

    r = random.Random(12)
    say = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    shared = say(40)
    rows = [(i, f"{say(30)} {shared} {say(30)}") for i in range(60)] + [(i, f"{say(30)} {shared[:200]} {say(30)}") for i in range(60, 80)]
    rows += [rows[5], (None, rows[6][1]), (3, rows[7][1])]
    kept, stored = {}, repeats.stored

    def spy(df, name):
        kept[name] = stored(df, name)
        return kept[name]

    monkeypatch.setattr(repeats, "stored", spy)
    monkeypatch.setattr(repeats, "HOT_ANCHOR", 10)
    docs = frame(spark, rows)
    n = 13 if words else 100
    key = lambda i: 2**63 if i is None else i
    units = [raw(t).split() if words else raw(t) for _, t in rows]
    windows = [[tuple(u[k : k + n]) if words else u[k : k + n] for k in range(len(u) - n + 1)] for u in units]
    seen = Counter(x for w in windows for x in w)
    least = {}
    for (i, _), w in zip(rows, windows, strict=True):
        for x in w:
            least[x] = min(key(i), least.get(x, key(i)))
    want = []
    for (i, _), u, w in zip(rows, units, windows, strict=True):
        cut = bytearray(len(u))
        for k, x in enumerate(w):
            if least[x] < key(i) if words else seen[x] > 1:
                cut[k : k + n] = b"\1" * n
        want.append((i, len(u), sum(cut)))
    if words:
        got, name = keyed(substring_dedup.remove_repeats(docs), "doc_id", "n_words", "n_removed"), "words"
    else:
        got, name = keyed(suffix_dedup.remove_repeats(docs, n), "doc_id", "n_bytes", "n_removed"), "suffixes"
    assert got == sorted(want, key=repr)
    sent = Counter(bytes(x["body"]) for x in kept[f"{name}-bodies"].where("body is not null").collect())
    assert max(sent.values(), default=0) <= 1
    assert kept[f"{name}-hot"].count() > 0


def test_windows_of_a_hot_anchor_are_counted_in_blocks(spark, monkeypatch):
    from collections import Counter

    from meridian.llm import repeats

    r = random.Random(5)
    say = lambda n: "".join(r.choices("abcdefgh ", k=n))
    shared, rows = say(900), []
    for i in range(120):
        k = r.randrange(900)
        # Contexts of a common passage, near copies with a mutation each or two the same, and pieces that begin and end anywhere.
        rows.append((i, [f"{say(150)}{shared}{say(150)}", f"{shared[:k]}#{shared[k + 1:]}", f"{shared[: k // 50 * 50]}#{shared[k // 50 * 50 + 1 :]}", f"{say(40)}{shared[k : k + 350]}{say(40)}"][i % 4]))
    rows += [rows[5], (None, rows[6][1]), (3, rows[7][1]), (130, None), (131, "short")]
    kept, stored = [], repeats.stored

    def spy(df, name):
        out = stored(df, name)
        kept.append((name, out))
        return out

    monkeypatch.setattr(repeats, "stored", spy)
    monkeypatch.setattr(repeats, "HOT_ANCHOR", 5)
    n = 200
    seen = Counter(raw(t)[k : k + n] for _, t in rows for k in range(len(raw(t)) - n + 1))
    want = []
    for i, t in rows:
        u, cut = raw(t), bytearray(len(raw(t)))
        for k in range(len(u) - n + 1):
            if seen[u[k : k + n]] > 1:
                cut[k : k + n] = b"\1" * n
        want.append((i, len(u), sum(cut), hashlib.sha256(bytes(c for c, x in zip(u, cut, strict=True) if not x)).hexdigest()))
    assert keyed(suffix_dedup.remove_repeats(frame(spark, rows), n), "doc_id", "n_bytes", "n_removed", "kept_sha256") == sorted(want, key=repr)
    rows_of = Counter()
    for name, df in kept:
        rows_of[name] += df.count()
    hot = dict(kept)["suffixes-hot"]
    windows = dict(kept)["suffixes-passages"].join(hot, "h").agg({"n": "sum"}).first()[0]
    assert windows > 4000 and rows_of["suffixes-bodies"] + rows_of["suffixes-blocks"] < windows / 2


def test_long_texts_go_in_blocks():
    from meridian.llm import repeats

    r = np.random.default_rng(1)
    u = repeats.mix(r.integers(1, 50, 4000).astype(np.uint64))
    kind = repeats.Kind("t", 40, 8, lambda t: u, None, None, False)
    whole = list(repeats._occurrences(kind, [b""]))
    before, repeats.BLOCK = repeats.BLOCK, 300
    try:
        cut = list(repeats._occurrences(kind, [b""]))
    finally:
        repeats.BLOCK = before
    windows = lambda found: {(int(h), int(lo + i)) for _, hs, _, los, ns, _ in found for h, lo, n in zip(hs, los, ns, strict=True) for i in range(n)}
    assert windows(whole) == windows(cut) and len(windows(whole)) == 4000 - 39


def test_words_are_hashed_together_as_alone():
    r = random.Random(5)
    long = ["x" * n for n in (7, 8, 9, 16, 63, 64, 65, 200)] + ["x" * 64 + "y", "y" + "x" * 64, "\0", "\0\0", "é" * 40, "\u2003", "a\u00a0b"]
    say = lambda: "".join(r.choice([*long, f"w{r.randrange(99)}"]) + r.choice([" ", "\t", "\n\r", "\x0b\x0c", "  "]) for _ in range(r.randrange(60)))
    texts = [raw(t) for t in ["", " ", "\n", *long, *(say() for _ in range(200)), " lead", "end", ""]]
    hashes = substring_dedup.word_hashes(texts)
    assert [len(h) for h in hashes] == [len(t.split()) for t in texts]
    seen = {(w, int(x)) for t, h in zip(texts, hashes, strict=True) for w, x in zip(t.split(), h, strict=True)}
    assert len({w for w, _ in seen}) == len({x for _, x in seen}) == len(seen) > 100
    assert all((substring_dedup.word_hashes([t])[0] == h).all() for t, h in zip(texts, hashes, strict=True))
    assert substring_dedup.word_hashes([]) == []


def test_anchors_are_dismissed_and_passages_counted_without_python_or_sorts(docs, rows, monkeypatch):
    from meridian.llm import repeats

    plans, stored = {}, repeats.stored

    def spy(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(repeats, "stored", spy)
    assert substring_dedup.remove_repeats(docs).count() == len(rows)
    assert "MapInArrow" not in plans["words-occurrences"]
    assert "SortAggregate" not in plans["words-passages"]


def test_the_bitmap_loses_no_row(spark):
    from meridian.llm import repeats

    r = random.Random(6)
    some = {r.getrandbits(64) - (1 << 63) for _ in range(300)} | {-1, 0, 63, 64, -(1 << 63), (1 << 63) - 1}
    others = {r.getrandbits(64) - (1 << 63) for _ in range(3000)}
    rows = spark.createDataFrame([(h, i) for i, h in enumerate(sorted(some | others))], "h long, lo int")
    got = repeats._likely(rows, spark.createDataFrame([(h,) for h in sorted(some)], "h long"))
    assert got.columns == ["h", "lo"]
    left = [x["h"] for x in got.collect()]
    low = {h & repeats._LOW for h in some}
    assert sorted(left) == sorted(h for h in some | others if h & repeats._LOW in low)


def test_fm_index_counts_patterns():
    r = np.random.default_rng(4)
    text = np.concatenate([r.integers(0, 6, 400), [0]])
    index = substring_dedup.FMIndex(text, 5)
    for _ in range(200):
        k = r.integers(1, 6)
        p = r.integers(1, 6, k)
        lo, hi = np.array([0]), np.array([len(text)])
        for c in p[::-1]:
            lo, hi = index.extend(np.array([c]), lo, hi)
        assert hi[0] - lo[0] == sum((text[i : i + k] == p).all() for i in range(len(text) - k + 1))


BENCH = [(1, "What is the largest planet in our solar system and how many moons does it have today"), (2, None), (3, ""), (4, "tiny item"), (5, " ".join(f"w{i}" for i in range(60)))]


def test_decontamination(spark, none):
    bench = spark.createDataFrame([(i, t, 1) for i, t in BENCH], "item_id long, text string, doc_id long")
    long = BENCH[4][1].split()
    changed = long[:30] + ["other"] + long[31:]
    rows = [(1, "before " + BENCH[0][1].upper() + "! after"), (2, None), (3, ""), (4, " ".join(["x"] * 50 + changed + ["y"] * 50)), (5, "what is the largest planet of all"), (6, "a tiny item here"), (6, "a tiny item here"), (7, "clean text with nothing at all to see"), (None, BENCH[0][1])]
    docs = frame(spark, rows)
    got = decontamination.find(docs, bench)
    assert keyed(got, "doc_id", "item_id") == sorted([(1, 1), (4, 5), (6, 4), (6, 4), (None, 1)], key=repr)
    best = {(r["doc_id"], r["item_id"]): r for r in got.collect()}
    assert best[1, 1]["similarity"] == 1.0 and best[1, 1]["word_start"] == 1
    assert best[4, 5]["similarity"] == pytest.approx(51 / 61) and best[4, 5]["word_start"] == 50
    left = decontamination.clean(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3, 5, 7]
    assert decontamination.find(none, bench).count() == 0
    assert decontamination.find(docs, bench.limit(0)).count() == 0
    assert decontamination.clean(docs, bench.limit(0)).count() == len(rows)


def test_decontamination_in_several_passes(spark, monkeypatch):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = frame(spark, [(i, t) for i, t in BENCH])
    whole = keyed(decontamination.find(docs, bench), "doc_id", "item_id")
    monkeypatch.setattr(decontamination, "INDEX_BYTES", 50)
    assert keyed(decontamination.find(docs, bench), "doc_id", "item_id") == whole == [(1, 1), (4, 4), (5, 5)]


def test_decontamination_of_documents_shorter_than_the_item(spark):
    from collections import Counter

    r = random.Random(8)
    bench = [(i, " ".join(f"v{r.randrange(400)}" for _ in range(n))) for i, n in enumerate((59, 59, 30, 12, 5, 3, 80))]
    rows = [(0, " ".join(bench[0][1].split()[:55]))]
    for _, item in bench:
        words = item.split()
        for a, b in ((0, 1), (1, 0), (1, 1), (2, 2), (4, 3), (0, 6), (8, 7), (0, 0)):
            cut = words[a : len(words) - b]
            rows.append((len(rows), " ".join(cut)))
            if len(cut) > 40:
                rows.append((len(rows), " ".join([*cut[:9], "else", *cut[10:]])))
                rows.append((len(rows), " ".join(["x"] * 30 + cut)))
    fp = lambda s: decontamination._pack(decontamination._bits(s).sum(0, keepdims=True))[0]
    hashed, want = decontamination.Words(), {}
    for d, t in rows:
        w = hashed(t.encode())
        for i, item in bench:
            x = hashed(item.encode())
            n, k = min(len(x), len(w)), min(5, len(x))
            b = decontamination.shingles(x, k)
            found = []
            for at in range(len(w) - n + 1):
                a = decontamination.shingles(w[at : at + n], k)
                far = int(np.bitwise_count(fp(a) ^ fp(b)))
                both = sum((Counter(a.tolist()) & Counter(b.tolist())).values())
                if n >= k and far <= 20 and both / (len(a) + len(b) - both) >= 0.8:
                    found.append((both / (len(a) + len(b) - both), -far, -at, n))
            if found:
                best = max(found)
                want[d, i] = (best[0], -best[1], -best[2], best[3])
    assert (0, 0) in want and want[0, 0][0] == pytest.approx(51 / 55) and sum(v[3] < len(bench[i][1].split()) for (_, i), v in want.items()) > 15
    docs = frame(spark, rows)
    got = {(x["doc_id"], x["item_id"]): (x["similarity"], x["distance"], x["word_start"], x["n_words"]) for x in decontamination.find(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == want
    left = decontamination.clean(docs, spark.createDataFrame(bench, "item_id long, text string"))
    assert {x["doc_id"] for x in left.collect()} == {d for d, _ in rows} - {d for d, _ in want}


def brute_secrets(text):
    out = []
    for kind, pattern, ok in (
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        out += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text, re.ASCII) if ok(m)]
    return sorted(out, key=lambda x: (x[0], secrets.KINDS.index(x[2])))


def test_secrets(spark, docs, rows, none):
    got = {(r["doc_id"], tuple((s["start"], s["end"], s["kind"]) for s in r["spans"])) for r in secrets.scan(docs).collect()}
    assert got == {(i, tuple(brute_secrets(t or ""))) for i, t in rows}
    assert secrets.scan(none).count() == 0
    r = random.Random(9)
    bits = ["password", "PassWD", "api_key", "apikey", "token", "secret", "=", ":", " ", "'", '"', "é", "日", "AKIA", "Z" * 9, "0af3" * 3, "abc", "-", "ſecret", "toKen", "\n"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
        assert secrets.find(text.encode()) == brute_secrets(text), text


def test_checksummed_secrets_and_redaction(spark):
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = "ghp_" + body + secrets.base62_crc(body.encode()).decode()
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    assert [k for *_, k in secrets.find(good.encode())] == ["github"] and secrets.find(bad.encode()) == []
    npm = "npm_" + body + secrets.base62_crc(body.encode()).decode()
    assert [k for *_, k in secrets.find(b"x " + npm.encode())] == ["npm"]
    raw_key = bytes.fromhex("0488ade4") + bytes(range(74))
    n, word = int.from_bytes(raw_key + hashlib.sha256(hashlib.sha256(raw_key).digest()).digest()[:4], "big"), ""
    while n:
        n, d = divmod(n, 58)
        word = chr(secrets._BASE58[d]) + word
    assert [k for *_, k in secrets.find(word.encode())] == ["xkey"]
    docs = frame(spark, [(1, f"é {good} and token=abcdef, end"), (2, None), (3, "plain")])
    out = {r["doc_id"]: r for r in secrets.redact(docs, length="n_chars").collect()}
    assert out[1]["text"] == "é [SECRET] and [SECRET], end" and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] is None and out[3]["text"] == "plain"


def test_sharding(docs, rows, none):
    got = sharding.shard(docs, shards=4, ranges=8).collect()
    want = sorted(((i, len(raw(t)) + 1, None if t is None else zlib.crc32(raw(t))) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == want
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert all(sorted(r["slot"] for r in g) == list(range(len(g))) for g in by.values())
    sizes = [sum(r["size"] for r in g) for g in by.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)
    assert sharding.shard(none).count() == 0


def test_sharding_splits_a_hot_text(spark):
    docs = frame(spark, [(i, "same text" if i % 2 else f"text {i}") for i in range(2000)])
    got = sharding.shard(docs, shards=16, ranges=32).groupBy("shard").agg({"size": "sum"}).collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 40


def test_sharding_keeps_equal_texts_together_beside_a_hot_text(spark):
    docs = frame(spark, [(i, "same text" if i % 3 else f"text {i % 250}") for i in range(3000)])
    rows = sharding.shard(docs, shards=16, ranges=4).collect()
    order = [r["text_crc32"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    runs = 1 + sum(a != b for a, b in zip(order, order[1:]))
    assert len(order) == 3000 and runs == len(set(order))


def vectors(seed=1):
    r = np.random.default_rng(seed)
    base = r.normal(size=(40, 8))
    rows = [(i, (base[i % 40] + r.normal(size=8) * 0.12).tolist()) for i in range(150)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, [2 * x for x in rows[3][1]]), (203, None), (204, []), (205, [0.0] * 8), (206, [1.0, None] + [0.0] * 6), (207, [float("nan")] * 8), (208, [float("inf")] + [0.0] * 7), (209, [1e-300] * 8), (210, [1e300] * 8), (3, rows[5][1]), (211, [1.0, 2.0]), (212, [2.0, 4.0])]
    return rows


@pytest.mark.parametrize("tile", [8192, 16])
def test_embedding_links(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, v int").repartition(3)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) if o else None for (_, v), o in zip(rows, ok, strict=True)]
    n = len(rows)
    linked = [(a, b) for a in range(n) for b in range(a) if ok[a] and ok[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    lab = labels_of(n, linked)
    least = {}
    for (i, _), c in zip(rows, lab, strict=True):
        least[c] = min(i, least.get(c, i))
    want = [(i, sum(k in p for p in linked), least[lab[k]], i == least[lab[k]]) for k, (i, _) in enumerate(rows)]
    got = keyed(embedding_dedup.links(df), "vec_id", "n_links")
    assert got == sorted(((a, b) for a, b, *_ in want), key=repr)
    single = [(i, v) for i, v in rows[:-3] + rows[-2:]]
    df = spark.createDataFrame(single, "vec_id long, embedding array<double>")
    keep = [k for k in range(n) if k != n - 3]
    lab = labels_of(n, [p for p in linked if n - 3 not in p])
    least = {}
    for k in keep:
        least[lab[k]] = min(rows[k][0], least.get(lab[k], rows[k][0]))
    want = sorted(((rows[k][0], least[lab[k]], rows[k][0] == least[lab[k]]) for k in keep), key=repr)
    assert keyed(embedding_dedup.links(df), "vec_id", "component_id", "kept") == want
    assert embedding_dedup.links(df.limit(0)).count() == 0


def test_chain_marginals_by_enumeration():
    from itertools import product

    r = np.random.default_rng(3)
    gain, moves, lens = r.normal(size=(3, 5)), r.normal(size=(2, 2)), np.array([5, 3, 1])
    one, moved, total = toxicity.chain_marginals(gain, lens, moves)
    for c, n in enumerate(lens):
        z, m, pairs = 0.0, np.zeros(5), np.zeros((2, 2))
        for y in product((0, 1), repeat=int(n)):
            w = np.exp(sum(gain[c, t] * y[t] for t in range(n)) + sum(moves[y[t - 1], y[t]] for t in range(1, n)))
            z += w
            m[:n] += w * np.array(y)
            for t in range(1, n):
                pairs[y[t - 1], y[t]] += w
        assert np.allclose(one[c], m / z) and np.allclose(moved[c], pairs / z) and np.isclose(total[c], np.log(z))


def test_toxicity_learns_and_tags(spark, none):
    r = random.Random(4)
    clean, bad = [f"word{i}" for i in range(80)], ["vilest", "grubbins", "grubbing", "grubbity", "mucksome"]
    rows, labels = [], []
    for i in range(400):
        words = [r.choice(clean) for _ in range(r.randint(20, 200))]
        if i % 4 == 0:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0), None))
    rows += [(1000, None), (1001, ""), (1002, "so Grubbinest, word1"), (1002, "so Grubbinest, word1"), (None, "word1 word2")]
    docs = frame(spark, rows)
    marks = spark.createDataFrame([*labels, (None, 1, None), (5000, None, None)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, marks.where("doc_id is null or doc_id % 5 <> 0"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(0, 400, 5)]
    assert sum(got[i]["predicted"] == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert got[1000]["predicted"] == got[1001]["predicted"] == 0 and 0 <= got[1001]["score"] <= 1
    assert got[1002]["predicted"] == 1 and [(s["start"], s["end"]) for s in got[1002]["spans"]] == [(3, 14)]
    left = toxicity.clean(docs, model)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i, x in got.items() if x["score"] < 0.5}
    assert toxicity.score(none, model).count() == 0
    one_kind = toxicity.fit(docs, marks.where("toxic = 0"))
    assert one_kind.base == 0.0 and toxicity.score(docs, one_kind).where("predicted <> 0").count() == 0
    assert toxicity.fit(docs, marks.limit(0)).logit is None


def test_components(spark):
    from meridian.llm.common import components

    r = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(7, 7)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = labels_of(600, edges)
    assert got == {i: want[i] for i in got} and {a for e in edges for a in e if e[0] != e[1]} <= set(got)
    assert json.dumps(sorted(got)) and components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stored_leaves_no_shuffle_files(spark):
    """A stored frame's shuffles are gone when its files stand, whether or not the driver collects garbage."""
    import glob
    import os
    import time

    from meridian.llm.common import _CLEANUP, stored

    dirs = spark._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*")}
    before, rows = files(), spark.range(100_000).selectExpr("id % 50000 AS k").groupBy("k").count()
    kept = stored(rows, "test")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert kept.count() == 50_000 and rows.count() == 50_000
    assert spark.conf.get(_CLEANUP) == "false"  # only the write is cleaned behind
