"""Packing, importance resampling and the Merkle manifest against brute force on
a hostile fixture: nulls in every column, empty and very long texts, ties,
repeated rows, clashing extra columns, empty tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.llm import manifest, packing, resampling
from meridian.llm.oracles import ORACLE
from meridian.llm.queries import QUERIES, tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, id long, leaf string, place long, task int, rank long, score long, key long"
MODEL = "byte_bpe_50k.json"


def make_rows(seed=3):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeABCéßñ日0'") for _ in range(r.randint(1, 7))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    rows = [(None, "No ID " + say(30), "en"), (None, None, "en"), (None, None, "en"), (None, "Other", None), (0, None, None), (1, "", "en"),
            (2, " \t\n ", "de"), (3, "<|endoftext|> in a text<|endoftext|>", "en"), (4, "Don't  'S 's't we'll \u0085x　y  ", ""),
            (5, "a" * 1_000_000, "en"), (6, " " * 100_000 + "x", "en"), (7, say(20_000), "en"), (-(1 << 63), "Least", "en"), ((1 << 63) - 1, "Greatest", "en")]
    rows += [(10 + i, say(r.randint(0, 300)), r.choice(["en", "en", "en", "fr", "日"])) for i in range(700)]
    rows += [(r.randrange(-(1 << 62), 1 << 62), say(25), "en") for _ in range(40)]
    rows += [(99, "Same ID", "en")] * 3 + [(99, f"Same id, other text {i % 7}", "en") for i in range(30)] + [rows[20], rows[20]]
    return [(i, t, lang, None if n % 5 == 0 else f"s{n % 3}", None if n % 7 == 0 else len(t or "")) for n, (i, t, lang) in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(*row, "x", 1, "y", 2, 3, 4, 5, 6) for row in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    """The fixture as tables of a registered query, with a target of some of its texts;
    without the two words of 100,000 characters and more, over which SQL's fold takes hours."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = docs.where("doc_id is null or doc_id not in (5, 6)")
    docs.write.parquet(f"{path}/documents.parquet")
    docs.where("lang = 'fr' or text is null").select(F.col("doc_id").alias("item_id"), "text").write.parquet(f"{path}/benchmark.parquet")
    return path


# -- packing ------------------------------------------------------------------


def test_packing_places_every_id_of_the_library_once(spark, docs, rows, none):
    from tokenizers import Tokenizer

    lib, cap = Tokenizer.from_file(tokenizer(MODEL)), 2048
    got = packing.pack(docs, tokenizer(MODEL), keep_ids=True).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % cap or cap if len(ids) > cap else len(ids)
        cuts = [0, *range(first, len(ids) + 1, cap)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= cap
    total = sum(n for _, _, _, n, _ in want.elements())
    assert len(sequences) <= -(-total // cap) + 1
    packed = packing.pack(docs, tokenizer(MODEL), keep_ids=True)
    whole = packing.assemble(packed).collect()
    assert sum(len(r.ids) for r in whole) == total and max(len(r.ids) for r in whole) <= cap
    assert packing.pack(none, tokenizer(MODEL)).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_plan_uses_every_piece_once_and_never_overfills(seed):
    r, cap = random.Random(seed), 64
    kinds = [lambda n: r.randint(0, 5), lambda n: 10**9 * (n % 3 == 0), lambda n: 1000 * (n > 30), lambda n: r.randint(0, 10**6) * (n < 9),
             lambda n: 7 if n in (33, 40) else 0, lambda n: 10**7 if n == 22 else r.randint(0, 2)]
    counts = {n: c for n in range(1, cap + 1) if (c := kinds[seed % len(kinds)](n))}
    plan, used, taken = packing.Plan.best(counts, cap), Counter(), Counter()
    for times, held in plan.patterns:
        assert times > 0 and sum(n * k for n, k in held.items()) <= cap
        for n, k in held.items():
            used[n] += times * k
    assert used == Counter(counts)
    for n, first, copies, offset, _ in plan.segments().tolist():
        assert first >= taken[n] and offset + copies * n <= cap
        taken[n] = first
    decreasing = first_fit_decreasing(counts, cap) if sum(counts.values()) < 1000 else None
    assert decreasing is None or plan.sequences <= decreasing


def first_fit_decreasing(counts, cap):
    gaps = []
    for n in sorted(Counter(counts).elements(), reverse=True):
        at = next((i for i, g in enumerate(gaps) if g >= n), None)
        if at is None:
            gaps.append(cap - n)
        else:
            gaps[at] -= n
    return len(gaps)


def test_plan_finds_singles_pairs_and_triples():
    assert packing.Plan({10: 4, 6: 4}, 16).sequences == 4
    assert packing.Plan({9: 5, 4: 5, 3: 5}, 16).sequences == 5
    assert packing.Plan({7: 3, 4: 3, 3: 3, 2: 3}, 16).sequences == 3
    assert packing.Plan({8: 7}, 16).sequences == 4
    assert packing.Plan({}, 16).sequences == 0 and len(packing.Plan({}, 16).segments()) == 0


def test_ranks_stand_for_the_library_only_where_they_merge_alike():
    with open(tokenizer(MODEL), encoding="utf-8") as f:
        model = f.read()
    assert packing.same_merges(model)
    with open(tokenizer("word_bpe_49k.json"), encoding="utf-8") as f:
        assert not packing.same_merges(f.read())


# -- importance resampling ------------------------------------------------------


def words_of(text):
    out, now = [], ""
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        if c.isascii() and not ("0" <= c <= "9" or "a" <= c <= "z"):
            out.append(now)
            now = ""
        else:
            now += c
    return [w for w in [*out, now] if w]


def brute_resample(rows, target, buckets, grams, least, percent, seed):
    def features(text):
        w = words_of(text)
        return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, grams + 1) for i in range(len(w) - k + 1)]

    every = [(i, *features(t)) for i, t, *_ in rows]
    s, t = Counter(b for _, _, f in every for b in f), Counter(b for x in target for b in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for i, n, f in every:
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    ranked = [(*r, k + 1) for k, r in enumerate(able[:len(able) * percent // 100])]
    rest = Counter(out) - Counter(r[:5] for r in ranked)
    return Counter(ranked) + Counter({(*r, None): n for r, n in rest.items()})


@pytest.mark.parametrize(("buckets", "grams", "percent"), [(10_000, 1, 10), (97, 3, 50), (64, 2, 100), (1000, 1, 0)])
def test_resampling_equals_brute_force(spark, docs, rows, none, buckets, grams, percent):
    items = [t for _, t, lang, *_ in rows if lang == "fr"] + [None, ""]
    target = spark.createDataFrame([(t,) for t in items], "text string")
    got = resampling.resample(docs, target, buckets, grams, 20, percent, 2024)
    assert Counter(map(tuple, got.collect())) == brute_resample(rows, items, buckets, grams, 20, percent, 2024)
    assert resampling.resample(none, target, buckets, grams, 20, percent).count() == 0


def test_bit_planes_weigh_exactly():
    r = np.random.default_rng(1)
    counts = r.integers(0, 1 << 20, (9, 1000)) * (r.random((9, 1000)) < 0.3)
    for span in (1, 1000, 1 << 16):
        gain = r.integers(-span, span, 1000)
        signed = resampling.planes(gain, int(np.abs(gain).max()).bit_length() + 1)
        assert (resampling.weigh(counts, signed) == counts @ gain).all()
    empty = np.zeros((2, 1000), np.int64)
    assert (resampling.weigh(empty, signed) == 0).all()


# -- manifest -------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    def digest(i, t, lang, source, n):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, t)))

    def lower(t):
        return t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def tree(nodes):
        """Levels from the nodes up."""
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    def climb(levels, at):
        for level in levels[:-1]:
            start = at // 8 * 8
            yield "".join(level[start:at]), "".join(level[at + 1:start + 8])
            at //= 8

    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0], digest(*row), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = tree([d for _, d, _ in groups[g]])
    top = tree([trees[g][-1][0] for g in order])
    root, out = top[-1][0], Counter()
    for at, g in enumerate(order):
        for k, (i, leaf, row) in enumerate(groups[g]):
            steps = [*climb(trees[g], k), *climb(top, at)]
            hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
            now = digest(i, lower(row[1]), *row[2:]) if hit else leaf
            for left, right in steps:
                now = sha(left + now + right)
            out[i, leaf, trees[g][-1][0], root, sha("".join(a + b for a, b in steps)), now, now == root] += 1
    return out


def test_manifest_equals_brute_force(spark, rows, none, folder):
    want = brute_manifest([r for r in rows if r[0] not in (5, 6)])
    assert Counter(map(tuple, QUERIES["op13_merkle_manifest"](spark, folder).collect())) == want
    assert {v for *_, v in want} == {True, False}
    assert manifest.build(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 511, 512, 513, 1200])
def test_manifest_of_one_group_at_every_edge(spark, n):
    rows = [(i * 37 % n, f"Text {i}", "en", "s", 1) for i in range(n)]
    got = manifest.build(frame(spark, rows)).select("doc_id", "leaf", "subroot", "root", "proof_sha256")
    assert Counter(map(tuple, got.collect())) == Counter({k[:5]: v for k, v in brute_manifest(rows).items()})


def test_manifest_of_many_groups_and_of_copies(spark, monkeypatch):
    monkeypatch.setattr(manifest, "COPIES_AT_ONCE", 16)
    rows = [(i % 4, f"T{i % 3}", f"lang{i}" if i % 2 else None, None, None) for i in range(1300)]
    got = manifest.build(frame(spark, rows)).select("doc_id", "leaf", "subroot", "root", "proof_sha256")
    want = Counter()
    for k, v in brute_manifest(rows).items():
        want[k[:5]] += v
    assert Counter(map(tuple, got.collect())) == want


def test_places_count_smaller_ids(spark):
    r = random.Random(9)
    ids = [None, None, -(1 << 63), (1 << 63) - 1, -1, 0, 63, 64, 65_535, 65_536] + [r.randrange(-(1 << 63), 1 << 63) >> r.randint(0, 60) for _ in range(2000)]
    leaves = spark.createDataFrame([("=a" if i % 2 else "", v, hashlib.sha256(str(i).encode()).digest(), None) for i, v in enumerate(ids)], "g string, id long, leaf binary, bad binary")
    got = manifest.places(leaves).collect()
    for g in ("", "=a"):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own))) and {r.total for r in own} == {len(own)}
        key = [(r.id is not None, r.id or 0, bytes(r.leaf)) for r in own]
        assert key == sorted(key)


# -- registered queries -----------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_registered_queries_equal_their_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    found = con.execute(ORACLE[name])
    columns = [d[0] for d in found.description]
    got = QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(map(tuple, got.select(columns).collect())) == Counter(found.fetchall())


def test_registered_packing_is_the_operator(spark, folder, docs):
    got = QUERIES["op11_best_fit_packing"](spark, folder)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.agg(F.sum("length")).first()[0] == packing.pieces(docs.where("doc_id is null or doc_id not in (5, 6)"), tokenizer(MODEL), 2048).agg(F.sum("length")).first()[0]
