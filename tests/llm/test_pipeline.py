"""The pipeline's stages against brute force on the smallest tables."""

import hashlib
import re

import pytest

import corpus_pipeline as P
from meridian.llm import decontamination, secrets
from meridian.llm.queries import QUERIES, tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, f in P.STAGES:
        docs = P.stored(f(spark, docs, SF), "test-stage")
        out.append(docs.collect())
    return out


def test_stages_keep_the_columns(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    for rows in stages[1:-1]:
        assert list(rows[0].asDict()) == columns


def test_stages_against_brute_force(spark, stages):
    from .test_operators import brute_fp, brute_secrets, labels_of

    docs, kept, once, clean, masked, tokens = stages
    assert {r["doc_id"] for r in kept} <= {r["doc_id"] for r in docs} and len(kept) > 0.8 * len(docs)
    fps = [brute_fp(r["text"]) for r in kept]
    lab = labels_of(len(kept), [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 3])
    least = {}
    for r, c in zip(kept, lab, strict=True):
        least[c] = min(r["doc_id"], least.get(c, r["doc_id"]))
    assert {r["doc_id"] for r in once} == set(least.values()) and len(once) == len(least)
    words = decontamination.Words()
    items = [words((r["text"] or "").encode()).tolist() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaky = set()
    for r in once:
        w = words(r["text"].encode()).tolist()
        for item in items:
            n = len(item)
            for at in range(len(w) - n + 1):
                a = [tuple(w[at + i : at + i + 5]) for i in range(max(1, n - 4))]
                b = [tuple(item[i : i + 5]) for i in range(max(1, n - 4))]
                if w[at] in item and len(set(a) & set(b)) >= 0.7 * len(set(b)):
                    both = sum(min(a.count(x), b.count(x)) for x in set(a))
                    if both / (len(a) + len(b) - both) >= 0.8:
                        leaky.add(r["doc_id"])
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in once} - leaky
    texts = {r["doc_id"]: r["text"] for r in clean}
    for r in masked:
        found = brute_secrets(texts[r["doc_id"]])
        assert (r["text"] != texts[r["doc_id"]]) == bool(found or secrets.find(texts[r["doc_id"]].encode()))
        assert r["n_chars"] == len(r["text"])
    import public_tokenizers
    import tiktoken

    from meridian.llm import bpe

    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Merges.load(tokenizer("byte_bpe_multi_50k.tiktoken")).ranks, special_tokens={})
    want = {r["doc_id"]: hashlib.sha256(",".join(map(str, lib.encode_ordinary(r["text"]))).encode()).hexdigest() for r in masked}
    assert {r["doc_id"]: r["ids_sha256"] for r in tokens} == want


def test_registered_queries_run(spark):
    import __spark_entry__ as E

    names = [n for n in E.queries() if re.match(r"op\d+_", n) or n == "pipeline"]
    assert sorted(names) == sorted([*QUERIES, "pipeline"]) and len(names) == 14
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    for n in ("op1_toxicity", "op10_sharding", "op9_secret_scan"):
        assert E.queries()[n](spark, SF).count() == docs
