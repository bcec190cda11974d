"""Encoding, token budget and packing against public tokenizers and brute force."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loam.llm import bpe, packing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.tokenizer_path()), reason="no vocabulary files")


def encoder():
    with open(bpe.tokenizer_path(), "rb") as f:
        return bpe.encoder(f.read())


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


REF = reference() if os.path.exists(bpe.tokenizer_path("byte_bpe_50k.json")) else None


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r'sdmtlver!?.,09aé  漢٣́"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_same_ids_as_public_tokenizer(text):
    ids, first = encoder().encode([text])
    assert ids.tolist() == REF.encode(text, add_special_tokens=False).ids
    by_id = {v: k for k, v in encoder().ranks.items()}
    assert bpe.decode(ids.tolist(), by_id) == text


def test_long_and_special_texts():
    enc = encoder()
    for text in ["a" * 20_000, " " * 5000, "ab" * 3000 + "'re'll", "<|endoftext|> <|endoftext|>", "'" * 99 + "s", "x" * 70 + "\n" * 70]:
        assert enc.encode([text])[0].tolist() == REF.encode(text, add_special_tokens=False).ids
    pieces = enc.offsets("don't  stop")
    assert [(a, b) for a, b, _ in pieces] == [(0, 3), (3, 5), (5, 6), (6, 11)]


def test_batches_do_not_touch(rng):
    texts = ["".join(rng.choice(" 'sre1.\n") for _ in range(rng.randrange(30))) for _ in range(300)]
    ids, first = encoder().encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [REF.encode(t, add_special_tokens=False).ids for t in texts]


def documents(spark, extra=()):
    rows = [(1, "Hello world, hello again"), (2, None), (3, ""), (4, "Hello world, hello again"), (5, "été ☃"), *extra]
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash")).withColumn("piece", F.lit(1))


def test_encode_column(spark):
    got = {r.doc_id: r.ids for r in bpe.encode_column(documents(spark), "doc_id", "text").collect()}
    assert got[2] == got[3] == [] and got[1] == got[4] == REF.encode("Hello world, hello again", add_special_tokens=False).ids
    assert bpe.encode_column(documents(spark).limit(0), "doc_id", "text").count() == 0


def test_offsets_of_a_column(spark):
    enc = encoder()
    by_id = {i: b for b, i in enc.ranks.items()}
    df = documents(spark)
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    got = {r.doc_id: r for r in bpe.offset_column(df, "doc_id", "text").collect()}
    assert set(got) == set(texts)
    for k, r in got.items():
        assert r.ids == REF.encode(texts[k], add_special_tokens=False).ids and sum(r.counts) == len(r.ids)
        at = 0
        for start, stop, n in zip(r.starts, [*r.starts[1:], len(texts[k])], r.counts):
            assert bpe.decode(r.ids[at : at + n], by_id) == texts[k][start:stop]
            at += n


def test_budget_counts_each_token(spark):
    docs = documents(spark).withColumn("source", F.when(F.col("doc_id") == 1, " Ab_c").when(F.col("doc_id") == 4, "AB-C"))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") == 1, "en-US").when(F.col("doc_id") == 4, "English")).withColumn("domain", F.lit(None).cast("string"))
    each = {r.doc_id: r.n_tokens for r in tokens.document_tokens(docs, "doc_id", "text").collect()}
    assert each == {i: len(REF.encode(t or "", add_special_tokens=False).ids) for i, t in docs.select("doc_id", "text").collect()}
    total = {(r.slice, r.source_corpus, r.lang): r.n_tokens for r in tokens.token_budget(docs, "doc_id", "text", "source", "lang", "domain").collect()}
    assert total["source", "ab-c", "*"] == each[1] + each[4] == total["lang", "*", "en"] and total["all", "*", "*"] == sum(each.values())
    assert tokens.token_budget(docs.limit(0), "doc_id", "text", "source", "lang", "domain").count() == 0


@pytest.mark.parametrize("many", [1000, 0])
def test_budget_of_a_whole_table(spark, monkeypatch, many):
    """Every record of sf0.01 against the public tokenizer, with lengths of frequent pieces joined or broadcast."""
    monkeypatch.setattr(tokens, "MANY", many)
    df = spark.read.parquet("/root/testdata/sf0.01/rfc4136.parquet")
    each = {r.record_id: r.n_tokens for r in tokens.document_tokens(df, "record_id", "extracted_text").collect()}
    want = {r.record_id: len(REF.encode(r.extracted_text or "", add_special_tokens=False).ids) for r in df.collect()}
    assert each == want
    rows = tokens.token_budget(df, "record_id", "extracted_text", "source_corpus", "lang", "domain").collect()
    for part in ("source+lang+domain", "source", "lang", "domain", "all"):
        own = [r for r in rows if r.slice == part]
        assert sum(r.n_tokens for r in own) == sum(want.values()) and sum(r.records for r in own) == len(want)
        assert sum(r.empty_records for r in own) == sum(n == 0 for n in want.values())


def stepwise(counts, capacity):
    """Best-two-fit, one container at a time."""
    left, out = sorted(s for s, n in counts.items() for _ in range(n)), []
    while left:
        bin_, gap = [], capacity
        while fit := [s for s in left if s <= gap]:
            s = max(fit)
            left.remove(s)
            bin_.append(s)
            gap -= s
        least = min(bin_)
        if gap:
            pairs = [left[i] + left[j] for i in range(len(left)) for j in range(i) if left[i] + left[j] <= gap + least]
            if pairs and (best := max(pairs)) > least:
                # the pair with the smaller first member, as the plan takes it
                a = next(x for x in sorted(set(left)) if best - x in left and (x != best - x or left.count(x) > 1))
                for s in (a, best - a):
                    left.remove(s)
                bin_.remove(least)
                bin_ += [a, best - a]
                left = sorted([*left, least])
        out.append(sorted(bin_))
    return out


def test_plan_equals_one_container_at_a_time(rng):
    for _ in range(60):
        capacity = rng.randrange(5, 40)
        counts = {rng.randrange(1, capacity + 1): rng.randrange(1, 9) for _ in range(rng.randrange(1, 9))}
        plan = packing.best_two_fit(counts, capacity)
        flat = [sorted(s for s, m in p.items() for _ in range(m)) for p, times in plan for _ in range(times)]
        assert flat == stepwise(counts, capacity)
    assert packing.best_two_fit({}, 9) == []


def test_containers_hold_everything(spark):
    rng = random.Random(1)
    sizes = [(i, rng.choice([0, 1, 3, 7, 7, 7, 30, 95, 260])) for i in range(500)] + [(900, None)]
    placed = packing.fill(spark.createDataFrame(sizes, "k bigint, size bigint"), [("a", 100), ("b", 16)], "k", "size").collect()
    for config, capacity in (("a", 100), ("b", 16)):
        own = [r for r in placed if r.config == config]
        fill, by_key = {}, {}
        for r in own:
            fill[r.container] = fill.get(r.container, 0) + r.n
            by_key.setdefault(r.k, []).append((r.first, r.n))
        assert max(fill.values()) <= capacity
        for k, n in sizes:
            parts = sorted(by_key[k])
            assert sum(x for _, x in parts) == (n or 0) and (len(parts) == 1 or n > capacity)
            assert all(a + x == b for (a, x), (b, _) in zip(parts, parts[1:]))
    assert packing.fill(spark.createDataFrame([], "k bigint, size bigint"), [("a", 10)], "k", "size").count() == 0
