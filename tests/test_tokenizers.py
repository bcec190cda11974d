"""Vocabulary files of three kinds against their libraries, packing over real ids, reuse of results."""

import os

import pytest
from pyspark.sql import functions as F

from loam.functions import tokenizers
from loam.operators import packing
from loam.plans import reuse

FOLDER = "/opt/tokenizers"
FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]
TEXTS = ["", None, "plain words", "  two  blanks\n\n\tand tabs ", "it's we'll", "Zürich ÄÖ 漢字 🙂", "<|endoftext|> is text", "12345 67", "x" * 3000]

needs = pytest.mark.skipif(not os.path.exists(FOLDER), reason="no vocabulary files")


@needs
@pytest.mark.parametrize("name", FILES)
def test_ids_and_texts(spark, name):
    path = f"{FOLDER}/{name}"
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k bigint, t string").withColumn("ids", F.lit("clash"))
    ids = tokenizers.token_ids(df, "k", "t", path)
    got = {r.k: r.ids for r in ids.collect()}
    t = tokenizers.load(path)
    assert got == {i: list(t.encode([x or ""])[0]) for i, x in enumerate(TEXTS)} and got[0] == got[1] == []
    assert all(0 <= i < t.size for v in got.values() for i in v)
    back = {r.k: r.text for r in tokenizers.decoded(ids, "k", "ids", path).collect()}
    if name.endswith(".tiktoken"):
        assert back == {i: x or "" for i, x in enumerate(TEXTS)}
    else:
        assert "plain" in back[2] and "words" in back[2] and back[0] == ""
    counts = {r.word: (r.pieces, r.unknown) for r in tokenizers.word_counts(spark.createDataFrame([("plain",), ("unbelievable",)], "word string"), "word", path).collect()}
    assert counts["plain"][0] >= 1 and counts["unbelievable"][0] >= counts["plain"][0]


@needs
def test_the_same_vocabulary_in_two_files():
    a, b = (tokenizers.load(f"{FOLDER}/byte_bpe_50k{k}") for k in (".tiktoken", ".json"))
    texts = [x for x in TEXTS if x]
    assert [list(v) for v in a.encode(texts)] == [list(v) for v in b.encode(texts)] and a.end == b.end == 50256


@needs
def test_packed_shape(spark):
    """Every sequence is full, ids are in the vocabulary, and the stream is the documents' ids with an end id each."""
    path = f"{FOLDER}/byte_bpe_50k.tiktoken"
    t = tokenizers.load(path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids = tokenizers.token_ids(docs, "doc_id", "text", path)
    packed = packing.pack(ids, "doc_id", F.col("ids"), 128, end=t.end)
    stream = [i for r in ids.orderBy("doc_id").collect() for i in [*r.ids, t.end]]
    got = [i for r in packed.orderBy("sequence_id").collect() for i in r.input_ids]
    assert got == stream[: len(stream) // 128 * 128]
    metrics = packing.pack_metrics(packing.spans(ids, "doc_id", F.col("ids"), 128), 128)
    held = lambda *a: {r.claim: r.holds for r in packing.compatibility(packed, metrics, *a).collect()}
    assert all(held(128, t.size).values())
    assert not held(128, 100)["ids in vocabulary"] and not held(100, t.size)["length divides"]
    words = packing.word_pieces(docs, "doc_id", "text", path)
    assert words.agg(F.sum(F.col("n"))).first()[0] == packing.word_pieces(docs, "doc_id", "text").agg(F.sum("n")).first()[0]


def test_unknown_kind(tmp_path):
    (tmp_path / "v.txt").write_text("x")
    with pytest.raises(ValueError, match="kind"):
        tokenizers.load(str(tmp_path / "v.txt"))


def test_results_are_reused(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 1.5)], "k bigint, t string, v double")
    same = df.orderBy(F.desc("k"))
    assert reuse.table_digest(df) == reuse.table_digest(same) != reuse.table_digest(df.withColumn("t", F.lit("a")))
    assert reuse.table_digest(df.limit(0)) == reuse.table_digest(df.where("k > 5"))
    made = []

    def build():
        made.append(1)
        return df

    one = reuse.identity({"a": 1}, reuse.table_digest(df))
    assert [reuse.reused(spark, str(tmp_path), n, build)[1] for n in (one, one, reuse.identity({"a": 2}))] == [False, True, False] and len(made) == 2
    (tmp_path / one / "_SUCCESS").unlink()  # a run that broke off
    assert not reuse.reused(spark, str(tmp_path), one, build)[1] and len(made) == 3
