"""Ids and pieces of texts by a public tokenizer's vocabulary file, for packing and diagnostics.

The kind of file decides the library: ``.tiktoken`` (ranks of byte pairs), ``.json`` (a tokenizer's whole
definition), ``.model`` (pieces with byte fallback).  Files are read once, their size is checked, and
workers load them once a process.  Strings that look like special tokens are ordinary text.  Null and
empty texts have no ids.
"""

from __future__ import annotations

import base64
import json
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loam.session import map_arrow, ship

#: Largest vocabulary file that is sent to every executor.
LARGEST = 64 << 20
#: Fixed value: how the byte-pair vocabularies split texts.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizer:
    """One interface over three kinds of vocabularies: ids of texts, token strings, ids for unknown text and for the end of a text."""

    def __init__(self, data: bytes, kind: str):
        if kind == ".tiktoken":
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
            encoding = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: encoding.encode_ordinary_batch([x.encode("utf-8", "replace").decode() for x in texts], num_threads=1)
            self.tokens = {i: b.decode("latin-1") for b, i in ranks.items()}
            by_id = {i: b for b, i in ranks.items()}
            self.decode = lambda ids: b"".join(map(by_id.__getitem__, ids)).decode("utf-8", "replace")
            self.unknown, self.end = None, max(ranks.values()) + 1
        elif kind == ".json":
            from tokenizers import Tokenizer as Library

            library = Library.from_str(data.decode())
            library.encode_special_tokens = True
            self.encode = lambda texts: [e.ids for e in library.encode_batch([x.encode("utf-8", "replace").decode() for x in texts], add_special_tokens=False)]
            self.decode = lambda ids: library.decode(ids, skip_special_tokens=False)
            self.tokens = {i: t for t, i in library.get_vocab().items()}
            name = json.loads(data).get("model", {}).get("unk_token")
            self.unknown = library.token_to_id(name) if name else None
            ends = [i for i, t in self.tokens.items() if "endoftext" in t or t in ("</s>", "<eos>")]
            self.end = ends[0] if ends else len(self.tokens)
        elif kind == ".model":
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_proto=data)
            self.encode = lambda texts: library.encode([x.encode("utf-8", "replace").decode() for x in texts], num_threads=1)
            self.decode = library.decode
            self.tokens = {i: library.id_to_piece(i) for i in range(library.vocab_size())}
            self.unknown, self.end = library.unk_id(), library.eos_id()
        else:
            raise ValueError(f"no vocabulary of kind {kind!r}")
        self.size = max(max(self.tokens), self.end) + 1


_loaded: dict[tuple[int, str], Tokenizer] = {}


def _tokenizer(data: bytes, kind: str) -> Tokenizer:
    if (key := (hash(data), kind)) not in _loaded:
        _loaded[key] = Tokenizer(data, kind)
    return _loaded[key]


def load(path: str) -> Tokenizer:
    """The tokenizer of a vocabulary file, for the driver."""
    return _tokenizer(_bytes(path), Path(path).suffix)


def _bytes(path: str) -> bytes:
    if (size := Path(path).stat().st_size) > LARGEST:
        raise ValueError(f"{path} has {size} bytes, more than a vocabulary may have")
    return Path(path).read_bytes()


def _shared(spark: SparkSession, path: str):
    ship(spark)
    return spark.sparkContext.broadcast((_bytes(path), Path(path).suffix))


def token_ids(df: DataFrame, key: str, text: str, path: str, out: str = "ids") -> DataFrame:
    """(key, ids) of every row: one pass, no shuffle; null and empty texts have the empty list."""
    data = _shared(df.sparkSession, path)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        t = _tokenizer(*data.value)
        for batch in batches:
            ids = t.encode([x or "" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, out])

    return map_arrow(df.select(key, text), run, f"`{key}` {kind}, `{out}` array<int>")


def decoded(df: DataFrame, key: str, ids: str, path: str, out: str = "text") -> DataFrame:
    """(key, text) of lists of ids; an empty or null list gives the empty text."""
    data = _shared(df.sparkSession, path)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        t = _tokenizer(*data.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode(x) if x else "" for x in batch.column(1).to_pylist()], pa.string())], names=[key, out])

    return map_arrow(df.select(key, ids), run, f"`{key}` {kind}, `{out}` string")


def word_counts(words: DataFrame, word: str, path: str) -> DataFrame:
    """(word, pieces, unknown): how many ids each word of a table of distinct words has, and how many of them stand for unknown text."""
    data = _shared(words.sparkSession, path)

    def run(batches):
        t = _tokenizer(*data.value)
        for batch in batches:
            ids = t.encode(batch.column(0).to_pylist())
            n = np.fromiter(map(len, ids), np.int64, batch.num_rows)
            unknown = np.fromiter((0 if t.unknown is None else i.count(t.unknown) for i in ids), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(unknown)], names=[word, "pieces", "unknown"])

    return map_arrow(words.select(word), run, f"`{word}` string, pieces bigint, unknown bigint")


def vocabulary_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, token) of a vocabulary: a table of bounded size."""
    return spark.createDataFrame(sorted(load(path).tokens.items()), "id int, token string")
