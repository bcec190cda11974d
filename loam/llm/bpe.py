"""Byte-level BPE over columns of text.

Pre-tokenisation uses no regular expression.  The texts of a batch become one
array of code points, each code point a symbol (its class, with what follows
already looked up), and a deterministic automaton over these symbols says where
pieces begin.  Its states come from an associative scan: every block of
symbols is composed into one function state -> state, the functions are
combined by prefix doubling, and a second pass over the blocks starts from the
known states.  The pieces between boundaries go through a cached pair merge.

Defined results: a null text and an empty text have no pieces and no ids; a
string that looks like a special token is ordinary text; any valid Unicode text
is encoded without loss (:func:`decode` gives it back); length is not limited.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loam.session import map_arrow, ship

#: Code points per inner batch, symbols per block, and pieces kept in a worker's cache.
CHUNK, BLOCK, CACHED = 1 << 20, 64, 400_000

_OTHER, _LETTER, _NUMBER, _BLANK, _SPACE, _END = range(6)
_L, _N, _O, _LEAD, _LAST, _WS, _A2, _A3, _SEP = range(9)
_IDLE, _IN_L, _IN_N, _IN_O, _IN_WS, _LED, _ONE, _TWO = range(8)


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken", folder: str = "/opt/tokenizers") -> str:
    """Where a vocabulary file lies; the files are never part of this repository."""
    return f"{folder}/{name}"


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes -> id of a rank file (one base64 token and its id a line)."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point."""
    table = np.zeros(0x110000, np.uint8)
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    table[[k == "L" for k in kinds]] = _LETTER
    table[[k == "N" for k in kinds]] = _NUMBER
    # Unicode White_Space
    table[[*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    table[32] = _BLANK
    return table


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a piece begins here", by symbol and state."""
    to = np.zeros((9, 8), np.uint8)
    new = np.ones((9, 8), bool)
    for sym, state in ((_L, _IN_L), (_N, _IN_N), (_O, _IN_O)):
        to[sym] = state
        for q in (state, _LED):
            new[sym, q] = False
    to[_L, _ONE], to[_L, _TWO] = _IDLE, _ONE  # the letters of a contraction
    new[_L, _ONE] = new[_L, _TWO] = False
    for sym, state in ((_A2, _ONE), (_A3, _TWO)):
        to[sym] = state
        for q in (_IN_O, _LED):  # inside a run of marks an apostrophe is one of them
            to[sym, q], new[sym, q] = _IN_O, False
    to[_LEAD], to[_LAST], to[_WS], to[_SEP] = _LED, _IDLE, _IN_WS, _IDLE
    new[_WS, _IN_WS] = False
    return to, new


_TO, _NEW = _automaton()


def _symbols(points: np.ndarray, separators: np.ndarray) -> np.ndarray:
    kind = _classes()[points]
    kind[separators] = _END
    after = np.append(kind[1:], np.uint8(_END))
    sym = np.array([_O, _L, _N, _WS, _WS, _SEP], np.uint8)[kind]
    last = ((kind == _BLANK) | (kind == _SPACE)) & (after < _BLANK)
    sym[last] = np.where(kind[last] == _BLANK, _LEAD, _LAST)
    marks = np.flatnonzero(points == 39)
    if len(marks):
        ahead = np.append(points, [0, 0])
        one, two = ahead[marks + 1], ahead[marks + 2]
        sym[marks[np.isin(one, [ord(x) for x in "sdmt"])]] = _A2
        pair = ((one == 108) & (two == 108)) | ((two == 101) & ((one == 118) | (one == 114)))
        sym[marks[pair]] = _A3
    return sym


def boundaries(sym: np.ndarray) -> np.ndarray:
    """Where pieces begin: the associative scan over the symbols."""
    n = len(sym)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, _SEP, np.uint8)
    padded[:n] = sym
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T) * np.uint8(8)
    step, begins = _TO.ravel(), _NEW.ravel()
    whole = np.repeat(np.arange(8, dtype=np.uint8)[:, None], blocks, 1)
    for column in columns:  # each block as a function of the state before it
        whole = step[column + whole]
    width = 1
    while width < blocks:  # prefix doubling: function of all blocks up to this one
        later = np.take_along_axis(whole[:, width:], whole[:, :-width], 0)
        whole = np.concatenate([whole[:, :width], later], 1)
        width *= 2
    state = np.concatenate([[np.uint8(_IDLE)], whole[_IDLE, :-1]]).astype(np.uint8)
    out = np.empty((BLOCK, blocks), bool)
    for j, column in enumerate(columns):
        at = column + state
        out[j] = begins[at]
        state = step[at]
    return out.T.ravel()[:n]


def pieces(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The pieces of all texts, the first piece of each text (and the end), and where each piece begins in its text."""
    joined = "\n".join(texts)
    if not joined:
        return [], np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    sym = _symbols(points, ends[:-1])
    starts = np.flatnonzero(boundaries(sym))
    stops = np.append(starts[1:], len(points))
    kept = sym[starts] != _SEP
    starts, stops = starts[kept], stops[kept]
    found = [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist())]
    first = np.concatenate([[0], np.searchsorted(starts, ends)])
    begin = np.concatenate([[0], ends[:-1] + 1])
    return found, first, starts - np.repeat(begin, np.diff(first))


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one piece: the lowest-ranked adjacent pair is merged until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    n = len(piece)
    if n <= 64:
        parts = [piece[i : i + 1] for i in range(n)]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)
    # long pieces: a heap of candidate pairs over a linked list
    end, prev, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        rank, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        end[i], after[i], alive[j] = stop, after[j], False
        if after[j] < n:
            prev[after[j]] = i
            if (r := ranks.get(piece[i : end[after[j]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[j]]))
        if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return tuple(out)


class Encoder(dict):
    """piece -> ids, each piece merged once while it stays in the cache."""

    def __init__(self, data: bytes):
        super().__init__()
        self.ranks = load_ranks(data)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= CACHED:
            self.clear()
        ids = merge(piece.encode("utf-8", "surrogatepass"), self.ranks)
        if len(piece) <= 256:
            self[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each text's first id (and the end)."""
        found, first, _ = pieces(texts)
        lists = list(map(self.__getitem__, found))
        until = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
        return np.fromiter(chain.from_iterable(lists), np.int32, int(until[-1])), until[first]

    def offsets(self, text: str) -> list[tuple[int, int, tuple[int, ...]]]:
        """(first code point, end, ids) of each piece; the pieces cover the text."""
        found, _, starts = pieces([text])
        return [(int(a), int(a) + len(p), self[p]) for p, a in zip(found, starts)]


def decode(ids: list[int], by_id: dict[int, bytes]) -> str:
    """The text of ids."""
    return b"".join(by_id[i] for i in ids).decode("utf-8", "surrogatepass")


_encoders: dict[int, Encoder] = {}


def encoder(data: bytes) -> Encoder:
    """This worker's encoder of a vocabulary."""
    if (key := hash(data)) not in _encoders:
        _encoders[key] = Encoder(data)
    return _encoders[key]


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of texts of about CHUNK code points; a longer text stands alone. Null becomes empty."""
    at, size, run = 0, 0, []
    for i, x in enumerate(texts):
        x = x or ""
        if run and size + len(x) > CHUNK:
            yield at, i, run
            at, size, run = i, 0, []
        run.append(x)
        size += len(x) + 1
    if run:
        yield at, len(texts), run


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary's bytes (under 2 MB, whatever the input) for all executors."""
    ship(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_column(df: DataFrame, key: str, text: str, path: str | None = None, out: str = "ids") -> DataFrame:
    """``key`` and the ids of ``text``: one row per row of ``df``, one pass, no shuffle.

    Null and empty texts have the empty list; other columns of ``df`` are not read.
    """
    data = vocabulary(df.sparkSession, path or tokenizer_path())
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoder(data.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b, part in chunks(texts):
                ids, first = enc.encode(part)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), lists], names=[key, out])

    return map_arrow(df.select(key, text), run, f"`{key}` {kind}, `{out}` array<int>")


def offset_column(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key`` and the pieces of ``text`` in order: where each begins (in code points), how many ids it has, and all ids.

    (key, starts, counts, ids): the ids of piece k follow those of the pieces before it, and piece k ends where the next
    one begins, so any run of ids can be decoded or cut at a place of the text.  Null and empty texts have empty lists.
    """
    data = vocabulary(df.sparkSession, path or tokenizer_path())
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoder(data.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b, part in chunks(texts):
                found, first, starts = pieces(part)
                lists = list(map(enc.__getitem__, found))
                n = np.fromiter(map(len, lists), np.int32, len(lists))
                until = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
                ends = pa.array(first.astype(np.int32))
                ids = pa.ListArray.from_arrays(pa.array(until[first].astype(np.int32)), pa.array(np.fromiter(chain.from_iterable(lists), np.int32, int(until[-1]))))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.ListArray.from_arrays(ends, pa.array(starts.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(n)), ids], names=[key, "starts", "counts", "ids"])

    return map_arrow(df.select(key, text), run, f"`{key}` {kind}, starts array<int>, counts array<int>, ids array<int>")


def count_column(df: DataFrame, key: str, text: str, path: str | None = None, out: str = "n_tokens") -> DataFrame:
    """``key`` and the number of ids of ``text``; null and empty texts have 0."""
    data = vocabulary(df.sparkSession, path or tokenizer_path())
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoder(data.value)
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for a, b, part in chunks(batch.column(1).to_pylist()):
                found, first, _ = pieces(part)
                until = np.concatenate([[0], np.cumsum(np.fromiter(map(len, map(enc.__getitem__, found)), np.int64, len(found)))])
                n[a:b] = np.diff(until[first])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], names=[key, out])

    return map_arrow(df.select(key, text), run, f"`{key}` {kind}, `{out}` bigint")
