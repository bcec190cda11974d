"""Words of normalised texts as arrays of 64-bit hashes."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

#: Characters that are never seen (soft hyphen, joiners, marks of direction, byte order mark and the like).
INVISIBLE = dict.fromkeys([0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFE0F, 0xFEFF])
_BROKEN = re.compile(r"(?<=\w)(?:[-‐­])[­​-‍﻿]*[ \t]*\r?\n[\s>|]*(?=\w)")
_SOFT = re.compile(r"(?<=\w)­[ \t]*\r?\n[\s>|]*(?=\w)")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def canonical(text: str) -> str:
    """Lower case, NFKC, without invisible characters."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", text).translate(INVISIBLE).lower()


def readings(text: str | None) -> list[str]:
    """The text with words broken at line ends joined, and, where that differs, with the hyphen kept."""
    if not text:
        return []
    joined = _BROKEN.sub("", text)
    if joined == text:
        return [canonical(text)]
    kept = _SOFT.sub("", text)
    return [canonical(joined)] + ([canonical(kept)] if kept != joined else [])


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


@lru_cache(4)
def word_table(underscore: bool = False, digits: bool = True) -> np.ndarray:
    """Whether a code point is part of a word: letters, digits, and the underscore if asked for."""
    table = np.zeros(0x110000, bool)
    kinds = ("L", "N") if digits else ("L",)
    table[[unicodedata.category(chr(c))[0] in kinds for c in range(0x110000)]] = True
    table[95] = underscore
    return table


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: list[str], underscore: bool = False, digits: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hash of every word, the first word of each text (and the end), and where each word begins and ends in the joined texts.

    The texts are joined by line feeds, so no word crosses from one to the next.
    """
    joined = "\n".join(texts)
    if not joined:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = word_table(underscore, digits)[points]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    starts, stops = edge[::2], edge[1::2]
    power, inverse = _power(len(points) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:-1])])
        h = mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    return h, np.concatenate([[0], np.searchsorted(starts, ends)]), starts, stops


def runs(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs of n words of one text, and the place of their first word."""
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        total = np.zeros(count, np.uint64)
        for k in range(n):
            total = total * np.uint64(0xC2B2AE3D27D4EB4F) + h[k : k + count]
        total = mix(total)
    ends = np.repeat(first[1:], np.diff(first))[:count]
    at = np.flatnonzero(np.arange(count) + n <= ends)
    return total[at], at
