"""The language of a text with a probability: character trigrams, profiles counted from labelled texts.

A text's beginning is reduced to lower-case letters and single blanks; each run of three characters
falls into one of GRAMS places.  Profiles are the counts of places by language over all labelled texts (an
aggregate), and a text's language is the one that makes its trigrams most likely.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.session import map_arrow, ship

#: Places of trigrams, characters of a text that are read, pseudo-count of a place, most languages of a set of profiles.
GRAMS, HEAD, PSEUDO, MOST = 1 << 16, 2000, 0.5, 100


def letters(text: Column, head: int = HEAD) -> Column:
    """The beginning in lower case, all but letters as single blanks."""
    return F.regexp_replace(F.lower(F.substring(text, 1, head)), r"[^\p{L}]+", " ")


def _places(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The places of all trigrams, and the text that each belongs to."""
    points = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for x in (x or "" for x in texts)]
    grams = [(p[:-2] * 961 + p[1:-1] * 31 + p[2:]) % GRAMS if len(p) > 2 else p[:0] for p in points]
    return np.concatenate([np.zeros(0, np.int64), *grams]), np.repeat(np.arange(len(texts)), [len(g) for g in grams])


def profiles(labelled: DataFrame, text: str, lang: str) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities by language and place) from all labelled texts; rows without label or text count for nothing."""

    def run(batches):
        for b in batches:
            at, owner = _places(b.column(0).to_pylist())
            labels = np.array(b.column(1).to_pylist(), object)
            for k in dict.fromkeys(labels.tolist()):
                place, n = np.unique(at[(labels == k)[owner]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(place), pa.string()), pa.array(place), pa.array(n)], names=["lang", "place", "n"])

    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(letters(F.col(text)).alias("t"), F.col(lang).alias("lang"))
    counts = map_arrow(known, run, "lang string, place bigint, n bigint").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    names = sorted(r.lang for r in counts.select("lang").distinct().limit(MOST + 1).collect())
    if len(names) > MOST:
        raise ValueError(f"more than {MOST} languages: choose labels first")
    table = np.zeros((len(names), GRAMS))
    found = counts.toArrow()  # at most MOST times GRAMS rows
    table[[names.index(x) for x in found.column("lang").to_pylist()], found.column("place").to_numpy()] = found.column("n").to_numpy()
    return names, np.log((table + PSEUDO) / (table.sum(1, keepdims=True) + PSEUDO * GRAMS))


def detect(df: DataFrame, key: str, text: str, known: tuple[list[str], np.ndarray]) -> DataFrame:
    """(key, language, probability) of every row; null where the beginning has fewer than three letters and blanks, or without profiles."""
    names, logs = known
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(logs.astype(np.float64))  # MOST times GRAMS numbers at most
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        table = shared.value
        for b in batches:
            at, owner = _places(b.column(1).to_pylist())
            score = np.stack([np.bincount(owner, row[at], b.num_rows) for row in table], 1) if len(names) else np.zeros((b.num_rows, 1))
            empty = (np.bincount(owner, minlength=b.num_rows) == 0) | (not names)
            best = score.argmax(1)
            chance = 1 / np.exp(np.clip(score - score.max(1, keepdims=True), -700, 0)).sum(1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([None if e else names[k] for e, k in zip(empty, best)], pa.string()), pa.array(chance, pa.float64(), mask=empty)], names=[key, "language", "probability"]
            )

    return map_arrow(df.select(key, letters(F.col(text)).alias("_t")), run, f"`{key}` {kind}, language string, probability double")
