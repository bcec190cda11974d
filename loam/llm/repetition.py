"""Repetition within a document by weak supervision.

Several rules measure how much of a text repeats itself; each votes "repetitive",
"sound" or abstains.  Expectation-maximisation over the counts of vote patterns estimates how
often each rule is right and how common repetition is, and gives each pattern a
posterior probability, which alone decides.  No rule has to be passed on its own.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import bpe, words
from loam.session import map_arrow, written

#: Words in a run that counts as repeated, fewest words of a text, share that counts as repetitive.
RUN, LEAST, SHARE = 4, 12, 0.30
#: Posterior probability from which a text is repetitive.
CUT = 0.5
#: How often a rule is right before any text is seen, and the weight of that as a share of all texts.
TRUST, WEIGHT = 0.8, 0.05
#: The rules: measure, votes "repetitive" from here, votes "sound" up to here; between them a rule abstains.
RULES = {
    "run_share": (SHARE, 0.10),
    "sentence_share": (0.30, 0.0),
    "line_share": (0.30, 0.0),
    "top_pair_share": (0.20, 0.07),
    "same_word_share": (0.62, 0.42),
    "squeezed": (0.62, 0.42),
}
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")


def _again(parts: list[str]) -> float:
    """The share of characters in parts that stood before."""
    seen, total, again = set(), 0, 0
    for p in parts:
        p = " ".join(p.lower().split())
        if len(p) < 2:
            continue
        total += len(p)
        again += len(p) if p in seen else 0
        seen.add(p)
    return again / total if total else 0.0


def _marked(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Values that are equal only within one text."""
    with np.errstate(over="ignore"):
        return words.mix(h + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def repeated_words(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text of a batch, how many words lie in a run of RUN words that also began earlier in it."""
    term, at = words.runs(h, first, RUN)
    late = np.ones(len(term), bool)
    late[np.unique(_marked(term, np.searchsorted(first, at, "right")), return_index=True)[1]] = False
    edges = np.zeros(len(h) + 1, np.int64)
    np.add.at(edges, at[late], 1)
    np.add.at(edges, at[late] + RUN, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edges[:-1]) > 0)])
    return covered[first[1:]] - covered[first[:-1]]


def _measures(texts: list[str], h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The repeated words of each text, and the measures of all RULES, a line for each text; texts without words measure 0."""
    n = np.diff(first)
    again = repeated_words(h, first)
    pair, at = words.runs(h, first, 2)
    who = np.searchsorted(first, at, "right") - 1
    _, place, times = np.unique(_marked(pair, who), return_index=True, return_counts=True)
    top = np.zeros(len(n), np.int64)
    np.maximum.at(top, who[place], times)
    owner = np.repeat(np.arange(len(n)), n)
    distinct = np.bincount(owner[np.unique(_marked(h, owner), return_index=True)[1]], minlength=len(n))
    some = np.maximum(n, 1)
    low = [x.lower().encode("utf-8", "surrogatepass") for x in texts]
    squeezed = [max(0.0, 1 - len(zlib.compress(x, 6)) / len(x)) if x else 0.0 for x in low]
    m = np.stack([again / some, [_again(_SENTENCE.split(x)) for x in texts], [_again(x.split("\n")) if "\n" in x else 0.0 for x in texts], np.where(top > 1, 2 * top / some, 0.0), 1 - distinct / some, squeezed], 1)
    return again, np.where(n[:, None] > 0, m, 0.0)


def measures(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_words, n_repeated, the RULES' measures, pattern) of every row.

    Words are lower-cased runs of letters.  A text that is null, empty or without
    letters has no words and measures 0.  The pattern has a digit for each rule: 0 sound, 1 repetitive,
    2 abstains; on texts of fewer than LEAST words no rule votes, and the pattern is null.
    """
    kind = df.schema[key].dataType.simpleString()
    high = np.array([a for a, _ in RULES.values()])
    low = np.array([b for _, b in RULES.values()])

    def run(batches):
        for batch in batches:
            for a, b, part in bpe.chunks(batch.column(1).to_pylist()):
                h, first, _, _ = words.word_hashes([x.lower() for x in part], digits=False)
                n = np.diff(first)
                again, m = _measures(part, h, first)
                vote = np.where(m >= high, 1, np.where(m <= low, 0, 2))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n), pa.array(again), *[pa.array(m[:, j]) for j in range(len(RULES))], pa.array(["".join(map(str, v)) if k >= LEAST else None for k, v in zip(n, vote)], pa.string())],
                    names=[key, "n_words", "n_repeated", *RULES, "pattern"],
                )

    columns = ", ".join(f"{r} double" for r in RULES)
    return map_arrow(df.select(key, text), run, f"`{key}` {kind}, n_words bigint, n_repeated bigint, {columns}, pattern string")


def estimate(patterns: dict[str, int], rounds: int = 200) -> dict:
    """EM over vote patterns: the share of repetitive texts, each rule's votes by class, and each pattern's posterior.

    A rule that abstains says nothing.  Each rule is held, with the weight of a few percent of all texts, to be
    right with probability TRUST on either class, so class 1 is the repetitive one even where nearly all texts are of one class.
    """
    names = sorted(patterns)
    votes = np.array([[int(c) for c in p] for p in names], int).reshape(len(names), len(RULES))
    count = np.array([patterns[p] for p in names], float)
    if not len(names) or not (votes < 2).any():
        return {"prior": 0.0, "right": {}, "posterior": {p: 0.0 for p in names}}
    for_, against = (votes == 1).sum(1), (votes == 0).sum(1)
    q = np.where(for_ + against > 0, (for_ + 0.5) / (for_ + against + 1), 0.05)
    held = max(2.0, WEIGHT * count.sum())
    for _ in range(rounds):
        prior = np.clip((q * count).sum() / count.sum(), 1e-4, 1 - 1e-4)
        by_class = []
        for weight, trust in ((1 - q, 1 - TRUST), (q, TRUST)):
            w = weight * count
            yes, no = ((votes == 1) * w[:, None]).sum(0), ((votes == 0) * w[:, None]).sum(0)
            by_class.append((yes + held * trust) / (yes + no + held))
        logit = np.full(len(names), np.log(prior / (1 - prior)))
        for j in range(votes.shape[1]):
            yes, no = np.log(by_class[1][j] / by_class[0][j]), np.log((1 - by_class[1][j]) / (1 - by_class[0][j]))
            logit += np.where(votes[:, j] == 1, yes, np.where(votes[:, j] == 0, no, 0.0))
        new = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    right = {r: (float(1 - a), float(b)) for r, a, b in zip(RULES, *by_class)}
    return {"prior": float(prior), "right": right, "posterior": dict(zip(names, map(float, q)))}


def score(df: DataFrame, key: str, text: str, cut: float = CUT) -> tuple[DataFrame, dict]:
    """(key, n_words, n_repeated, measures, p_repetitive, flagged) of every row, and the estimate.

    A text is flagged where the posterior of its votes is at least ``cut``; no rule decides by itself, and
    nothing but the counts of vote patterns over all rows enters the estimate.  Texts of fewer than LEAST words have
    probability 0, however common repetition is.  Rows delivered twice
    give equal rows; an empty table gives none.
    """
    made = written(measures(df, key, text))
    seen = made.where("pattern is not null").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 to the number of rules rows
    model = estimate({r.pattern: r.n for r in seen}) | {"cut": cut}
    table = F.create_map(*[F.lit(x) for kv in sorted(model["posterior"].items()) for x in kv]) if seen else F.create_map().cast("map<string,double>")
    out = made.withColumn("p_repetitive", F.coalesce(F.try_element_at(table, F.col("pattern")), F.lit(0.0)))
    return out.withColumn("flagged", F.col("p_repetitive") >= F.lit(cut)).drop("pattern"), model


def repetitive(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key): the texts that the posterior flags."""
    return score(df, key, text)[0].where("flagged").select(key).distinct()


def rule_report(df: DataFrame, key: str, text: str) -> DataFrame:
    """(rule, right_on_sound, right_on_repetitive, prior, cut): what EM found."""
    _, model = score(df, key, text)
    rows = [(r, a, b, model["prior"], model["cut"]) for r, (a, b) in model["right"].items()]
    return df.sparkSession.createDataFrame(rows, "rule string, right_on_sound double, right_on_repetitive double, prior double, cut double")
