"""Near-duplicate records: order MinHash, banded alignment, and an exact check.

A sketch takes the two smallest of all occurrence-labelled runs of ``SHINGLE`` words
(under one hash function of several) and keeps them in text order.  Records with repeated runs
have sketches of their distinct runs as well.  Records that
share ``SHARED`` sketches are candidates: at the threshold two records share a sketch
with probability 0.7 squared times that of the same order, so of 64 about 16 to 30.
Sketches of more than ``HOT`` records join nothing; records that have one are compared by
an index of their rarest runs, which loses no pair.

A candidate is aligned: its common runs are laid into bands of diagonals, and a moved
block has a band of its own.  Pairs whose bands of two common runs or more cover ``ALIGNED`` of the smaller
record go on, and the Jaccard similarity of the sets of runs is checked exactly.
Records with equal sets form one class, of which one member is compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import bpe, words
from loam.operators.components import connected_components
from loam.operators.grouping import with_group_values
from loam.session import map_arrow, written

#: Words in a run, sketches of a record, sketches that candidates share, half the width of a band.
SHINGLE, SKETCHES, SHARED, BAND = 3, 64, 3, 24
#: Records from which a sketch joins nothing, share of the smaller record's runs that an alignment covers.
HOT, ALIGNED = 1000, 0.6
_SEEDS = words.mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _drawn(named: np.ndarray) -> np.ndarray:
    """The order sketches of runs in text order."""
    with np.errstate(over="ignore"):
        drawn = words.mix(named[None, :] ^ _SEEDS[:, None])
        if len(named) > 2:
            two = np.sort(np.argpartition(drawn, 2, axis=1)[:, :2], axis=1)
        else:
            two = np.tile(np.array([0, len(named) - 1]), (SKETCHES, 1))
        return words.mix(named[two[:, 0]] * np.uint64(3) + named[two[:, 1]] * np.uint64(0xC2B2AE3D27D4EB4F) + _SEEDS)


def _sketches(term: np.ndarray) -> np.ndarray:
    """The order sketches of one text's runs of words, labelled by occurrence; where runs repeat, those of the first occurrences too."""
    order = np.argsort(term, kind="stable")
    ranked = term[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    since = np.maximum.accumulate(np.where(new, np.arange(len(term)), 0))
    times = np.empty(len(term), np.uint64)
    times[order] = (np.arange(len(term)) - since).astype(np.uint64)
    with np.errstate(over="ignore"):
        named = words.mix(term + times * np.uint64(0xA24BAED4963EE407))
    return _drawn(named) if new.all() else np.unique(np.concatenate([_drawn(named), _drawn(named[times == 0])]))


def sketch(df: DataFrame, key: str, text: str, least_words: int = 20) -> DataFrame:
    """(key, same, n_runs, seq, sketches) of the records with at least so many words; ``same`` is equal for equal sets of runs."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keys = batch.column(0)
            for a, _, part in bpe.chunks(batch.column(1).to_pylist()):
                h, first, _, _ = words.word_hashes([x.lower() for x in part], underscore=True)
                rows, same, n_runs, seqs, sk = [], [], [], [], []
                for i in range(len(part)):
                    seq = h[first[i] : first[i + 1]]
                    if len(seq) < max(least_words, SHINGLE):
                        continue
                    term, _ = words.runs(seq, np.array([0, len(seq)]), SHINGLE)
                    known = np.unique(term)
                    with np.errstate(over="ignore"):
                        same.append(int(words.mix(np.array([words.mix(known).sum() + np.uint64(len(known))], np.uint64)).view(np.int64)[0]))
                    rows.append(a + i)
                    n_runs.append(len(known))
                    seqs.append(seq.view(np.int64))
                    sk.append(_sketches(term).view(np.int64))
                if rows:
                    until = np.concatenate([[0], np.cumsum([len(s) for s in seqs])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.take(pa.array(rows)),
                            pa.array(same, pa.int64()),
                            pa.array(n_runs, pa.int64()),
                            pa.ListArray.from_arrays(pa.array(until), pa.array(np.concatenate(seqs))),
                            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sk])]).astype(np.int32)), pa.array(np.concatenate(sk))),
                        ],
                        names=[key, "same", "n_runs", "seq", "sketches"],
                    )

    return map_arrow(df.select(key, text), run, f"`{key}` {kind}, same bigint, n_runs bigint, seq array<bigint>, sketches array<bigint>")


def _blocks(x: np.ndarray, y: np.ndarray) -> tuple[float, float, int]:
    """Jaccard similarity of the sets of runs, share of the smaller set in bands of two runs or more, and the main diagonal."""
    tx, _ = words.runs(x, np.array([0, len(x)]), SHINGLE)
    ty, _ = words.runs(y, np.array([0, len(y)]), SHINGLE)
    ux, ix = np.unique(tx, return_index=True)
    uy, iy = np.unique(ty, return_index=True)
    _, cx, cy = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
    jaccard = len(cx) / (len(ux) + len(uy) - len(cx))
    diagonal = iy[cy] - ix[cx]
    if not len(diagonal):
        return 0.0, 0.0, 0
    band, seeds = np.unique(diagonal // BAND, return_counts=True)
    main = int(np.median(diagonal[diagonal // BAND == band[np.argmax(seeds)]]))
    return jaccard, int(seeds[seeds > 1].sum()) / min(len(ux), len(uy)), main


def banded_distance(left: list[np.ndarray], right: list[np.ndarray], shift: list[int]) -> np.ndarray:
    """Word edit distances within BAND of the diagonals ``shift``, all pairs at once; what leaves the band costs its length."""
    n = len(left)
    width = 2 * BAND + 1
    lx, ly = np.array([len(x) for x in left]), np.array([len(y) for y in right])
    rows = int(lx.max())
    off = np.array(shift)
    a = np.zeros((n, rows), np.uint64)
    # right texts shifted so that column k of row i is word i + off - BAND + k
    b = np.zeros((n, rows + width), np.uint64)
    inside = np.zeros((n, rows + width), bool)
    for p in range(n):
        a[p, : lx[p]] = left[p]
        start = off[p] - BAND
        lo, hi = max(0, start), min(ly[p], start + rows + width)
        if hi > lo:
            b[p, lo - start : hi - start] = right[p][lo:hi]
            inside[p, lo - start : hi - start] = True
    step = np.arange(width)
    far = 1 << 28
    j = off[:, None] - BAND + step  # right position before the first row, by column
    now = np.where((j >= 0) & (j <= ly[:, None]), j, far).astype(np.int64)
    out = np.full(n, far, np.int64)
    for i in range(rows):
        j = i + 1 + off[:, None] - BAND + step
        other = np.where(inside[:, i : i + width], b[:, i : i + width] != a[:, i, None], True)
        best = np.minimum(now + other, np.concatenate([now[:, 1:], np.full((n, 1), far)], 1) + 1)
        best = np.where(j == 0, i + 1, best)
        best = np.where((j < 0) | (j > ly[:, None]), far, best)
        now = np.minimum(np.minimum.accumulate(best - step, axis=1) + step, far)
        now = np.where((j < 0) | (j > ly[:, None]), far, now)
        done = np.flatnonzero(lx == i + 1)
        if len(done):
            at = ly[done] - (i + 1) - off[done] + BAND
            ok = (at >= 0) & (at < width)
            out[done[ok]] = now[done[ok], at[ok]]
            # the end lies outside the band: the rest of the longer text is inserted or deleted
            rest = np.abs(ly[done] - (i + 1) - off[done])
            edge = now[done, np.where(at < 0, 0, width - 1)]
            out[done[~ok]] = np.minimum(edge + np.maximum(rest - BAND, 0), far)[~ok]
    return np.minimum(out, np.maximum(lx, ly))


def _verify(pairs: DataFrame, threshold: float, key: str, kind: str, describe: bool) -> DataFrame:
    """(a, b, jaccard, in_bands, edit_similarity) of the pairs that align and pass; ``pairs`` has a, b, sa, sb. Without ``describe`` edit similarities are null."""

    def run(batches):
        for batch in batches:
            xs, ys = batch.column(2), batch.column(3)
            px, py = xs.offsets.to_numpy(), ys.offsets.to_numpy()
            vx, vy = xs.values.to_numpy().view(np.uint64), ys.values.to_numpy().view(np.uint64)
            keep, score, banded, left, right, shift = [], [], [], [], [], []
            for i in range(batch.num_rows):
                x, y = vx[px[i] : px[i + 1]], vy[py[i] : py[i + 1]]
                jaccard, aligned, main = _blocks(x, y)
                if aligned >= ALIGNED and jaccard >= threshold:
                    keep.append(i)
                    score.append(jaccard)
                    banded.append(aligned)
                    left.append(x)
                    right.append(y)
                    shift.append(main)
            edit = np.zeros(len(keep))
            order = sorted(range(len(keep)), key=lambda i: len(left[i])) if describe else []
            at = 0
            while at < len(order):
                until, most = at, len(left[order[at]])
                while until < len(order) and until - at < 256 and len(left[order[until]]) <= 1.25 * most + 16:
                    until += 1
                own = order[at:until]
                d = banded_distance([left[i] for i in own], [right[i] for i in own], [shift[i] for i in own])
                edit[own] = 1 - d / np.array([max(len(left[i]), len(right[i])) for i in own])
                at = until
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(score, pa.float64()), pa.array(banded, pa.float64()), pa.array(edit, pa.float64(), mask=np.full(len(keep), not describe))],
                names=["a", "b", "jaccard", "in_bands", "edit_similarity"],
            )

    return map_arrow(pairs.select("a", "b", "sa", "sb"), run, f"a {kind}, b {kind}, jaccard double, in_bands double, edit_similarity double")


def _distinct_runs(made: DataFrame, key: str) -> DataFrame:
    """(k, n_runs, r): each distinct run of each record."""
    kind = made.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            seqs = batch.column(2)
            off, flat = seqs.offsets.to_numpy(), seqs.values.to_numpy().view(np.uint64)
            own = [np.unique(words.runs(flat[a:b], np.array([0, b - a]), SHINGLE)[0]) for a, b in zip(off[:-1], off[1:])]
            rows = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64))], names=["k", "n_runs", "r"]
            )

    return map_arrow(made.select(key, "n_runs", "seq"), run, f"k {kind}, n_runs bigint, r bigint")


def rarest_run_pairs(made: DataFrame, key: str, threshold: float) -> DataFrame:
    """(a, b), a < b: a superset of all pairs that reach the threshold.

    Two such sets have a run in common among the n - ceil(threshold n) + 1 rarest of either.  Rare
    runs come first, so a notice that many records share is in none of these lists as long as it
    is less of a record than the threshold.
    """
    each = with_group_values(_distinct_runs(made, key), "r", "k", records=F.count(F.lit(1)))
    lists = each.groupBy("k", "n_runs").agg(F.array_sort(F.collect_list(F.struct("records", "r"))).alias("rs"))  # a record's own runs
    first = F.slice("rs", F.lit(1), (F.col("n_runs") - F.ceil(F.col("n_runs") * threshold - 1e-9) + 1).cast("int"))
    index = written(lists.select("k", "n_runs", F.explode(first).alias("r")).where("r.records > 1").select("k", "n_runs", F.col("r.r").alias("s")))
    return _paired(index, threshold).distinct()


def _paired(buckets: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: one row for each common s of two records whose sizes allow the threshold."""
    other = buckets.select(F.col("k").alias("k2"), F.col("n_runs").alias("n2"), "s")
    close = (F.col("k") < F.col("k2")) & (F.least("n_runs", "n2") >= F.lit(float(threshold)) * F.greatest("n_runs", "n2"))
    return buckets.join(other, "s").where(close).select(F.col("k").alias("a"), F.col("k2").alias("b"))


def candidates(first: DataFrame, key: str, threshold: float, hot: int = HOT) -> DataFrame:
    """(a, b): pairs that share SHARED sketches, and of the records with a sketch that more than ``hot`` share, those with a rare run in common."""
    buckets = first.select(F.col(key).alias("k"), "n_runs", F.explode("sketches").alias("s"))
    shared = buckets.groupBy("s").agg(F.count(F.lit(1)).alias("m")).where("m > 1")  # most sketches have one record
    known = written(buckets.join(shared, "s"))
    enough = _paired(known.where(F.col("m") <= hot).drop("m"), threshold).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SHARED)
    found = enough.select("a", "b")
    crowded = known.where(F.col("m") > hot).select(F.col("k").alias(key)).distinct()
    if crowded.isEmpty():
        return found
    return found.unionByName(rarest_run_pairs(first.join(crowded, key, "left_semi"), key, threshold)).distinct()


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = 0.7, least_words: int = 20, describe: bool = True, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, jaccard, in_bands, edit_similarity) between classes, and members (rep, key).

    Texts with fewer words (null, empty and blank ones too) are in neither.
    ``key`` is unique; other columns are not read; an empty table gives no rows.
    Equal sets of runs form one class, named by its smallest key, whatever its size.
    ``describe`` measures edit distances along each link's main band.
    """
    kind = df.schema[key].dataType.simpleString()
    made = written(sketch(df, key, text, least_words))
    reps = made.groupBy("same").agg(F.min(key).alias("rep"))
    members = written(made.select(key, "same").join(reps, "same").select("rep", key))
    # one member of each class goes on
    first = made.join(reps.select(F.col("rep").alias(key)), key, "left_semi")
    cand = candidates(first, key, threshold, hot)
    seqs = first.select(F.col(key).alias("k"), "seq")
    pairs = cand.join(seqs.select(F.col("k").alias("a"), F.col("seq").alias("sa")), "a").join(
        seqs.select(F.col("k").alias("b"), F.col("seq").alias("sb")), "b"
    )
    return _verify(pairs, threshold, key, kind, describe), members


def expand(links: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(a, b), a < b: the linked records, members of one class included."""
    one = members.select(F.col("rep").alias("r1"), F.col(key).alias("x"))
    two = members.select(F.col("rep").alias("r2"), F.col(key).alias("y"))
    within = one.join(two, F.col("r1") == F.col("r2")).where("x < y").select("x", "y")
    across = links.select(F.col("a").alias("r1"), F.col("b").alias("r2")).join(one, "r1").join(two, "r2").select("x", "y")
    return within.unionByName(across).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def classes(links: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(key, class_id, class_size, links): one row a record; links counts the records it is similar to."""
    links = written(links)
    comp = connected_components(links)
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(sizes.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.sum("copies").alias("far"))
    reps = (
        sizes.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
        .join(degree.withColumnRenamed("a", "rep"), "rep", "left")
        .select("rep", "copies", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    total = reps.groupBy("class_id").agg(F.sum("copies").alias("class_size"))
    return members.join(reps, "rep").join(total, "class_id").select(key, "class_id", "class_size", "links")
