"""Exact, paragraph-wise and near duplicates; greedy selection in order."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators.grouping import first_rows, ranked, with_group_values
from loam.session import map_arrow, written

PRIME = 4294967291
#: Texts from which a band of signatures pairs nothing.
HOT = 1000


def first_occurrences(df: DataFrame, key: str, content: Column) -> DataFrame:
    """Every row with ``duplicate_of``: the smallest key with equal content, null for that row itself. Null content is never a duplicate."""
    x = df.withColumn("_h", F.coalesce(F.sha2(content, 256), F.concat(F.lit("null:"), F.col(key).cast("string"))))
    slim = with_group_values(x.select(key, "_h"), "_h", key, _first=F.min(key)).where(F.col("_first") < F.col(key)).select(key, F.col("_first").alias("duplicate_of"))
    return df.join(slim.distinct(), key, "left")


#: List items and commands, by how a line begins.
LIST_ITEM = r"^[ \t]*(?:[-*+•]|[0-9]+[.)]|[A-Za-z][.)])[ \t]+"
CLI_LINE = (
    r"(?i)^[ \t]*(?:(?:switch|router|leaf|spine|n[3579]k)[\w.-]*(?:\([^)]*\))*[#>]|configure(?:[ \t]+terminal)?\b|conf[ \t]+t\b|show[ \t]+[^ \t]+"
    r"|interface[ \t]+[^ \t]+|router[ \t]+(?:bgp|ospf)\b|feature[ \t]+[^ \t]+|vlan[ \t]+[0-9]+\b|vrf(?:[ \t]+context)?[ \t]+[^ \t]+|ip[ \t]+route\b"
    r"|no[ \t]+shutdown[ \t]*$|shutdown[ \t]*$|switchport\b|exit[ \t]*$|end[ \t]*$)"
)


def paragraph_kind(p: Column, min_chars: int = 150) -> Column:
    """short, fenced_code, table, list, cli or prose."""
    return T.let(F.filter(F.transform(F.split(p, "\n"), lambda v: F.btrim(v, F.lit(" \t\r"))), lambda v: v != ""), lambda lines: _kind(p, lines, min_chars))


def _kind(p: Column, lines: Column, min_chars: int) -> Column:
    n = F.size(lines)
    bars = F.size(F.filter(lines, lambda v: (F.regexp_count(v, F.lit(r"\|")) >= 2) | (F.regexp_count(v, F.lit("\t")) >= 2)))
    items = F.size(F.filter(lines, lambda v: v.rlike(LIST_ITEM)))
    cli = F.size(F.filter(lines, lambda v: v.rlike(CLI_LINE)))
    return (
        F.when(F.length(T.squeeze(p)) < min_chars, "short")
        .when(p.contains("```"), "fenced_code")
        .when((bars >= 2) & (bars >= 0.5 * n), "table")
        .when((items >= 2) & (items >= 0.4 * n), "list")
        .when((cli >= 2) & (cli >= 0.4 * n), "cli")
        .otherwise("prose")
    )


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, paragraph): the non-blank paragraphs of each text, from 1."""
    parts = F.filter(F.transform(F.split(T.line_ends(F.col(text)), "\n[ \t]*\n[ \t\n]*"), T.strip), lambda p: p != "")
    return docs.select(key, F.posexplode(parts).alias("pos", "paragraph")).withColumn("pos", F.col("pos") + 1)


def paragraph_dedup(docs: DataFrame, key: str, text: str, most: int = 1, min_chars: int = 150) -> DataFrame:
    """(key, pos, paragraph, kind, nth, kept): prose paragraphs beyond the first ``most`` equal ones in the corpus are dropped.

    Paragraphs of other kinds are always kept.  Places among copies come from ranks over range partitions
    (:func:`loam.operators.grouping.ranked`), so no task sees all copies of a paragraph that a third of all texts
    hold.  What is ranked are digests; texts are read twice.
    """
    p = paragraphs(docs, key, text).withColumn("kind", paragraph_kind(F.col("paragraph"), min_chars))
    p = p.withColumn("digest", F.sha2(F.lower(T.squeeze("paragraph")), 256))
    prose = p.where("kind = 'prose'").select("digest", key, "pos")
    nth = ranked(prose, ["digest"], [key, "pos"], [], "nth").select(key, "pos", (F.col("nth") + 1).alias("nth"))
    return (
        p.join(nth, [key, "pos"], "left")
        .withColumn("kept", F.col("nth").isNull() | (F.col("nth") <= most))
        .select(key, "pos", "paragraph", "digest", "kind", "nth", "kept")
    )


# -- MinHash --------------------------------------------------------------------------------


def coefficients(n: int = 128, seed: int = 1) -> list[tuple[int, int]]:
    """The n pairs (a, b) of the permutations (a h + b) mod PRIME."""
    rng = random.Random(seed)
    return [(rng.randrange(1, PRIME // 4), rng.randrange(0, PRIME)) for _ in range(n)]


def shingles(text: Column, n: int = 3) -> Column:
    """The distinct runs of n words; the words themselves where there are fewer than n."""

    def runs(w):
        return F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))

    return F.array_distinct(T.let(T.tokens(text), lambda w: F.when(F.size(w) >= n, runs(w)).otherwise(w)))


def signatures(docs: DataFrame, key: str, text: str, permutations: int = 128, n: int = 3) -> DataFrame:
    """(key, signature array<bigint>) of the texts that have words: the minimum per permutation.

    No shuffle: a row's run hashes are made by column expressions, and all permutations of a batch
    are applied to one flat array (128 aggregates in one grouping would leave generated code).
    """
    kind = docs.schema[key].dataType.simpleString()
    hashes = F.transform(shingles(F.col(text), n), lambda s: F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint"))
    pairs = coefficients(permutations)

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.uint64)
            starts = (offsets[:-1] - offsets[0]).astype(np.int64)
            out = np.empty((len(starts), permutations), np.int64)
            for i, (a, b) in enumerate(pairs if len(starts) else []):
                out[:, i] = np.minimum.reduceat((flat * np.uint64(a) + np.uint64(b)) % np.uint64(PRIME), starts)
            ends = np.arange(len(starts) + 1, dtype=np.int32) * permutations
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))], names=[key, "signature"])

    rows = docs.select(key, hashes.alias("h")).where(F.size("h") > 0)
    return map_arrow(rows, run, f"`{key}` {kind}, signature array<bigint>")


def bands_of(signed: DataFrame, key: str, bands: Column) -> DataFrame:
    """(a, band): ``bands`` parts, as equal as can be, that each signature is cut into."""
    start = lambda i: F.floor(i * F.size("signature") / bands).cast("int")
    band = F.explode(F.transform(F.sequence(F.lit(0), bands - 1), lambda i: F.struct(i.alias("i"), F.xxhash64(F.slice("signature", start(i) + 1, start(i + 1) - start(i))).alias("h"))))
    return signed.select(F.col(key).alias("a"), band.alias("band"))


def rarest_places(signed: DataFrame, key: str, threshold: float) -> DataFrame:
    """(a, b), a < b: a superset of all pairs of signatures that agree by the threshold.

    Signatures are sets of (place, minimum).  Two that agree so much have one in common among the
    n - ceil(threshold n) + 1 rarest of either; what a notice that many texts share puts into signatures is rare in none.
    """
    each = signed.select(F.col(key).alias("a"), F.size("signature").alias("n"), F.posexplode("signature").alias("i", "m")).select("a", "n", F.xxhash64("i", "m").alias("h"))
    each = with_group_values(each, "h", "a", texts=F.count(F.lit(1)))
    order = each.groupBy("a", "n").agg(F.array_sort(F.collect_list(F.struct("texts", "h"))).alias("hs"))  # as many as a signature has places
    first = order.select("a", F.explode(F.slice("hs", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))).alias("r"))
    index = written(first.where("r.texts > 1").select("a", F.col("r.h").alias("h")))
    return index.join(index.withColumnRenamed("a", "b"), "h").where("a < b").select("a", "b").distinct()


def candidate_pairs(signed: DataFrame, key: str, threshold: float, hot: int = HOT) -> DataFrame:
    """(a, b), a < b: a superset of all pairs of distinct signatures that agree by the threshold.

    Such signatures differ in at most k places, so of k + 1 bands one at least is equal.  A band of more
    than ``hot`` texts pairs nothing; its texts are compared by :func:`rarest_places`.
    """
    bands = F.least(F.size("signature"), F.size("signature") - F.ceil(F.size("signature") * threshold - 1e-9) + 1).cast("int")
    each = bands_of(signed, key, bands)
    shared = each.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1")  # most bands have one text
    known = written(each.join(shared, "band"))
    x = known.where(F.col("m") <= hot).select("a", "band")
    pairs = x.join(x.withColumnRenamed("a", "b"), "band").where("a < b").select("a", "b")
    crowded = known.where(F.col("m") > hot).select(F.col("a").alias(key)).distinct()
    if not crowded.isEmpty():
        pairs = pairs.unionByName(rarest_places(signed.join(crowded, key, "left_semi"), key, threshold))
    return pairs.distinct()


def similar_pairs(signed: DataFrame, key: str, threshold: float = 0.85, hot: int = HOT) -> DataFrame:
    """(a, b, similarity): all pairs whose signatures agree in at least that share of places.

    Equal signatures are one class, of which the smallest key is compared; the pairs of classes
    are given for all their members in the end.
    """
    signed = written(signed.withColumn("_c", F.sha2(F.array_join("signature", ","), 256)))
    classes = written(signed.groupBy("_c").agg(F.min(key).alias("_rep")))
    members = signed.select(F.col(key).alias("k"), "_c").join(classes, "_c").select("_rep", "k")
    reps = signed.join(classes.select(F.col("_rep").alias(key)), key, "left_semi")
    one = reps.select(F.col(key).alias("a"), F.col("signature").alias("sa"))
    two = reps.select(F.col(key).alias("b"), F.col("signature").alias("sb"))
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda v: v)) / F.size("sa")
    linked = candidate_pairs(reps, key, threshold, hot).join(one, "a").join(two, "b").select("a", "b", same.alias("similarity")).where(F.col("similarity") >= threshold)
    left, right = members.select(F.col("_rep").alias("a"), F.col("k").alias("x")), members.select(F.col("_rep").alias("b"), F.col("k").alias("y"))
    across = linked.join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    copies = left.join(right, F.col("a") == F.col("b")).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(1.0).alias("similarity"))
    return across.unionByName(copies)


def jaccard_pairs(docs: DataFrame, key: str, text: str, threshold: float = 0.85, n: int = 3) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of texts whose sets of runs have at least that Jaccard similarity.

    Sets that similar have a run in common among the first size - ceil(threshold size) + 1 of either, whatever
    order all sets are brought into; with rare runs first, the lists of an index over these are short.
    """
    sets = written(docs.select(key, F.array_distinct(F.transform(shingles(F.col(text), n), lambda s: F.xxhash64(s))).alias("s")).where(F.size("s") > 0))
    each = with_group_values(sets.select(key, F.size("s").alias("size"), F.explode("s").alias("h")), "h", key, texts=F.count(F.lit(1)))
    order = each.groupBy(key, "size").agg(F.array_sort(F.collect_list(F.struct("texts", "h"))).alias("runs"))
    first = order.select(key, "size", F.explode(F.slice("runs", F.lit(1), (F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1).cast("int"))).alias("r"))
    index = written(first.where("r.texts > 1").select(key, "size", F.col("r.h").alias("h")))  # what one text has alone joins nothing
    x = index.select(F.col(key).alias("a"), F.col("size").alias("na"), "h")
    y = index.select(F.col(key).alias("b"), F.col("size").alias("nb"), "h")
    close = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9)
    pairs = x.join(y, "h").where(close).select("a", "b").distinct()
    both = pairs.join(sets.select(F.col(key).alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col(key).alias("b"), F.col("s").alias("sb")), "b")
    common = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("k"))
    return common.select("a", "b", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("similarity")).where(F.col("similarity") >= threshold)


def greedy_keep(nodes: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """(key, kept): going through the keys in order, one is kept if no smaller kept key is its neighbour.

    ``edges`` has a < b.  All that is decided at once is decided in one round, so
    the rounds follow the longest chain of neighbours, not the number of keys.  Each round decides the
    smallest open key at least, so the rounds end by themselves.
    """
    state = written(nodes.select(F.col(key).alias("k"), F.lit(None).cast("boolean").alias("kept")))
    edges = written(edges.select("a", "b").distinct())
    while state.where("kept is null").limit(1).count():
        ahead = (
            edges.join(state.select(F.col("k").alias("a"), F.col("kept").alias("ka")), "a")
            .groupBy("b")
            .agg(F.bool_or(F.coalesce("ka", F.lit(False))).alias("beaten"), F.bool_or(F.col("ka").isNull()).alias("open"))
        )
        verdict = F.when(F.coalesce("beaten", F.lit(False)), F.lit(False)).when(~F.coalesce("open", F.lit(False)), F.lit(True))
        state = written(state.join(ahead, state.k == ahead.b, "left").select("k", F.coalesce("kept", verdict).alias("kept")), instead_of=state)
    return state.select(F.col("k").alias(key), "kept")


def two_key_dedup(pairs: DataFrame, order: list, left: Column, right: Column) -> DataFrame:
    """The rows kept when, in ``order``, a row is dropped if an earlier kept row has its left or its right key.

    A dropped row does not occupy its keys.  Rows with equal keys on both sides collapse first.
    """
    x = first_rows(pairs.withColumn("_l", left).withColumn("_r", right), ["_l", "_r"], order_columns(order))
    x = written(x.withColumn("_o", F.struct(*order_columns(order))).withColumn("_id", F.sha2(F.concat_ws("\x01", "_l", "_r"), 256)))
    slim = x.select("_id", "_o", "_l", "_r")
    # round by round: rows that are first under both keys are kept, and beat all others of their keys
    kept, rest = None, slim
    while True:
        first_l = rest.groupBy("_l").agg(F.min("_o").alias("ol"))
        first_r = rest.groupBy("_r").agg(F.min("_o").alias("or_"))
        won = written(rest.join(first_l, "_l").join(first_r, "_r").where((F.col("_o") == F.col("ol")) & (F.col("_o") == F.col("or_"))).select("_id", "_l", "_r"))
        kept = won.select("_id") if kept is None else kept.unionByName(won.select("_id"))
        rest = written(rest.join(won.select("_l"), "_l", "left_anti").join(won.select("_r"), "_r", "left_anti"), instead_of=rest)
        if not rest.limit(1).count():
            break
    return x.join(kept, "_id", "left_semi").drop("_l", "_r", "_o", "_id")


def order_columns(order: list) -> list:
    """Sort keys as ascending columns: a number that sorts descending must be given negated."""
    return [F.col(o) if isinstance(o, str) else o for o in order]
