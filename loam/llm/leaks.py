"""Held-out items in the training corpus: a positional inverted index.

A term is a run of ``TERM`` words.  One pass over the corpus stores the postings
(term, document, position) of the terms that occur in any item; a bitmap of
fixed size lets only those through.  In each run of words that is to be found,
the rarest term (by the lengths of the posting lists) is looked up, and the
lists of its other terms are intersected at their offsets.  What items have in common,
quoted boilerplate say, is looked up and intersected once, and given to its items in the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm import bpe, words
from loam.session import map_arrow, written

#: Words in a term; largest bitmap in bits (16 MB): it bounds what is broadcast, whatever the input.
TERM, LARGEST = 4, 1 << 27
#: Positions of the second reading of a text (hyphens at line ends kept) begin here.
SECOND = 1 << 40


def _terms(df: DataFrame, key: str, text: str, keep=None) -> DataFrame:
    """(key, pos, term) of all runs of TERM words; ``keep`` gives a bitmap that terms must be in."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        bits = keep.value if keep is not None else None
        for batch in batches:
            keys = batch.column(0)
            for a, _, part in bpe.chunks(batch.column(1).to_pylist()):
                read = [(a + i, v, r) for i, x in enumerate(part) for v, r in enumerate(words.readings(x))]
                if not read:
                    continue
                h, first, _, _ = words.word_hashes([r for _, _, r in read])
                term, at = words.runs(h, first, TERM)
                if bits is not None:
                    slot = term & np.uint64(len(bits) * 8 - 1)
                    hit = (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
                    term, at = term[hit > 0], at[hit > 0]
                owner = np.searchsorted(first, at, "right") - 1
                row = np.array([i for i, _, _ in read])[owner]
                pos = at - first[owner] + np.array([v * SECOND for _, v, _ in read])[owner]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(pos), pa.array(term.view(np.int64))], names=[key, "pos", "term"])

    return map_arrow(df.select(key, text), run, f"`{key}` {kind}, pos bigint, term bigint")


def _bitmap(terms: DataFrame, count: int) -> np.ndarray:
    """The bits of all terms; its size follows their number up to LARGEST."""
    bits = min(LARGEST, max(1 << 16, 1 << (16 * max(count, 1) - 1).bit_length()))
    slot = F.col("term").bitwiseAND(F.lit(bits - 1))
    found = terms.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, int((term & {bits - 1}L) & 63))")).alias("b"))
    out = np.zeros(bits // 64, np.int64)
    table = found.toArrow()  # at most bits / 64 rows
    out[table.column("w").to_numpy()] = table.column("b").to_numpy()
    return out.view(np.uint8)


def _stretches(known: DataFrame, item_key: str, need: int) -> DataFrame:
    """(item_key, v, j, term, lo, hi, terms, s): every term that is the rarest of some run of ``need`` places of its item.

    The runs of words that begin at lo to hi have it as their anchor and all their terms in the index; ``terms`` are
    those of the whole stretch by their distance o from the anchor, and s is equal for equal stretches.  Where no
    run has all its terms lo, hi, terms and s are null.  ``known`` has the terms (item_key, v, j, term, df) that have postings.
    """
    kind = known.schema[item_key].dataType.simpleString()
    pair = pa.struct([("o", pa.int64()), ("other", pa.int64())])

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            off, flat = lists.offsets.to_numpy(), lists.values
            j, df, term = (flat.field(k).to_numpy() for k in range(3))
            n = len(j)
            row = np.repeat(np.arange(batch.num_rows), np.diff(off))
            base = int(off[0])
            j, df, term = j[base : base + len(row)], df[base : base + len(row)], term[base : base + len(row)]
            n = len(j)
            count, best, least = np.zeros(n, np.int64), np.arange(n), np.full(n, np.iinfo(np.int64).max)
            for d in range(need):
                i = np.arange(n - d) if d < n else np.zeros(0, np.int64)
                i = i[(row[i + d] == row[i]) & (j[i + d] < j[i] + need)]
                count[i] += 1
                rarer = i[df[i + d] < least[i]]
                best[rarer], least[rarer] = rarer + d, df[rarer + d]
            full = np.flatnonzero(count == need)
            anchors = np.unique(best)
            # of each anchor the first and the last full run
            own, first = np.unique(best[full], return_index=True)
            last = np.append(first[1:], len(full)) - 1
            begin, size = full[first], full[last] + need - full[first] if len(full) else full
            at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(full) else full
            o, other = j[at] - j[np.repeat(own, size)], term[at]
            with np.errstate(over="ignore"):
                each = words.mix(other.view(np.uint64) * np.uint64(3) + words.mix(o.view(np.uint64) + np.uint64(1)))
                until = np.cumsum(size)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(each, dtype=np.uint64)])
                s = words.mix(sums[until] - sums[until - size] + words.mix(term[own].view(np.uint64))).view(np.int64) if len(full) else full
            # anchors without a full run stand among the others with nulls
            has = np.isin(anchors, own)
            place = np.full(len(anchors), -1)
            place[has] = np.arange(len(own))
            take = pa.array(place, pa.int64(), mask=~has)
            ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            terms = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(o), pa.array(other)], fields=list(pair)))
            rows = pa.array(row[anchors])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows), batch.column(1).take(rows), pa.array(j[anchors]), pa.array(term[anchors]),
                    pa.array(j[begin], pa.int64()).take(take), pa.array(j[full[last]] if len(full) else full, pa.int64()).take(take), terms.take(take), pa.array(s, pa.int64()).take(take),
                ],
                names=[item_key, "v", "j", "term", "lo", "hi", "terms", "s"],
            )

    lists = known.groupBy(item_key, "v").agg(F.array_sort(F.collect_list(F.struct("j", "df", "term"))).alias("ts"))  # as long as the item
    return map_arrow(lists, run, f"`{item_key}` {kind}, v bigint, j bigint, term bigint, lo bigint, hi bigint, terms array<struct<o:bigint,other:bigint>>, s bigint")


def find_leaks(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, run: int = 10, slack: int = 8):
    """Two tables: exact runs, and near matches.

    The first has (doc_key, item_key, v, diff, at): words [at, at + run) of the item
    stand in the document, from word at + diff on; one row for each such run of words and place.
    The second has (doc_key, item_key, n_terms, spread): the document holds at
    least two of the item's rarest terms in places that agree within ``slack`` words;
    the cluster of most terms is given, of these the closest, wherever else the terms occur.

    Words are lower-cased runs of letters and digits after NFKC, without
    invisible characters; a word broken at a line end counts joined and as two.  Items
    and texts that are null, empty or shorter than ``run`` words give no rows; rows
    delivered twice count once.  ``docs`` and ``items`` are read once each.
    """
    spark = docs.sparkSession
    item = [item_key, "v"]  # v tells texts under one key apart
    texts = items.select(item_key, item_text).distinct().withColumn("v", F.xxhash64(item_text))
    keyed = texts.select(F.struct(item_key, "v").alias("item"), F.col(item_text).alias("text"))
    own = written(_terms(keyed, "item", "text").select("item.*", F.col("pos").alias("j"), "term").distinct())
    keep = spark.sparkContext.broadcast(_bitmap(own, own.count()))
    index = written(_terms(docs, doc_key, doc_text, keep))

    there = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = own.join(there, "term")  # a term without postings is in no run that is found
    need = run - TERM + 1
    stretch = written(_stretches(known, item_key, need))
    # equal stretches of several items are looked up once
    lookups = stretch.where("s is not null").groupBy("s").agg(F.first("term").alias("term"), F.first("terms").alias("terms"))
    expect = lookups.join(index, "term").select("s", doc_key, F.col("pos").alias("p"), F.explode("terms").alias("t")).select("s", doc_key, "p", "t.o", (F.col("p") + F.col("t.o")).alias("pos"), F.col("t.other").alias("term"))
    there = expect.join(index, [doc_key, "pos", "term"], "left_semi").groupBy("s", doc_key, "p").agg(F.array_sort(F.collect_set("o")).alias("os"))
    starts = F.filter("os", lambda o, i: F.get("os", i + (need - 1)) == o + (need - 1))  # need consecutive places
    exact = (
        there.select("s", doc_key, "p", F.explode(starts).alias("o"))
        .join(stretch.select("s", *item, "j", "lo", "hi"), "s")
        .withColumn("at", F.col("j") + F.col("o"))
        .where(F.col("at").between(F.col("lo"), F.col("hi")))  # other runs have other anchors
        .select(doc_key, *item, (F.col("p") - F.col("j")).alias("diff"), "at")
    )
    hits = stretch.select(*item, "j", "term").join(index, "term").withColumn("diff", F.col("pos") - F.col("j"))
    # both readings of a text count as one; offsets are signed, and each place with the last one of the same term
    half = SECOND >> 1
    d = F.pmod(F.col("diff") + half, F.lit(SECOND)) - half
    pair = [doc_key, *item]
    places = hits.select(*pair, "j", d.alias("d")).repartition(*pair).withColumn("last", F.lag("d").over(Window.partitionBy(*pair, "j").orderBy("d")))
    within = Window.partitionBy(*pair).orderBy("d").rangeBetween(0, slack)
    several = F.min("j").over(within) < F.max("j").over(within)
    cluster = F.filter(F.collect_list(F.struct("d", "last")).over(within), lambda x: x["last"].isNull() | (x["last"] < F.col("d")))  # once a term
    best = F.max(F.struct(F.size("terms").alias("n"), (F.col("d") - F.array_max("terms.d")).alias("s")))
    near = (
        places.select(*pair, "d", several.alias("several"), cluster.alias("terms"))
        .where("several")
        .groupBy(doc_key, item_key)
        .agg(best.alias("best"))
        .select(doc_key, item_key, F.col("best.n").cast("bigint").alias("n_terms"), (-F.col("best.s")).alias("spread"))
    )
    return exact, near


def leak_report(exact: DataFrame, items: DataFrame, doc_key: str, item_key: str, item_text: str, run: int = 10) -> DataFrame:
    """(doc_key, item_key, longest, covered, words): the longest common run, the item's words in any run, and its words."""
    group = Window.partitionBy(doc_key, item_key, "v", "diff").orderBy("at")
    islands = exact.withColumn("g", F.col("at") - F.row_number().over(group))
    longest = islands.groupBy(doc_key, item_key, "v", "diff", "g").agg((F.count(F.lit(1)) + run - 1).alias("len"), F.min("at").alias("a"))
    spots = longest.withColumn("w", F.explode(F.expr("sequence(a, a + len - 1)"))).groupBy(doc_key, item_key)
    per = spots.agg(F.max("len").alias("longest"), F.countDistinct("w").alias("covered"))
    sizes = item_words(items, item_key, item_text)
    return per.join(sizes, item_key).select(doc_key, item_key, "longest", "covered", "words")


def item_words(items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(item_key, words): the number of words of each item."""
    kind = items.schema[item_key].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = [(words.readings(x) or [""])[0] for x in b.column(1).to_pylist()]
            _, first, _, _ = words.word_hashes(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(first))], names=[item_key, "words"])

    return map_arrow(items.select(item_key, item_text), run, f"`{item_key}` {kind}, words bigint").groupBy(item_key).agg(F.max("words").alias("words"))
