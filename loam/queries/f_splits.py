"""Splits, strata, selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import splits as S
from loam.queries import query
from loam.session import read


@query("select doc_id, row_number() over (order by sha256('42:' || doc_id), doc_id) as rank from documents")
def hash_order(spark, d):
    """The place of each document in the seeded hash order."""
    return S.hash_rank(read(spark, d, "documents").select("doc_id"), "doc_id", 42)


_SPLIT = """r as (select doc_id, text, row_number() over (order by sha256('42:' || doc_id), doc_id) as rank, count(*) over () as n from documents),
sp as (select doc_id, text, case when rank <= least(greatest(1, round_even(n * 10 / 100, 0)), n - 1) then 'test' else 'train' end as split from r)"""


@query(f"with {_SPLIT} select doc_id, split from sp")
def split_90_10(spark, d):
    """A tenth of the documents held out, in hash order."""
    return S.random_split(read(spark, d, "documents").select("doc_id"), "doc_id", 10)


@query("with r as (select pair_id, row_number() over (order by sha256('7:' || pair_id), pair_id) as rank, count(*) over () as n from (select distinct pair_id from evaluation)) select pair_id, case when rank <= floor(n * 0.8) then 'train' else 'eval' end as split from r")
def split_pairs_80_20(spark, d):
    """Four fifths of the pairs for training."""
    return S.fraction_split(read(spark, d, "evaluation").select("pair_id").distinct(), "pair_id", 0.8)


_STRATA = """z as (select coalesce(source, 'none') as s, count(*) as n from documents group by 1),
t as (select *, sum(n) over () as total, greatest(1, round_even(sum(n) over () * 0.25, 0)) as target from z),
e as (select *, target * n / total as exact, floor(target * n / total) as fl from t),
o as (select *, row_number() over (order by round(exact - fl, 12) desc, s) as o, max(target) over () - sum(fl) over () as left_over from e),
al as (select s, n, (fl + case when o <= left_over then 1 else 0 end)::bigint as allocated from o)"""


@query(f"with {_STRATA} select s as source, n::bigint as documents, allocated from al")
def strata_allocation(spark, d):
    """A quarter of the corpus shared among sources by largest remainder."""
    sizes = read(spark, d, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count(F.lit(1)).alias("documents"))
    return S.largest_remainder(sizes, "source", "documents", 0.25)


@query(f"with {_STRATA}, r as (select doc_id, coalesce(source, 'none') as s, row_number() over (partition by coalesce(source, 'none') order by sha256('42:' || doc_id), doc_id) as r from documents) select doc_id, case when r <= allocated then 'eval' else 'train' end as split from r join al using (s)")
def split_stratified(spark, d):
    return S.stratified_split(read(spark, d, "documents").select("doc_id", "source"), "doc_id", "source", 0.25).select("doc_id", "split")


@query(f"with {_SPLIT} select (select count(*) from sp) as total, (select count(*) from sp where split = 'train') as train, (select count(*) from sp where split <> 'train') as held_out, (select count(*) from (select doc_id from sp group by 1 having count(distinct split) > 1)) as shared_keys, (select count(*) from (select text from sp group by text having count(distinct split) > 1)) as shared_contents")
def split_disjoint(spark, d):
    """Documents and contents on both sides of a split."""
    return S.disjoint_report(S.random_split(read(spark, d, "documents").select("doc_id", "text"), "doc_id", 10), "doc_id", F.col("text"))


_CAP = """c as (select pair_id, coalesce(source, 'none') as source, -length(coalesce(response, '')) as k from (select distinct pair_id, source, response from evaluation)),
r as (select *, row_number() over (partition by source order by k, pair_id)::int as rank from c qualify rank <= 3)"""


@query(f"with {_CAP} select pair_id, source, rank from r")
def cap_by_source(spark, d):
    """The three longest answers of each source."""
    x = read(spark, d, "evaluation").select("pair_id", F.coalesce("source", F.lit("none")).alias("source"), (-F.length(F.coalesce("response", F.lit("")))).alias("k")).distinct()
    return S.cap_per_group(x, "source", ["k", "pair_id"], 3).select("pair_id", "source", "rank")


@query(f"with {_CAP} select pair_id, source from r order by rank, sha256('42:' || source), source limit 60")
def round_robin_select(spark, d):
    """Sixty pairs taken in turns from the sources."""
    x = read(spark, d, "evaluation").select("pair_id", F.coalesce("source", F.lit("none")).alias("source"), (-F.length(F.coalesce("response", F.lit("")))).alias("k")).distinct()
    return S.round_robin(S.cap_per_group(x, "source", ["k", "pair_id"], 3), "source", 60).select("pair_id", "source")


@query(
    """with recursive x as (select distinct pair_id, coalesce(source, 'none') as source from evaluation), z as (select source, least(count(*), 10) as n from x group by source),
t as (select sum(n)::bigint as total, count(*) as m from z), o as (select source, n, row_number() over (order by sha256('42:' || source)) as i from z),
f as (select 0::bigint as i, total as rest, 0::bigint as taken, 0::bigint as k, false as go, false as done, null::varchar as source from t union all
  select i, rest - case when go then n else 0 end, taken + case when go then n else 0 end, k + go::int, go, done or (go and taken + n >= total // 5 and k + 1 >= least(8, m - 1)), source
  from (select o.i, f.rest, f.taken, f.k, f.done, o.n, o.source, t.total, t.m, not f.done and f.rest - o.n >= t.total - t.total // 4 as go from f join o on o.i = f.i + 1, t))
select source, (k - 1)::int as position from f where go"""
)
def source_disjoint_eval(spark, d):
    """Sources held out so that enough remains for training."""
    x = read(spark, d, "evaluation").select("pair_id", F.coalesce("source", F.lit("none")).alias("source")).distinct()
    return S.choose_sources(x.groupBy("source").agg(F.least(F.count(F.lit(1)), F.lit(10)).alias("n")), "source", "n", 0.2, 0.75)


@query("select pair_id from (select distinct pair_id from evaluation where coalesce(response, '') <> '') order by sha256('20042:' || pair_id), pair_id limit 50")
def seeded_sample(spark, d):
    """Fifty pairs in seeded order: a sampling operator."""
    x = read(spark, d, "evaluation").where(F.coalesce("response", F.lit("")) != "").select("pair_id").distinct()
    return x.orderBy(T.seeded_rank(20042, "pair_id"), "pair_id").limit(50)


@query(f"with {_SPLIT}, acc as (select doc_id from documents where text is not null) select (select count(*) from (select doc_id from acc except select doc_id from sp)) as missing, (select count(*) from (select doc_id from sp except select doc_id from documents)) as extra, (select count(*) from (select doc_id from sp intersect select doc_id from acc)) as common")
def partition_proof(spark, d):
    """Set differences both ways and the intersection of a split with its input."""
    docs = read(spark, d, "documents")
    sp = S.random_split(docs.select("doc_id"), "doc_id", 10).select("doc_id")
    acc = docs.where("text is not null").select("doc_id")
    n = lambda x, name: x.agg(F.count(F.lit(1)).alias(name))
    return n(acc.exceptAll(sp), "missing").join(n(sp.exceptAll(docs.select("doc_id")), "extra")).join(n(sp.intersect(acc), "common"))
