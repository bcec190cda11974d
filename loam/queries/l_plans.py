"""Whole pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.operators import dedup as D
from loam.plans import prepare as P
from loam.plans import prompts as PR
from loam.plans import reuse as R
from loam.queries import query
from loam.queries.b_gates import REASONS, REASONS2, SECOND
from loam.queries.c_dedup import _PERMS
from loam.session import read, scratch


@query()
def prepare_pipeline(spark, d):
    """Documents through gates, both kinds of duplicates, block cleaning, split and packing: the metrics (no SQL: it includes the block cleaner)."""
    out = P.prepare(read(spark, d, "documents"), "doc_id", "text", P.PrepareConfig(strategy="both", length=256))
    one = lambda n: out[f"metrics_{n}"].withColumn("split", F.lit(n))
    return one("train").unionByName(one("test"))


@query(
    REASONS2
    + """, a as (select g.doc_id, coalesce(source, 'none') as s from g join documents using (doc_id) where reason is null),
z as (select s, count(*) as n from a group by 1), t as (select *, sum(n) over () as total, greatest(1, round_even(sum(n) over () * 0.1, 0)) as target from z),
e as (select *, target * n / total as exact, floor(target * n / total) as fl from t), o as (select *, row_number() over (order by round(exact - fl, 12) desc, s) as o, max(target) over () - sum(fl) over () as left_over from e),
al as (select s, fl + case when o <= left_over then 1 else 0 end as allocated from o),
rk as (select doc_id, s, row_number() over (partition by s order by sha256('42:' || doc_id), doc_id) as r from a)
select g.doc_id, coalesce(documents.source, 'none') as source_corpus, content_md5, characters, round(repetition, 9) as repetition, language, reason is null as accepted, reason as rejection_reason, duplicate_of,
  case when rk.r is null then null when rk.r <= allocated then 'eval' else 'train' end as split from g join documents using (doc_id) left join rk using (doc_id) left join al using (s)"""
)
def manifest(spark, d):
    """One row a document: measures, acceptance, stratified split."""
    docs = read(spark, d, "documents").withColumn("source", F.coalesce("source", F.lit("none")))
    return P.manifest(docs, "doc_id", "text", "source", P.PrepareConfig(gates=SECOND)).withColumn("repetition", F.round("repetition", 9))


@query("with p as (select s_suppkey as k, 'rfc2' || lpad(s_suppkey::varchar, 4, '0') as f from supplier), r as (select distinct output_filename as name from rfc4136 where output_filename is not null), h as (select k, count(*) as n, min(name) as name from p join r on contains(name, f) group by k) select k, name from h where n = 1")
def only_matching_source(spark, d):
    """The one file whose name contains a fragment."""
    p = read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("rfc2"), F.lpad(F.col("s_suppkey").cast("string"), 4, "0")).alias("f"))
    return PR.only_match(p, "k", "f", read(spark, d, "rfc4136").where("output_filename is not null").select(F.col("output_filename").alias("name")).distinct(), "name")


@query("with x as (select distinct pair_id, instruction, response from evaluation) select pair_id, case when sha256('42:' || pair_id)[1:1] < '8' then instruction else response end as answer_a, case when sha256('42:' || pair_id)[1:1] < '8' then response else instruction end as answer_b, sha256('42:' || pair_id)[1:1] < '8' as base_is_a from x")
def blinded_review(spark, d):
    """Two texts in an order that a reviewer cannot tell."""
    return PR.blinded(read(spark, d, "evaluation").select("pair_id", "instruction", "response").distinct(), "pair_id", "instruction", "response")


@query("select category, count(*)::bigint as n, case category when 'routing' then 25 when 'law' then 15 end::bigint as wanted, coalesce(count(*) = case category when 'routing' then 25 when 'law' then 15 end, false) as holds from domain_exact_generation_queries group by category")
def prompt_contract(spark, d):
    """Counts by category against those a frozen set must have."""
    return PR.contract(read(spark, d, "domain_exact_generation_queries"), "category", {"routing": 25, "law": 15})



@query("select coalesce(lang, 'none') as lang, count(*)::bigint as documents, sum(length(coalesce(text, '')))::bigint as characters from documents group by 1")
def reused_report(spark, d):
    """A report by language that a second run with the same inputs and options finds finished."""
    docs, at = read(spark, d, "documents"), scratch(spark, "reports")
    name = R.identity({"report": "languages"}, R.table_digest(docs.select("doc_id", "lang", "text")))
    build = lambda: docs.groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("characters"))
    R.reused(spark, at, name, build)
    found, held = R.reused(spark, at, name, build)
    return found.where(F.lit(held))


_RECORDS = "documents as (select record_id as doc_id, extracted_text as text, lang from rfc4136),\n"
_ONE_BY_ONE = rf"""
z0 as (select g.doc_id, text from g join documents using (doc_id) where {{passed}}),
z1 as (select min(doc_id) as k, regexp_extract_all(lower(text), '[\p{{{{L}}}}\p{{{{N}}}}_]+') as w from z0 where text is not null group by text),
z2 as (select k, unnest(list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) else w end)) as s from z1),
z3 as (select k, ('0x' || md5(s)[1:8])::bigint as h from z2),
z4 as (select k, i, min((a::bigint * h + b::bigint) % {D.PRIME}) as m from z3, (values {_PERMS}) t(i, a, b) group by k, i),
z5 as (select x.k as a, y.k as b, count(*) / 128.0 as similarity from z4 x join z4 y on x.i = y.i and x.m = y.m and x.k < y.k group by all having count(*) >= 0.85 * 128),
z6 as (select b, list(a) as ahead, row_number() over (order by b) as n from z5 group by b),
z7 as (select 0::bigint as n, []::bigint[] as dropped union all select z7.n + 1, case when len(list_filter(ahead, lambda a: not list_contains(dropped, a))) > 0 then list_append(dropped, b) else dropped end from z7 join z6 on z6.n = z7.n + 1),
z8 as (select arg_max(dropped, n) as dropped from z7),
z9 as (select b as k, (array_agg(a order by similarity desc, a))[1] as near from z5, z8 where list_contains(dropped, b) and not list_contains(dropped, a) group by b),
y1 as (select doc_id as k, min(doc_id) over (partition by text) as copy from z0 where text is not null),
y2 as (select g.doc_id, {{reason}} as reason, {{of}} as of, z9.near, case when y1.copy < y1.k then y1.copy end as copy from g left join z9 on z9.k = g.doc_id left join y1 on y1.k = g.doc_id),
y3 as (select doc_id, coalesce(reason, case when coalesce(near, copy) is not null then 'near_duplicate' end) as reason, coalesce(of, near, copy) as of from y2)
select doc_id, case when z9.near is not null then 'near_duplicate' else reason end as reason, coalesce(z9.near, of) as duplicate_of from y3 left join z9 on z9.k = y3.of"""


def _strategy(spark, d, strategy):
    x = read(spark, d, "rfc4136").select(F.col("record_id").alias("doc_id"), F.col("extracted_text").alias("text"))
    return P.reasons(x, "doc_id", "text", P.PrepareConfig(strategy=strategy)).select("doc_id", "reason", "duplicate_of")


@query("with recursive " + _RECORDS + REASONS.removeprefix("with ").rstrip() + "," + _ONE_BY_ONE.format(passed="reason is null", reason="g.reason", of="duplicate_of"))
def dedup_strategy_both(spark, d):
    """Gates with exact and near duplicates: each dropped record names one that is kept."""
    return _strategy(spark, d, "both")


@query("with recursive " + _RECORDS + REASONS.removeprefix("with ").rstrip() + "," + _ONE_BY_ONE.format(passed="reason is null or reason = 'exact_duplicate'", reason="nullif(g.reason, 'exact_duplicate')", of="null::bigint"))
def dedup_strategy_near(spark, d):
    """Gates with near duplicates only: exact copies are near duplicates too."""
    return _strategy(spark, d, "near")
