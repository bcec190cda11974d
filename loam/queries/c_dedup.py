"""Exact, paragraph and near duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import dedup as D
from loam.operators.grouping import first_rows
from loam.queries import query
from loam.queries.a_text import WS
from loam.session import read


@query("select doc_id, case when text is null then null else nullif(min(doc_id) over (partition by text), doc_id) end as duplicate_of from documents")
def exact_dedup_lineage(spark, d):
    """The first document with the same text."""
    return D.first_occurrences(read(spark, d, "documents"), "doc_id", F.col("text")).select("doc_id", "duplicate_of")


_KIND = rf"""
n as (select doc_id, list_filter(list_transform(regexp_split_to_array(replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10)), '\n[ \t]*\n[ \t\n]*'), lambda x: regexp_replace(regexp_replace(x, '^[{WS}]+', ''), '[{WS}]+\z', '')), lambda x: x <> '') as ps from documents where text is not null),
p as (select doc_id, unnest(ps) as paragraph, generate_subscripts(ps, 1)::int as pos from n),
q as (select *, trim(regexp_replace(paragraph, '[{WS}]+', ' ', 'g'), ' ') as sq, list_filter(list_transform(string_split(paragraph, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') as ls from p),
k as (select *, len(ls) as n,
  len(list_filter(ls, lambda x: len(regexp_extract_all(x, '\|')) >= 2 or len(regexp_extract_all(x, '\t')) >= 2)) as bars,
  len(list_filter(ls, lambda x: regexp_matches(x, '{D.LIST_ITEM}'))) as items,
  len(list_filter(ls, lambda x: regexp_matches(x, '{D.CLI_LINE}'))) as cli from q),
kinds as (select doc_id, pos, paragraph, sha256(lower(sq)) as digest, case when length(sq) < 150 then 'short' when contains(paragraph, '```') then 'fenced_code'
  when bars >= 2 and bars >= 0.5 * n then 'table' when items >= 2 and items >= 0.4 * n then 'list' when cli >= 2 and cli >= 0.4 * n then 'cli' else 'prose' end as kind from k),
nth as (select doc_id, pos, row_number() over (partition by digest order by doc_id, pos) as nth from kinds where kind = 'prose'),
res as (select kinds.*, nth.nth, nth.nth is null or nth.nth <= 1 as kept from kinds left join nth using (doc_id, pos))
"""


def _paragraphs(spark, d):
    return D.paragraph_dedup(read(spark, d, "documents").where("text is not null"), "doc_id", "text")


@query("with " + _KIND + "select doc_id, pos, kind, digest, nth, kept from res")
def paragraph_dedup(spark, d):
    """Prose paragraphs beyond the first equal one in the corpus."""
    return _paragraphs(spark, d).select("doc_id", "pos", "kind", "digest", "nth", "kept")


@query("with " + _KIND + "select kind, count(*)::bigint as paragraphs, count(*) filter (not kept)::bigint as removed, round(count(*) filter (not kept) / count(*), 9) as removed_share, coalesce(sum(length(paragraph)) filter (not kept), 0)::bigint as removed_characters from res group by kind")
def paragraph_kinds(spark, d):
    """Paragraphs by kind and what of them is removed."""
    gone = ~F.col("kept")
    return _paragraphs(spark, d).groupBy("kind").agg(
        F.count(F.lit(1)).alias("paragraphs"), F.count_if(gone).alias("removed"), F.round(F.count_if(gone) / F.count(F.lit(1)), 9).alias("removed_share"),
        F.coalesce(F.sum(F.when(gone, F.length("paragraph"))), F.lit(0)).cast("bigint").alias("removed_characters"),
    )


@query("with " + _KIND + "select doc_id, md5(string_agg(paragraph, chr(10)||chr(10) order by pos)) as text_md5, count(*)::bigint as paragraphs from res where kept group by doc_id")
def paragraph_dedup_texts(spark, d):
    """The texts put together again from what is kept."""
    x = _paragraphs(spark, d).where("kept").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "paragraph"))).alias("ps"))
    return x.select("doc_id", F.md5(F.array_join(F.transform("ps", lambda p: p["paragraph"]), "\n\n")).alias("text_md5"), F.size("ps").cast("bigint").alias("paragraphs"))


@query("with " + _KIND + ", f as (select digest, min(struct_pack(d := doc_id, p := pos)) as o from kinds where kind = 'prose' group by digest) select r.doc_id, r.pos, r.digest, f.o.d as kept_doc, f.o.p as kept_pos, length(r.paragraph)::bigint as characters, r.nth from res r join f using (digest) where not r.kept")
def paragraph_dedup_audit(spark, d):
    """Each removed paragraph with the place of the one that stays."""
    x = _paragraphs(spark, d)
    first = x.where("kind = 'prose'").groupBy("digest").agg(F.min(F.struct("doc_id", "pos")).alias("o"))
    return x.where("not kept").join(first, "digest").select("doc_id", "pos", "digest", F.col("o.doc_id").alias("kept_doc"), F.col("o.pos").alias("kept_pos"), F.length("paragraph").cast("bigint").alias("characters"), "nth")


_PERMS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(D.coefficients()))
_SIGN = rf"""
w as (select min(record_id) as doc_id, regexp_extract_all(lower(extracted_text), '[\p{{L}}\p{{N}}_]+') as w from rfc4136 where extracted_text is not null group by extracted_text),
s as (select doc_id, unnest(list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) else w end)) as s from w),
h as (select doc_id, ('0x' || md5(s)[1:8])::bigint as h from s),
c as (select * from (values {_PERMS}) t(i, a, b)),
m as (select doc_id, i, min((a::bigint * h + b::bigint) % {D.PRIME}) as m from h, c group by doc_id, i),
sig as (select doc_id, array_agg(m order by i) as signature from m group by doc_id),
agree as (select x.doc_id as a, y.doc_id as b, count(*) / 128.0 as similarity from m x join m y on x.i = y.i and x.m = y.m and x.doc_id < y.doc_id group by all having count(*) >= 0.85 * 128)
"""


def _distinct(spark, d):
    docs = read(spark, d, "rfc4136").where("extracted_text is not null").select(F.col("record_id").alias("doc_id"), F.col("extracted_text").alias("text"))
    first = docs.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"))  # exact copies go first
    return docs.join(first.select("doc_id"), "doc_id", "left_semi")


def _signed(spark, d):
    return D.signatures(_distinct(spark, d), "doc_id", "text")


@query("with " + _SIGN + "select doc_id, md5(array_to_string(signature, ',')) as signature_md5, signature[1] as first_minimum from sig")
def minhash_signatures(spark, d):
    """128 minima of the word-run hashes of each distinct text."""
    return _signed(spark, d).select("doc_id", F.md5(F.array_join("signature", ",")).alias("signature_md5"), F.element_at("signature", 1).alias("first_minimum"))


@query("with " + _SIGN + "select a, b, round(similarity, 9) as similarity from agree where similarity >= 0.85")
def near_dup_pairs(spark, d):
    """Pairs of distinct texts whose signatures agree by 0.85 or more."""
    return D.similar_pairs(_signed(spark, d), "doc_id").withColumn("similarity", F.round("similarity", 9))


@query(
    "with "
    + _SIGN
    + """, n as (select doc_id, count(*) as n from s group by doc_id),
k as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.s = y.s and x.doc_id < y.doc_id group by all),
j as (select a, b, k / (x.n + y.n - k) as similarity from k join n x on x.doc_id = a join n y on y.doc_id = b)
select a, b, round(similarity, 9) as similarity from j where similarity >= 0.85"""
)
def near_dup_pairs_exact_jaccard(spark, d):
    """Pairs of distinct texts whose sets of word runs have a Jaccard similarity of 0.85 or more, without signatures."""
    return D.jaccard_pairs(_distinct(spark, d), "doc_id", "text").withColumn("similarity", F.round("similarity", 9))


#: One text after the other, in order of the key: dropped if it is close to one that is not.
_IN_ORDER = """, e as (select b, list(a) as ahead, row_number() over (order by b) as n from agree where similarity >= 0.85 group by b),
f as (select 0::bigint as n, []::bigint[] as dropped union all
  select f.n + 1, case when len(list_filter(ahead, lambda a: not list_contains(dropped, a))) > 0 then list_append(dropped, b) else dropped end from f join e on e.n = f.n + 1)
select doc_id, not list_contains((select arg_max(dropped, n) from f), doc_id) as kept from sig"""


@query("with recursive " + _SIGN + _IN_ORDER)
def near_dup_greedy(spark, d):
    """Near duplicates dropped in order of the key: one is dropped only for a kept one."""
    signed = _signed(spark, d)
    return D.greedy_keep(signed.select("doc_id"), "doc_id", D.similar_pairs(signed, "doc_id"))


@query(
    """
with recursive x as (select pair_id, instruction, response, trim(regexp_replace(lower(coalesce(instruction, '')), '[^a-z0-9]+', ' ', 'g'), ' ') as l,
  trim(regexp_replace(lower(coalesce(response, '')), '[^a-z0-9]+', ' ', 'g'), ' ') as r from (select distinct * from evaluation)),
o as (select *, row_number() over (order by -length(coalesce(response, '')), pair_id) as n from (select * from x qualify row_number() over (partition by l, r order by -length(coalesce(response, '')), pair_id) = 1)),
e as (select b, list(a) as ahead, row_number() over (order by b) as i from (select a.n as a, b.n as b from o a join o b on a.l = b.l and a.n < b.n union select a.n, b.n from o a join o b on a.r = b.r and a.n < b.n) group by b),
f as (select 0::bigint as i, []::bigint[] as dropped union all
  select f.i + 1, case when len(list_filter(ahead, lambda a: not list_contains(dropped, a))) > 0 then list_append(dropped, b) else dropped end from f join e on e.i = f.i + 1)
select pair_id, l as instruction_key from o where not list_contains((select arg_max(dropped, i) from f), n)"""
)
def pair_dedup_two_keys(spark, d):
    """Pairs kept in order (longest response first) if neither the instruction nor the response is taken by a kept pair."""
    x = read(spark, d, "evaluation").select("pair_id", "instruction", "response").distinct().withColumn("rank", -F.length(F.coalesce("response", F.lit(""))))
    key = lambda c: T.alnum_key(F.coalesce(c, F.lit("")))
    return D.two_key_dedup(x, ["rank", "pair_id"], key("instruction"), key("response")).select("pair_id", key("instruction").alias("instruction_key"))


@query("select pair_id, instruction from (select distinct pair_id, instruction from evaluation where instruction is not null and instruction <> '') qualify row_number() over (partition by lower(instruction) order by pair_id, instruction) = 1")
def instruction_dedup(spark, d):
    """The first pair of each instruction, case aside."""
    x = read(spark, d, "evaluation").select("pair_id", "instruction").where("instruction is not null and instruction <> ''")
    return first_rows(x.withColumn("k", F.lower("instruction")), ["k"], [F.col("pair_id"), F.col("instruction")]).drop("k")
