"""Gates, audits and waterfalls."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import languages as L
from loam.functions import text as T
from loam.operators import gates as G
from loam.queries import query
from loam.queries.a_text import CANON, WS
from loam.session import read

CANON0 = CANON.replace("replace(replace(text,", "replace(replace(coalesce(text, ''),")
_LANG = ", ".join(
    f"len(list_filter(w, lambda x: x in ({', '.join(repr(v) for v in words.split())})))::bigint as {k}" for k, words in G.STOPWORDS.items()
)
MEASURED = rf"""
c as (select doc_id, {CANON0} as t from documents),
p as (select *, list_filter(list_transform(string_split(t, chr(10)||chr(10)), lambda x: trim(regexp_replace(x, '[{WS}]+', ' ', 'g'), ' ')), lambda x: x <> '') as paras,
  regexp_extract_all(lower(t[1:2000]), '\p{{L}}+') as w from c),
s as (select *, {_LANG} from p),
m as (select doc_id, t, md5(t) as content_md5, length(t)::bigint as characters,
  case when len(paras) = 0 then 1.0 else (len(paras) - len(list_distinct(list_transform(paras, lambda x: lower(x))))) / len(paras) end::double as repetition,
  case when len(paras) = 0 then 0.0 else (len(paras) - len(list_distinct(paras))) / len(paras) end::double as repetition_cased,
  case when greatest(en, de, fr, es) = 0 or (en = greatest(en, de, fr, es))::int + (de = greatest(en, de, fr, es))::int + (fr = greatest(en, de, fr, es))::int + (es = greatest(en, de, fr, es))::int > 1 then 'undetermined'
       when en = greatest(en, de, fr, es) then 'en' when de = greatest(en, de, fr, es) then 'de' when fr = greatest(en, de, fr, es) then 'fr' else 'es' end as language from s)
"""
REASONS = (
    "with "
    + MEASURED
    + """, f as (select *, min(doc_id) over (partition by content_md5) as first_id from m),
r as (select doc_id, content_md5, characters, repetition, language, case when characters < 50 then 'length' when repetition > 0.30 then 'repetition'
  when language <> 'en' then 'language' when first_id < doc_id then 'exact_duplicate' end as reason, first_id from f),
g as (select * exclude (first_id), case when reason = 'exact_duplicate' then first_id end as duplicate_of from r)
"""
)
REASONS2 = REASONS.replace("repetition > 0.30", "repetition_cased > 0.30").replace("characters, repetition, language, case", "characters, repetition_cased as repetition, language, case").replace(
    "when language <> 'en' then 'language' when first_id < doc_id then 'exact_duplicate' end", "when first_id < doc_id then 'exact_duplicate' when language <> 'en' then 'language' end"
)
SECOND = G.GateConfig(strip_before_length=False, fold_case=False, empty_repetition=0.0, language_after_duplicates=True)


def _reasons(spark, d, cfg=G.GateConfig()):
    return G.gate_reasons(read(spark, d, "documents"), "doc_id", "text", cfg)


@query("with " + MEASURED + " select doc_id, characters, characters >= 50 as passes, round(repetition, 9) as repetition, repetition <= 0.30 as varied, round(repetition_cased, 9) as repetition_cased from m")
def gate_measures(spark, d):
    """Length and repetition gates, with and without case."""
    x = read(spark, d, "documents").select("doc_id", T.canonical(F.coalesce("text", F.lit(""))).alias("t"))
    a, b = G.repetition_ratio(F.col("t"), G.GateConfig()), G.repetition_ratio(F.col("t"), SECOND)
    return x.select("doc_id", G.length_of(F.col("t"), G.GateConfig()).cast("bigint").alias("characters"), a.alias("a"), b.alias("b")).select(
        "doc_id", "characters", (F.col("characters") >= 50).alias("passes"), F.round("a", 9).alias("repetition"), (F.col("a") <= 0.30).alias("varied"), F.round("b", 9).alias("repetition_cased")
    )


@query("with " + MEASURED.replace("m as (", "q as (") + " select doc_id, en, de, fr, es, language from s join q using (doc_id)")
def language_scores(spark, d):
    """Frequent-word hits of four languages, and the best."""
    x = read(spark, d, "documents").select("doc_id", T.canonical(F.coalesce("text", F.lit(""))).alias("t"))
    s = x.select("doc_id", G.language_scores(F.col("t")).alias("s"))
    return s.select("doc_id", "s.*", G.best_language(F.col("s")).alias("language"))


_DETECTED = r"""
lt as (select doc_id, lang, regexp_replace(lower(text[1:2000]), '[^\p{L}]+', ' ', 'g') as x from documents where text is not null),
lc as (select doc_id, lang, list_transform(string_split(x, ''), lambda v: unicode(v)) as c from lt where length(x) >= 3),
tri as (select doc_id, lang, unnest(list_transform(range(1, len(c) - 1), lambda i: (c[i] * 961 + c[i + 1] * 31 + c[i + 2]) % 65536)) as place from lc),
prof as (select lang, place, count(*) as n from tri where lang in ('en', 'de', 'fr', 'es') group by all), tot as (select lang, sum(n) as t from prof group by lang),
own as (select doc_id, place, count(*) as k from tri group by all),
sc as (select doc_id, tot.lang as lang, sum(k * ln((coalesce(n, 0) + 0.5) / (t + 32768))) as s from own cross join tot left join prof on prof.lang = tot.lang and prof.place = own.place group by all),
top as (select doc_id, arg_max(lang, s) as language, max(s) as best from sc group by doc_id),
det as (select doc_id, language, 1 / sum(exp(greatest(s - best, -700))) as probability from sc join top using (doc_id) group by all)
"""


def _detected(spark, d):
    docs = read(spark, d, "documents")
    return docs, L.detect(docs, "doc_id", "text", L.profiles(docs.where(F.col("lang").isin("en", "de", "fr", "es")), "text", "lang"))


@query("with " + _DETECTED + "select doc_id, language, round(probability, 6) as probability from documents left join det using (doc_id)")
def detected_languages(spark, d):
    """Each document's language with its probability, by profiles of all documents that are labelled."""
    return _detected(spark, d)[1].withColumn("probability", F.round("probability", 6))


@query(
    REASONS.replace("'undetermined'\n       when", "'undetermined' when").replace(
        "m as (select", "m0 as (select", 1
    ).replace("f as (select *, min(doc_id) over (partition by content_md5) as first_id from m)", _DETECTED.strip() + """,
m as (select m0.* exclude (language), case when probability >= 0.8 then det.language else 'undetermined' end as language from m0 left join det using (doc_id)),
f as (select *, min(doc_id) over (partition by content_md5) as first_id from m)""")
    + "select language, reason, count(*)::bigint as documents from g group by all"
)
def gate_reasons_detected(spark, d):
    """The gates with detected languages: documents by language and reason."""
    docs, found = _detected(spark, d)
    return G.gate_reasons(docs, "doc_id", "text", detected=found).groupBy("language", "reason").agg(F.count(F.lit(1)).alias("documents"))


@query(REASONS + "select doc_id, content_md5, characters, round(repetition, 9) as repetition, language, reason, duplicate_of from g")
def gate_reasons(spark, d):
    """The first failed gate of each document; language before duplicates."""
    return _reasons(spark, d).withColumn("repetition", F.round("repetition", 9))


@query(REASONS2 + "select doc_id, content_md5, characters, round(repetition, 9) as repetition, language, reason, duplicate_of from g")
def gate_reasons_manifest(spark, d):
    """The second reading of the gates: case-sensitive repetition, duplicates before language."""
    return _reasons(spark, d, SECOND).withColumn("repetition", F.round("repetition", 9))


_FALL = """, o as (select * from (values ('length', 1), ('repetition', 2), ('exact_duplicate', 3), ('near_duplicate', 4), ('language', 5)) t(gate, position)),
n as (select gate, position, (select count(*) from g where reason = gate) as removed, (select count(*) from g) as total from o),
w as (select gate, position::int as position, total - coalesce(sum(removed) over (order by position rows between unbounded preceding and 1 preceding), 0) as before, removed from n)
select gate, position, before::bigint as before, removed::bigint as removed, (before - removed)::bigint as after, (removed > 0 and removed = max(removed) over ()) as greatest from w"""


@query(REASONS + _FALL)
def gate_waterfall(spark, d):
    """Documents before and after each gate, and which removes most."""
    return G.waterfall(_reasons(spark, d))


@query(
    REASONS
    + """select (select count(*) from g) as input, (select count(*) from g where reason is null) as kept, (select count(*) from g where reason is not null) as rejected,
(select count(*) from g where duplicate_of is not null and duplicate_of not in (select doc_id from g where reason is null)) as broken_lineage,
(select count(*) from g where reason is null) + (select count(*) from g where reason is not null) = (select count(*) from g) as balanced"""
)
def gate_audit(spark, d):
    """Kept and rejected add up, and every duplicate's original is kept."""
    return G.audit(_reasons(spark, d), "doc_id")


@query(
    REASONS
    + """select coalesce(source, 'none') as source, count(*)::bigint as documents, count(*) filter (reason is null)::bigint as accepted, max(reason) as last_reason,
sum(characters)::bigint as characters from g join documents using (doc_id) group by 1"""
)
def gate_by_source(spark, d):
    """Documents and accepted ones by source."""
    src = read(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"))
    return _reasons(spark, d).join(src, "doc_id").groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("reason").isNull()).alias("accepted"), F.max("reason").alias("last_reason"), F.sum("characters").alias("characters")
    )


@query(
    REASONS
    + r""", rej as (select doc_id, 'gates' as stage, reason, duplicate_of from g where reason is not null),
con as (select doc_id, 'content' as stage, case when length(t) < 200 then 'too_short' when length(regexp_replace(t, '[^\p{L}]', '', 'g')) / greatest(length(regexp_replace(t, '[WS]+', '', 'g')), 1) < 0.25 then 'low_alphabetic_ratio' end as reason, null::bigint as duplicate_of
  from g join c using (doc_id) where g.reason is null)
select * from rej union all select * from con where reason is not null""".replace("WS", WS)
)
def rejected_documents(spark, d):
    """Rejections of both stages (gates, then content) in one table."""
    r = _reasons(spark, d)
    text = read(spark, d, "documents").select("doc_id", T.canonical(F.coalesce("text", F.lit(""))).alias("t"))
    one = r.where("reason is not null").select("doc_id", F.lit("gates").alias("stage"), "reason", "duplicate_of")
    two = r.where("reason is null").select("doc_id").join(text, "doc_id").select("doc_id", F.lit("content").alias("stage"), G.content_gate(F.col("t")).alias("reason"))
    return one.unionByName(two.where("reason is not null"), allowMissingColumns=True)
