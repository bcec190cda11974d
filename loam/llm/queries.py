"""The named queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import bpe, leaks, neardups, packing, pairs, repetition, splits, subjects, tokens
from loam.session import read


def _near(spark: SparkSession, d: str, describe: bool = True):
    return neardups.near_duplicates(read(spark, d, "rfc4136"), "record_id", "extracted_text", describe=describe)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    links, members = _near(spark, d, False)
    return neardups.expand(links, members, "record_id").select(F.col("a").alias("record_id_a"), F.col("b").alias("record_id_b"))


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d)[0]


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return neardups.classes(*_near(spark, d, False), "record_id")


def _held_out(spark: SparkSession, d: str) -> DataFrame:
    asked = read(spark, d, "domain_exact_generation_queries").select(
        F.col("id").alias("item_id"), F.concat(F.coalesce("prompt", F.lit("")), F.lit(" "), F.coalesce("expected_continuation", F.lit(""))).alias("item")
    )
    return asked.unionByName(read(spark, d, "evaluation").select(F.col("pair_id").alias("item_id"), F.col("response").alias("item")))


def _leaks(spark: SparkSession, d: str):
    return leaks.find_leaks(read(spark, d, "documents"), "doc_id", "text", _held_out(spark, d), "item_id", "item")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)[0].select("doc_id", "item_id").distinct()


def p2_leak_report(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leak_report(_leaks(spark, d)[0], _held_out(spark, d), "doc_id", "item_id", "item")


def p2_near_matches(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)[1]


def p3_token_budget(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_budget(read(spark, d, "rfc4136"), "record_id", "extracted_text", "source_corpus", "lang", "domain")


def p3_record_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.document_tokens(read(spark, d, "rfc4136"), "record_id", "extracted_text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(read(spark, d, "model_responses"), "response_id", "response")


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    return repetition.score(read(spark, d, "model_responses"), "response_id", "response")[0].distinct()


def p4_rules(spark: SparkSession, d: str) -> DataFrame:
    return repetition.rule_report(read(spark, d, "model_responses"), "response_id", "response")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.broken_pairs(read(spark, d, "evaluation"), "pair_id", "instruction", "response")


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    return splits.groups(read(spark, d, "domain_exact_generation_queries"), "id", ["source_document", "source_file"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(spark, d).where("component < id").select(F.col("component").alias("first_id"), "id")


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign(_grouped(spark, d), "id", read(spark, d, "split_targets"))


def p6_split_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_report(p6_splits(spark, d), read(spark, d, "split_targets"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_column(read(spark, d, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(read(spark, d, "documents"), read(spark, d, "pack_capacity"), "doc_id", "text")


def p8_container_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_fill(p8_containers(spark, d), read(spark, d, "pack_capacity"))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(read(spark, d, "documents"), "doc_id", "text", read(spark, d, "subject_examples"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject").distinct()


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents by subject: how many deal with it, and how much of them."""
    return _subjects(spark, d).groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"), F.round(F.avg("share"), 6).alias("mean_share"))


QUERIES = {f.__name__: f for f in (p1_found, p1_links, p1_classes, p2_found, p2_leak_report, p2_near_matches, p3_token_budget, p3_record_tokens, p4_found, p4_scores, p4_rules, p5_found, p6_found, p6_splits, p6_split_report, p7_ids, p8_containers, p8_container_fill, p9_found, p9_composition)}

#: The runs that records have in common.
_RUNS = r"""
with w as (select record_id, regexp_extract_all(lower(extracted_text), '[\p{L}\p{N}_]+') as w from rfc4136 where extracted_text is not null),
s as (select distinct record_id, unnest(list_transform(range(1, len(w) - 1), lambda i: md5(array_to_string(w[i:i+2], ' ')))) as s from w where len(w) >= 20),
n as (select record_id, count(*) as n from s group by record_id),
c as (select a.record_id as a, b.record_id as b, count(*) as c from s a join s b on a.s = b.s and a.record_id < b.record_id group by all)"""
#: Both readings of documents and items as words; ligatures and full-width letters stand for the compatibility forms, which this engine lacks.
_WORDS = r"""
with t as (select doc_id::varchar as k, text as x from documents where text is not null union all
  select 'i' || id, coalesce(prompt, '') || ' ' || coalesce(expected_continuation, '') from domain_exact_generation_queries union all select distinct 'i' || pair_id, response from evaluation where response is not null),
v as (select k, regexp_replace(x, '([\p{L}\p{N}_])[-‐\x{AD}][\x{AD}\x{200B}-\x{200D}\x{FEFF}]*[ \t]*\r?\n[ \t\r\n>|]*([\p{L}\p{N}_])', '\1\2', 'g') as joined, regexp_replace(x, '([\p{L}\p{N}_])\x{AD}[ \t]*\r?\n[ \t\r\n>|]*([\p{L}\p{N}_])', '\1\2', 'g') as kept from t),
b as (select k, 0 as v, joined as x from v union all select k, 1, kept from v where kept <> joined),
l as (select k, v, regexp_extract_all(lower(translate(replace(replace(replace(replace(replace(regexp_replace(x, '[\x{AD}\x{34F}\x{61C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE0F}\x{FEFF}]', '', 'g'),
  'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789')), '[\p{L}\p{N}]+') as w from b),"""

#: The documents that queries name, and all queries that these connect each with.
_NAMED = r"""
with recursive q as (select id, source_document as x from domain_exact_generation_queries where source_document is not null union all select id, source_file from domain_exact_generation_queries where source_file is not null),
p as (select id, trim(unnest(regexp_split_to_array(lower(x), ' *; *| +/ +| +and +'))) as x from q),
r as (select id, 'rfc:' || unnest(regexp_extract_all(x, '(?:rfc|request for comments)[^0-9a-z]*0*([0-9]+)', 1)) as e from p),
f as (select id, regexp_replace(case when contains(x, ' ') then x else regexp_replace(x, '^.*[/\\]', '') end, '\.(?:pdf|txt)$', '') as x from p where not regexp_matches(x, '(?:rfc|request for comments)[^0-9a-z]*[0-9]')),
t as (select id, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(x, ',? *(?:chapter|section) [0-9.]+ *$', ''), '[^a-z0-9]+', ' ', 'g')), '^the ', ''), ' (?:release |rel |v)([0-9]+ [0-9]+)$', ' \1') as e from f),
n as (select distinct id, e from r union select distinct id, e from t where regexp_matches(e, '^[a-z].* [0-9]+ [0-9]+$')),
d as (select distinct a.id, b.id as other from n a join n b using (e)),
c as (select id, other from d union select c.id, d.other from c join d on d.id = c.other)"""
#: Each query's component, and the split whose range its hash falls into.
_ASSIGNED = """,
g as (select id, coalesce(min(other), id) as component from (select distinct id from domain_exact_generation_queries where id is not null) left join c using (id) group by id),
k as (select split_name, sum(proportion) over (order by split_name) / sum(proportion) over () as upto from split_targets where proportion > 0),
a as (select id, component, arg_min(split_name, upto) as split_name from (select *, ('0x' || substr(sha256('split:' || component), 1, 13))::bigint / 4503599627370496.0 as place from g) join k on place < upto group by id, component)"""

#: Where SQL can say what a query finds, whatever way the operator takes.
SQL: dict[str, str] = {
    "p1_found": _RUNS + """
select a as record_id_a, b as record_id_b from c join n x on x.record_id = a join n y on y.record_id = b where c >= 0.7 * (x.n + y.n - c)""",
    "p1_classes": _RUNS.replace("with w", "with recursive w", 1) + """,
l as (select a as record_id_a, b as record_id_b from c join n x on x.record_id = a join n y on y.record_id = b where c >= 0.7 * (x.n + y.n - c)),
e as (select record_id_a as x, record_id_b as y from l union all select record_id_b, record_id_a from l),
t as (select x, y from e union select t.x, e.y from t join e on e.x = t.y),
k as (select n.record_id, least(n.record_id, coalesce(min(t.y), n.record_id)) as class_id from n left join t on t.x = n.record_id group by n.record_id)
select record_id, class_id, count(*) over (partition by class_id) as class_size, (select count(*) from e where e.x = k.record_id) as links from k""",
    "p2_found": _WORDS + """
g as (select distinct k, unnest(list_transform(range(1, len(w) - 8), lambda i: md5(array_to_string(w[i:i+9], ' ')))) as g from l where len(w) >= 10)
select distinct d.k::bigint as doc_id, i.k[2:] as item_id from g d join g i using (g) where i.k[1:1] = 'i' and d.k[1:1] <> 'i'""",
    "p2_leak_report": _WORDS + """
g as (select k, v, unnest(list_transform(range(1, len(w) - 8), lambda i: struct_pack(p := i - 1, g := md5(array_to_string(w[i:i+9], ' '))))) as g from l where len(w) >= 10),
m as (select d.k::bigint as doc_id, i.k[2:] as item_id, i.v as iv, d.v as dv, d.g.p - i.g.p as diff, i.g.p as pos from g d join g i on d.g.g = i.g.g where i.k[1:1] = 'i' and d.k[1:1] <> 'i'),
r as (select *, pos - row_number() over (partition by doc_id, item_id, iv, dv, diff order by pos) as island from m),
n as (select doc_id, item_id, max(n) + 9 as longest from (select doc_id, item_id, count(*) as n from r group by doc_id, item_id, iv, dv, diff, island) group by all),
c as (select doc_id, item_id, count(distinct (iv, pos + o)) as covered from m, (select unnest(range(10)) as o) group by all),
z as (select k[2:] as item_id, max(len(w))::bigint as words from l where k[1:1] = 'i' and v = 0 group by 1)
select doc_id, item_id, longest, covered, words from n join c using (doc_id, item_id) join z using (item_id)""",
    "p4_found": r"""
with r as (select row_number() over () as i, response_id, regexp_extract_all(lower(response), '\p{L}+') as w from (select distinct response_id, response from model_responses where response is not null)),
g as (select i, unnest(range(1, len(w) - 2)) as p, w from r where len(w) >= 12),
f as (select i, p, min(p) over (partition by i, array_to_string(w[p:p+3], ' ')) < p as again from g),
c as (select i, count(distinct p + k) as covered from f, (select unnest(range(4)) as k) where again group by i)
select distinct response_id from r join c using (i) where covered >= 0.3 * len(w)""",
    "p6_found": _NAMED + """
select min(other) as first_id, id from c group by id having min(other) < id""",
    "p6_splits": _NAMED + _ASSIGNED + """
select id, component, split_name from a""",
    "p6_split_report": _NAMED + _ASSIGNED + """,
m as (select split_name, count(*)::bigint as records, count(distinct component)::bigint as components from a group by 1)
select split_name, proportion, coalesce(records, 0) as records, coalesce(components, 0) as components, coalesce(records, 0) / sum(coalesce(records, 0)) over () as share from split_targets left join m using (split_name)""",
}
