"""Line-wise cleaning of finished texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import lines as L
from loam.queries import query
from loam.queries.a_text import WS
from loam.session import read

#: The oracle's texts hold links, addresses and encoded data at known places of known documents.
_PLANT = r"""
s as (select doc_id, replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10)) as text from documents where text is not null),
l as (select doc_id, unnest(string_split(text, chr(10))) as v0, generate_subscripts(string_split(text, chr(10)), 1)::int as i from s),
p as (select doc_id, i, case (doc_id + i) % 7 when 0 then v0 || ' see [the notes](https://a.example/x_y) and http://b.example/c.' when 1 then 'http://only.example/' || doc_id
  when 2 then v0 || ' 12:ab:' || repeat('0f:', 7) || '1c end' when 3 then v0 || ' ' || sha256(doc_id::varchar) || ' ' when 4 then 'Table' || i || ':x ' || v0 when 5 then v0 || ' ' || repeat('ab,cd;', 12) || 'z' else v0 end as v from l)
"""


def _planted(spark, d):
    x = read(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split(T.line_ends("text"), "\n")).alias("p", "v0")).select("doc_id", (F.col("p") + 1).alias("i"), "v0")
    k = (F.col("doc_id") + F.col("i")) % 7
    return x.select(
        "doc_id", "i",
        F.when(k == 0, F.concat("v0", F.lit(" see [the notes](https://a.example/x_y) and http://b.example/c.")))
        .when(k == 1, F.concat(F.lit("http://only.example/"), F.col("doc_id").cast("string")))
        .when(k == 2, F.concat("v0", F.lit(" 12:ab:" + "0f:" * 7 + "1c end")))
        .when(k == 3, F.concat("v0", F.lit(" "), F.sha2(F.col("doc_id").cast("string"), 256), F.lit(" ")))
        .when(k == 4, F.concat(F.lit("Table"), F.col("i").cast("string"), F.lit(":x "), "v0"))
        .when(k == 5, F.concat("v0", F.lit(" " + "ab,cd;" * 12 + "z")))
        .otherwise(F.col("v0")).alias("v"),
    )


_U = rf"""https?://[^{WS}<>"'']+"""


@query(
    "with "
    + _PLANT
    + rf""", a as (select doc_id, i, regexp_replace(v, '(?i)\[([^\]]+)]\(https?://[^)]+\)', '\1', 'g') as v from p),
b as (select *, list_sum(list_transform(regexp_extract_all(v, '(?i){_U}'), lambda u: length(u))) / greatest(length(regexp_replace(regexp_replace(v, '^[{WS}]+', ''), '[{WS}]+\z', '')), 1) as share from a),
c as (select doc_id, i, case when share is null then v when share >= 0.6 then '' else
  regexp_replace(v, '(?i)https?://[^{WS}<>"'']*?([.,;:!?)\]}}]*)([{WS}<>"'']|\z)', '\1\2', 'g') end as v from b)
select doc_id, i, md5(v) as line_md5 from c"""
)
def lines_without_urls(spark, d):
    """Links reduced to labels, address lines emptied, addresses removed."""
    return _planted(spark, d).select("doc_id", "i", F.md5(L.remove_urls(F.col("v"))).alias("line_md5"))


@query(
    "with "
    + _PLANT
    + r""" select doc_id, i, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '(?i)(?:fingerprint[ \t]*[=:]?[ \t]*)?(?:[0-9a-f]{2}:){7,}[0-9a-f]{2}', '', 'g'),
 '(?i)(^|[^0-9a-f])[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}([^0-9a-f]|\z)', '\1\2', 'g'), '(?i)[0-9a-f]{40,}', '', 'g'),
 '[A-Za-z0-9+/]{64,}={0,2}([^A-Za-z0-9+/=]|\z)', '\1', 'g')) as line_md5 from p"""
)
def lines_without_encoded(spark, d):
    """Fingerprints, UUIDs, long hexadecimal and Base64 values removed."""
    return _planted(spark, d).select("doc_id", "i", F.md5(L.remove_encoded(F.col("v"))).alias("line_md5"))


@query(
    "with "
    + _PLANT
    + rf""", w as (select doc_id, i, regexp_extract_all(v, '[{WS}]+|[^{WS}]+') as ws from p)
select doc_id, i, md5(array_to_string(list_transform(ws, lambda x: case when length(x) >= 60 and len(regexp_extract_all(x, '[,;]')) >= 3 then regexp_replace(x, '([,;])([^{WS},;])', '\1 \2', 'g') else x end), '')) as line_md5 from w"""
)
def packed_lists_split(spark, d):
    """Blanks put into long packed lists."""
    return _planted(spark, d).select("doc_id", "i", F.md5(L.split_packed(F.col("v"))).alias("line_md5"))


@query(
    "with "
    + _PLANT
    + rf""", a as (select doc_id, i, regexp_replace(v, '\b(Table|Figure|Example)([0-9]+):([^{WS}])', '\1 \2: \3', 'g') || case when i = 1 then ' ConfiguringTheBorderGatewayProtocolForXMLParsers' else '' end as v from p),
b as (select doc_id, i, v, regexp_extract_all(v, '[A-Za-z]+|[^A-Za-z]+') as ws from a),
c as (select doc_id, i, array_to_string(list_transform(ws, lambda x: case when length(x) >= 30 and len(regexp_extract_all(regexp_replace(regexp_replace(x, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), ' ')) >= 2
  then regexp_replace(regexp_replace(x, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g') else x end), '') as v from b)
select doc_id, i, md5(v) as line_md5 from c"""
)
def joined_headings_repaired(spark, d):
    """Table labels and joined headings taken apart."""
    extra = F.when(F.col("i") == 1, " ConfiguringTheBorderGatewayProtocolForXMLParsers").otherwise("")
    return _planted(spark, d).select("doc_id", "i", F.md5(L.repair_headings(F.concat("v", extra))).alias("line_md5"))


@query(
    rf"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as v from documents where text is not null),
w as (select doc_id, v, regexp_replace(regexp_replace(v, '^[{WS}]+', ''), '[{WS}]+\z', '') as s, regexp_extract_all(v, '[^{WS}]+') as ws from l)
select doc_id, md5(v) as line_md5, length(v)::bigint as characters from w where length(s) >= 180 and len(ws) <= 2 and list_max(list_transform(ws, lambda x: length(x))) >= 160"""
)
def suspicious_lines(spark, d):
    """Long lines without words."""
    x = read(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("v"))
    return x.where(L.is_suspicious(F.col("v"))).select("doc_id", F.md5("v").alias("line_md5"), F.length("v").cast("bigint").alias("characters"))


@query(
    r"""
with l as (select doc_id, unnest(string_split(replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10)), chr(10))) as v0, generate_subscripts(string_split(replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1)::int as i from documents where text is not null),
p as (select doc_id, i, case when (doc_id * 31 + i) % 17 = 3 then '-----BEGIN CERTIFICATE-----' when (doc_id * 31 + i) % 13 = 5 then '-----END CERTIFICATE-----' else v0 end as v from l),
m as (select *, case when v = '-----BEGIN CERTIFICATE-----' then 1 when v = '-----END CERTIFICATE-----' then 0 end as mark from p),
w as (select *, coalesce(last_value(mark ignore nulls) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as inside from m),
k as (select doc_id, i, v from w where inside = 0 and coalesce(mark, 0) = 0)
select doc_id, md5(regexp_replace(string_agg(v, chr(10) order by i), '\n+\z', '')) as text_md5, count(*)::bigint as lines from k group by doc_id"""
)
def pem_blocks_removed(spark, d):
    """Certificates taken out of texts, unfinished ones to the end."""
    x = read(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split(T.line_ends("text"), "\n")).alias("p", "v0"))
    n = F.col("doc_id") * 31 + F.col("p") + 1
    x = x.select("doc_id", "p", F.when(n % 17 == 3, "-----BEGIN CERTIFICATE-----").when(n % 13 == 5, "-----END CERTIFICATE-----").otherwise(F.col("v0")).alias("v"))
    ls = L.outside_blocks(x, "doc_id", "p", "v").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias("ls"))
    return ls.select("doc_id", F.md5(T.sub(F.array_join("ls", "\n"), "\n+\\z")).alias("text_md5"), F.size("ls").cast("bigint").alias("lines"))


@query()
def post_clean(spark, d):
    """All steps together, by digest, with metrics before and after (no SQL: nine dependent rewrites of each line)."""
    x = read(spark, d, "documents").where("text is not null").select("doc_id", "text", L.post_clean(F.col("text")).alias("t"))
    return x.select("doc_id", F.md5("t").alias("text_md5"), F.length("text").cast("bigint").alias("before"), F.length("t").cast("bigint").alias("after"))


@query(
    r"""
with a as (select 'long_hex_values_removed' as action, len(regexp_extract_all(text, '(?i)[0-9a-f]{40,}'))::bigint as n from documents where text is not null union all
select 'base64_values_removed', len(regexp_extract_all(text, '[A-Za-z0-9+/]{64,}={0,2}(?:[^A-Za-z0-9+/=]|\z)')) from documents where text is not null union all
select 'fingerprints_removed', len(regexp_extract_all(text, '(?i)(?:fingerprint[ \t]*[=:]?[ \t]*)?(?:[0-9a-f]{2}:){7,}[0-9a-f]{2}')) from documents where text is not null union all
select 'markdown_urls_removed', len(regexp_extract_all(text, '(?i)\[([^\]]+)]\(https?://[^)]+\)')) from documents where text is not null)
select action, sum(n)::bigint as total, count(*)::bigint as documents from a where n > 0 group by action"""
)
def post_clean_totals(spark, d):
    """How often each step found something, over the corpus."""
    return L.action_totals(read(spark, d, "documents").where("text is not null"), "text")
