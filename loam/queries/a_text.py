"""Text functions (normalisation, metrics, names, hashes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import text as T
from loam.queries import query
from loam.session import read

WS = r"\t\n\x0B\f\r\x1c-\x1f \x85\p{Z}"
CANON = r"""
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10)),
  '(?m)^#[ \t]*MD5:[ \t]*[a-fA-F0-9]{32}[ \t]*\n?', '', 'g'),
  '(?mi)^[ \t]*\[EXTRACTED TABLES\]:?[ \t]*\n?', '', 'g'),
  '[\x00-\x08\x0B-\x1f\x7f-\x9f\p{Cf}]', '', 'g'),
  '[ \t]+\n', chr(10), 'g'),
  '\n[ \t]*\n(?:[ \t]*\n)+', chr(10)||chr(10), 'g'),
  '^[WS]+', ''), '[WS]+\z', '')
""".replace("WS", WS)


@query(
    rf"""
select doc_id, length(text)::bigint as characters,
  (case when text = '' then 0 else len(string_split(regexp_replace(regexp_replace(text, '\r\n?|[\x0b\x0c\x1c\x1d\x1e\x85\x{{2028}}\x{{2029}}]', chr(10), 'g'), '\n\z', ''), chr(10))) end)::bigint as lines,
  len(regexp_extract_all(text, '[^{WS}]+'))::bigint as words,
  len(regexp_extract_all(text, '(?i)https?://[^{WS}<>"'']+'))::bigint as urls,
  len(regexp_extract_all(text, '(?i)[0-9a-f]{{40,}}'))::bigint as long_hex_values,
  len(regexp_extract_all(text, '[A-Za-z0-9+/]{{64,}}={{0,2}}(?:[^A-Za-z0-9+/=]|\z)'))::bigint as base64_values
from documents where text is not null"""
)
def text_metrics(spark, d):
    """Characters, lines, words, URLs, long hexadecimal and Base64 values of each text."""
    x = F.col("text")
    return (
        read(spark, d, "documents")
        .where(x.isNotNull())
        .select(
            "doc_id",
            F.length(x).cast("bigint").alias("characters"),
            F.when(x == "", 0).otherwise(F.size(T.split_lines(x))).cast("bigint").alias("lines"),
            T.count_matches(x, f"[^{T.WS}]+").alias("words"),
            T.count_matches(x, T.URL).alias("urls"),
            T.count_matches(x, T.LONG_HEX).alias("long_hex_values"),
            T.count_matches(x, T.BASE64).alias("base64_values"),
        )
    )


@query(f"select doc_id, md5(t) as clean_md5, length(t)::bigint as clean_characters from (select doc_id, {CANON} as t from documents where text is not null)")
def norm_canonical(spark, d):
    """The canonical clean text (line ends, header lines, controls, blank runs), by digest."""
    x = T.canonical("text")
    return (
        read(spark, d, "documents").where("text is not null").select("doc_id", x.alias("t")).select("doc_id", F.md5("t").alias("clean_md5"), F.length("t").cast("bigint").alias("clean_characters"))
    )


@query(
    rf"""
with p as (select doc_id, unnest(regexp_split_to_array({CANON}, '\n\n+')) as para from documents where text is not null)
select doc_id, count(*)::bigint as paragraphs, count(distinct para)::bigint as distinct_raw,
  count(distinct trim(regexp_replace(para, '[{WS}]+', ' ', 'g'), ' '))::bigint as distinct_squeezed,
  count(distinct lower(trim(regexp_replace(para, '[{WS}]+', ' ', 'g'), ' ')))::bigint as distinct_folded,
  count(distinct replace(lower(trim(regexp_replace(para, '[{WS}]+', ' ', 'g'), ' ')), 'ß', 'ss'))::bigint as distinct_casefolded
from p where para <> '' group by doc_id"""
)
def paragraph_keys(spark, d):
    """How many paragraphs differ, raw and under three ways of comparing."""
    p = F.filter(F.split(T.canonical("text"), "\n\n+"), lambda v: v != "")
    n = lambda v: F.size(F.array_distinct(v)).cast("bigint")
    sq = F.transform("p", lambda v: T.squeeze(v))
    return (
        read(spark, d, "documents")
        .where("text is not null")
        .select("doc_id", p.alias("p"))
        .where(F.size("p") > 0)
        .select(
            "doc_id", F.size("p").cast("bigint").alias("paragraphs"), n(F.col("p")).alias("distinct_raw"), n(sq).alias("distinct_squeezed"),
            n(F.transform(sq, F.lower)).alias("distinct_folded"), n(F.transform(sq, lambda v: T.fold(v, True))).alias("distinct_casefolded"),
        )
    )


@query(
    rf"""
with l as (select unnest(string_split(replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10)), chr(10))) as line from documents where text is not null),
m as (select trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '<n>', 'g'), '[{WS}]+', ' ', 'g'), ' ') as masked from l)
select masked, count(*)::bigint as lines from m where length(masked) between 8 and 220 group by masked having count(*) >= 3"""
)
def masked_line_counts(spark, d):
    """Lines that recur (3 times or more) once their numbers are masked."""
    lines = read(spark, d, "documents").where("text is not null").select(F.explode(F.split(T.line_ends("text"), "\n")).alias("line"))
    return (
        lines.select(T.digit_mask("line").alias("masked")).where(F.length("masked").between(8, 220)).groupBy("masked").agg(F.count(F.lit(1)).alias("lines")).where("lines >= 3")
    )


@query("select distinct trim(regexp_replace(lower(source), '[^a-z0-9]+', ' ', 'g'), ' ') as source_key, trim(regexp_replace(source, '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g'), ' -') as compacted from documents where source is not null")
def source_keys(spark, d):
    """Labels as letter-and-digit keys, and compacted."""
    return read(spark, d, "documents").where("source is not null").select(T.alnum_key("source").alias("source_key"), T.compact("source").alias("compacted")).distinct()


@query(
    r"""
with s as (select doc_id, text, replace(replace(text, 'fi', chr(57379)), '• ', chr(61623)) as damaged from documents where text is not null)
select doc_id, md5(replace(replace(damaged, chr(57379), 'fi'), chr(61623), '•')) as repaired_md5,
  (length(damaged) - length(replace(damaged, chr(57379), '')))::bigint as fi_glyphs
from s"""
)
def glyph_repair(spark, d):
    """Private-use glyphs put back: texts are damaged with two of them and repaired."""
    damaged = F.replace(F.replace("text", F.lit("fi"), F.lit("")), F.lit("• "), F.lit(""))
    return (
        read(spark, d, "documents")
        .where("text is not null")
        .select("doc_id", damaged.alias("x"))
        .select("doc_id", F.md5(T.translate_glyphs("x")).alias("repaired_md5"), F.coalesce(F.try_element_at(T.glyph_counts("x"), F.lit("U+E023")), F.lit(0)).cast("bigint").alias("fi_glyphs"))
    )


@query(
    rf"""
with s as (select doc_id, trim(regexp_replace(text, '[{WS}]+', ' ', 'g'), ' ') as x from documents where text is not null)
select doc_id, x[1:180] as preview, case when length(x) > 160 then x[1:157] || '...' else x end as sample,
  case when length(x) > 80 then x[1:79] || '…' else x end as cell from s"""
)
def previews(spark, d):
    """Beginnings of three kinds."""
    return read(spark, d, "documents").where("text is not null").select(
        "doc_id", T.preview("text").alias("preview"), T.clip("text").alias("sample"), T.clip("text", 80, "…").alias("cell")
    )


@query("select doc_id, md5(text) as text_md5, sha256(text) as text_sha256 from documents where text is not null")
def doc_hashes(spark, d):
    return read(spark, d, "documents").where("text is not null").select("doc_id", F.md5("text").alias("text_md5"), F.sha2("text", 256).alias("text_sha256"))


@query(
    r"""
with n as (select record_id, path, coalesce(source_corpus, 'none') as corpus, regexp_extract(path, '([^/\\]*)$', 1) as name from rfc4136 where path is not null),
s as (select *, regexp_replace(name, '(.)\.[^.]*$', '\1') as stem from n)
select record_id, corpus || '-' || trim(regexp_replace(lower(stem), '[^a-z0-9]+', '-', 'g'), '-')[1:72] || '-' || sha256(corpus || '/' || path)[1:12] as document_id,
  name as file_name, stem as file_stem, lower(regexp_extract(name, '.(\.[^.]*)$', 1)) as file_suffix,
  coalesce(nullif(trim(regexp_replace(stem, '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'document') as safe_name from s"""
)
def doc_ids(spark, d):
    """Stable document identifiers and parts of paths."""
    c = F.coalesce("source_corpus", F.lit("none"))
    return read(spark, d, "rfc4136").where("path is not null").select(
        "record_id", T.document_id(c, "path").alias("document_id"), T.file_name("path").alias("file_name"), T.stem("path").alias("file_stem"), T.suffix("path").alias("file_suffix"), T.safe_name(T.stem("path")).alias("safe_name")
    )


@query(
    r"""
with b as (select coalesce(nullif(trim(regexp_replace(regexp_extract(path, '([^/\\]*)$', 1), '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'document') as base, path, record_id from rfc4136 where path is not null),
r as (select *, row_number() over (partition by base order by path, record_id) as n from b)
select record_id, case when n = 1 then base else base || '-' || sha256(path || ':' || n)[1:8] end as output_name from r"""
)
def unique_output_names(spark, d):
    """File names that no two records share: later ones get a hash."""
    from pyspark.sql import Window

    w = Window.partitionBy("base").orderBy("path", "record_id")
    x = read(spark, d, "rfc4136").where("path is not null").select("record_id", "path", T.safe_name(T.file_name("path")).alias("base")).withColumn("n", F.row_number().over(w))
    tail = F.substring(F.sha2(F.concat_ws(":", "path", F.col("n").cast("string")), 256), 1, 8)
    return x.select("record_id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", tail)).alias("output_name"))


@query(
    r"""
with c as (select r_regionkey, r_name, array_agg(n_name order by n_nationkey) as names, array_agg(n_nationkey order by n_nationkey) as keys from region join nation on n_regionkey = r_regionkey group by all)
select r_regionkey, '| ' || r_name || ' | key |' || chr(10) || '| --- | --- |' || chr(10) ||
  array_to_string(list_transform(list_zip(names, keys), lambda p: '| ' || p[1] || ' | ' || (case when p[2] % 5 = 0 then '' else p[2]::varchar end) || ' |'), chr(10)) as table_text from c"""
)
def markdown_tables(spark, d):
    """Rows of cells as Markdown tables, short rows filled up."""
    n = read(spark, d, "nation").select(
        F.col("n_regionkey").alias("r_regionkey"), "n_nationkey",
        F.when(F.col("n_nationkey") % 5 == 0, F.array("n_name")).otherwise(F.array("n_name", F.col("n_nationkey").cast("string"))).alias("cells"),
    )
    rows = n.groupBy("r_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "cells"))), lambda s: s["cells"]).alias("rows"))
    head = F.array(F.array("r_name", F.lit("key")))
    return read(spark, d, "region").join(rows, "r_regionkey").select("r_regionkey", T.markdown_table(F.concat(head, "rows")).alias("table_text"))


@query(
    """
select event_id, case when value / 10 < 20 then round(exp(value / 10), 6) else 'Infinity'::double end as perplexity,
  case when value < 100 then round(exp(value / 100), 6) else 'Infinity'::double end as adapter_perplexity, printf('%.1f%%', floor(value / 1000 * 100 * 10 + 0.5) / 10) as percent_text
from events where value is not null"""
)
def perplexity_values(spark, d):
    """exp(loss) with two ceilings, and a formatted percentage."""
    v = F.col("value")
    return read(spark, d, "events").where("value is not null").select(
        "event_id", F.round(T.perplexity(v / 10), 6).alias("perplexity"), F.when(v < 100, F.round(F.exp(v / 100), 6)).otherwise(F.lit(float("inf"))).alias("adapter_perplexity"), T.percent(v / 1000).alias("percent_text")
    )


@query()
def norm_compatibility(spark, d):
    """NFKC texts by digest (no SQL: the oracle's engine has no compatibility forms)."""
    from loam.functions import normal

    return read(spark, d, "documents").where("text is not null").select("doc_id", normal.normalised("text").alias("t")).select("doc_id", F.md5("t").alias("text_md5"))
