"""Document types, page furniture, kinds of blocks, content cleaning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import blocks as B
from loam.queries import query
from loam.queries.a_text import WS
from loam.session import read

STRIP = lambda x: f"regexp_replace(regexp_replace({x}, '^[{WS}]+', ''), '[{WS}]+\\z', '')"
SQUEEZE = lambda x: f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'), ' ')"


def _docs(spark, d):
    return read(spark, d, "documents").where("text is not null")


_TYPES = " ".join(f"when regexp_matches(text[1:12000], '{p}') then '{n}'" for n, p in B.DOCUMENT_TYPES)


@query(f"select doc_id, case {_TYPES} else 'generic' end as document_type from documents where text is not null")
def document_types(spark, d):
    return _docs(spark, d).select("doc_id", B.document_type(F.col("text")).alias("document_type"))


_MASK = SQUEEZE("regexp_replace(lower(v), '[0-9]+', '<n>', 'g')")
_PAGE = " or ".join(f"regexp_matches({STRIP('v')}, '{p}')" for p in B.PAGE_LINES)
_RUNNING = rf"""
l as (select doc_id, unnest(string_split(text, chr(10))) as v from documents where text is not null),
m as (select doc_id, v, {_MASK} as masked from l),
rep as (select doc_id, masked from m where length({STRIP('v')}) between 8 and 220 and regexp_matches(masked, '{B.RUNNING_HINT}') group by doc_id, masked having count(*) >= 3),
why as (select m.doc_id, m.v, case when {_PAGE} then 'page_header_or_footer' when rep.masked is not null then 'repeated_running_header_or_footer'
   when regexp_matches({STRIP('v')}, '^©[ \t]*[0-9]{{4}}') then 'copyright_line' end as reason from m left join rep on rep.doc_id = m.doc_id and rep.masked = m.masked)
"""


@query("with " + _RUNNING + "select doc_id, reason, count(*)::bigint as lines, sum(length(v))::bigint as characters from why where reason is not null group by all")
def running_lines(spark, d):
    """Page headers, footers and copyright lines by document and reason."""
    x = _docs(spark, d).select("doc_id", F.split("text", "\n").alias("l"))
    x = x.withColumn("rep", B.repeated_lines(F.col("l")))
    x = x.select("doc_id", "rep", F.explode("l").alias("v")).select("doc_id", "v", B.running_line_reason(F.col("v"), F.col("rep")).alias("reason"))
    return x.where("reason is not null").groupBy("doc_id", "reason").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("v")).cast("bigint").alias("characters"))


_PHRASES = " or ".join(f"""contains(lower({SQUEEZE('b')}), '{p.replace("'", "''")}')""" for p in B.BOILERPLATE)
_N = "len(f)"
_CNT = lambda p: f"len(list_filter(f, lambda x: regexp_matches(x, '{p}')))"
_BLOCKS = rf"""
t as (select doc_id, text, case {_TYPES} else 'generic' end as document_type from documents where text is not null),
s as (select doc_id, document_type, list_filter(list_transform(regexp_split_to_array(text, '\n[{WS}]*\n'), lambda x: {STRIP('x')}), lambda x: x <> '') as bs from t),
b as (select doc_id, document_type, unnest(bs) as b, generate_subscripts(bs, 1)::int - 1 as pos from s),
f as (select *, list_filter(list_transform(string_split(b, chr(10)), lambda x: {STRIP('x')}), lambda x: x <> '') as f from b),
c as (select *, {_CNT(B.DOT_LEADER)} as dots, {_CNT(B.CONTACT)} as contacts, len(regexp_extract_all(array_to_string(f, chr(10)), '[\p{{L}}\p{{N}}_]+')) as words, {_CNT('[.:;?!]$')} as ended,
  {_CNT('[^ \t][ \t]+[•▪‣][ \t]+[^ \t]')} as mid, {_CNT('[^ \t][ \t]{5,}[^ \t]')} as gaps, {_CNT(r'^\|')} as bars, array_to_string(f, '') as chars,
  {_CNT(B.PROMPT)} as prompts, len(list_filter(f, lambda x: length(x) <= 160 and not ends_with(x, '.') and regexp_matches(x, '{B.COMMAND}'))) as commands from f),
kinds as (select doc_id, document_type, pos, b, f, case
  when {_N} >= 3 and ((lower(f[1]) in ('contents', 'table of contents') and dots >= 2) or ({_N} >= 5 and dots >= 0.6 * {_N})) then 'table_of_contents'
  when {_PHRASES} or ({_N} >= 3 and contacts > 0.5 * {_N}) then 'boilerplate'
  when {_N} >= 8 and words >= 3 * {_N} and words <= 12 * {_N} and ended < 0.15 * {_N} and (mid >= 2 or gaps >= 0.5 * {_N}) then 'garbled_columns'
  when {_N} > 0 and bars >= 0.5 * {_N} then 'table'
  when {_N} >= 4 and length(chars) - length(regexp_replace(chars, '[|+\-=<>/\\_*]', '', 'g')) > 0.28 * length(chars) and length(chars) - length(regexp_replace(chars, '[\p{{L}}]', '', 'g')) < 0.35 * length(chars) then 'ascii_diagram'
  when document_type <> 'rfc' and {_N} > 0 and (prompts + commands >= 0.35 * {_N} or (prompts >= 3 and prompts + commands >= 0.10 * {_N}) or (commands >= 4 and prompts + commands >= 0.20 * {_N})) then 'cli'
  else 'prose' end as kind from c)
"""


def _kinds(spark, d):
    x = _docs(spark, d).select("doc_id", B.document_type(F.col("text")).alias("t"), F.filter(F.transform(F.split("text", f"\n[{T.WS}]*\n"), T.strip), lambda b: b != "").alias("bs"))
    x = x.select("doc_id", "t", F.posexplode("bs").alias("pos", "b"))
    return x.withColumn("kind", B.block_kind(F.col("b"), F.col("t")))


@query("with " + _BLOCKS + "select doc_id, pos, kind, md5(b) as block_md5 from kinds")
def block_kinds(spark, d):
    """The kind of every block."""
    return _kinds(spark, d).select("doc_id", "pos", "kind", F.md5("b").alias("block_md5"))


@query(
    "with "
    + _BLOCKS
    + f""", k as (select doc_id, pos, lower({SQUEEZE('b')}) as key from kinds)
select doc_id, pos, row_number() over (partition by doc_id, key order by pos)::int as nth from k where length(key) >= 120 qualify nth > 1"""
)
def duplicate_blocks(spark, d):
    """Long blocks that stood before in the same document."""
    keys = F.transform(F.filter(F.transform(F.split("text", f"\n[{T.WS}]*\n"), T.strip), lambda b: b != ""), lambda b: F.lower(T.squeeze(b)))
    x = _docs(spark, d).select("doc_id", F.posexplode(keys).alias("pos", "key")).where(F.length("key") >= 120).select("doc_id", "pos", F.sha2("key", 256).alias("digest"))
    return x.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("pos"))).where("nth > 1").select("doc_id", "pos", "nth")


_HEAD = rf"""s <> '' and length(s) <= 110 and not regexp_matches(s, '[.,;?!]$') and len(w) between 1 and 14 and (regexp_matches(s, '^(?:CHAPTER|Chapter|Appendix|Preface|Overview)\b')
  or (regexp_matches(s, '[A-Za-z]') and not regexp_matches(s, '[\p{{Ll}}]')) or (len(w) <= 8 and len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) >= 0.75 * len(w)))"""


@query(
    rf"""
with l as (select distinct {STRIP('v')} as s from (select unnest(string_split(text, chr(10))) as v from documents where text is not null)),
w as (select s, regexp_extract_all(s, '[A-Za-z0-9][A-Za-z0-9_/-]*') as w from l)
select md5(s) as line_md5, length(s)::bigint as characters from w where {_HEAD}"""
)
def heading_lines(spark, d):
    """Distinct lines that look like headings."""
    x = _docs(spark, d).select(F.explode(F.split("text", "\n")).alias("v")).select(T.strip("v").alias("s")).distinct()
    return x.where(B.is_heading_line(F.col("s"))).select(F.md5("s").alias("line_md5"), F.length("s").cast("bigint").alias("characters"))


_EDGE = rf"""
blk as (select doc_id, unnest(regexp_split_to_array(text, '\n\n+')) as b, generate_subscripts(regexp_split_to_array(text, '\n\n+'), 1) as bi from documents where text is not null),
ln as (select doc_id, bi, unnest(string_split(b, chr(10))) as v, generate_subscripts(string_split(b, chr(10)), 1) as i from blk),
fl as (select *, row_number() over (partition by doc_id, bi order by i) as up, count(*) over (partition by doc_id, bi) as n from ln where regexp_matches(v, '[^{WS}]')),
pg as (select doc_id, bi from fl group by doc_id, bi having count(*) >= 4 and count(*) filter (regexp_matches(v, '^[ \t]*\|')) <= count(*) / 2),
cnt as (select doc_id, count(*) as pages from pg group by doc_id),
ed as (select fl.doc_id, fl.bi, lower({SQUEEZE('v')}) as k, v from fl join pg using (doc_id, bi) where up <= 4 or up > n - 4),
ok as (select distinct doc_id, bi, k from ed where length(k) between 12 and 200 and not regexp_matches(v, '^[ \t]*(?:\||```)') and not regexp_matches(v, '[#{{}}]') and len(regexp_extract_all(k, '[a-z][a-z0-9-]*')) >= 4)
select ok.doc_id, k as edge_line, count(*)::bigint as blocks from ok join cnt using (doc_id) group by ok.doc_id, k, pages having pages >= 3 and count(*) >= greatest(3, ceil(pages / 20))"""


@query("with " + _EDGE)
def page_edge_lines(spark, d):
    """Lines that recur at the edges of page blocks."""
    blocks = F.transform(F.split("text", r"\n{2,}"), lambda b: F.split(b, "\n"))
    x = _docs(spark, d).select("doc_id", F.filter(blocks, B.is_page_block).alias("pages")).where(F.size("pages") >= 3)
    keys = F.transform("pages", lambda b: F.array_distinct(F.transform(F.filter(B.edge_lines(b), B.is_edge_candidate), B.edge_key)))
    x = x.select("doc_id", F.size("pages").alias("n"), F.explode(F.flatten(keys)).alias("edge_line"))
    return x.groupBy("doc_id", "n", "edge_line").agg(F.count(F.lit(1)).alias("blocks")).where(F.col("blocks") >= F.greatest(F.lit(3), F.ceil(F.col("n") / 20))).select("doc_id", "edge_line", "blocks")


def page_edges_removed(spark, d):
    """Texts without their recurring page edges, by digest (no SQL: positions within blocks after removal)."""
    return _docs(spark, d).select("doc_id", F.md5(B.remove_page_edges(T.line_ends("text"))).alias("text_md5"))


query()(page_edges_removed)


def _cleaned(spark, d):
    return B.clean_blocks(read(spark, d, "documents"), "doc_id", "text")


@query()
def content_clean(spark, d):
    """The block cleaner's text, by digest, with kept blocks by kind (no SQL: paragraphs are folded line by line)."""
    x = _cleaned(spark, d)
    kinds = lambda k: F.size(F.filter("blocks", lambda b: b["action"].isNull() & (b["kind"] == k))).cast("bigint")
    return x.select("doc_id", "document_type", F.md5("cleaned").alias("cleaned_md5"), F.length("cleaned").cast("bigint").alias("characters"), *[kinds(k).alias(f"{k}_blocks") for k in ("prose", "heading", "table", "cli")])


@query()
def content_removed(spark, d):
    """What the cleaner removed, by reason."""
    return B.removal_totals(_cleaned(spark, d))


@query()
def content_removed_samples(spark, d):
    """Up to three previews of each reason in each document."""
    return B.removal_samples(_cleaned(spark, d), "doc_id")


_SPACED = r"^((?:[A-Za-z][ \t]+){2,}[A-Za-z])(?:[ \t]+([0-9]+))?$"
_UNSPACED = lambda x: f"case when regexp_matches({x}, '{_SPACED}') then upper(regexp_replace(regexp_extract({x}, '{_SPACED}', 1), '[ \\t]+', '', 'g')[1:1]) || lower(regexp_replace(regexp_extract({x}, '{_SPACED}', 1), '[ \\t]+', '', 'g')[2:]) || case when regexp_extract({x}, '{_SPACED}', 2) <> '' then ' ' || regexp_extract({x}, '{_SPACED}', 2) else '' end else {x} end"


@query(
    f"""with n as (select n_nationkey, regexp_replace(n_name, '(.)', '\\1 ', 'g') || case when n_nationkey % 2 = 0 then n_nationkey::varchar else '' end as line from nation),
s as (select n_nationkey, {STRIP('line')} as s from n) select n_nationkey, {_UNSPACED('s')} as heading from s"""
)
def spaced_headings(spark, d):
    """Headings with blanks between their letters, put right (names, some with a number)."""
    x = read(spark, d, "nation").select("n_nationkey", F.concat(F.regexp_replace("n_name", "(.)", "$1 "), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("string")).otherwise("")).alias("line"))
    return x.select("n_nationkey", B.unspaced_heading(F.col("line")).alias("heading"))


@query(
    "with "
    + _BLOCKS
    + f""", x as (select doc_id, pos, list_filter(list_transform(string_split(b, chr(10)), lambda v: regexp_replace(v, '[{WS}]+\\z', '')), lambda v: v <> '') as own from kinds where kind in ('cli', 'table'))
select doc_id, pos, md5('```text' || chr(10) || array_to_string(own[1:160], chr(10)) || chr(10) || '```') as fence_md5, greatest(len(own) - 160, 0)::int as tail from x"""
)
def command_fences(spark, d):
    """Blocks of commands and tables within a fence, up to 160 lines; the lines beyond are counted."""
    x = _kinds(spark, d).where("kind in ('cli', 'table')").select("doc_id", "pos", B.fenced(F.col("b")).alias("f"))
    return x.select("doc_id", "pos", F.md5("f.text").alias("fence_md5"), "f.tail")


_WORDS = r"[A-Za-z0-9][\p{L}\p{N}_/-]*"


@query(
    "with "
    + _BLOCKS
    + f""", v as (select doc_id, pos, unnest(string_split(b, chr(10))) as v, generate_subscripts(string_split(b, chr(10)), 1) as i from kinds where kind = 'prose'),
u0 as (select doc_id, pos, i, {STRIP('v')} as s from v), u as (select doc_id, pos, i, {_UNSPACED('s')} as s from u0),
w as (select *, regexp_extract_all(s, '{_WORDS}') as w from u),
q as (select *, case when s = '' then 'blank' when regexp_matches(s, '{B.BULLET}') then 'bullet' when {_HEAD} then 'heading' else 'text' end as part from w),
g as (select *, sum(case when part = 'text' and before = 'text' then 0 else 1 end) over (partition by doc_id, pos order by i) as g from (select *, lag(part) over (partition by doc_id, pos order by i) as before from q)),
p as (select doc_id, pos, g, any_value(part) as part, list_reduce(array_agg(s order by i), lambda x, y: case when ends_with(x, '-') and regexp_matches(y, '^[\\p{{Ll}}]') then x[:-2] || y else x || ' ' || y end) as x from g group by all)
select doc_id, pos, md5(array_to_string(array_agg(case when part = 'heading' then x else {SQUEEZE('x')} end order by g), chr(10) || chr(10))) as text_md5, case when bool_and(part = 'heading') then 'heading' else 'prose' end as kind from p where part <> 'blank' group by doc_id, pos"""
)
def reflowed_blocks(spark, d):
    """Blocks of prose with their wrapped lines joined; bullets and headings stand alone."""
    x = B.reflow_blocks(_kinds(spark, d).where("kind = 'prose'"), ["doc_id", "pos"], "b")
    return x.select("doc_id", "pos", F.md5("text").alias("text_md5"), "kind")
