"""Instruction pairs and their training form."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import dedup as D
from loam.operators import instruct as I
from loam.operators import packing as P
from loam.operators import splits as S
from loam.queries import query
from loam.queries.a_text import WS
from loam.session import read

_COMPACT = lambda x: f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'), ' -' || chr(9) || chr(13) || chr(10))"
_STRIP = lambda x: f"regexp_replace(regexp_replace({x}, '^[{WS}]+', ''), '[{WS}]+\\z', '')"
_TITLE = lambda x: rf"trim(regexp_replace(regexp_replace(regexp_replace({x}, '(?i)^(?:chapter[ ]+)?[0-9]+(?:\.[0-9]+)*\.?[ ]+', ''), '(?i)[ ]+Chapter[ ]+[0-9]+[ ]*$', ''), '(?i)[ ]+Examples?[ ]*$', ''), ' .:?!-')"
_Q = lambda p: p.replace("'", "''")
#: Documents get a heading before their text, so that there are sections to find.
_HEADED = """d as (select doc_id, coalesce(source, 'none') as source, case doc_id % 5 when 0 then 'Configuring the ' || coalesce(source, 'none') || ' network' when 1 then '2.' || (doc_id % 9) || '. Router interface behaviour' when 2 then 'Overview of network interfaces' when 3 then 'Introduction' else 'Guidelines for packet routing and protocol use' end
  || chr(10) || chr(10) || 'Note.' || chr(10) || chr(10) || 'Each network interface of the router keeps a packet queue. ' || text as text from documents where text is not null)"""
_BLOCKS = rf"""{_HEADED},
n as (select doc_id, source, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t]*\n[ \t\n]*'), lambda b: {_STRIP('b')}), lambda b: b <> '') as bs from d),
b as (select doc_id, source, unnest(bs) as b, generate_subscripts(bs, 1)::int as pos from n),
r as (select *, {_COMPACT('b')} as raw from b), t as (select *, {_TITLE('raw')} as title from r),
h as (select *, not contains(b, chr(10)) and length(raw) between 3 and 120 and len(string_split(raw, ' ')) <= 17 and not regexp_matches(raw, '[|{{}}=]') and not regexp_matches(raw, '{I.BOILERPLATE}')
  and title <> '' and lower(title) not in ({', '.join(repr(g) for g in I.GENERIC)}) and not regexp_matches(title, '{_Q(I.NO_CONTENT)}') and not regexp_matches(title, '{I.FRAGMENT}') and not regexp_matches(title, '{I.OUT_OF_SCOPE}')
  and not regexp_matches(title, ' [0-9]+-[0-9]+$') and not regexp_matches(title, '(?i)\b(?:and|for|from|in|of|on|the|to|with) *$')
  and len(regexp_extract_all(title, '\(')) = len(regexp_extract_all(title, '\)')) and len(regexp_extract_all(title, '"')) % 2 = 0
  and (regexp_matches(raw, '^[0-9]+(?:\.[0-9]+)+\.? +[A-Z]') or {' or '.join(f"starts_with(raw, '{p}')" for p in I.PREFIXES)}) as head,
  length(raw) between 180 and 2400 and not regexp_matches(raw, '{I.BOILERPLATE}') and len(regexp_extract_all(raw, '\|')) <= 8 and not contains(raw, '(cid:') and len(regexp_extract_all(raw, '(?i)https?://|www\.')) <= 1
  and length(regexp_replace(raw, '[^\p{{L}}]', '', 'g')) >= 0.55 * length(raw) and regexp_matches(raw, '{I.DOMAIN}') and not regexp_matches(regexp_extract(raw, '(\p{{L}})', 1), '[\p{{Ll}}]')
  and not regexp_matches(raw, '(?i)\b(?:a|an|and|for|in|of|or|the|to|with) *$') and not ends_with(raw, ':') as answer from t)
"""


def _headed(spark, d):
    k = F.col("doc_id") % 5
    s = F.coalesce("source", F.lit("none"))
    head = F.when(k == 0, F.concat(F.lit("Configuring the "), s, F.lit(" network"))).when(k == 1, F.concat(F.lit("2."), (F.col("doc_id") % 9).cast("string"), F.lit(". Router interface behaviour"))).when(
        k == 2, "Overview of network interfaces"
    ).when(k == 3, "Introduction").otherwise("Guidelines for packet routing and protocol use")
    body = F.concat(head, F.lit("\n\nNote.\n\nEach network interface of the router keeps a packet queue. "), "text")
    return read(spark, d, "documents").where("text is not null").select("doc_id", s.alias("source"), body.alias("text"))


def _blocks(spark, d):
    bs = F.filter(F.transform(F.split("text", "\n[ \t]*\n[ \t\n]*"), T.strip), lambda b: b != "")
    x = _headed(spark, d).select("doc_id", F.posexplode(bs).alias("pos", "b"))
    return x.select("doc_id", (F.col("pos") + 1).alias("pos"), "b")


@query("with " + _BLOCKS + "select doc_id, pos, title, head, answer from h where head or answer")
def heading_blocks(spark, d):
    """Blocks that are headings or can answer."""
    x = _blocks(spark, d).select("doc_id", "pos", I.heading_title(F.col("b")).alias("title"), I.is_heading(F.col("b")).alias("head"), I.is_answer(F.col("b")).alias("answer"))
    return x.where("head or answer")


_TOPIC = lambda x: f"list_distinct(list_transform(regexp_extract_all({x}, '[A-Za-z][A-Za-z0-9-]{{2,}}'), lambda w: lower(w)))"
_KEY = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' ')"
_LEADS = ", ".join(f"lead(head, {j}) over w as h{j}, lead(answer, {j}) over w as a{j}, lead(raw, {j}) over w as r{j}, lead(title, {j}) over w as t{j}" for j in (1, 2, 3))
_OK = lambda j: f"(coalesce(a{j}, false) and not h{j} and len(list_intersect({_TOPIC(f'r{j}')}, topic)) >= least(2, len(topic)))"
_STOP = lambda j: f"(coalesce(h{j}, false) and {_KEY(f't{j}')} <> {_KEY('title')})"
_PAIRS = (
    _BLOCKS
    + f""", l as (select *, {_LEADS} from h window w as (partition by doc_id order by pos)),
k as (select *, list_filter({_TOPIC('title')}, lambda w: w not in ({', '.join(repr(w) for w in I.STOP)})) as topic from l where head),
c as (select doc_id, pos, source, title, case when {_STOP(1)} then null when {_OK(1)} then r1 when {_STOP(2)} then null when {_OK(2)} then r2 when {_STOP(3)} then null when {_OK(3)} then r3 end as response from k),
q as (select doc_id, pos, source, title as section, response, case when starts_with(lower(title), 'configuring ') then 'How do you configure ' || trim(title[13:], ' .:-') || '?'
  when starts_with(lower(title), 'overview of ') then (case when regexp_matches(trim(title[13:], ' .:-'), '(?i)(?:files|interfaces|routes|settings)$') then 'What are ' else 'What is ' end) || trim(title[13:], ' .:-') || '?'
  when starts_with(lower(title), 'guidelines for ') then 'What guidelines apply to ' || trim(title[16:]) || '?' when starts_with(lower(source), 'rfc') then 'According to ' || upper(source) || ', what is ' || title || '?' else 'Explain ' || title || '.' end as instruction from c where response is not null),
pr as (select *, (case when length(response) between 280 and 1400 then 3 when length(response) <= 1800 then 1 else 0 end + case when regexp_matches(response, '(?i)\\b(?:must|should|use|configure|command|supports|provides|enables)\\b') then 2 else 0 end
  + case when regexp_matches(response, '{I.PRODUCT}') then 2 else 0 end + case when regexp_matches(lower(section), '^(?:about|understanding|configuring|troubleshooting) ') then 2 else 0 end - case when regexp_matches(response, '(?i)\\b(?:page|figure|table) +[0-9]+') then 2 else 0 end)::int as score from q)
"""
)


def _pairs(spark, d):
    return I.heading_pairs(_headed(spark, d), "doc_id", "text", "source")


@query("with " + _PAIRS + "select doc_id, pos, instruction, md5(response) as response_md5, section, score from pr")
def heading_pairs(spark, d):
    """Questions from headings with the block that answers them, scored."""
    return _pairs(spark, d).select("doc_id", "pos", "instruction", F.md5("response").alias("response_md5"), "section", "score")


@query("with " + _PAIRS + "select score, count(*)::bigint as pairs, min(length(response))::int as least, round(avg(length(response)), 2) as average, max(length(response))::int as most from pr group by score")
def pair_statistics(spark, d):
    """Lengths of answers by score."""
    return I.length_statistics(_pairs(spark, d), "response", "score")


@query("with " + _PAIRS + f", x as (select pr.doc_id, pr.response, {_COMPACT('d.text')} as t from pr join d using (doc_id)) select count(*)::bigint as pairs, count(*) filter (not contains(t, response))::bigint as ungrounded from x")
def pair_grounding(spark, d):
    """Answers that do not stand in their document (must be 0)."""
    p, docs = _pairs(spark, d), _headed(spark, d)
    bad = I.ungrounded(p, "doc_id", "response", docs, "text").agg(F.count(F.lit(1)).alias("ungrounded"))
    return p.agg(F.count(F.lit(1)).alias("pairs")).join(bad)


@query("with " + _PAIRS + ", o as (select *, row_number() over (order by sha256('20042:' || doc_id), doc_id, pos) as index from pr) select index, doc_id, pos, sha256(instruction) as instruction_sha256, sha256(response) as response_sha256, section from o")
def pair_provenance(spark, d):
    """Pairs in seeded order with digests and section."""
    p = _pairs(spark, d).withColumn("k", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pos").cast("string")))
    from pyspark.sql import Window

    # documents have few pairs: ranks of documents are shared by two phases, then places within
    r = S.hash_rank(p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "doc_id", 20042, "r")
    start = P.prefix_sum(r, "r", "n").select("r", "start")
    x = p.join(r.select("doc_id", "r"), "doc_id").join(start, "r").withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))
    return x.select((F.col("start") + F.col("i")).cast("bigint").alias("index"), "doc_id", "pos", F.sha2("instruction", 256).alias("instruction_sha256"), F.sha2("response", 256).alias("response_sha256"), "section")


@query(
    "with recursive "
    + _PAIRS
    + f""", s1 as (select *, {_KEY('instruction')} as ik, {_KEY('response')} as rk from pr),
s2 as (select *, row_number() over (order by -score, source, instruction, doc_id, pos) as place from (select * from s1 qualify row_number() over (partition by ik, rk order by -score, source, instruction, doc_id, pos) = 1)),
s3 as (select later, list(earlier) as ahead, row_number() over (order by later) as i from (select a.place as earlier, b.place as later from s2 a join s2 b on a.ik = b.ik and a.place < b.place union select a.place, b.place from s2 a join s2 b on a.rk = b.rk and a.place < b.place) group by later),
s4 as (select 0::bigint as i, []::bigint[] as dropped union all select s4.i + 1, case when len(list_filter(ahead, lambda x: not list_contains(dropped, x))) > 0 then list_append(dropped, later) else dropped end from s4 join s3 on s3.i = s4.i + 1),
s5 as (select *, row_number() over (partition by source order by -score, lower(instruction), doc_id)::int as rank from s2 where not list_contains((select arg_max(dropped, i) from s4), place) qualify rank <= 10)
select doc_id, pos, instruction, source, rank from s5 order by rank, sha256('42:' || source), source limit 200"""
)
def pair_selection(spark, d):
    """The whole builder: pairs, both keys unique, capped by source, taken in turns."""
    p = _pairs(spark, d).join(_headed(spark, d).select("doc_id", "source"), "doc_id").withColumn("order", -F.col("score"))
    kept = D.two_key_dedup(p, ["order", "source", "instruction", "doc_id", "pos"], T.alnum_key("instruction"), T.alnum_key("response"))
    return S.round_robin(S.cap_per_group(kept, "source", ["order", F.lower("instruction"), "doc_id"], 10), "source", 200).select("doc_id", "pos", "instruction", "source", "rank")


_SIGNS = " or ".join("(" + " and ".join(f"len(regexp_extract_all(lower(answer), '{p}')) >= {n}" for p, n in group) + ")" for group in I.CONTENTS_SIGNS)
_ASKED = " ".join(f"when starts_with(lower(h), '{p}') then '{t.split('{}')[0]}' || {_STRIP(f'h[{len(p) + 1}:]')} || '{t.split('{}')[1]}'" for p, t in I.LINE_QUESTIONS)


@query(
    rf"""with l as (select doc_id, list_transform(string_split('Configuring the ' || coalesce(source, 'none') || ' network' || chr(10) || text, chr(10)), lambda v: {_STRIP('v')}) as v from documents where text is not null),
h as (select doc_id, v, list_filter(range(1, len(v) + 1), lambda i: regexp_matches(v[i], '{I.LINE_HEADING}')) as hs from l),
s as (select doc_id, unnest(list_transform(range(1, len(hs) + 1), lambda n: struct_pack(n := n, head := v[hs[n]], body := v[hs[n] + 1:coalesce(hs[n + 1], len(v) + 1) - 1]))) as s from h),
o as (select doc_id, s.n as n, s.head as head, s.body[list_position(list_transform(s.body, lambda x: x <> ''), true):] as own from s where list_contains(list_transform(s.body, lambda x: x <> ''), true)),
r as (select doc_id, n, head, own[1:coalesce(nullif(list_position(own, ''), 0) - 1, len(own))] as run from o),
a as (select doc_id, n, head, trim(regexp_replace(list_reduce(run, lambda x, y: case when length(x) < 900 then x || ' ' || y else x end), '[{WS}]+', ' ', 'g'), ' ') as answer from r),
g as (select *, {_STRIP("regexp_replace(head, ':+$', '')")} as h from a where length(head) between 8 and 90 and length(answer) >= 120 and not ({_SIGNS}) and length(answer) - length(replace(answer, ' ', '')) >= 0.10 * length(answer))
select doc_id, (row_number() over (partition by doc_id order by n) - 1)::int as pos,
  case {_ASKED} when starts_with(lower(h), 'verifying') or starts_with(lower(h), 'monitoring') then 'How do I ' || lower(h[1]) || h[2:] || '?' else 'Explain the following Cisco topic: ' || h end as instruction, md5(answer[1:900]) as response_md5 from g"""
)
def line_pairs(spark, d):
    """Questions from lines that begin a section, with what follows them."""
    x = read(spark, d, "documents").where("text is not null").select("doc_id", F.concat(F.lit("Configuring the "), F.coalesce("source", F.lit("none")), F.lit(" network\n"), "text").alias("text"))
    return I.line_pairs(x, "doc_id", "text").select("doc_id", "pos", "instruction", F.md5("response").alias("response_md5"))


@query(f"with t as (select doc_id, {_COMPACT('text')} as t from documents where text is not null), p as (select doc_id, t, position('the ' in t) as a from t), q as (select *, position(' faster' in t[a+4:]) as b from p where a > 0), r as (select doc_id, trim(t[a:a+b+2], ' -') as passage from q where b > 0) select doc_id, md5(passage) as passage_md5 from r where length(passage) between 180 and 2800")
def passages_between(spark, d):
    """What stands from one marker to before another."""
    return I.between_markers(read(spark, d, "documents").where("text is not null"), "doc_id", "text", "the ", " faster").select("doc_id", F.md5("passage").alias("passage_md5"))


@query("select pair_id, md5('### Instruction:' || chr(10) || coalesce(instruction, '') || chr(10) || chr(10) || '### Response:' || chr(10) || coalesce(response, '')) as chat_md5 from (select distinct pair_id, instruction, response from evaluation)")
def chat_format(spark, d):
    x = read(spark, d, "evaluation").select("pair_id", "instruction", "response").distinct()
    return x.select("pair_id", F.md5(I.chat(F.col("instruction"), F.col("response"))).alias("chat_md5"))


_WORDS = lambda x: f"list_transform(regexp_extract_all(coalesce({x}, ''), '[^{WS}]+'), lambda w: ('0x' || md5(w)[1:7])::int)"
_SFT = f"""e as (select pair_id, {_WORDS('instruction')} as p, list_append({_WORDS('response')}, {P.EOS}) as r, row_number() over (order by pair_id, response) - 1 as i from (select distinct pair_id, instruction, response from evaluation)),
m as (select i, pair_id, list_concat(p, r)[1:48] as input_ids, list_concat(list_transform(p, lambda x: -100), r)[1:48] as labels from e)"""


def _examples(spark, d, most=48, refuse=False):
    x = read(spark, d, "evaluation").select("pair_id", "instruction", "response").distinct()
    if refuse:
        x = x.where(F.size(P.word_ids(F.col("instruction"))) < most)
    m = I.masked(P.word_ids(F.col("instruction")), F.concat(P.word_ids(F.col("response")), F.array(F.lit(P.EOS))), most)
    return x.select("pair_id", "response", m.alias("m")).select("pair_id", "response", "m.*")


@query(f"with {_SFT} select pair_id, md5(array_to_string(input_ids, ',')) as ids_md5, md5(array_to_string(labels, ',')) as labels_md5, len(input_ids)::int as n from m")
def sft_masks(spark, d):
    """Labels masked on the prompt, cut at 48 ids."""
    return _examples(spark, d).select("pair_id", F.md5(F.array_join("input_ids", ",")).alias("ids_md5"), F.md5(F.array_join("labels", ",")).alias("labels_md5"), F.size("input_ids").alias("n"))


@query(f"with {_SFT}, b as (select *, floor(i / 8)::bigint as batch from m), w as (select *, max(len(input_ids)) over (partition by batch) as n from b) select i::bigint as i, batch, md5(array_to_string(list_concat(input_ids, list_transform(range(n - len(input_ids)), lambda x: 0)), ',')) as ids_md5, md5(array_to_string(list_concat(labels, list_transform(range(n - len(labels)), lambda x: -100)), ',')) as labels_md5 from w")
def padded_batches(spark, d):
    """Batches of eight padded to their longest."""
    x = _examples(spark, d).withColumn("one", F.lit(1)).withColumn("k", F.struct("pair_id", "response"))
    n = P.prefix_sum(x, "k", "one").select("k", F.col("start").alias("i"))
    y = I.padded(x.join(n, "k"), "i", 8, 0)
    return y.select("i", "batch", F.md5(F.array_join("input_ids", ",")).alias("ids_md5"), F.md5(F.array_join("labels", ",")).alias("labels_md5"))


#: Fixed value: the length of examples in training; a prompt that fills it is refused.
FULL = 1024
_SFT_FULL = f"""q as (select pair_id, {_WORDS('instruction')} as p, list_append({_WORDS('response')}, {P.EOS}) as r, response from (select distinct pair_id, instruction, response from evaluation)),
e as (select *, row_number() over (order by pair_id, response) - 1 as i from q where len(p) < {FULL}),
m as (select i, pair_id, list_concat(p, r)[1:{FULL}] as input_ids, list_concat(list_transform(p, lambda x: -100), r)[1:{FULL}] as labels from e)"""


@query(f"with {_SFT_FULL} select pair_id, md5(array_to_string(input_ids, ',')) as ids_md5, md5(array_to_string(labels, ',')) as labels_md5, len(input_ids)::int as n from m")
def sft_masks_full(spark, d):
    """Labels masked on the prompt, at the full length; prompts without room are in sft_refused."""
    return _examples(spark, d, FULL, True).select("pair_id", F.md5(F.array_join("input_ids", ",")).alias("ids_md5"), F.md5(F.array_join("labels", ",")).alias("labels_md5"), F.size("input_ids").alias("n"))


@query(f"with {_SFT_FULL}, b as (select *, floor(i / 8)::bigint as batch from m), w as (select *, max(len(input_ids)) over (partition by batch) as n from b) select i::bigint as i, batch, md5(array_to_string(list_concat(input_ids, list_transform(range(n - len(input_ids)), lambda x: 0)), ',')) as ids_md5, md5(array_to_string(list_concat(labels, list_transform(range(n - len(labels)), lambda x: -100)), ',')) as labels_md5 from w")
def padded_batches_full(spark, d):
    """Batches of eight padded to their longest, at the full length."""
    x = _examples(spark, d, FULL, True).withColumn("one", F.lit(1)).withColumn("k", F.struct("pair_id", "response"))
    n = P.prefix_sum(x, "k", "one").select("k", F.col("start").alias("i"))
    y = I.padded(x.join(n, "k"), "i", 8, 0)
    return y.select("i", "batch", F.md5(F.array_join("input_ids", ",")).alias("ids_md5"), F.md5(F.array_join("labels", ",")).alias("labels_md5"))


@query(f"with {_SFT_FULL} select pair_id, md5(response) as response_md5, len(p)::int as prompt_ids from q where len(p) >= {FULL}")
def sft_refused(spark, d):
    """Pairs whose prompt leaves no room for a response at the full length."""
    x = read(spark, d, "evaluation").select("pair_id", "instruction", "response").distinct().withColumn("prompt_ids", F.size(P.word_ids(F.col("instruction"))))
    return x.where(F.col("prompt_ids") >= FULL).select("pair_id", F.md5("response").alias("response_md5"), "prompt_ids")


@query(f"select count(*)::bigint as pairs, count(*) filter (regexp_replace(coalesce(instruction, ''), '[{WS}]+', '', 'g') = '')::bigint as blank_instructions, count(*) filter (regexp_replace(coalesce(response, ''), '[{WS}]+', '', 'g') = '')::bigint as blank_responses, (count(*) - count(distinct pair_id))::bigint as repeated_ids from evaluation")
def pair_validation(spark, d):
    """Blank fields and repeated identifiers of the pair file."""
    blank = lambda c: F.count_if(T.strip(F.coalesce(c, F.lit(""))) == "")
    return read(spark, d, "evaluation").agg(F.count(F.lit(1)).alias("pairs"), blank("instruction").alias("blank_instructions"), blank("response").alias("blank_responses"), (F.count(F.lit(1)) - F.countDistinct("pair_id")).alias("repeated_ids"))
