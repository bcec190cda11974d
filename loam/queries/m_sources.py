"""Sources and sinks by writing and reading back: what comes out must be what went in."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from loam.functions import tokenizers
from loam.operators import packing as P
from loam.queries import query
from loam.queries.a_text import WS
from loam.queries.g_packing import _SEQ
from loam.session import read, scratch
from loam.sources import files, sinks

_STRIP = lambda x: f"regexp_replace(regexp_replace({x}, '^[{WS}]+', ''), '[{WS}]+\\z', '')"
#: A public tokenizer's vocabulary; the folder can be set for other machines.
VOCABULARY = os.path.join(os.environ.get("LOAM_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_multi_50k.tiktoken")


@query("select 'example-' || example_id as document, md5(text || chr(10)) as text_md5, octet_length(encode(text)) + 1 as bytes from subject_examples")
def text_files(spark, d):
    """Texts written one folder a document, scanned again without hidden files (a fixed table)."""
    x = read(spark, d, "subject_examples").select(F.concat(F.lit("example-"), F.col("example_id")).alias("name"), "text")
    at = scratch(spark, "texts")
    sinks.write_texts(x, at, "name", "text")
    found, _ = files.as_text(files.scan(spark, at, "*.txt"))
    return found.select(F.regexp_extract("path", "document=([^/]+)/", 1).alias("document"), F.md5("text").alias("text_md5"), F.octet_length("text").cast("bigint").alias("bytes"))


@query("select example_id % 3 = 0 as fresh, count(*)::bigint as n, count(distinct md5(text))::bigint as contents from subject_examples group by 1")
def changed_files(spark, d):
    """Files with a new digest are read again, the others' rows hold (a third has changed)."""
    x = read(spark, d, "subject_examples").select(F.col("example_id").cast("string").alias("path"), F.md5("text").alias("content_md5"), (F.col("example_id") % 3 == 0).alias("odd"))
    manifest = x.select("path", F.when(F.col("odd"), F.lit("old")).otherwise(F.col("content_md5")).alias("content_md5"))
    fresh, held = files.changed(x.drop("odd"), manifest)
    n = lambda y, flag: y.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("content_md5").alias("contents")).select(F.lit(flag).alias("fresh"), "n", "contents")
    return n(fresh, True).unionByName(n(held, False)).where("n > 0")


@query("select id, category, md5(prompt) as prompt_md5, array_to_string(expected_concepts, '|') as concepts from generic_forgetting_queries where trim(coalesce(prompt, '')) <> ''")
def query_set_files(spark, d):
    """A query set as one JSON file with a list, read again (a fixed table)."""
    x = read(spark, d, "generic_forgetting_queries")
    at = scratch(spark, "queries")
    x.select(F.lit("generic").alias("name"), F.struct(*x.columns).alias("q")).groupBy("name").agg(F.collect_list("q").alias("queries")).coalesce(1).write.json(at)
    got = files.read_query_sets(spark, at)
    return got.select("id", "category", F.md5("prompt").alias("prompt_md5"), F.array_join("expected_concepts", "|").alias("concepts"))


@query("select id, 'pre_cpt' as evaluation_stage, 'generic.json' as query_file, md5(prompt) as prompt_md5, md5('answer to ' || id) as response_md5 from generic_forgetting_queries")
def response_files(spark, d):
    """Responses of one run as a JSON file with a list of results, read again with the run's facts (a fixed table)."""
    x = read(spark, d, "generic_forgetting_queries").withColumn("response", F.concat(F.lit("answer to "), "id"))
    at = scratch(spark, "responses")
    run = [F.lit("pre_cpt").alias("evaluation_stage"), F.lit("m").alias("model_name"), F.lit("sets/generic.json").alias("query_source")]
    x.groupBy(*run).agg(F.collect_list(F.struct("id", "category", "prompt", "response", "expected_concepts")).alias("results")).coalesce(1).write.json(at)
    return files.read_responses(spark, at).select("id", "evaluation_stage", "query_file", F.md5("prompt").alias("prompt_md5"), F.md5("response").alias("response_md5"))


_PAIRS = "select distinct pair_id, md5(coalesce(instruction, 'null')) as instruction_md5, md5(coalesce({r}, 'null')) as response_md5 from evaluation"


def _digests(x):
    return x.select("pair_id", F.md5(F.coalesce("instruction", F.lit("null"))).alias("instruction_md5"), F.md5(F.coalesce("response", F.lit("null"))).alias("response_md5"))


@query(_PAIRS.format(r="response"))
def jsonl_round_trip(spark, d):
    """Pairs as JSON lines, read again by a fixed schema."""
    at = scratch(spark, "jsonl")
    sinks.write_jsonl(read(spark, d, "evaluation").select("pair_id", "instruction", "response").distinct(), at)
    return _digests(files.read_jsonl(spark, at, "pair_id string, instruction string, response string", unique="pair_id"))


@query("select distinct pair_id, md5(coalesce(replace(instruction, chr(10), '\\n'), '')) as instruction_md5, md5(coalesce(replace(response, chr(10), '\\n'), '')) as response_md5 from evaluation")
def csv_round_trip(spark, d):
    """Pairs as CSV, line ends written as backslash n; null and empty fields are one there."""
    at = scratch(spark, "csv")
    sinks.write_csv(read(spark, d, "evaluation").select("pair_id", "instruction", "response").distinct(), at)
    x = files.read_csv(spark, at, "pair_id string, instruction string, response string")
    return x.select("pair_id", *[F.md5(F.coalesce(c, F.lit(""))).alias(f"{c}_md5") for c in ("instruction", "response")])


@query(f"with {_SEQ} select sequence_id, md5(array_to_string(input_ids, ',')) as ids_md5 from q")
def packed_round_trip(spark, d):
    """Sequences as Parquet, only two columns read again."""
    at = scratch(spark, "packed")
    x = P.with_masks(P.pack(read(spark, d, "documents"), "doc_id", P.word_ids(F.col("text")), 128))
    sinks.write_packed(x, at, 128)
    return files.read_packed(spark, at, "sequence_id", "input_ids").select("sequence_id", F.md5(F.array_join("input_ids", ",")).alias("ids_md5"))


@query(
    """with t as (select doc_id, list_append(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::int), 256) as w from documents),
sp as (select *, coalesce(sum(len(w)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as stream_start from t),
x as (select unnest(w) as id, stream_start + generate_subscripts(w, 1) - 1 as pos from sp),
q as (select (pos // 256)::bigint as s, array_agg(id order by pos) as ids from x group by 1 having count(*) = 256) select md5(array_to_string(ids, ',')) as ids_md5, count(*)::bigint as n from q group by all"""
)
def flat_round_trip(spark, d):
    """Byte ids with an end id in flat files of 16 bits, read again as samples."""
    at = scratch(spark, "flat").removeprefix("file://")
    sinks.write_flat(P.pack(read(spark, d, "documents"), "doc_id", P.byte_ids(F.col("text")), 256, end=256), at)
    x = files.read_flat(spark, f"file://{at}", 256)
    return x.groupBy(F.md5(F.array_join("input_ids", ",")).alias("ids_md5")).agg(F.count(F.lit(1)).alias("n"))


def _paged(spark, d):
    x = read(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return files.extract_pages(x, lambda content: [(p, None) for p in content.decode().split("\f")])


_PAGED = f"""p as (select doc_id::varchar as path, string_split(text, chr(12)) as ps from documents where text is not null),
f as (select path, ps, list_filter(list_transform(ps, lambda x: {_STRIP('x')}), lambda x: x <> '') as f from p)"""


@query(
    f"""with {_PAGED} select path, md5(array_to_string(f, chr(10) || chr(10))) as text_md5, len(ps)::int as pages, (len(ps) - len(f))::int as empty_pages, 0::int as failed_pages,
  array_to_string(list_transform(range(1, len(f) + 1), lambda i: case when i = 1 then 0 else length(array_to_string(f[1:i - 1], chr(10) || chr(10))) + 2 end), ',') as starts from f"""
)
def paged_texts(spark, d):
    """Pages cut at form feeds by an extractor, filled ones joined, with where each begins."""
    x = files.joined_pages(_paged(spark, d))
    return x.select("path", F.md5("text").alias("text_md5"), "pages", "empty_pages", "failed_pages", F.array_join(F.col("starts").cast("array<string>"), ",").alias("starts"))


_FIND = "(?i)interface|router"


@query(
    f"""with p as (select doc_id::varchar as path, string_split(text, chr(12)) as ps from documents where text is not null),
h as (select path, ps, list_filter(range(1, len(ps) + 1), lambda i: regexp_matches(ps[i], '{_FIND}')) as hs from p),
t as (select path, hs[1] as page, ps[hs[1]] as t from h where len(hs) > 0), a as (select *, strpos(t, regexp_extract(t, '{_FIND}')) as i from t)
select path, page::int as page, md5(trim(regexp_replace(t[greatest(1, i - 220):i + 520 - 1], '[{WS}]+', ' ', 'g'), ' ')) as excerpt_md5 from a"""
)
def evidence_pages(spark, d):
    """The first page of each document that matches, with the text around it."""
    return files.find_evidence(_paged(spark, d), _FIND).select("path", "page", F.md5("excerpt").alias("excerpt_md5"))


@query("select doc_id, md5(coalesce(text, '')) as text_md5 from documents")
def token_round_trip(spark, d):
    """Ids of a public tokenizer, decoded again: every text as it was."""
    x = tokenizers.token_ids(read(spark, d, "documents"), "doc_id", "text", VOCABULARY)
    return tokenizers.decoded(x, "doc_id", "ids", VOCABULARY).select("doc_id", F.md5("text").alias("text_md5"))


@query()
def pack_tokenizer_validation(spark, d):
    """Sequences of 1,024 ids of a public tokenizer with its end id: lengths, largest id, type (no SQL: byte pair merging)."""
    end = tokenizers.load(VOCABULARY).end
    x = tokenizers.token_ids(read(spark, d, "documents"), "doc_id", "text", VOCABULARY)
    return P.validate(P.pack(x, "doc_id", F.col("ids"), 1024, end=end), 1024, end + 1)


@query()
def oov_tokenizer_verdicts(spark, d):
    """Fragmentation of the corpus' words by a public tokenizer, in one row with verdicts (no SQL: byte pair merging)."""
    x = P.verdicts(P.fragmentation(P.word_pieces(read(spark, d, "documents"), "doc_id", "text", VOCABULARY)))
    for c in ("pieces_per_word", "pseudo_oov_percent", "oov_percent"):
        x = x.withColumn(c, F.round(c, 9))
    return x


@query(f"with {_SEQ}, s as (select count(*) as n, sum(len(input_ids)) as ids, max(list_max(input_ids)) as m from q), z as (select sum(wrapped_tokens) as stream from sp) select unnest(['length divides', 'ids in vocabulary', 'packed tokens agree', 'sequences agree']) as claim, unnest([ids % 128 = 0, m < {P.EOS + 2}, ids = floor(stream / 128) * 128, n = floor(stream / 128)]) as holds from s, z")
def pack_compatibility(spark, d):
    """Whether packed sequences fit a model: length, vocabulary, and the metrics written with them."""
    docs = read(spark, d, "documents")
    packed = P.pack(docs, "doc_id", P.word_ids(F.col("text")), 128)
    return P.compatibility(packed, P.pack_metrics(P.spans(docs, "doc_id", P.word_ids(F.col("text")), 128), 128), 128, P.EOS + 2)


@query(
    """with n as (select n_nationkey::varchar as k, n_name as name, n_regionkey::varchar as r from nation), w as (select greatest(11, max(length(k))) as a, greatest(6, max(length(name))) as b, greatest(11, max(length(r))) as c from n)
select rtrim(lpad(k, a::int, ' ') || '  ' || rpad(name, b::int, ' ') || '  ' || lpad(r, c::int, ' ')) as value from n, w union all
select rtrim(lpad('n_nationkey', a::int, ' ') || '  ' || rpad('n_name', b::int, ' ') || '  ' || lpad('n_regionkey', c::int, ' ')) from w union all select repeat('-', a::int) || '  ' || repeat('-', b::int) || '  ' || repeat('-', c::int) from w"""
)
def aligned_table(spark, d):
    """A table for a console, columns aligned."""
    return sinks.aligned_rows(read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))
