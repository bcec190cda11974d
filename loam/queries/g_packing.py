"""Packing into sequences and tokenizer diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.operators import packing as P
from loam.queries import query
from loam.queries.a_text import WS
from loam.session import read

_IDS = f"""t as (select doc_id, coalesce(source, 'none') as source, list_transform(regexp_extract_all(coalesce(text, ''), '[^{WS}]+'), lambda w: ('0x' || md5(w)[1:7])::int) as ids from documents),
sp as (select doc_id, source, len(ids)::bigint as content_tokens, (len(ids) + 1)::bigint as wrapped_tokens, list_append(ids, {P.EOS}) as w, coalesce(sum(len(ids) + 1) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as stream_start from t),
st as (select *, stream_start + wrapped_tokens as stream_end, (floor(sum(wrapped_tokens) over () / 128) * 128)::bigint as packed from sp)
"""
_SEQ = (
    _IDS
    + """, x as (select unnest(w) as id, stream_start + generate_subscripts(w, 1) - 1 as pos from sp),
q as (select (pos // 128)::bigint as sequence_id, array_agg(id order by pos) as input_ids from x group by 1 having count(*) = 128)"""
)


def _docs(spark, d):
    return read(spark, d, "documents")


@query(f"with {_SEQ} select sequence_id, md5(array_to_string(input_ids, ',')) as ids_md5, len(input_ids)::bigint as n from q")
def pack_sequences(spark, d):
    """Documents with an end token each, cut into sequences of 128."""
    x = P.pack(_docs(spark, d), "doc_id", P.word_ids(F.col("text")), 128)
    return x.select("sequence_id", F.md5(F.array_join("input_ids", ",")).alias("ids_md5"), F.size("input_ids").cast("bigint").alias("n"))


@query(f"with {_SEQ.replace('len(ids) + 1', 'len(ids) + 2').replace(f'list_append(ids, {P.EOS})', f'list_append(list_prepend({P.BOS}, ids), {P.EOS})')} select sequence_id, md5(array_to_string(input_ids, ',')) as ids_md5, 128::bigint as mask_sum, input_ids[1] as first_label from q")
def pack_sequences_wide(spark, d):
    """With begin and end tokens, attention masks and labels."""
    x = P.with_masks(P.pack(_docs(spark, d), "doc_id", P.word_ids(F.col("text")), 128, bos=True))
    return x.select("sequence_id", F.md5(F.array_join("input_ids", ",")).alias("ids_md5"), F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("mask_sum"), F.col("labels")[0].alias("first_label"))


@query(f"with {_IDS} select doc_id, content_tokens, wrapped_tokens, stream_start, stream_end, least(stream_end, packed) - least(stream_start, packed) as packed_tokens, packed < stream_end as truncated from st")
def pack_spans(spark, d):
    """Where each document lies in the stream and how much of it is packed."""
    return P.spans(_docs(spark, d), "doc_id", P.word_ids(F.col("text")), 128)


@query(f"with {_IDS} select count(*)::bigint as documents, sum(content_tokens)::bigint as raw_tokens, sum(wrapped_tokens)::bigint as stream_tokens, round(sum(content_tokens) / count(*), 9) as average_tokens, floor(sum(wrapped_tokens) / 128)::bigint as sequences, (floor(sum(wrapped_tokens) / 128) * 128)::bigint as packed_tokens, (sum(wrapped_tokens) % 128)::bigint as residual_tokens from st")
def pack_metrics(spark, d):
    return P.pack_metrics(P.spans(_docs(spark, d), "doc_id", P.word_ids(F.col("text")), 128), 128).withColumn("average_tokens", F.round("average_tokens", 9))


@query(f"with {_IDS} select source, count(*)::bigint as documents, sum(content_tokens)::bigint as content_tokens, round(avg(content_tokens), 9) as mean_tokens from st group by rollup (source)")
def pack_source_totals(spark, d):
    """Tokens by source, with the total."""
    x = _docs(spark, d).select(F.coalesce("source", F.lit("none")).alias("source"), F.size(P.word_ids(F.col("text"))).cast("bigint").alias("n"))
    return x.rollup("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("content_tokens"), F.round(F.avg("n"), 9).alias("mean_tokens"))


@query(f"with {_SEQ} select count(*)::bigint as sequences, count(*) filter (len(input_ids) <> 128)::bigint as wrong_length, max(list_max(input_ids))::bigint as largest_id, count(*) filter (list_max(input_ids) >= {P.WORD_IDS + 1})::bigint as beyond_vocabulary, case when max(list_max(input_ids)) <= 65535 then 'uint16' when max(list_max(input_ids)) <= 4294967295 then 'uint32' else 'uint64' end as dtype from q")
def pack_validation(spark, d):
    """Lengths, largest id, its type."""
    return P.validate(P.pack(_docs(spark, d), "doc_id", P.word_ids(F.col("text")), 128), 128, P.WORD_IDS + 1)


@query("select doc_id, md5(array_to_string(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::int), ',')) as ids_md5, octet_length(encode(coalesce(text, '')))::bigint as n from documents")
def byte_token_ids(spark, d):
    """UTF-8 bytes as ids."""
    x = _docs(spark, d).select("doc_id", P.byte_ids(F.col("text")).alias("ids"))
    return x.select("doc_id", F.md5(F.array_join("ids", ",")).alias("ids_md5"), F.size("ids").cast("bigint").alias("n"))


@query("""select sha256(string_agg('[' || n_nationkey || ',["' || n_name || '"]]' || chr(10), '' order by n_nationkey, n_name)) as sha256 from nation""")
def vocabulary_fingerprint(spark, d):
    """A vocabulary's digest over its ids and tokens in order."""
    return P.vocabulary_fingerprint(read(spark, d, "nation"), "n_nationkey", "n_name")


_PIECES = rf"""w as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^{WS}]+')) as word from documents),
c as (select doc_id, word, count(*) as n from w group by all),
p as (select *, len(regexp_extract_all(word, '{P.PIECE}')) as pieces, len(regexp_extract_all(word, '[^\x00-\x7F]')) as unknown from c),
"""
_FRAG = """select {by} sum(n)::bigint as words, sum(n * pieces)::bigint as word_pieces, sum(case when pieces >= 3 then n else 0 end)::bigint as fragmented_words, max(pieces)::bigint as most_pieces, sum(n * unknown)::bigint as unknown_pieces,
sum(n * pieces) / sum(n) as pieces_per_word, sum(case when pieces >= 3 then n else 0 end) / sum(n) * 100 as pseudo_oov_percent, sum(n * unknown) / sum(n * pieces) * 100 as oov_percent from p {group}"""
_ROUNDED = "round(pieces_per_word, 9) as pieces_per_word, round(pseudo_oov_percent, 9) as pseudo_oov_percent, round(oov_percent, 9) as oov_percent"
_BARE = "words, word_pieces, fragmented_words, most_pieces, unknown_pieces"


def _round(x):
    for c in ("pieces_per_word", "pseudo_oov_percent", "oov_percent"):
        x = x.withColumn(c, F.round(c, 9))
    return x


@query(f"with {_PIECES} f as ({_FRAG.format(by='doc_id,', group='group by doc_id')}) select doc_id, {_BARE}, {_ROUNDED} from f")
def oov_by_document(spark, d):
    """Fragmentation of each document's words."""
    return _round(P.fragmentation(P.word_pieces(_docs(spark, d), "doc_id", "text"), "doc_id"))


@query(
    f"""with {_PIECES} f as ({_FRAG.format(by='', group='')}), v as (select *, case when oov_percent <= 0.1 then 'GOOD' when oov_percent <= 1.0 then 'REVIEW' else 'POOR' end as oov_verdict,
case when pieces_per_word <= 1.5 then 'GOOD' when pieces_per_word <= 2.0 then 'ACCEPTABLE' when pieces_per_word <= 2.5 then 'REVIEW' else 'POOR' end as fragmentation_verdict,
case when pieces_per_word > 1.5 or pseudo_oov_percent > 15 then 'POOR' else 'GOOD' end as pseudo_oov_verdict from f)
select {_BARE}, {_ROUNDED}, oov_verdict, fragmentation_verdict, pseudo_oov_verdict, case when pseudo_oov_verdict = 'POOR' then 'POOR' else oov_verdict end as overall_verdict from v"""
)
def oov_verdicts(spark, d):
    """The corpus in one row, with verdicts."""
    return _round(P.verdicts(P.fragmentation(P.word_pieces(_docs(spark, d), "doc_id", "text"))))


@query(f"with {_PIECES} g as (select word, max(pieces)::bigint as pieces, sum(n)::bigint as n from p group by word) select word, pieces, n from g order by pieces desc, n desc, word desc limit 50")
def top_fragmented_words(spark, d):
    """The fifty words of most pieces (a top-k report)."""
    x = P.word_pieces(_docs(spark, d), "doc_id", "text").groupBy("word").agg(F.max("pieces").alias("pieces"), F.sum("n").alias("n"))
    return x.orderBy(F.desc("pieces"), F.desc("n"), F.desc("word")).limit(50)


@query(f"with {_PIECES} f as ({_FRAG.format(by='doc_id,', group='group by doc_id')}) select doc_id, round(pseudo_oov_percent, 9) as pseudo_oov_percent, round(pieces_per_word, 9) as pieces_per_word from f order by round(pseudo_oov_percent, 9) desc, round(pieces_per_word, 9) desc, doc_id limit 10")
def top_fragmented_documents(spark, d):
    """The ten documents of most fragmented words (a top-k report)."""
    x = _round(P.fragmentation(P.word_pieces(_docs(spark, d), "doc_id", "text"), "doc_id")).select("doc_id", "pseudo_oov_percent", "pieces_per_word")
    return x.orderBy(F.desc("pseudo_oov_percent"), F.desc("pieces_per_word"), "doc_id").limit(10)


@query(f"with {_PIECES} u as (select unnest(regexp_extract_all(word, '[^\\x00-\\x7F]')) as piece, n from p) select piece, sum(n)::bigint as n from u group by piece order by n desc, piece limit 20")
def top_unknown_pieces(spark, d):
    """The twenty most frequent unknown pieces (a top-k report)."""
    x = P.word_pieces(_docs(spark, d), "doc_id", "text").where("unknown > 0")
    x = x.select("n", F.explode(F.regexp_extract_all("word", F.lit(r"[^\x00-\x7F]"), 0)).alias("piece"))
    return x.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(20)
