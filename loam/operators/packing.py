"""Token streams cut into sequences of fixed length, and tokenizer diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.functions import tokenizers
from loam.session import written

#: Ids of the word tokenizer lie below this; boundaries follow.
WORD_IDS = 1 << 28
EOS, BOS = WORD_IDS, WORD_IDS + 1
#: Pieces of the subword tokenizer of the diagnostics; a piece outside of ASCII is unknown.
PIECE = r"[A-Za-z]{1,5}|[0-9]{1,3}|[^A-Za-z0-9]"


def word_ids(text: Column) -> Column:
    """array<int>: an id for each word between white space (28 bits of MD5); null and empty texts have none."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^{T.WS}]+"), 0)
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int"))


def byte_ids(text: Column) -> Column:
    """array<int>: the UTF-8 bytes."""
    return F.transform(F.regexp_extract_all(F.hex(F.coalesce(text, F.lit(""))), F.lit(".."), 0), lambda b: F.conv(b, 16, 10).cast("int"))


def prefix_sum(df: DataFrame, key: str, n: str) -> DataFrame:
    """(key, n, start): the sum of ``n`` over all smaller keys, without a global sort in one task.

    Rows are range-partitioned by key and written with their partition's number; sums within
    partitions are shifted by the totals of earlier partitions (one row a partition).
    """
    parts = written(df.select(key, F.col(n).cast("bigint").alias(n)).repartitionByRange(key).withColumn("_p", F.spark_partition_id()))
    totals = parts.groupBy("_p").agg(F.sum(n).alias("_t"))
    shift = totals.withColumn("_s", F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_s")
    within = Window.partitionBy("_p").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_w", F.coalesce(F.sum(n).over(within), F.lit(0))).join(F.broadcast(shift), "_p").select(key, n, (F.col("_w") + F.col("_s")).alias("start"))


def bounded_ids(ids: Column, bos: bool = False, end: int = EOS, begin: int = BOS) -> Column:
    """Ids with their document's boundary tokens."""
    tail = F.concat(ids, F.array(F.lit(end)))
    return F.concat(F.array(F.lit(begin)), tail) if bos else tail


def spans(docs: DataFrame, key: str, ids: Column, length: int, bos: bool = False) -> DataFrame:
    """(key, content_tokens, wrapped_tokens, stream_start, stream_end, packed_tokens, truncated): each document in the stream."""
    extra = 2 if bos else 1
    counted = docs.select(key, F.size(ids).cast("bigint").alias("content_tokens")).withColumn("wrapped_tokens", F.col("content_tokens") + extra)
    placed = prefix_sum(counted, key, "wrapped_tokens").withColumnRenamed("start", "stream_start").withColumn("stream_end", F.col("stream_start") + F.col("wrapped_tokens"))
    total = placed.agg(F.coalesce(F.floor(F.max("stream_end") / length) * length, F.lit(0)).alias("_packed"))
    kept = F.least("stream_end", "_packed") - F.least("stream_start", "_packed")
    return placed.join(F.broadcast(total)).select(
        key, (F.col("wrapped_tokens") - extra).alias("content_tokens"), "wrapped_tokens", "stream_start", "stream_end", kept.alias("packed_tokens"), (F.col("_packed") < F.col("stream_end")).alias("truncated")
    )


def pack(docs: DataFrame, key: str, ids: Column, length: int, bos: bool = False, end: int = EOS, begin: int = BOS) -> DataFrame:
    """(sequence_id, input_ids): the stream of all documents in key order, cut into full sequences; a rest is dropped.

    ``ids`` is any column of ids (:func:`loam.functions.tokenizers.token_ids` gives those of a public tokenizer), ``end`` and
    ``begin`` are the boundary ids of its vocabulary.

    A document is exploded once per sequence that it touches, never per token.
    """
    wrapped = written(docs.select(key, bounded_ids(ids, bos, end, begin).alias("_ids")))
    at = prefix_sum(wrapped.select(key, F.size("_ids").alias("_n")), key, "_n")
    x = wrapped.join(at, key).withColumn("s", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("_n") - 1) / length))))
    first = F.greatest(F.col("s") * length, F.col("start"))
    last = F.least((F.col("s") + 1) * length, F.col("start") + F.col("_n"))
    part = F.slice("_ids", (first - F.col("start") + 1).cast("int"), (last - first).cast("int"))
    g = x.select(F.col("s").alias("sequence_id"), first.alias("f"), part.alias("p")).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("f", "p"))).alias("ps"))
    return g.select("sequence_id", F.flatten(F.transform("ps", lambda v: v["p"])).alias("input_ids")).where(F.size("input_ids") == length)


def with_masks(packed: DataFrame) -> DataFrame:
    """The wide layout: attention mask of ones, labels equal to the ids."""
    return packed.select("sequence_id", "input_ids", F.transform("input_ids", lambda v: F.lit(1)).alias("attention_mask"), F.col("input_ids").alias("labels"))


def pack_metrics(span: DataFrame, length: int) -> DataFrame:
    """One row: documents, raw and stream tokens, average, sequences, packed and residual tokens."""
    n, stream = F.count(F.lit(1)), F.coalesce(F.sum("wrapped_tokens"), F.lit(0))
    return span.agg(n.alias("documents"), F.coalesce(F.sum("content_tokens"), F.lit(0)).alias("raw_tokens"), stream.alias("stream_tokens")).select(
        "*", (F.col("raw_tokens") / F.col("documents")).alias("average_tokens"), F.floor(F.col("stream_tokens") / length).alias("sequences"),
        (F.floor(F.col("stream_tokens") / length) * length).alias("packed_tokens"), (F.col("stream_tokens") % length).alias("residual_tokens"),
    )


def narrowest_dtype(most: Column) -> Column:
    """The narrowest unsigned type for ids up to ``most``."""
    return F.when(most <= 65535, "uint16").when(most <= 4294967295, "uint32").otherwise("uint64")


def validate(packed: DataFrame, length: int, vocabulary: int) -> DataFrame:
    """One row: sequences, those of another length, the largest id, its type, ids beyond the vocabulary."""
    m = F.array_max("input_ids")
    return packed.agg(
        F.count(F.lit(1)).alias("sequences"), F.count_if(F.size("input_ids") != length).alias("wrong_length"), F.max(m).cast("bigint").alias("largest_id"),
        F.count_if(m >= vocabulary).alias("beyond_vocabulary"),
    ).withColumn("dtype", narrowest_dtype(F.col("largest_id")))


def compatibility(packed: DataFrame, metrics: DataFrame, length: int, vocabulary: int) -> DataFrame:
    """(claim, holds): whether packed sequences fit a model of this context length and vocabulary, and the metrics (:func:`pack_metrics`) written with them."""
    m = packed.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("input_ids").cast("bigint")), F.lit(0)).alias("ids"), F.max(F.array_max("input_ids")).alias("most"), F.min(F.array_min("input_ids")).alias("least"),
        F.count_if(F.size("input_ids") % length != 0).alias("uneven"),
    ).join(metrics.select("sequences", "packed_tokens"))  # one row each
    claims = {
        "length divides": F.col("uneven") == 0, "ids in vocabulary": F.coalesce((F.col("most") < vocabulary) & (F.col("least") >= 0), F.lit(True)),
        "packed tokens agree": F.col("ids") == F.col("packed_tokens"), "sequences agree": F.col("ids") == F.col("sequences") * length,
    }
    return m.select(F.explode(F.array(*[F.struct(F.lit(k).alias("claim"), v.alias("holds")) for k, v in claims.items()])).alias("c")).select("c.*")


def vocabulary_fingerprint(vocabulary: DataFrame, ident: str, token: str) -> DataFrame:
    """(sha256): over lines [id,"token"] in the order of id and token; a vocabulary is a bounded table."""
    line = F.concat(F.lit("["), F.col(ident).cast("string"), F.lit(","), F.to_json(F.array(token)), F.lit("]\n"))
    lines = vocabulary.agg(F.array_sort(F.collect_list(F.struct(ident, token, line.alias("l")))).alias("v"))
    return lines.select(F.sha2(F.array_join(F.transform("v", lambda x: x["l"]), ""), 256).alias("sha256"))


def word_pieces(docs: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, word, n, pieces, unknown): each distinct word of a document once, with its pieces.

    With the ``path`` of a vocabulary file pieces are that tokenizer's, each distinct word of the corpus being
    encoded once; else they are runs of PIECE.
    """
    words = docs.select(key, F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"[^{T.WS}]+"), 0)).alias("word"))
    counted = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    if path is not None:
        counted = written(counted)
        return counted.join(tokenizers.word_counts(counted.select("word").distinct(), "word", path), "word").select(key, "word", "n", "pieces", "unknown")
    return counted.withColumn("pieces", F.regexp_count("word", F.lit(PIECE)).cast("bigint")).withColumn("unknown", F.regexp_count("word", F.lit(r"[^\x00-\x7F]")).cast("bigint"))


def fragmentation(pieces: DataFrame, *by: str) -> DataFrame:
    """Words, pieces per word, share of words in three pieces or more, unknown pieces, by the given columns or over all."""
    n = F.sum("n")
    return pieces.groupBy(*by).agg(
        n.alias("words"), F.sum(F.col("n") * F.col("pieces")).alias("word_pieces"), F.sum(F.when(F.col("pieces") >= 3, F.col("n")).otherwise(0)).alias("fragmented_words"),
        F.max("pieces").alias("most_pieces"), F.sum(F.col("n") * F.col("unknown")).alias("unknown_pieces"),
    ).select(
        "*", (F.col("word_pieces") / F.col("words")).alias("pieces_per_word"), (F.col("fragmented_words") / F.col("words") * 100).alias("pseudo_oov_percent"),
        (F.col("unknown_pieces") / F.col("word_pieces") * 100).alias("oov_percent"),
    )


def verdicts(stats: DataFrame) -> DataFrame:
    """``stats`` of :func:`fragmentation` with the verdict on unknown pieces, fragmentation, pseudo unknown words, and the worse of first and third."""
    o, f, p = F.col("oov_percent"), F.col("pieces_per_word"), F.col("pseudo_oov_percent")
    x = stats.withColumn("oov_verdict", F.when(o <= 0.1, "GOOD").when(o <= 1.0, "REVIEW").otherwise("POOR"))
    x = x.withColumn("fragmentation_verdict", F.when(f <= 1.5, "GOOD").when(f <= 2.0, "ACCEPTABLE").when(f <= 2.5, "REVIEW").otherwise("POOR"))
    x = x.withColumn("pseudo_oov_verdict", F.when((f > 1.5) | (p > 15.0), "POOR").otherwise("GOOD"))
    worst = F.when(F.col("pseudo_oov_verdict") == "POOR", "POOR").otherwise(F.col("oov_verdict"))
    return x.withColumn("overall_verdict", worst)
