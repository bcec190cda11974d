"""Exact token counts by distinct piece: the budget of each source and language."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.labels import label, language
from loam.llm import bpe
from loam.session import map_arrow, written

#: Most pieces whose lengths are broadcast, and postings that such a piece has at least.
FREQUENT, MANY = 5000, 1000


def piece_postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(piece, keys, times): for each block of rows, in which rows a piece stands and how often.

    A block is what one Arrow batch holds, so a piece that stands in every
    text has one row per block, not one per text.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, _, part in bpe.chunks(texts):
                found, first, _ = bpe.pieces(part)
                number = defaultdict()
                number.default_factory = number.__len__
                codes = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
                rows = np.repeat(np.arange(len(part)), np.diff(first))
                pairs, times = np.unique(codes * len(part) + rows, return_counts=True)
                code, row = np.divmod(pairs, max(len(part), 1))
                offsets = np.searchsorted(code, np.arange(len(number) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(number), pa.string()),
                        pa.ListArray.from_arrays(pa.array(offsets), ids.take(pa.array(row + a))),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(times.astype(np.int32))),
                    ],
                    names=["piece", "keys", "times"],
                )

    return map_arrow(df.select(key, text), run, f"piece string, keys array<{kind}>, times array<int>")


def piece_lengths(pieces: DataFrame, path: str | None = None) -> DataFrame:
    """(piece, blocks, n_ids): each distinct piece merged once; ``blocks`` is in how many rows of ``pieces`` it stands."""
    data = bpe.vocabulary(pieces.sparkSession, path or bpe.tokenizer_path())

    def run(batches):
        enc = bpe.encoder(data.value)
        for batch in batches:
            n = np.fromiter((len(enc[p]) for p in batch.column(0).to_pylist()), np.int32, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n)], names=["piece", "blocks", "n_ids"])

    return map_arrow(pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("blocks")), run, "piece string, blocks bigint, n_ids int")


def _counted(df: DataFrame, key: str, text: str, path: str | None) -> DataFrame:
    """(key, n_tokens) of the texts that have pieces.

    Lengths of pieces that stand in more than MANY postings and the FREQUENTth part of all are broadcast (so at most FREQUENT of them), and their
    postings, which list nearly every text, are spread over the join's partitions; all others are joined by piece.
    """
    postings = written(piece_postings(df, key, text))
    lengths = written(piece_lengths(postings, path))
    total = lengths.agg(F.sum("blocks")).first()[0] or 0
    many = F.col("blocks") > max(MANY, total // FREQUENT)
    frequent = lengths.where(many).select("piece", F.col("n_ids").alias("n1"))
    rest = lengths.where(~many).select(F.col("piece").alias("at"), F.col("n_ids").alias("n2"))
    spread = F.concat(F.col("piece"), F.lit("\0"), F.xxhash64(F.col("keys")[0]).cast("string"))
    return (
        postings.join(F.broadcast(frequent), "piece", "left")
        .withColumn("at", F.when(F.col("n1").isNull(), F.col("piece")).otherwise(spread))
        .join(rest, "at", "left")
        .select(F.coalesce("n2", "n1").alias("n_ids"), F.explode(F.arrays_zip("keys", "times")).alias("p"))
        .groupBy(F.col("p.keys").alias(key))
        .agg(F.sum(F.col("n_ids") * F.col("p.times")).alias("n_tokens"))
    )


def document_tokens(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, n_tokens): the sum over a text's pieces of times x ids.

    ``key`` is unique and not null. Rows whose text is null or empty have 0.
    """
    return df.select(key).join(_counted(df, key, text, path), key, "left").select(key, F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))


def token_budget(df: DataFrame, key: str, text: str, source: str, lang: str, domain: str, path: str | None = None) -> DataFrame:
    """Totals by source, language and domain, by each of them alone, and over all.

    (slice, source_corpus, lang, domain, records, empty_records, chars, n_tokens).  Labels
    are brought to one form first; null and blank labels count as 'unknown'.  In a
    total over all values of a label that label is '*'. An empty table gives no rows.
    """
    rows = df.select(
        key,
        label(source).alias("source_corpus"),
        language(lang).alias("lang"),
        label(domain).alias("domain"),
        F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("chars"),
    ).join(_counted(df, key, text, path), key, "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)).cast("bigint"))
    finest = rows.groupBy("source_corpus", "lang", "domain").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("n_tokens") == 0).alias("empty_records"),
        F.sum("chars").alias("chars"),
        F.sum("n_tokens").alias("n_tokens"),
    )
    sets = {"source+lang+domain": (1, 1, 1), "source": (1, 0, 0), "lang": (0, 1, 0), "domain": (0, 0, 1), "all": (0, 0, 0)}
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(bool(b)).alias(n) for n, b in zip("sld", v)]) for k, v in sets.items()])
    star = F.lit("*")
    return (
        finest.withColumn("g", F.explode(kinds))
        .groupBy(
            F.col("g.k").alias("slice"),
            F.when(F.col("g.s"), F.col("source_corpus")).otherwise(star).alias("source_corpus"),
            F.when(F.col("g.l"), F.col("lang")).otherwise(star).alias("lang"),
            F.when(F.col("g.d"), F.col("domain")).otherwise(star).alias("domain"),
        )
        .agg(*[F.sum(c).alias(c) for c in ("records", "empty_records", "chars", "n_tokens")])
    )
