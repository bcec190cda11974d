"""From documents to packed sequences, in the two layouts of the pipeline."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import blocks, dedup, gates, packing, splits
from loam.plans.reuse import identity
from loam.session import written


@dataclass(frozen=True)
class PrepareConfig:
    """Parameters of a run; ``strategy`` is exact, near or both."""

    gates: gates.GateConfig = field(default_factory=gates.GateConfig)
    strategy: str = "exact"
    similarity: float = 0.85
    clean_blocks: bool = True
    min_content: int = 200
    min_alpha: float = 0.25
    held_out_percent: int = 10
    seed: int = 42
    length: int = 1024
    bos: bool = False

    def __post_init__(self):
        if self.strategy not in ("exact", "near", "both"):
            raise ValueError("strategy must be exact, near or both")
        if not 0 < self.similarity <= 1 or not 0 <= self.gates.max_repetition <= 1:
            raise ValueError("similarity and repetition are shares of 1")
        context_length(self.length)

    def identity(self, *digests: str) -> str:
        """What a finished run can be reused by: its parameters and inputs."""
        return identity(asdict(self), *sorted(digests))


def context_length(wanted: int | None, limit: int | None = None, auto: int = 8192) -> int:
    """The length of sequences: as wanted, else the model's limit up to ``auto``; beyond that it must be given."""
    if wanted is None:
        if limit is None or not 2 <= limit <= auto:
            raise ValueError("no context length: give one")
        return limit
    if not 2 <= wanted <= 10_000_000 or (limit is not None and wanted > limit):
        raise ValueError(f"context length {wanted} is out of range")
    return wanted


def reasons(docs: DataFrame, key: str, text: str, cfg: PrepareConfig) -> DataFrame:
    """Gate reasons with the duplicates of the chosen strategy.

    A near duplicate is dropped only for a document that passes all gates and is kept, so
    near duplicates are sought among those that pass the others.
    """
    r = gates.gate_reasons(docs, key, text, cfg.gates)
    if cfg.strategy == "near":
        r = r.withColumn("reason", F.when(F.col("reason") != "exact_duplicate", F.col("reason"))).withColumn("duplicate_of", F.lit(None).cast(docs.schema[key].dataType))
    if cfg.strategy == "exact":
        return r
    r = written(r)
    passed = docs.join(r.where("reason is null").select(key), key, "left_semi")
    first = passed.groupBy(F.md5(text).alias("_h")).agg(F.min(key).alias(key))
    signed = written(dedup.signatures(passed.join(first.select(key), key, "left_semi"), key, text))
    pairs = written(dedup.similar_pairs(signed, key, cfg.similarity))
    kept = dedup.greedy_keep(signed.select(key), key, pairs)
    copies = dedup.first_occurrences(passed.select(key, text), key, F.col(text)).select(key, F.col("duplicate_of").alias("_copy"))
    best = (
        pairs.join(kept.where("kept").select(F.col(key).alias("a")), "a", "left_semi").groupBy(F.col("b").alias(key)).agg(F.max_by("a", F.struct("similarity", -F.col("a"))).alias("_near"))
    )
    lost = kept.where("not kept").select(key).join(best, key)
    near = copies.join(lost, key, "left").select(key, F.coalesce("_near", "_copy").alias("_of")).where("_of is not null")
    out = r.join(near, key, "left")
    out = out.withColumn("reason", F.coalesce("reason", F.when(F.col("_of").isNotNull(), "near_duplicate"))).withColumn("duplicate_of", F.coalesce("duplicate_of", "_of")).drop("_of")
    # a copy of a text that is dropped for a kept one is a near duplicate of that kept one
    of = F.coalesce("_kept", "duplicate_of")
    out = out.join(lost.select(F.col(key).alias("duplicate_of"), F.col("_near").alias("_kept")), "duplicate_of", "left").withColumn("reason", F.when(F.col("_kept").isNotNull(), "near_duplicate").otherwise(F.col("reason")))
    return out.withColumn("duplicate_of", of).select(*r.columns)


def prepare(docs: DataFrame, key: str, text: str, cfg: PrepareConfig = PrepareConfig()) -> dict[str, DataFrame]:
    """The whole pipeline: 'reasons', 'kept' (key, text, split), 'rejected', and for each split 'packed_*' and 'metrics_*'."""
    clean = docs.select(key, T.canonical(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    why = written(reasons(clean, key, "text", cfg))
    kept = clean.join(why.where("reason is null").select(key), key, "left_semi")
    if cfg.clean_blocks:
        kept = blocks.clean_blocks(kept, key, "text").select(key, F.col("cleaned").alias("text"))
    kept = written(kept.withColumn("refused", gates.content_gate(F.col("text"), cfg.min_content, cfg.min_alpha)))
    rejected = why.where("reason is not null").select(key, F.lit("gates").alias("stage"), "reason", "duplicate_of").unionByName(
        kept.where("refused is not null").select(key, F.lit("content").alias("stage"), F.col("refused").alias("reason")), allowMissingColumns=True
    )
    split = written(splits.random_split(kept.where("refused is null").drop("refused"), key, cfg.held_out_percent, cfg.seed))
    out = {"reasons": why, "kept": split, "rejected": rejected}
    for name in ("train", "test"):
        part = split.where(F.col("split") == name)
        ids = packing.word_ids(F.col("text"))
        out[f"packed_{name}"] = packing.pack(part, key, ids, cfg.length, cfg.bos)
        out[f"metrics_{name}"] = packing.pack_metrics(packing.spans(part, key, ids, cfg.length, cfg.bos), cfg.length)
    return out


def manifest(docs: DataFrame, key: str, text: str, corpus: str, cfg: PrepareConfig, fraction: float = 0.1) -> DataFrame:
    """The second layout: one row a document with measures, acceptance, reason, duplicate and stratified split."""
    g = gates.gate_reasons(docs, key, text, cfg.gates)
    accepted = g.where("reason is null").join(docs.select(key, corpus), key)
    split = splits.stratified_split(accepted.select(key, corpus), key, corpus, fraction, cfg.seed).select(key, "split")
    return docs.select(key, corpus).join(g, key).join(split, key, "left").select(
        key, F.col(corpus).alias("source_corpus"), "content_md5", "characters", "repetition", "language", F.col("reason").isNull().alias("accepted"), F.col("reason").alias("rejection_reason"), "duplicate_of", "split"
    )
