"""Quality gates over documents, with the reason and evidence of each rejection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators.grouping import with_group_values
from loam.session import written

#: Frequent words that tell languages apart.
STOPWORDS = {
    "en": "the and of to in is that for with as this are",
    "de": "der die und das den von mit ist auf für eine nicht",
    "fr": "le la les des et est une dans pour que sur avec",
    "es": "el los las del que una para con por como está en",
}


@dataclass(frozen=True)
class GateConfig:
    """The gates' parameters; where two readings of a gate exist, a parameter chooses."""

    min_chars: int = 50
    strip_before_length: bool = True
    max_repetition: float = 0.30
    paragraph_break: str = "\n\n"
    fold_case: bool = True
    empty_repetition: float = 1.0
    language: str | None = "en"
    language_after_duplicates: bool = False
    min_probability: float = 0.8


def length_of(text: Column, cfg: GateConfig) -> Column:
    return F.length(T.strip(text) if cfg.strip_before_length else text)


def repetition_ratio(text: Column, cfg: GateConfig) -> Column:
    """Paragraphs that repeat an earlier one, as a share; of a text without any, ``empty_repetition``."""

    def ratio(parts):
        keys = F.transform(parts, F.lower) if cfg.fold_case else parts
        n = F.size(parts)
        return F.when(n == 0, F.lit(cfg.empty_repetition)).otherwise((n - F.size(F.array_distinct(keys))) / n)

    return T.let(F.filter(F.transform(F.split(text, cfg.paragraph_break), T.squeeze), lambda p: p != ""), ratio)


def language_scores(text: Column, head: int = 2000) -> Column:
    """struct<en, de, fr, es>: hits of each language's frequent words in the beginning of a text."""

    def hits(w, known: list[str]) -> Column:
        return F.size(F.filter(w, lambda x: x.isin(*known))).cast("bigint")

    words = F.regexp_extract_all(F.lower(F.substring(text, 1, head)), F.lit(r"[\p{L}]+"), 0)
    return T.let(words, lambda w: F.struct(*[hits(w, v.split()).alias(k) for k, v in STOPWORDS.items()]))


def best_language(scores: Column) -> Column:
    """The language with most hits; 'undetermined' without hits or with a tie."""
    return T.let(scores, lambda s: _best({k: s[k] for k in STOPWORDS}))


def _best(scores: dict[str, Column]) -> Column:
    top = F.greatest(*scores.values())
    ties = sum(F.when(s == top, 1).otherwise(0) for s in scores.values())
    out = F.when((top == 0) | (ties > 1), "undetermined")
    for k, s in scores.items():
        out = out.when(s == top, k)
    return out


def gate_reasons(docs: DataFrame, key: str, text: str, cfg: GateConfig = GateConfig(), detected: DataFrame | None = None) -> DataFrame:
    """(key, content_md5, characters, repetition, language, reason, duplicate_of) of every row.

    ``reason`` is the first gate that a document fails - length, repetition,
    exact_duplicate, language - or null.  Only documents that pass all gates are kept, so
    a duplicate always names a kept one, that with the smallest key.  Equal texts pass or fail
    alike, so the smallest key of a digest decides; null text counts as empty.  Texts are read once
    and never shuffled; a digest that a third of all rows share is no hot group.

    ``detected`` has (key, language, probability) of :func:`loam.functions.languages.detect`; below
    ``cfg.min_probability`` and without an entry the language is undetermined.  Without it frequent words decide.
    """
    x = T.canonical(F.coalesce(F.col(text), F.lit("")))
    m = docs.select(F.col(key), x.alias("_t")).select(
        key, F.md5("_t").alias("content_md5"), length_of(F.col("_t"), cfg).cast("bigint").alias("characters"),
        repetition_ratio(F.col("_t"), cfg).cast("double").alias("repetition"), best_language(language_scores(F.col("_t"))).alias("language"),
    )
    if detected is not None:
        sure = F.when(F.col("probability") >= cfg.min_probability, F.col("_language"))
        seen = detected.select(key, F.col("language").alias("_language"), "probability")
        m = m.join(seen, key, "left").withColumn("language", F.coalesce(sure, F.lit("undetermined"))).drop("_language", "probability")
    early = F.when(F.col("characters") < cfg.min_chars, "length").when(F.col("repetition") > cfg.max_repetition, "repetition")
    wrong = (F.col("language") != cfg.language) if cfg.language else F.lit(False)
    dup = F.col("_first") < F.col(key)
    late = F.when(dup, "exact_duplicate").when(wrong, "language") if cfg.language_after_duplicates else F.when(wrong, "language").when(dup, "exact_duplicate")
    return (
        with_group_values(written(m), "content_md5", key, _first=F.min(key))
        .withColumn("reason", F.coalesce(early, late))
        .withColumn("duplicate_of", F.when(F.col("reason") == "exact_duplicate", F.col("_first")))
        .drop("_first")
    )


GATES = ("length", "repetition", "exact_duplicate", "near_duplicate", "language")


def waterfall(reasons: DataFrame, gates: tuple[str, ...] = GATES) -> DataFrame:
    """(gate, position, before, removed, after, greatest): documents through the gates in order; ties share 'greatest'."""
    spark = reasons.sparkSession
    order = spark.createDataFrame([(g, i) for i, g in enumerate(gates, 1)], "gate string, position int")
    counts = reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    upto = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)  # over the gates only
    return (
        order.join(counts, order.gate == counts.reason, "left")
        .join(total)
        .select("gate", "position", F.coalesce("n", F.lit(0)).alias("removed"), F.coalesce("total", F.lit(0)).alias("total"))
        .withColumn("before", F.col("total") - F.coalesce(F.sum("removed").over(upto), F.lit(0)))
        .withColumn("after", F.col("before") - F.col("removed"))
        .withColumn("greatest", (F.rank().over(Window.orderBy(F.desc("removed"))) == 1) & (F.col("removed") > 0))
        .select("gate", "position", "before", "removed", "after", "greatest")
    )


def audit(reasons: DataFrame, key: str) -> DataFrame:
    """One row of invariants: input, kept, rejected, and duplicates whose original is not kept (must be 0)."""
    kept = reasons.where("reason is null").select(F.col(key).alias("duplicate_of"))
    lost = reasons.where("duplicate_of is not null").join(kept, "duplicate_of", "left_anti").agg(F.count(F.lit(1)).alias("broken_lineage"))
    sums = reasons.agg(F.count(F.lit(1)).alias("input"), F.count_if(F.col("reason").isNull()).alias("kept"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))
    return sums.join(lost).withColumn("balanced", F.col("kept") + F.col("rejected") == F.col("input"))


def content_gate(text: Column, min_chars: int = 200, min_alpha: float = 0.25) -> Column:
    """Why a cleaned text is refused, or null."""
    return F.when(F.length(text) < min_chars, "too_short").when(T.alpha_ratio(text) < min_alpha, "low_alphabetic_ratio")
