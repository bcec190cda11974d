"""Frozen prompt sets, blinded review, resolution of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators.matching import only_text


def only_match(prompts: DataFrame, key: str, fragment: str, docs: DataFrame, ident: str) -> DataFrame:
    """(key, ident): the one document whose identifier contains the prompt's fragment; none or several give no row."""
    return only_text(prompts, key, fragment, docs, ident)


def blinded(answers: DataFrame, key: str, base: str, new: str, seed: int = 42) -> DataFrame:
    """(key, answer_a, answer_b, base_is_a): which answer stands first is a bit of the seeded hash."""
    bit = F.substring(T.seeded_rank(seed, key), 1, 1) < "8"
    return answers.select(key, F.when(bit, F.col(base)).otherwise(F.col(new)).alias("answer_a"), F.when(bit, F.col(new)).otherwise(F.col(base)).alias("answer_b"), bit.alias("base_is_a"))


def contract(prompts: DataFrame, by: str, wanted: dict[str, int]) -> DataFrame:
    """(group, n, wanted, holds): the cardinalities that a frozen set must have."""
    table = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])
    n = prompts.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("wanted", F.try_element_at(table, F.col(by)).cast("bigint")).withColumn("holds", F.coalesce(F.col("n") == F.col("wanted"), F.lit(False)))


def same_digests(one: DataFrame, two: DataFrame, key: str, digest: Column) -> DataFrame:
    """Rows whose digest differs between two tables or is missing in one."""
    a, b = one.select(key, digest.alias("one")), two.select(key, digest.alias("two"))
    return a.join(b, key, "full").where(~F.coalesce(F.col("one") == F.col("two"), F.lit(False)))
