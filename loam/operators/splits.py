"""Deterministic splits: whole corpus, by stratum, by source."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators.grouping import first_k, ranked
from loam.session import map_arrow


def hash_rank(df: DataFrame, key: str, seed: int, out: str = "rank") -> DataFrame:
    """``df`` with the 1-based place of each row in the order of SHA-256('seed:key'); keys are unique.

    Only keys and hashes are ranked, over range partitions.
    """
    keyed = df.select(key).withColumn("_all", F.lit(1)).withColumn("_h", T.seeded_rank(seed, key))
    places = ranked(keyed, ["_all"], ["_h", key], [], "_place").select(F.col(key).alias("_k"), (F.col("_place") + 1).alias(out))
    if df.columns == [key]:
        return places.withColumnRenamed("_k", key)
    return df.join(places, F.col(key) == F.col("_k")).drop("_k")


def held_out_size(n: Column, percent: Column | int) -> Column:
    """Half-even rounding of the share, at least 1, at most all but 1."""
    p = F.lit(percent) if isinstance(percent, int) else percent
    return F.least(F.greatest(F.lit(1), F.bround(n * p / 100, 0).cast("bigint")), n - 1)


def random_split(df: DataFrame, key: str, percent: int, seed: int = 42, rest: str = "train", held: str = "test") -> DataFrame:
    """``df`` with ``split``: the first rows in hash order are held out."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    x = hash_rank(df, key, seed, "_rank").join(F.broadcast(total))
    return x.withColumn("split", F.when(F.col("_rank") <= held_out_size(F.col("_total"), percent), held).otherwise(rest)).drop("_rank", "_total")


def fraction_split(df: DataFrame, key: str, fraction: float, seed: int = 7) -> DataFrame:
    """``df`` with ``split``: the first floor(n * fraction) rows in hash order are 'train', the others 'eval'."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    x = hash_rank(df, key, seed, "_rank").join(F.broadcast(total))
    return x.withColumn("split", F.when(F.col("_rank") <= F.floor(F.col("_total") * fraction), "train").otherwise("eval")).drop("_rank", "_total")


def largest_remainder(sizes: DataFrame, stratum: str, n: str, fraction: float) -> DataFrame:
    """(stratum, n, allocated): the held-out rows of the whole, shared among strata by largest remainder."""
    total = sizes.agg(F.sum(n).alias("_t"))
    x = sizes.join(F.broadcast(total)).withColumn("_target", F.greatest(F.lit(1), F.bround(F.col("_t") * fraction, 0).cast("bigint")))
    x = x.withColumn("_exact", F.col("_target") * F.col(n) / F.col("_t")).withColumn("_floor", F.floor("_exact"))
    left = x.agg((F.max("_target") - F.sum("_floor")).alias("_left"))
    order = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 12)), stratum))  # over the strata
    x = x.withColumn("_o", order).join(F.broadcast(left))
    return x.select(stratum, n, (F.col("_floor") + F.when(F.col("_o") <= F.col("_left"), 1).otherwise(0)).alias("allocated"))


def stratified_split(df: DataFrame, key: str, stratum: str, fraction: float, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: of each stratum as many rows as it is allocated, in hash order, are 'eval'; null strata are one. Keys are unique."""
    x = df.withColumn("_s", F.coalesce(F.col(stratum), F.lit("none")))
    sizes = x.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    share = largest_remainder(sizes, "_s", "_n", fraction)
    rank = ranked(x.withColumn("_h", T.seeded_rank(seed, key)), ["_s"], ["_h", key], [], "_r").select(F.col(key).alias("_k"), "_r", "_s")
    side = rank.join(share.select("_s", "allocated"), "_s").select("_k", F.when(F.col("_r") < F.col("allocated"), "eval").otherwise("train").alias("split"))
    return df.join(side, df[key] == side["_k"]).drop("_k")


def disjoint_report(split: DataFrame, key: str, content: Column) -> DataFrame:
    """One row: rows of each side, and keys and contents that stand on both (must be 0)."""
    def both(c):
        g = split.groupBy(c.alias("_c")).agg(F.countDistinct("split").alias("_n"))
        return g.agg(F.count_if(F.col("_n") > 1).alias("x"))

    sums = split.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("split").isin("train")).alias("train"), F.count_if(~F.col("split").isin("train")).alias("held_out"))
    return sums.join(both(F.col(key)).withColumnRenamed("x", "shared_keys")).join(both(content).withColumnRenamed("x", "shared_contents"))


def choose_sources(sizes: DataFrame, source: str, n: str, held_share: float, train_share: float, preferred: tuple[str, ...] = (), seed: int = 42) -> DataFrame:
    """(source, position): sources for the held-out side: preferred ones first, then in hash order.

    ``sizes`` is one row a source, after capping.  A source that would leave less than ``train_share`` of all
    rows for training is skipped.  It ends when ``held_share`` and min(8, sources - 1) sources are reached.  Each
    skip depends on those before, so the sources pass one task in order, which keeps a few numbers only.
    """
    total, count = sizes.agg(F.coalesce(F.sum(n), F.lit(0)), F.count(F.lit(1))).first()
    held, train, least = int(total * held_share), total - int(total * (1 - train_share)), min(8, count - 1)
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, preferred)), F.col(source)), F.lit(0)), F.lit(len(preferred) + 1)) if preferred else F.lit(0)
    ordered = sizes.select(source, F.col(n).cast("bigint").alias("n"), place.alias("_p"), F.sha2(F.concat(F.lit(f"{seed}:"), F.col(source)), 256).alias("_h"))
    ordered = ordered.repartition(1).sortWithinPartitions("_p", "_h").select(source, "n")

    def run(batches):
        left, taken, position = total, 0, 0
        for batch in batches:
            rows, at = [], []
            for i, size in enumerate(batch.column(1).to_pylist()):
                if left - size >= train and not (taken >= held and position >= least and position):
                    rows.append(i)
                    at.append(position)
                    left, taken, position = left - size, taken + size, position + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(at, pa.int32())], names=[source, "position"])

    return map_arrow(ordered, run, f"`{source}` {sizes.schema[source].dataType.simpleString()}, position int")


def cap_per_group(df: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group in the given order, with their rank."""
    return first_k(df, group, order, most)


def round_robin(ranked: DataFrame, group: str, target: int, seed: int = 42) -> DataFrame:
    """``target`` rows: every group's first (groups in hash order), then every group's second, and so on."""
    return ranked.withColumn("_g", T.seeded_rank(seed, group)).orderBy("rank", "_g", group).limit(target).drop("_g")


def balance(total: int, first_capacity: int, second_capacity: int) -> tuple[int, int]:
    """How many rows each of two strata gives: half each, what one lacks from the other; too few of both is an error."""
    first = min(total // 2, first_capacity)
    second = min(total - first, second_capacity)
    first = min(total - second, first_capacity)
    if first + second < total:
        raise ValueError("the strata hold too few rows")
    return first, second
