"""Grouping that a hot key does not slow: values of groups, ranks within groups, first rows of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.session import written

#: A group of more than this part of all rows is hot; so there are at most as many.
HOT = 5000


def with_group_values(df: DataFrame, by: str, key: str, **values: Column) -> DataFrame:
    """``df`` with aggregates of each row's group (equal, not null ``by``).

    Groups are aggregated map-side.  Values of hot groups (at most HOT rows) are broadcast,
    those of all others joined; rows of hot groups are spread over the join's partitions, so
    no task gets a group.  ``df`` is read twice.
    """
    groups = written(df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), *[v.alias(k) for k, v in values.items()]))
    total = groups.agg(F.sum("_n")).first()[0] or 0
    most = max(1000, total // HOT)
    hot = groups.where(F.col("_n") > most).select(F.col(by).alias("_hot"), F.struct(*values).alias("_hv"))
    cold = groups.where(F.col("_n") <= most).select(F.concat(F.lit("g"), F.col(by).cast("string")).alias("_g"), F.struct(*values).alias("_cv"))
    x = df.join(F.broadcast(hot), F.col(by) == F.col("_hot"), "left")
    spread = F.concat(F.lit("s"), F.xxhash64(key).cast("string"))
    x = x.withColumn("_g", F.when(F.col("_hot").isNull(), F.concat(F.lit("g"), F.col(by).cast("string"))).otherwise(spread))
    x = x.join(cold, "_g", "left").withColumn("_v", F.coalesce("_hv", "_cv"))
    return x.select(*df.columns, *[F.col(f"_v.{k}").alias(k) for k in values])


def ranked(df: DataFrame, by: list[str], order: list[str], keep: list[str], out: str = "rank", size: str | None = None) -> DataFrame:
    """(by, order, keep, rank[, size]): the 0-based place of each row within its group in ascending order.

    The whole table is range-partitioned by group and order and numbered within
    partitions; totals of earlier partitions and the start of each group shift the numbers.  A group
    may span any number of partitions.  Ties in ``order`` must be broken by it.
    """
    cols = list(dict.fromkeys([*by, *order, *keep]))
    parts = written(df.select(*cols).repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    shift = totals.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*by, *order)) - 1
    x = parts.withColumn("_place", within).join(F.broadcast(shift), "_part").withColumn("_place", F.col("_place") + F.col("_shift"))
    # inside a partition a group's start is local; only the first and last group of a partition may reach further
    local = Window.partitionBy("_part", *by)
    x = x.withColumn("_start", F.min("_place").over(local)).withColumn("_size", F.count(F.lit(1)).over(local))
    group = F.struct(*by)
    ends = x.groupBy("_part").agg(F.array(F.min_by(group, "_place"), F.max_by(group, "_place")).alias("_g")).select(F.explode("_g").alias("_g")).distinct()
    ends = ends.select(*[F.col(f"_g.{c}").alias(f"_by_{c}") for c in by])  # at most two a partition
    on = None
    for c in by:
        e = F.col(c).eqNullSafe(F.col(f"_by_{c}"))
        on = e if on is None else on & e
    whole = x.join(F.broadcast(ends), on).groupBy(*[f"_by_{c}" for c in by]).agg(F.min("_place").alias("_start2"), F.count(F.lit(1)).alias("_size2"))
    x = x.join(F.broadcast(whole), on, "left")
    extra = [F.coalesce("_size2", "_size").cast("bigint").alias(size)] if size else []
    return x.select(*cols, (F.col("_place") - F.coalesce("_start2", "_start")).cast("bigint").alias(out), *extra)


def first_rows(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group: an aggregate with partial minima instead of a window."""
    rest = [c for c in df.columns if c not in by]
    x = df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_first_row"))
    return x.select(*by, *[F.col(f"_first_row.{c}").alias(c) for c in rest])


def first_k(df: DataFrame, by: str, order: list, k: int, out: str = "rank", salts: int = 64) -> DataFrame:
    """The first k rows of each group with their rank: candidates by part of a group first, then among those."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c, t in df.dtypes if not t.startswith("map")]), F.lit(salts))
    x = df.withColumn("_salt", salt).withColumn("_n", F.row_number().over(Window.partitionBy(by, "_salt").orderBy(*order))).where(F.col("_n") <= k).drop("_n", "_salt")
    return x.withColumn(out, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(out) <= k)
