"""Finished results found again by what they were made from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_digest(df: DataFrame) -> str:
    """A digest of a table's columns and rows, whatever their order: one aggregate."""
    h = F.xxhash64(*[F.to_json(F.struct(c)) for c in df.columns]).cast("decimal(38,0)")
    n, low, high = df.agg(F.count(F.lit(1)), F.sum(F.pmod(h, F.lit(1 << 32).cast("decimal(38,0)"))), F.sum(h)).first()
    return hashlib.sha256(json.dumps([df.dtypes, n, str(low), str(high)]).encode()).hexdigest()


def identity(options: dict, *digests: str) -> str:
    """What a result follows from: all options and the digests of all inputs, in their order."""
    return hashlib.sha256(json.dumps([options, digests], sort_keys=True, default=str).encode()).hexdigest()


def _finished(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def reused(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """(result, whether it was there): the result under ``folder`` with this identity, made and written if no run has finished it."""
    path = f"{folder.rstrip('/')}/{name}"
    held = _finished(spark, path)
    if not held:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), held
