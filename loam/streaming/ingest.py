"""Streams: new files into a manifest, late measurements into windows, a growing loss log."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import text as T

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def ingest(spark: SparkSession, root: str, manifest: str, pattern: str = "*.txt", checkpoint: str | None = None, once: bool = True):
    """Reads files that arrive under ``root`` into the Parquet table ``manifest`` (path, md5, text); contents that it holds already are skipped.

    Each micro-batch is joined against the manifest, so a replayed batch adds nothing twice.  The stream's
    checkpoint lies beside the manifest unless another place is given, under a name that follows from both
    paths, so that a later process goes on where an earlier one stopped.
    """
    if checkpoint is None:
        checkpoint = f"{manifest.rstrip('/')}-checkpoint-{hashlib.sha256(repr((root, manifest)).encode()).hexdigest()[:16]}"
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    rows = files.select("path", F.md5("content").alias("md5"), T.canonical(T.strip_bom(F.col("content").cast("string"))).alias("text"))

    def add(batch: DataFrame, _: int) -> None:
        s = batch.sparkSession
        fresh = batch.dropDuplicates(["md5"])
        try:
            fresh = fresh.join(s.read.parquet(manifest).select("md5"), "md5", "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.select("path", "md5", "text").write.mode("append").parquet(manifest)

    w = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def windowed(events: DataFrame, ts: str, value: str, by: str, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """(by, start, end, n, mean): tumbling windows of a stream (or a table); rows later than ``late`` are dropped by the watermark."""
    x = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    g = x.groupBy(F.window("_t", width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return g.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean")


def sessions(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(by, start, end, n): sessions closed by a gap."""
    x = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return x.groupBy(F.session_window("_t", gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def append_losses(rows: DataFrame, path: str, checkpoint: str):
    """A stream of (step, epoch, loss, ...) appended to a log of JSON lines."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
