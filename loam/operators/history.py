"""Ordered series of measurements: windows, plateaus, epochs, runs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators.grouping import first_rows, ranked
from loam.session import map_arrow


def tumbling_means(df: DataFrame, series: str, order: list[str], value: str, size: int) -> DataFrame:
    """(series, window, start, end, mean): means of full windows of ``size`` rows in order; a last partial window is dropped."""
    x = ranked(df.where(F.col(value).isNotNull()), [series], order, [value], "_r").withColumn("window", F.floor(F.col("_r") / size))
    g = x.groupBy(series, "window").agg(F.count(F.lit(1)).alias("_n"), F.min("_r").alias("start"), F.max("_r").alias("end"), F.avg(value).alias("mean"))
    return g.where(F.col("_n") == size).select(series, "window", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "mean")


def plateau(windows: DataFrame, series: str, threshold: float = 0.01, patience: int = 3) -> DataFrame:
    """(series, windows, best, plateau_start): the first of ``patience`` windows in a row that do not improve the best mean by the threshold.

    The best only changes when it is beaten by the threshold, so a running minimum is not the
    same: each series passes in order through a task, which keeps its state and no windows.
    """

    def run(batches):
        now, n, best, stale, back, hit = None, 0, None, 0, [], None
        out: list[tuple] = []
        for batch in batches:
            for name, start, mean in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if n and name != now:
                    out.append((now, n, best, hit))
                    n = 0
                if not n:
                    now, best, stale, back, hit = name, None, 0, [], None
                n += 1
                back = [*back[-(patience - 1) :], start] if patience > 1 else [start]
                if best is None or (best - mean) / best >= threshold:
                    best, stale = mean, 0
                else:
                    stale += 1
                    hit = back[0] if hit is None and stale >= patience else hit
            yield _plateaus(out)
            out = []
        if n:
            yield _plateaus([(now, n, best, hit)])

    kind = pa.schema([(series, pa.string()), ("windows", pa.int64()), ("best", pa.float64()), ("plateau_start", pa.int64())])

    def _plateaus(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind.field(i).type) for i in range(4)], schema=kind)

    name = windows.schema[series].dataType.simpleString()
    ordered = windows.where(F.col(series).isNotNull()).select(F.col(series).cast("string").alias(series), "window", F.col("start").cast("bigint").alias("start"), F.col("mean").cast("double").alias("mean")).repartition(series).sortWithinPartitions(series, "window").select(series, "start", "mean")
    return map_arrow(ordered, run, f"`{series}` string, windows bigint, best double, plateau_start bigint").withColumn(series, F.col(series).cast(name))


def trailing_change(df: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """(series, n, previous, recent, percent, state): the last window against the one before; a window is a tenth of the rows, 5 to 20."""
    x = ranked(df.where(F.col(value).isNotNull()), [series], order, [value], "_up", "_n").withColumn("_r", F.col("_n") - F.col("_up"))
    x = x.withColumn("_w", F.least(F.lit(20), F.greatest(F.lit(5), F.floor(F.col("_n") / 10))))
    g = x.groupBy(series).agg(
        F.max("_n").alias("n"), F.avg(F.when((F.col("_r") > F.col("_w")) & (F.col("_r") <= 2 * F.col("_w")), F.col(value))).alias("previous"), F.avg(F.when(F.col("_r") <= F.col("_w"), F.col(value))).alias("recent"), F.max("_w").alias("w")
    ).where(F.col("n") >= 2 * F.col("w"))
    p = (F.col("recent") - F.col("previous")) / F.col("previous") * 100
    return g.select(series, "n", "previous", "recent", p.alias("percent"), F.when(F.abs(p) < 2, "plateau").when(p < 0, "improving").otherwise("worse").alias("state"))


def by_epoch(df: DataFrame, epoch: Column, step: str, loss: str) -> DataFrame:
    """(epoch, updates, mean, least, last) of the rows that have a loss."""
    return df.where(F.col(loss).isNotNull()).groupBy(epoch.alias("epoch")).agg(F.count(F.lit(1)).alias("updates"), F.avg(loss).alias("mean"), F.min(loss).alias("least"), F.max_by(loss, step).alias("last"))


def best_epoch(df: DataFrame, run: str, epoch: str, loss: str, step: str) -> DataFrame:
    """(run, best_epoch, best_loss): the least loss, the earliest step on ties; runs without a loss give no row."""
    return df.where(F.col(loss).isNotNull()).groupBy(run).agg(F.min_by(epoch, F.struct(loss, step)).alias("best_epoch"), F.min(loss).alias("best_loss"))


def run_table(runs: DataFrame) -> DataFrame:
    """Runs (run, rank, alpha, use_rs, initial_loss, final_loss) with scaling, perplexities, their change and a verdict.

    BEST has the least final loss of all (first run on ties); Improved and Degraded go by perplexity;
    Incomplete lacks a loss.  Runs without a rank sort last.
    """
    rank = F.col("rank")
    scaling = F.when(rank > 0, F.when(F.coalesce("use_rs", F.lit(False)), F.col("alpha") / F.sqrt(rank)).otherwise(F.col("alpha") / rank))
    x = runs.withColumn("scaling", scaling).withColumn("initial_perplexity", T.perplexity("initial_loss", 100.0)).withColumn("final_perplexity", T.perplexity("final_loss", 100.0))
    change = F.when(F.col("initial_perplexity") != 0, (F.col("final_perplexity") - F.col("initial_perplexity")) / F.col("initial_perplexity") * 100)
    best = runs.where("final_loss is not null").agg(F.min_by("run", F.struct("final_loss", "run")).alias("_best"))
    x = x.withColumn("change_percent", change).join(F.broadcast(best))
    return x.withColumn(
        "verdict", F.when(F.col("final_loss").isNull() | F.col("initial_loss").isNull(), "Incomplete").when(F.col("run") == F.col("_best"), "BEST").when(change < 0, "Improved").otherwise("Degraded")
    ).withColumn("capacity", F.when(rank == 8, "A / Low").when(rank == 16, "B / Balanced").when(rank == 32, "C / High").otherwise("Custom")).drop("_best")


def newest_artifact(files: DataFrame, run: str, path: str) -> DataFrame:
    """One file of each run: final ones before checkpoints, then the shallowest, then by path."""
    return first_rows(files, [run], [F.col(path).contains("checkpoint-"), F.size(F.split(path, "/")), F.col(path)])


def extremes(df: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """(series, first, last, least) of each series' values in order."""
    o = F.struct(*order)
    return df.where(F.col(value).isNotNull()).groupBy(series).agg(F.min_by(value, o).alias("first"), F.max_by(value, o).alias("last"), F.min(value).alias("least"))


def run_deltas(runs: DataFrame) -> DataFrame:
    """``runs`` with the change of loss and perplexity, absolute and in percent, and GOOD, NEEDS IMPROVEMENT, UNCHANGED or UNAVAILABLE."""
    a, b = F.col("initial_loss"), F.col("final_loss")
    x = runs.withColumn("loss_change", b - a).withColumn("loss_change_percent", F.when(a != 0, (b - a) / a * 100))
    p, q = T.perplexity("initial_loss", 100.0), T.perplexity("final_loss", 100.0)
    x = x.withColumn("perplexity_change", q - p).withColumn("perplexity_change_percent", F.when(p != 0, (q - p) / p * 100))
    return x.withColumn("state", F.when(a.isNull() | b.isNull(), "UNAVAILABLE").when(b < a, "GOOD").when(b > a, "NEEDS IMPROVEMENT").otherwise("UNCHANGED"))
