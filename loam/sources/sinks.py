"""Sinks: packed Parquet, flat binaries, texts, JSON and CSV reports."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.session import ship

CODECS = ("none", "snappy", "gzip", "brotli", "lz4", "zstd")


def write_packed(packed: DataFrame, path: str, length: int, codec: str = "zstd", overwrite: bool = False, **facts) -> None:
    """Sequences as Parquet, committed as a whole; ``facts`` (totals, dtype) go into the columns' metadata."""
    if codec not in CODECS:
        raise ValueError(f"codec must be one of {CODECS}")
    x = packed.withMetadata("input_ids", {"context_length": length, "packing": "concatenated_document_stream_no_padding", **facts})
    x.write.mode("overwrite" if overwrite else "errorifexists").option("compression", codec).parquet(path)


def write_flat(packed: DataFrame, folder: str, dtype: str = "uint16") -> None:
    """One binary file a partition, named by its first sequence, in the order of sequences; an id beyond the type is an error.

    ``folder`` is on storage that all executors share.  Files are written under a
    temporary name and renamed, so a task that runs twice leaves one file.
    """
    folder = folder.removeprefix("file://")
    if "://" in folder:
        raise ValueError(f"{folder} is no path of a file system that executors mount")
    ship(packed.sparkSession)
    most = np.iinfo(dtype).max

    def put(rows):
        first, parts = None, []
        for r in rows:
            ids = np.asarray(r.input_ids, np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() > most):
                raise OverflowError(f"an id does not fit {dtype}")
            first = r.sequence_id if first is None else first
            parts.append(ids.astype(np.dtype(dtype).newbyteorder("<")).tobytes())
        if first is not None:
            os.makedirs(folder, exist_ok=True)
            name = os.path.join(folder, f"part-{first:012d}.bin")
            with open(f"{name}.{os.getpid()}.tmp", "wb") as f:
                f.writelines(parts)
            os.replace(f"{name}.{os.getpid()}.tmp", name)

    packed.select("sequence_id", "input_ids").repartitionByRange("sequence_id").sortWithinPartitions("sequence_id").foreachPartition(put)


def write_texts(texts: DataFrame, path: str, name: str, text: str) -> None:
    """One folder a document (its safe name), with its text."""
    texts.select(T.safe_name(name).alias("document"), F.col(text).alias("value")).write.partitionBy("document").text(path)


def combined(texts: DataFrame, key: str, text: str, markers: bool = False) -> DataFrame:
    """(value): the documents in key order as rows of one text file, a blank line between them, with or without marker lines."""
    body = F.concat(F.lit("<<<DOCUMENT "), F.col(key).cast("string"), F.lit(">>>\n"), F.col(text)) if markers else F.col(text)
    return texts.orderBy(key).select(F.concat(body, F.lit("\n")).alias("value"))


def write_report(rows: DataFrame, path: str) -> None:
    """A small report as JSON lines, keys in the order of the columns' names."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).coalesce(1).write.text(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.option("ignoreNullFields", "false").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with header; line ends within fields are written as backslash n."""
    flat = [F.replace(F.col(c), F.lit("\n"), F.lit("\\n")).alias(c) if k == "string" else F.col(c) for c, k in rows.dtypes]
    rows.select(*flat).write.option("header", "true").option("escape", "\"").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


def write_responses(rows: DataFrame, path: str, by: str = "query_file") -> None:
    """Responses in one folder for each query file."""
    rows.write.partitionBy(by).option("ignoreNullFields", "false").json(path)


def write_splits(rows: DataFrame, path: str) -> None:
    """One folder for each split, so that a reader of one split reads only that."""
    rows.write.partitionBy("split").parquet(path)


def markdown_rows(rows: DataFrame, most: int = 240) -> DataFrame:
    """(value): a Markdown table's lines, cells escaped and clipped; the header is one literal row."""
    cell = lambda c: F.replace(T.clip(F.coalesce(F.col(c).cast("string"), F.lit("")), most, "…"), F.lit("|"), F.lit("\\|"))
    bar = lambda parts: F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))
    head = rows.sparkSession.createDataFrame([("| " + " | ".join(rows.columns) + " |",), ("|" + " --- |" * len(rows.columns),)], "value string")
    return head.unionByName(rows.select(bar([cell(c) for c in rows.columns]).alias("value")))


def aligned_rows(rows: DataFrame, most: int = 60) -> DataFrame:
    """(value): a table for a console: cells clipped and padded to their column's width, numbers to the right; header and rule first.

    Widths come from one aggregate; the order of rows is the caller's.
    """
    numbers = {c for c, k in rows.dtypes if k in ("tinyint", "smallint", "int", "bigint", "float", "double") or k.startswith("decimal")}
    cells = rows.select(*[T.clip(F.coalesce(F.col(c).cast("string"), F.lit("")), most, "…").alias(c) for c in rows.columns])
    seen = cells.agg(*[F.max(F.length(c)).alias(c) for c in cells.columns]).first()  # one row
    width = {c: max(len(c), seen[c] or 0) for c in cells.columns}
    pad = lambda c, x: F.lpad(x, width[c], " ") if c in numbers else F.rpad(x, width[c], " ")
    head = ["  ".join(c.rjust(width[c]) if c in numbers else c.ljust(width[c]) for c in cells.columns), "  ".join("-" * width[c] for c in cells.columns)]
    body = cells.select(F.rtrim(F.concat_ws("  ", *[pad(c, F.col(c)) for c in cells.columns])).alias("value"))
    return rows.sparkSession.createDataFrame([(h.rstrip(),) for h in head], "value string").unionByName(body)
