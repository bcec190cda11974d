"""Scans of files: texts, documents with pages, JSON sets, packed sequences, flat binaries."""

from __future__ import annotations

import functools
import io
import signal
import threading
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.session import map_arrow

PAGES = "array<struct<page_number:int,text:string,error:string>>"
QUERY_FIELDS = "id string, category string, evaluation_type string, prompt string, expected_continuation string, expected_concepts array<string>, source_file string, source_document string"
RESULT_FIELDS = "id string, category string, prompt string, response string, expected_concepts array<string>"


def _visible(path) -> F.Column:
    """No part of the path begins with a dot."""
    return ~F.col(path).rlike(r"(?:^|/)\.[^/.]")


def scan(spark: SparkSession, root: str, pattern: str = "*.{txt,pdf}", recursive: bool = True, exclude: list[str] | None = None) -> DataFrame:
    """(path, bytes, content, content_md5, content_sha256) of the files under a folder or of one file; hidden parts are skipped.

    ``exclude`` lists paths that are left out.  The order of files is that of their paths.
    """
    x = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(root)
    x = x.where(_visible("path")).select("path", F.col("length").alias("bytes"), "content", F.md5("content").alias("content_md5"), F.sha2("content", 256).alias("content_sha256"))
    return x.where(~F.col("path").isin(exclude)) if exclude else x


def as_text(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts (path, md5, text) of valid UTF-8 files without byte order mark and digest header, and rejects (path, reason)."""
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    body = T.strip_digest_header(T.strip_bom(F.col("content").cast("string")))
    return files.where(valid).select("path", F.col("content_md5").alias("md5"), body.alias("text")), files.where(~valid).select("path", F.lit("not valid UTF-8").alias("reason"))


def changed(files: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to read, rows of the manifest (path, content_md5, ...) that still hold): a file is read again only if its digest is new."""
    known = ["path", "content_md5"]
    return files.join(manifest.select(*known), known, "left_anti"), manifest.join(files.select(*known), known, "left_semi")


def _within(seconds: float | None, f: Callable, x):
    """``f(x)``, or TimeoutError after so many seconds (in a worker's main thread, where the signal arrives)."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        return f(x)

    def late(*_):
        raise TimeoutError(f"not done within {seconds:g} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return f(x)
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def extract_pages(files: DataFrame, extractor: Callable[[bytes], Iterable], timeout: float | None = None) -> DataFrame:
    """(path, pages): a pluggable extractor gives, for each page, (text, error) or a function that makes them.

    A failing file has one page with its error.  ``timeout`` is the seconds that a file's extractor, and each page
    given as a function, may take: a page that takes longer has an error and the others stand.
    """

    def page(p):
        try:
            return _within(timeout, lambda f: f(), p) if callable(p) else p
        except Exception as e:  # noqa: BLE001 - one bad page must not end the file
            return None, f"{type(e).__name__}: {e}"

    def run(batches):
        for b in batches:
            out = []
            for content in b.column(1).to_pylist():
                try:
                    found, pages = [], iter(_within(timeout, extractor, content))
                    while (p := _within(timeout, lambda it: next(it, None), pages)) is not None:  # page by page: what made them may be open
                        found.append(page(p))
                    out.append([{"page_number": n, "text": t, "error": e} for n, (t, e) in enumerate(found, 1)])
                except Exception as e:  # noqa: BLE001 - one bad file must not end the scan
                    out.append([{"page_number": 0, "text": None, "error": f"{type(e).__name__}: {e}"}])
            kind = pa.list_(pa.struct([("page_number", pa.int32()), ("text", pa.string()), ("error", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["path", "pages"])

    return map_arrow(files.select("path", "content"), run, f"path string, pages {PAGES}")


def boxes_overlap(a: tuple, b: tuple) -> bool:
    """Whether two boxes (left, top, right, bottom) share an area."""
    return a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]


def pdf_pages(content: bytes, tables: str = "[EXTRACTED TABLES]") -> Iterator[Callable[[], tuple[str, None]]]:
    """An extractor of PDF files: the prose of each page without what lies in its tables, then the tables as Markdown after a marker line.

    Needs the library pdfplumber on the executors, which nothing else here does.
    """
    try:
        import pdfplumber
    except ImportError as e:
        raise ImportError("pdf_pages needs pdfplumber") from e

    def made(p):
        grids = p.find_tables()
        boxes = [g.bbox for g in grids]
        prose = p.filter(lambda o: o.get("object_type") != "char" or not any(boxes_overlap((o["x0"], o["top"], o["x1"], o["bottom"]), x) for x in boxes)) if boxes else p
        parts = [prose.extract_text() or ""]
        rows = [t for t in (_markdown(g.extract()) for g in grids) if t]
        return "\n\n".join([*parts, *([tables + "\n" + "\n\n".join(rows)] if rows else [])]), None

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        pages = list(pdf.pages)
        yield from (functools.partial(made, p) for p in pages)


def _markdown(grid: list[list[str | None]]) -> str:
    rows = [[" ".join((c or "").split()).replace("|", "\\|") for c in r] for r in grid if r and any(c and c.strip() for c in r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def joined_pages(paged: DataFrame, key: str = "path") -> DataFrame:
    """(key, text, pages, empty_pages, failed_pages, starts): filled pages joined by a blank line, with where each begins."""
    full = F.filter(F.transform("pages", lambda p: T.strip(F.coalesce(p["text"], F.lit("")))), lambda t: t != "")
    starts = F.aggregate("_f", F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + F.length(t) + 2)), lambda a: F.slice(a, 1, F.size("_f")))
    x = paged.withColumn("_f", full)
    return x.select(
        key, F.array_join("_f", "\n\n").alias("text"), F.size("pages").alias("pages"), (F.size("pages") - F.size("_f")).alias("empty_pages"),
        F.size(F.filter("pages", lambda p: p["error"].isNotNull())).alias("failed_pages"), F.when(F.size("_f") > 0, starts).otherwise(F.array().cast("array<int>")).alias("starts"),
    )


def find_evidence(paged: DataFrame, pattern: str, first_page: int = 1, before: int = 220, after: int = 520, key: str = "path") -> DataFrame:
    """(key, page, excerpt): the first page from ``first_page`` on with a match, and the text around it."""
    x = paged.select(key, F.explode("pages").alias("p")).where((F.col("p.page_number") >= first_page) & F.col("p.text").rlike(pattern))
    x = x.groupBy(key).agg(F.min_by("p", F.col("p.page_number")).alias("p"))
    at = F.regexp_instr("p.text", F.lit(pattern))
    a = F.greatest(F.lit(1), at - before)
    return x.select(key, F.col("p.page_number").alias("page"), T.squeeze(F.substr("p.text", a, at + after - a)).alias("excerpt"))


def read_query_sets(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """One row a query of JSON files with a list 'queries', with the file's name; queries without prompt are left out; a path given twice counts once."""
    paths = sorted(set([paths] if isinstance(paths, str) else paths))
    x = spark.read.option("multiLine", "true").schema(f"name string, queries array<struct<{_fields(QUERY_FIELDS)}>>").json(paths)
    return x.select(T.file_name(F.input_file_name()).alias("query_file"), "name", F.explode("queries").alias("q")).select("query_file", "name", "q.*").where(T.strip(F.coalesce("prompt", F.lit(""))) != "")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """One row a result of response files, with file, stage, model and source of the queries."""
    x = spark.read.option("multiLine", "true").schema(f"evaluation_stage string, timestamp_utc string, model_name string, query_source string, results array<struct<{_fields(RESULT_FIELDS)}>>").json(path)
    return x.select(T.file_name(F.input_file_name()).alias("response_file"), "evaluation_stage", "timestamp_utc", "model_name", T.file_name("query_source").alias("query_file"), F.explode("results").alias("r")).select(
        "response_file", "evaluation_stage", "timestamp_utc", "model_name", "query_file", "r.*"
    )


def _fields(schema: str) -> str:
    return ",".join(f.strip().replace(" ", ":", 1) for f in schema.split(", "))


def read_jsonl(spark: SparkSession, path: str, schema: str, unique: str | None = None) -> DataFrame:
    """JSON lines of a fixed schema; with ``unique`` a repeated key is an error."""
    x = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if unique and x.groupBy(unique).count().where("count > 1").limit(1).count():
        raise ValueError(f"{path}: {unique} repeats")
    return x


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def read_packed(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Packed sequences, only the columns asked for."""
    x = spark.read.parquet(path)
    return x.select(*columns) if columns else x


def read_flat(spark: SparkSession, path: str, length: int, dtype: str = "uint16") -> DataFrame:
    """(path, sample, input_ids): flat binary files cut into samples of ``length`` ids; a rest is dropped."""

    def run(batches):
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(content, np.dtype(dtype).newbyteorder("<")).astype(np.int64)
                n = len(ids) // length
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * length), pa.array(ids[: n * length]))
                yield pa.RecordBatch.from_arrays([pa.array([p] * n, pa.string()), pa.array(np.arange(n)), lists], names=["path", "sample", "input_ids"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return map_arrow(files, run, "path string, sample bigint, input_ids array<bigint>")


def parse_prompts(value: F.Column) -> F.Column:
    """array<string>: the prompts of one line of comma-separated values, quotes respected, blanks dropped."""
    cells = F.regexp_extract_all(value, F.lit(r'([ \t]*"(?:[^"]|"")*"[ \t]*|[^,]+)'), 1)
    bare = F.transform(cells, lambda c: T.strip(F.replace(T.sub(T.strip(c), r'^"|"$'), F.lit('""'), F.lit('"'))))
    return F.filter(bare, lambda c: c != "")
