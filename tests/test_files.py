"""Files, sinks and streams: exact round trips."""

import json
import subprocess
import sys
import time
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from loam import session
from loam.functions import text as T
from loam.sources import files, sinks
from loam.streaming import ingest


def test_scan_and_cache(spark, tmp_path, rows):
    (tmp_path / "in/.hidden").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_bytes("﻿# MD5: ".encode() + b"0" * 32 + b"\nAlpha")
    (tmp_path / "in/b.txt").write_bytes(b"\xff\xfe bad")
    (tmp_path / "in/.hidden/c.txt").write_text("no")
    found = files.scan(spark, str(tmp_path / "in"))
    texts, rejects = files.as_text(found)
    assert [r.text for r in texts.collect()] == ["Alpha"] and rejects.count() == 1
    manifest = spark.createDataFrame(texts.select("path", F.col("md5").alias("content_md5")).collect())
    fresh, held = files.changed(found, manifest)
    assert fresh.count() == 1 and held.count() == 1


def test_pages(spark):
    x = spark.createDataFrame([("f", b"one\x0c\x0cthree needle here"), ("g", b"boom")], "path string, content binary")

    def pages(content):
        if content == b"boom":
            raise ValueError("broken")
        return [(p.decode(), None) for p in content.split(b"\x0c")]

    paged = files.extract_pages(x, pages)
    f, g = files.joined_pages(paged).orderBy("path").collect()
    assert (f.text, f.pages, f.empty_pages, f.starts) == ("one\n\nthree needle here", 3, 1, [0, 5]) and (g.failed_pages, g.text) == (1, "")
    assert files.find_evidence(paged, "needle", 2).first().page == 3


def test_json_sets(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"name": "n", "queries": [{"id": "1", "prompt": "p"}, {"id": "2", "prompt": " "}]}))
    (tmp_path / "r.json").write_text(json.dumps({"model_name": "m", "query_source": "x/q.json", "results": [{"id": "1", "response": "r"}]}))
    assert [r.id for r in files.read_query_sets(spark, [str(tmp_path / "q.json")] * 2).collect()] == ["1"]
    assert files.read_responses(spark, str(tmp_path / "r.json")).first().query_file == "q.json"


def test_jsonl_and_csv(spark, tmp_path, rows):
    x = spark.createDataFrame([(1, "a\nb"), (2, None)], "k bigint, v string")
    sinks.write_jsonl(x, str(tmp_path / "j"))
    assert rows(files.read_jsonl(spark, str(tmp_path / "j"), "k bigint, v string", "k")) == rows(x)
    sinks.write_csv(x, str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c"), "k bigint, v string").orderBy("k").first().v == "a\\nb"


def test_packed_and_flat(spark, tmp_path):
    packed = spark.createDataFrame([(i, [i, i + 1, i + 2, 7]) for i in range(10)], "sequence_id bigint, input_ids array<int>")
    sinks.write_packed(packed, str(tmp_path / "p"), 4, total=40)
    back = files.read_packed(spark, str(tmp_path / "p"), "sequence_id", "input_ids")
    assert back.schema["input_ids"].metadata["context_length"] == 4 and back.count() == 10
    sinks.write_flat(packed, str(tmp_path / "f"), "uint16")
    flat = files.read_flat(spark, str(tmp_path / "f"), 4)
    assert sorted(r.input_ids for r in flat.collect()) == sorted(r.input_ids for r in packed.collect())


def test_reports(spark, tmp_path):
    x = spark.createDataFrame([(2, "b|c", "test"), (1, "a", "train")], "k bigint, v string, split string")
    assert [r.value for r in sinks.combined(x, "k", "v", markers=True).collect()] == ["<<<DOCUMENT 1>>>\na\n", "<<<DOCUMENT 2>>>\nb|c\n"]
    assert "| 2 | b\\|c | test |" in [r.value for r in sinks.markdown_rows(x).collect()]
    sinks.write_splits(x, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("split = 'test'").count() == 1
    sinks.write_report(x.limit(1), str(tmp_path / "r"))
    sinks.write_texts(x, str(tmp_path / "t"), "k", "v")
    sinks.write_responses(x.withColumn("query_file", F.lit("q")), str(tmp_path / "q"))
    assert (tmp_path / "q/query_file=q").exists()


def test_prompts_line(spark):
    x = spark.createDataFrame([('a, "b, c" ,, d',)], "v string")
    assert x.select(files.parse_prompts(F.col("v"))).first()[0] == ["a", "b, c", "d"]


def test_pages_that_take_too_long(spark):
    x = spark.createDataFrame([("f", b"quick"), ("g", b"slow file"), ("h", b"slow page")], "path string, content binary")

    def pages(content):
        if content == b"slow file":
            time.sleep(30)
        yield ("one", None)
        yield lambda: (time.sleep(30) if content == b"slow page" else None, None)
        yield lambda: ("three", None)

    got = {r.path: [(p.text, (p.error or "").split(":")[0]) for p in r.pages] for r in files.extract_pages(x, pages, timeout=0.5).collect()}
    assert got == {"f": [("one", ""), (None, ""), ("three", "")], "g": [(None, "TimeoutError")], "h": [("one", ""), (None, "TimeoutError"), ("three", "")]}


def test_prose_without_tables(monkeypatch):
    """The extractor against a stand-in for its library: characters inside of a table's box are no prose."""

    class Page:
        def __init__(self, chars, boxes):
            self.chars, self.boxes = chars, boxes

        def find_tables(self):
            return [SimpleNamespace(bbox=b, extract=lambda: [["a", "b|c"], [None, "  "], ["1", None]]) for b in self.boxes]

        def filter(self, test):
            return Page([c for c in self.chars if test(c)], [])

        def extract_text(self):
            return "".join(c["text"] for c in self.chars)

    char = lambda t, x, y: {"object_type": "char", "text": t, "x0": x, "x1": x + 1, "top": y, "bottom": y + 1}
    page = Page([char("P", 0, 0), char("T", 10, 10), char("Q", 30, 0)], [(9, 9, 20, 20)])

    class Open:
        pages = [page, Page([char("R", 0, 0)], [])]

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

    monkeypatch.setitem(sys.modules, "pdfplumber", SimpleNamespace(open=lambda _: Open()))
    assert [p() for p in files.pdf_pages(b"")] == [("PQ\n\n[EXTRACTED TABLES]\n| a | b\\|c |\n| --- | --- |\n| 1 |  |", None), ("R", None)]
    monkeypatch.setitem(sys.modules, "pdfplumber", None)
    with pytest.raises(ImportError, match="pdfplumber"):
        list(files.pdf_pages(b""))


def test_ingest_twice(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one")
    (tmp_path / "in/b.txt").write_text("one")
    for more in (None, "two"):
        if more:
            (tmp_path / "in/c.txt").write_text(more)
        ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "m"), checkpoint=str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "m")).collect()) == ["one", "two"]


def test_ingest_goes_on_in_another_process(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one")
    program = (
        "import sys; from loam.session import local_session; from loam.streaming.ingest import ingest; s = local_session(2, 2, '1g');"
        "q = ingest(s, sys.argv[1], sys.argv[2]); q.awaitTermination(); print('rows', sum(p['numInputRows'] for p in q.recentProgress))"
    )
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "m")).awaitTermination()
    (tmp_path / "in/b.txt").write_text("two")
    run = subprocess.run([sys.executable, "-c", program, str(tmp_path / "in"), str(tmp_path / "m")], capture_output=True, text=True, timeout=300, cwd=Path(__file__).parent.parent)
    assert "rows 1\n" in run.stdout, run.stderr[-2000:]
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "m")).collect()) == ["one", "two"]


def test_a_cluster_needs_a_shared_folder(spark):
    assert session.shared_dir(spark) == session.shared_dir(spark)
    made = session.written(spark.range(3))
    path = made._loam_path.removeprefix("file://")
    assert Path(path).exists()
    after = session.written(made.where("id > 0"), instead_of=made)
    assert not Path(path).exists() and after.count() == 2

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: None)

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "app-1"
            getConf = staticmethod(lambda: {})

            class _jsc:  # noqa: N801
                class Context:
                    class Nothing:
                        isDefined = staticmethod(lambda: False)

                    getCheckpointDir = staticmethod(lambda: Cluster.sparkContext._jsc.Context.Nothing)

                sc = staticmethod(lambda: Cluster.sparkContext._jsc.Context)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster)


def test_stream_windows_equal_batch(spark, tmp_path, rows):
    src = spark.createDataFrame([(i, f"2026-01-01 0{i % 5}:10:00", float(i)) for i in range(20)], "k bigint, ts string, value double").withColumn("ts", F.to_timestamp("ts")).withColumn("kind", F.lit("x"))
    src.write.parquet(str(tmp_path / "e"))
    stream = ingest.windowed(spark.readStream.schema(src.schema).parquet(str(tmp_path / "e")), "ts", "value", "kind")
    q = stream.writeStream.format("memory").queryName("loam_windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("loam_windows")) == rows(ingest.windowed(src, "ts", "value", "kind"))


def test_names(spark):
    x = spark.createDataFrame([("c", "d/e/A b.TXT")], "c string, p string")
    assert x.select(T.suffix("p"), T.stem("p"), T.safe_name(T.stem("p"))).first()[:] == (".txt", "A b", "A_b")
