"""Streams with state: events out of order, silent jobs, repeated requests, restarts, and progress written once."""

import json
import time

import pytest
from pyspark.sql import functions as F

from cloakframe.schemas import TABLES
from cloakframe.sources.store import Conflict, Store
from cloakframe.streaming import protocol as p
from cloakframe.streaming import stateful as s

LINE = "seq long, at long, value string"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    s.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def _page(n, *ids):
    blocks = [{"localId": i, "blockType": "TEXT", "text": "t", "bbox": {"x": 0, "y": 0, "width": 1, "height": 1}, "source": "NATIVE", "readingOrder": k} for k, i in enumerate(ids)]
    return {"pageNo": n, "originalWidth": 1, "originalHeight": 1, "rotation": 0, "sourceType": "NATIVE", "blocks": blocks}


def _line(job, seq, kind, at=None, **more):
    return json.dumps({"seq": seq, "at": seq if at is None else at, "value": json.dumps({"protocolVersion": 1, "type": kind, "jobId": job, "documentId": "d", **more})})


def _put(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / f".{name}").write_text("\n".join(lines) + "\n")
    (folder / f".{name}").rename(folder / f"{name}.json")


def _events(spark, folder):
    return p.parse(spark.readStream.schema(LINE).option("maxFilesPerTrigger", 1).json(f"file://{folder}"))


def _rows(df, folder, name):
    there = df.sparkSession.read.schema(df.schema).parquet(f"file://{folder}/{name}") if list(folder.glob(f"{name}/*.parquet")) else df.sparkSession.createDataFrame([], df.schema)
    return sorted((tuple(r) for r in there.collect()), key=repr)


def _run(df, folder, name, batches=None):
    """Run a stream over what is there, into files; a second call goes on from its checkpoint.

    Streams with timers go on making batches, so those are stopped once ``batches`` are committed.
    """
    w = df.writeStream.format("parquet").option("path", f"file://{folder}/{name}").option("checkpointLocation", f"file://{folder}/{name}-cp")
    if batches is None:
        q = w.trigger(availableNow=True).start()
        q.awaitTermination(100)
    else:
        q, end = w.start(), time.time() + 100
        while q.isActive and time.time() < end and len(list((folder / f"{name}-cp" / "commits").glob("[0-9]*"))) < batches:
            time.sleep(0.5)
        q.stop()
    assert q.exception() is None
    return _rows(df, folder, name)


def test_order_over_batches_and_restart(spark, tmp_path):
    f = tmp_path / "in"
    _put(f, "1", _line("a", 3, "page_result", page=_page(2, "p2")), _line("b", 0, "started"), _line("c", 1, "completed", pageCount=0, processedPages=0))
    _put(f, "2", _line("a", 0, "started"), _line("a", 4, "completed", pageCount=2, processedPages=2), _line("b", 1, "page_result", page=_page(1, "x")), _line("c", 0, "started"))
    out = s.assemble_stream(_events(spark, f))
    first = _run(out, tmp_path, "out", 2)
    assert [(r[0], r[1], r[2], r[4]) for r in first if r[0] == "a"] == []
    assert [(r[1], r[4], r[5]) for r in first if r[0] == "c"] == [("RESULT", "COMPLETED", 0)]
    # what was missing comes behind a restart; a repeated number and events past the end change nothing
    _put(f, "3", _line("a", 2, "page_result", page=_page(1, "p1")), _line("a", 3, "page_result", page=_page(9, "p9")), _line("a", 1, "progress", stage="INSPECT", completed=0, total=1), _line("b", 2, "page_result", page=_page(2, "x")))
    _put(f, "4", _line("a", 5, "page_result", page=_page(3, "p3")), _line("c", 0, "started"), _line("b", 3, "completed", pageCount=2, processedPages=2))
    rows = _run(out, tmp_path, "out", len(list((tmp_path / "out-cp" / "commits").glob("[0-9]*"))) + 3)
    assert sorted(((r[1], r[2], r[4], r[5]) for r in rows if r[0] == "a"), key=repr) == [("PAGE", 1, None, None), ("PAGE", 2, None, None), ("RESULT", None, "COMPLETED", 2)], rows
    # a localId on two pages is a broken job
    assert [(r[4], r[5]) for r in rows if r[0] == "b" and r[1] == "RESULT"] == [("INCOMPLETE", 2)]
    assert len([r for r in rows if r[0] == "c"]) == 1


def test_silent_jobs_end(spark, tmp_path):
    _put(tmp_path / "in", "1", _line("a", 0, "started"), _line("a", 1, "page_result", page=_page(1, "x")))
    out = s.assemble_stream(_events(spark, tmp_path / "in"), silent_ms=500)
    q = out.writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    end = time.time() + 120
    while time.time() < end and not spark.table("silent").filter("kind = 'RESULT'").count():
        time.sleep(1)
    q.stop()
    assert [(r.kind, r.outcome, r.n_pages) for r in spark.table("silent").orderBy("kind").collect()] == [("PAGE", None, None), ("RESULT", "TIMED_OUT", 1)]


def _ask(job, at):
    return _line(job, None, "process_document", at, filePath="f", pageStart=1, ocr=False, detectLayout=True)


def test_a_job_is_active_once(spark, tmp_path):
    f = tmp_path / "in"
    _put(f, "1", _ask("a", 2), _ask("a", 1), _ask("b", 1))
    _put(f, "2", _ask("a", 3), _line("b", 9, "completed", 2, pageCount=0, processedPages=0), _ask("b", 3))
    _put(f, "3", _line("a", 9, "error", 4, code="CANCELLED", message="m", retryable=False), _line("b", 1, "started", 4), _ask("b", 5))
    _put(f, "4", _ask("a", 5), _ask("c", 1))
    lines = spark.readStream.schema(LINE).option("maxFilesPerTrigger", 1).json(f"file://{f}")
    out = s.active_stream(p.valid_requests(lines), p.parse(lines))
    assert _run(out, tmp_path, "out") == [("a", 1, True), ("a", 2, False), ("a", 3, False), ("a", 5, True), ("b", 1, True), ("b", 3, True), ("b", 5, False), ("c", 1, True)]


def _job(i, matter, **more):
    return {"id": i, "document_id": f"d{i}", "job_type": "PARSE", "status": "RUNNING", "progress": 0.0, "created_at": 1, "started_at": 1, "scope": matter} | more


def test_progress_is_written_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    names = [*TABLES["processing_jobs"].names, "scope"]
    jobs = [_job("a", "m1"), _job("b", "m1", status="FAILED", finished_at=2, error_cipher=b"e"), _job("c", "m2"), _job("d", "m3"), _job("e", "m2")]
    schema = TABLES["processing_jobs"].simpleString()[7:-1].replace(":", " ") + ", scope string"
    store.commit({"processing_jobs": spark.createDataFrame([tuple(j.get(n) for n in names) for j in jobs], schema)})
    documents = [{"id": j["document_id"], "matter_id": j["scope"], "file_hash": j["id"], "mime_type": "t", "parse_status": "PARSING", "created_at": 1, "updated_at": 1} for j in jobs]
    store.commit({"documents": spark.createDataFrame([tuple(d.get(n) for n in TABLES["documents"].names) for d in documents], TABLES["documents"].simpleString()[7:-1].replace(":", " "))})
    third = store.manifest()["processing_jobs"]["m3"]
    f = tmp_path / "in"
    _put(f, "1", _line("a", 1, "progress", stage="NATIVE_PARSE", completed=2, total=4), _line("b", 1, "progress", stage="NATIVE_PARSE", completed=4, total=4), _line("none", 1, "completed", pageCount=0, processedPages=0))
    _put(f, "2", _line("a", 2, "progress", stage="NATIVE_PARSE", completed=1, total=4), _line("c", 3, "completed", pageCount=1, processedPages=1), _line("e", 1, "error", code="OCR_ENGINE_FAILURE", message="m", retryable=True))
    write, calls = s.progress_sink(store, "worker", lambda: 50, lambda v, i: F.concat_ws(":", i, v).cast("binary")), []

    def lost(batch, number):
        write(batch, number)
        calls.append((number, store.version()))
        if len(calls) == 1:
            raise RuntimeError("the acknowledgement is lost")

    def run():
        q = _events(spark, f).writeStream.foreachBatch(lost).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        try:
            q.awaitTermination(200)
        except Exception:  # the first run is meant to fail
            pass
        return q.exception()

    assert run() is not None and store.batch("worker") == 0
    assert run() is None and store.batch("worker") == 1
    # the first batch came twice and was committed once
    assert [n for n, _ in calls] == [0, 0, 1] and calls[0][1] == calls[1][1] == calls[2][1] - 1
    got = {r.id: (r.status, r.progress, r.finished_at) for r in store.read("processing_jobs").collect()}
    assert got == {"a": ("RUNNING", 0.5, None), "b": ("FAILED", 0.0, 2), "c": ("COMPLETED", 1.0, 50), "d": ("RUNNING", 0.0, None), "e": ("FAILED", 0.0, 50)}
    assert bytes(store.find("processing_jobs", "id", ["e"]).first().error_cipher) == b"e:OCR_ENGINE_FAILURE"
    assert store.manifest()["processing_jobs"]["m3"] == third
    with pytest.raises(Conflict):
        store.commit(batch=("worker", 1))
