"""The worker protocol on batches and on a stream."""

import json

import pytest

from cloakframe.sources import files
from cloakframe.streaming import protocol as p


def _event(kind, job="j1", **more):
    return json.dumps({"protocolVersion": 1, "type": kind, "jobId": job, "documentId": "d" + job[1:], **more})


def _page(n, ids=("a", "b"), **more):
    block = lambda i: {"localId": i, "blockType": "TEXT", "text": "t", "bbox": {"x": 0, "y": 0, "width": 1, "height": 0.5}, "source": "NATIVE", "readingOrder": 0}
    return {"pageNo": n, "originalWidth": 10, "originalHeight": 20, "rotation": 0, "sourceType": "NATIVE", "blocks": [block(i) for i in ids], **more}


def _lines():
    return [
        _event("started"),
        _event("page_result", page=_page(1)),
        _event("progress", stage="OCR", completed=1, total=2),
        _event("page_result", page=_page(2)),
        _event("completed", pageCount=2, processedPages=2),
        _event("page_result", "j2", page=_page(2)),
        _event("completed", "j2", pageCount=2, processedPages=2),
        _event("page_result", "j3", page=_page(1, ("a", "a"))),
        _event("completed", "j3", pageCount=1, processedPages=1),
        _event("cancelled", "j4", lastCompletedPage=0),
        _event("error", "j5", code="INTERNAL_ERROR", message="m", retryable=True),
        _event("started", "j6"),
    ]


WANT = {"j1": "COMPLETED", "j2": "INCOMPLETE", "j3": "INCOMPLETE", "j4": "CANCELLED", "j5": "FAILED"}


def test_validity(spark):
    bad = ["", "{", "[]", _event("started").replace(": 1,", ": 2,"), _event("unknown"), _event("progress", stage="PAINT", completed=0, total=1), _event("progress", stage="OCR", completed=0, total=0), _event("error", code="X", message="m", retryable=True), _event("completed", pageCount=-1, processedPages=0), _event("page_result", page=_page(0)), _event("page_result"), _event("started", "")]
    off = _page(1)
    off["blocks"][0]["bbox"]["x"] = 0.5
    bad.append(_event("page_result", page=off))
    df = spark.createDataFrame([(x, False) for x in bad] + [(x, True) for x in _lines()], "value string, want boolean")
    assert p.parse(df).filter("valid <> want").collect() == []


def test_requests(spark):
    base = {"protocolVersion": 1, "type": "process_document", "jobId": "j", "documentId": "d", "filePath": "f", "pageStart": 1, "pageEnd": None, "ocr": False, "detectLayout": True}
    rows = [(json.dumps(base | x), w) for x, w in (({}, True), ({"pageEnd": 3}, True), ({"pageStart": 0}, False), ({"pageStart": 4, "pageEnd": 3}, False), ({"ocr": None}, False), ({"type": "cancel_job"}, True), ({"jobId": ""}, False), ({"protocolVersion": 3}, False))]
    got = [r.valid for r in p.valid_requests(spark.createDataFrame([(v,) for v, _ in rows], "value string")).collect()]
    assert got == [w for _, w in rows]


def test_results_and_routing(spark):
    df = p.parse(spark.createDataFrame(list(enumerate(_lines())), "seq int, value string"))
    got = {r.jobId: r for r in p.job_results(df).collect()}
    assert {k: r.outcome for k, r in got.items()} == WANT | {"j6": "RUNNING"}
    assert (got["j1"].n_pages, got["j1"].last_stage, got["j1"].last_completed) == (2, "OCR", 1)
    jobs = spark.createDataFrame([("j1", "d1"), ("j2", "other")], "job_id string, document_id string")
    problems = {(r.jobId, r.problem) for r in p.route(df, jobs).collect()}
    assert problems == {("j1", None), ("j2", "WRONG_DOCUMENT"), *((f"j{k}", "UNKNOWN_JOB") for k in (3, 4, 5, 6))}


def test_a_mismatch_fails_the_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text(_event("started") + "\n" + _event("started", "j9") + "\n")
    jobs = spark.createDataFrame([("j1", "d1")], "job_id string, document_id string")
    out = p.strict(p.route(p.parse(p.read_lines(spark, f"file://{tmp_path}/in")), jobs)).select("jobId")
    q = out.writeStream.format("memory").queryName("refused").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="UNKNOWN_JOB j9"):
        q.awaitTermination(120)
        raise q.exception()
    batch = p.route(p.parse(spark.createDataFrame([(_event("started"),)], "value string")), jobs)
    assert p.strict(batch).count() == 1


def test_first_request_is_the_active_one(spark):
    base = {"protocolVersion": 1, "type": "process_document", "jobId": "j", "documentId": "d", "filePath": "f", "pageStart": 1, "ocr": False, "detectLayout": True}
    rows = [(3, json.dumps(base | {"filePath": "late"})), (1, json.dumps(base | {"filePath": "first"})), (2, json.dumps(base | {"jobId": "k"})), (0, json.dumps(base | {"pageStart": 0}))]
    df = spark.createDataFrame(rows, "seq int, value string")
    got = p.active_once(p.valid_requests(df)).collect()
    assert {(r.seq, r.filePath, r.active) for r in got} == {(1, "first", True), (3, "late", False), (2, "f", True)}


def test_worker(spark):
    item = ("text", " hello ", 1.0, 1.0, 5.0, 2.0)
    pages = spark.createDataFrame([("f", n, 10.0, 20.0, 450 if n == 2 else 0, [item] if n != 3 else []) for n in (1, 2, 3)], files.PAGE)
    ask = lambda job, start=1, end=None, path="f": (job, "d" + job, path, start, end)
    asked = [ask("a"), ask("b", 2, 9), ask("c", 4), ask("d", path="none"), ask("e"), ask("e", 2), ask("g"), ask("h", 2, 2)]
    base = {"protocolVersion": 1, "type": "process_document", "ocr": False, "detectLayout": True}
    lines = [(i, json.dumps(base | dict(zip(("jobId", "documentId", "filePath", "pageStart", "pageEnd"), x, strict=True)))) for i, x in enumerate(asked)]
    requests = p.valid_requests(spark.createDataFrame(lines, "seq int, value string"))
    cancels = spark.createDataFrame([("e", 1), ("g", 0), ("a", 7)], "jobId string, after int")
    events = p.in_order(p.parse(p.serve(requests, pages, cancels)))
    rows = events.collect()
    assert all(r.valid for r in rows)
    kinds = lambda j: [r.type for r in sorted((r for r in rows if r.jobId == j), key=lambda r: r.seq)]
    assert kinds("a") == ["started", "progress"] + ["page_result", "progress"] * 3 + ["progress", "completed"]
    assert kinds("b") == ["started", "progress"] + ["page_result", "progress"] * 2 + ["progress", "completed"]
    assert kinds("c") == kinds("d") == ["started", "progress", "error"] and kinds("g") == ["started", "progress", "cancelled"]
    assert sorted(kinds("e")) == sorted(["started", "progress", "page_result", "progress", "cancelled", "error"])
    last = {r.jobId: r for r in rows if r.type in p.TERMINAL}
    assert last["c"].code == "INVALID_REQUEST" and last["d"].code == "FILE_NOT_FOUND" and last["g"].lastCompletedPage == 0
    assert (last["b"].pageCount, last["b"].processedPages, last["h"].processedPages) == (3, 2, 1)
    page = next(r.page for r in rows if r.jobId == "b" and r.type == "page_result" and r.page.pageNo == 2)
    assert page.rotation == 90 and page.blocks[0].text == "hello" and page.sourceType == "NATIVE"
    results = {r.jobId: r.outcome for r in p.job_results(events).collect()}
    assert results["a"] == "COMPLETED" and results["c"] == "FAILED" and results["g"] == "CANCELLED"


def test_polling_ends_with_the_stage():
    seen, slept = iter(["DETECTING", "DETECTING", "DETECTED", "never"]), []
    assert list(p.poll(lambda: next(seen), sleep=slept.append)) == ["DETECTING", "DETECTING", "DETECTED"] and slept == [1.0, 1.0]
