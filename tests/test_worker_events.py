"""The data source of event files, at once and as a stream that is started again."""

import json

import pytest

from cloakframe.sources import worker_events as w
from cloakframe.streaming import protocol as p


@pytest.fixture(autouse=True)
def known(spark):
    w.register(spark)


def _event(job, kind="started", **more):
    return json.dumps({"protocolVersion": 1, "type": kind, "jobId": job, "documentId": "d", **more}, ensure_ascii=False)


@pytest.mark.parametrize("size", [1, 7, 50, 1 << 20])
def test_ranges_hold_each_line_once(tmp_path, size):
    lines = [_event(f"é{k}") for k in range(9)] + ["", "{", "[]", "x" * 200]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "_skipped").write_text("no")
    reader = w._Batch(f"file://{tmp_path}", size)
    rows = [r for part in reader.partitions() for r in reader.read(part)]
    assert [r[2] for r in rows] == [x for x in lines if x]
    assert [r[3] for r in rows][:2] == ["é0", "é1"] and [r[3:] for r in rows][-3:] == [(None, None)] * 3


def test_batch_and_filters(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(_event(f"j{k % 3}", "started" if k % 2 else "error") for k in range(12)) + "\n")
    (tmp_path / "b.jsonl").write_text(_event("j1") + "\n{\n")
    df = spark.read.format("worker_events").option("rangeBytes", "100").load(f"file://{tmp_path}")
    assert df.count() == 14 and df.rdd.getNumPartitions() > 4
    some = df.filter("jobId = 'j1' and type = 'started' and at >= 0")
    assert some.count() == 3
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert "jobId" not in plan.split("RelationV2")[0] or "= j1" not in plan.split("RelationV2")[0]
    assert {r.jobId for r in p.parse(df.select("value")).filter("valid").collect()} == {"j1"}


def test_stream_goes_on_behind_its_last_byte(spark, tmp_path):
    (tmp_path / "in").mkdir()
    a, b = tmp_path / "in" / "a.jsonl", tmp_path / "in" / "b.jsonl"
    a.write_text(_event("j1") + "\n" + _event("j2") + "\n" + _event("half")[:10])
    df = spark.readStream.format("worker_events").option("rangeBytes", "60").load(f"file://{tmp_path}/in")

    def run():
        q = df.select("jobId", "at").writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
        return sorted(r.jobId for r in spark.read.schema("jobId string, at long").parquet(f"file://{tmp_path}/out").collect())

    assert run() == ["j1", "j2"]
    # the line that was not whole yet, a new file, and nothing twice after a restart
    with open(a, "a") as f:
        f.write(_event("half")[10:] + "\n")
    b.write_text(_event("j3") + "\n")
    assert run() == ["half", "j1", "j2", "j3"]
    assert run() == ["half", "j1", "j2", "j3"]
