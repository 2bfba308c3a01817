"""Files in pieces: digests by chunks, and pages by ranges."""

import hashlib
import sys
import unicodedata

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cloakframe.functions.normalize import nfkc
from cloakframe.sources import files

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks cannot import this module


def test_digests(spark, tmp_path):
    sizes = {"one.pdf": 2, "a b%20c.PNG": 1, "ünï.docx": files.CHUNK, "more.bin": 3 * files.CHUNK + 7}
    (tmp_path / "in" / "below").mkdir(parents=True)
    for k, (name, n) in enumerate(sizes.items()):
        (tmp_path / "in" / ("below" if k % 2 else ".") / name).write_bytes(bytes(i % 251 for i in range(n)))
    got = {r.original_name: r for r in files.inspect(spark, f"file://{tmp_path}/in").collect()}
    assert {n: (r.byte_size, r.file_hash) for n, r in got.items()} == {n: (k, hashlib.sha256(bytes(i % 251 for i in range(k))).hexdigest()) for n, k in sizes.items()}
    assert got["a b%20c.PNG"].mime_type == "image/png"


def test_a_file_above_two_gigabytes(spark, tmp_path):
    with open(tmp_path / "sparse.bin", "wb") as f:
        f.truncate((2 << 30) + 5)
    row = files.inspect(spark, f"file://{tmp_path}/sparse.bin").first()
    h = hashlib.sha256()
    for _ in range(32):
        h.update(bytes(64 << 20))
    h.update(bytes(5))
    assert (row.byte_size, row.file_hash) == ((2 << 30) + 5, h.hexdigest())


class Box:
    def __init__(self, *inner, **more):
        self.inner, self.x0, self.y0, self.x1, self.y1 = inner, 0, 0, 1, 1
        self.__dict__.update(more)

    def __iter__(self):
        return iter(self.inner)


class Words(Box):
    def get_text(self):
        return "t"


class Image:
    x0, y0, x1, y1 = 0, 0, 1, 1


class Lines:
    """A page is a line of the file; what is opened is written down."""

    def __init__(self, log):
        self.log = log

    def count(self, file):
        return len(file.read().splitlines())

    def layouts(self, file, numbers):
        import uuid

        lines = file.read().splitlines()
        with open(f"{self.log}/{uuid.uuid4().hex}", "w") as out:
            out.write(lines[0].decode()[0] + ":" + ",".join(map(str, numbers)))
        for n in numbers:
            yield Box(Box(Words()), Image(), width=1, height=2, rotate=int(lines[n - 1].split()[-1]))

    def kinds(self):
        return Box, Words, Image


def test_tasks_open_their_pages_only(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "log").mkdir()
    (tmp_path / "in" / "a.pdf").write_text("\n".join(f"a {90 * k}" for k in range(11)))
    (tmp_path / "in" / "b.pdf").write_text("b 450")
    (tmp_path / "in" / "none.pdf").write_text("")
    source, path = files.PagedSource(Lines(str(tmp_path / "log")), 4), f"file://{tmp_path}/in"

    def run(at, *more):
        rows = source.pages(spark, at, *more).collect()
        said = sorted(f.read_text() for f in (tmp_path / "log").iterdir())
        for f in (tmp_path / "log").iterdir():
            f.unlink()
        return sorted((r.path[-5], r.page_no, r.rotation, [i["kind"] for i in r["items"]]) for r in rows), said

    both = ["text", "image"]
    rows, said = run(path)
    assert rows == [*[("a", k + 1, 90 * k % 360, both) for k in range(11)], ("b", 1, 90, both)]
    assert said == ["a:1,2,3,4", "a:5,6,7,8", "a:9,10,11", "b:1"]
    rows, said = run(f"{path}/a.pdf", 6, 99)
    assert [r[1] for r in rows] == [6, 7, 8, 9, 10, 11] and said == ["a:10,11", "a:6,7,8,9"]
    rows, said = run(f"{path}/a.pdf", 3, 3)
    assert [r[1] for r in rows] == [3] and said == ["a:3"]
    assert run(f"{path}/none.pdf") == ([], [])
    with pytest.raises(Exception, match="INVALID_REQUEST"):
        source.pages(spark, f"{path}/b.pdf", 2).collect()
    with pytest.raises(ValueError):
        source.pages(spark, path, 3, 2)


def test_normal_form(spark):
    values = [None, "", "plain", "Ａｂｃ１", "é", "é", "ﬁ", "①", "ｶﾞ", "À", "가"] * 2
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(nfkc(F.col("v"))).collect()]
    assert got == [None if v is None else unicodedata.normalize("NFKC", v) for v in values]
    assert [r[0] for r in spark.createDataFrame([("a",), (None,)], "v string").select(nfkc(F.col("v"))).collect()] == ["a", None]
