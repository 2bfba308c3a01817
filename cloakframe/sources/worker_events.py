"""Workers' event files as a Spark data source: ``spark.read.format("worker_events")`` and ``readStream``.

A folder holds files of JSON lines to which workers append.  The batch reader cuts files
into byte ranges, one partition each; a line belongs to the range it begins in.  The stream
reader's offset is the bytes read of each file, up to the last whole line, so that a stream
that starts again goes on behind the last byte that it has committed; a line that is still
being written waits.  Equality filters on ``jobId`` and ``type`` are taken over by the
reader, if ``spark.sql.python.filterPushdown.enabled`` lets Spark offer them.

Lines that are no JSON object have null ``jobId`` and ``type`` and stay, as it is for
``protocol.parse`` to refuse them; empty lines are none.  The same line twice is two rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

from cloakframe.sources.files import opened

#: Bytes of a file that one task reads.
RANGE = 32 << 20
SCHEMA = "file string, at long, value string, jobId string, type string"
_FIELDS = ("jobId", "type")


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int

    def __init__(self, file: str, start: int, end: int) -> None:
        super().__init__((file, start, end))
        self.file, self.start, self.end = file, start, end


def _sizes(path: str) -> dict[str, int]:
    """Files of a folder and their bytes; names that begin with a dot or an underscore are none."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if not rest or scheme == "file":
        where, system = "/" + (rest or path).lstrip("/"), fs.LocalFileSystem()
        prefix = "file:"
    else:
        system, where = fs.FileSystem.from_uri(path)
        prefix = path[: path.index(where.lstrip("/"))]
    found = system.get_file_info(fs.FileSelector(where))
    return {f"{prefix}{f.path}": f.size for f in found if f.is_file and not f.base_name.startswith((".", "_"))}


def _whole(file: str, start: int, end: int) -> int:
    """The end of the last whole line up to ``end``, or ``start`` if none ends there."""
    step = 1 << 16
    with opened(file) as f:
        at = end
        while at > start:
            low = max(start, at - step)
            f.seek(low)
            k = f.read(at - low).rfind(b"\n")
            if k >= 0:
                return low + k + 1
            at = low
    return start


def _lines(part: Range, wanted: dict[str, str], open_end: bool) -> Iterator[tuple]:
    """Rows of the lines that begin in a range; ``open_end``: the range's end may lie inside a line, which then belongs to it."""
    with opened(part.file) as f:
        at = part.start
        f.seek(at)
        if open_end and at:
            f.seek(at - 1)
            at = at - 1 + len(_line(f))
        while at < part.end:
            line = _line(f)
            if not line:
                return
            here, at = at, at + len(line)
            value = line.rstrip(b"\r\n").decode("utf-8", "replace")
            if not value:
                continue
            try:
                told = json.loads(value)
            except ValueError:
                told = None
            fields = [told.get(k) if isinstance(told, dict) and isinstance(told.get(k), str) else None for k in _FIELDS]
            if all(fields[_FIELDS.index(k)] == v for k, v in wanted.items()):
                yield (part.file, here, value, *fields)


def _line(f) -> bytes:
    """The next line with its end, in pieces, as such files have no readline."""
    out = b""
    place = f.tell()
    while piece := f.read(1 << 14):
        k = piece.find(b"\n")
        if k >= 0:
            out += piece[: k + 1]
            f.seek(place + len(out))
            return out
        out += piece
    return out


class _Batch(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size, self.wanted = path, size, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for x in filters:
            if isinstance(x, EqualTo) and len(x.attribute) == 1 and x.attribute[0] in _FIELDS and isinstance(x.value, str) and x.attribute[0] not in self.wanted:
                self.wanted[x.attribute[0]] = x.value
            else:
                yield x

    def partitions(self) -> Sequence[InputPartition]:
        return [Range(f, a, min(a + self.size, n)) for f, n in sorted(_sizes(self.path).items()) for a in range(0, n, self.size)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return _lines(partition, self.wanted, True)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size
        self.last: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for f, n in _sizes(self.path).items():
            before = self.last.get(f, 0)
            if n > before:
                self.last[f] = _whole(f, before, n)
        return {f: n for f, n in sorted(self.last.items()) if n}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        # ranges begin and end with lines, or lie inside such a range
        return [Range(f, a, min(a + self.size, n)) for f, n in end.items() for a in range(start.get(f, 0), n, self.size)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return _lines(partition, {}, True)

    def commit(self, end: dict) -> None:
        """Files stay; what has been read is in the checkpoint."""


class WorkerEvents(DataSource):
    """Options: ``path`` of the folder; ``rangeBytes``, the bytes of a file that one task reads."""

    @classmethod
    def name(cls) -> str:
        return "worker_events"

    def schema(self) -> str:
        return SCHEMA

    def _asked(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("rangeBytes", RANGE))

    def reader(self, schema: StructType) -> _Batch:
        return _Batch(*self._asked())

    def streamReader(self, schema: StructType) -> _Stream:
        return _Stream(*self._asked())


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let Spark offer filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkerEvents)
