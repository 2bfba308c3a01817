"""Streams of worker events with state: reordering, silent jobs, repeated requests, and progress written exactly once.

State is kept by job with ``transformWithStateInPandas``: a map of waiting events by their
number, what has been seen, and a timer.  It needs the RocksDB state store, which
``use_rocksdb`` sets for the session before such a stream starts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cloakframe.operators import integrity as I
from cloakframe.sources.store import Store, settled
from cloakframe.streaming.protocol import TERMINAL, add_page

RESULT = "jobId string, kind string, page_no int, page string, outcome string, n_pages int"
_NAMES = ["jobId", "kind", "page_no", "page", "outcome", "n_pages"]
#: Milliseconds after which a job that says nothing is ended.
SILENT_MS = 600_000
#: What a job has waiting, apart from its place.
_EVENT = "type string, page_no int, page string, page_count int, processed int"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that maps and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES).astype({"page_no": "Int32", "n_pages": "Int32"})


def _whole(x: float | None) -> int | None:
    return None if pd.isna(x) else int(x)


class Assembly(StatefulProcessor):
    """Events of a job in the order of their numbers, whatever batch brings them.

    An event waits until all before it have come.  Pages go out as their turn comes; the
    last event gives the job's result and leaves only a mark that it has ended, which a
    timer clears.  A job that is silent for ``silent_ms`` ends as TIMED_OUT.  A number that
    comes again, and events after the end, change nothing.
    """

    def __init__(self, silent_ms: int, first: int) -> None:
        self.silent_ms, self.first = silent_ms, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "seq long", _EVENT)
        self.local = handle.getMapState("local", "id string", "page int")
        self.place = handle.getValueState("place", "next long, ranges string, broken boolean, ended boolean")

    def handleInputRows(self, key: tuple[str], rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, ranges, broken, ended = self._place()
        if ended:
            for _ in rows:  # read to the end
                pass
            return
        for frame in rows:
            for r in frame.itertuples(index=False):
                if r.seq >= at and not self.waiting.containsKey((int(r.seq),)):
                    self.waiting.updateValue((int(r.seq),), (r.type, _whole(r.page_no), r.page, _whole(r.page_count), _whole(r.processed)))
        out: list[tuple] = []
        while not ended and self.waiting.containsKey((at,)):
            kind, page_no, page, page_count, processed = self.waiting.getValue((at,))
            self.waiting.removeKey((at,))
            at += 1
            if kind == "page_result":
                broken = not add_page(ranges, page_no) or self._repeated(page, page_no) or broken
                out.append((key[0], "PAGE", page_no, page, None, None))
            elif kind in TERMINAL:
                n = sum(hi - lo + 1 for lo, hi in ranges)
                whole = kind == "completed" and not broken and ranges == ([[1, n]] if n else []) and page_count == processed == n
                out.append((key[0], "RESULT", None, None, {"cancelled": "CANCELLED", "error": "FAILED"}.get(kind, "COMPLETED" if whole else "INCOMPLETE"), n))
                ended = True
        self._clear_timers()
        if ended:
            self.waiting.clear()
            self.local.clear()
        self.place.update((at, json.dumps([] if ended else ranges), bool(broken), ended))
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)
        yield _frame(out)

    def handleExpiredTimer(self, key: tuple[str], timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, ranges, _, ended = self._place()
        if ended:  # long enough for what was still on its way
            self.place.clear()
            return
        self.waiting.clear()
        self.local.clear()
        self.place.update((0, "[]", False, True))
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)
        yield _frame([(key[0], "RESULT", None, None, "TIMED_OUT", sum(hi - lo + 1 for lo, hi in ranges))])

    def close(self) -> None:
        pass

    def _place(self) -> tuple[int, list[list[int]], bool, bool]:
        if not self.place.exists():
            return self.first, [], False, False
        at, ranges, broken, ended = self.place.get()
        return at, json.loads(ranges), broken, ended

    def _repeated(self, page: str, page_no: int) -> bool:
        """Whether a block's localId has come before, on this page or another; remembers the new ones."""
        again = False
        for b in json.loads(page).get("blocks", []):
            if self.local.containsKey((b["localId"],)):
                again = True
            else:
                self.local.updateValue((b["localId"],), (page_no,))
        return again

    def _clear_timers(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)


def assemble_stream(events: DataFrame, seq: str = "seq", silent_ms: int = SILENT_MS, first: int = 0) -> DataFrame:
    """(jobId, kind, page_no, page, outcome, n_pages): pages in order as they come, then each job's result.

    ``events``: rows of ``protocol.parse`` with each job's running number ``seq`` from
    ``first`` on.  A reader takes the pages of jobs with a good result.  As timers go by the
    clock, such a stream makes batches without data too and does not end by itself.
    """
    slim = events.filter("valid").select("jobId", "type", F.col(seq).cast("long").alias("seq"), F.col("page.pageNo").alias("page_no"), F.to_json("page").alias("page"), F.col("pageCount").alias("page_count"), F.col("processedPages").alias("processed"))
    return slim.filter("seq is not null").groupBy("jobId").transformWithStateInPandas(Assembly(silent_ms, first), RESULT, "append", "processingTime")


class OpenJobs(StatefulProcessor):
    """Whether a job may start: not while an earlier request of it is open."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "since long")

    def handleInputRows(self, key: tuple[str], rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        since = self.open.get()[0] if self.open.exists() else None
        for r in sorted((r for f in rows for r in f.itertuples(index=False)), key=lambda r: (r.at, r.request)):
            if not r.request:
                since = None
            else:
                out.append((key[0], int(r.at), since is None))
                since = int(r.at) if since is None else since
        if since is None:
            self.open.clear()
        else:
            self.open.update((since,))
        yield pd.DataFrame(out, columns=["jobId", "at", "active"])

    def close(self) -> None:
        pass


def active_stream(requests: DataFrame, events: DataFrame, at: str = "at") -> DataFrame:
    """(jobId, at, active) of each valid request to process: refused while the job is open, from a request until a last event.

    ``at`` orders a job's requests and events within a batch; of equal ones the event counts
    first.  State is one number for each open job.
    """
    asked = requests.filter("valid and type = 'process_document'").select("jobId", F.col(at).cast("long").alias("at"), F.lit(True).alias("request"))
    ended = events.filter(F.col("valid") & F.col("type").isin(*TERMINAL)).select("jobId", F.col(at).cast("long").alias("at"), F.lit(False).alias("request"))
    return asked.unionByName(ended).groupBy("jobId").transformWithStateInPandas(OpenJobs(), "jobId string, at long, active boolean", "append", "none")


# -- progress into tables -----------------------------------------------------------


def latest_progress(events: DataFrame, seq: str = "seq") -> DataFrame:
    """(id, progress, status, error) of each job in a batch of events: the share of pages done, its end if it came, and that error's code."""
    kind = F.col("type")
    ended = F.min_by("type", F.when(kind.isin(*TERMINAL), F.col(seq)))
    share = F.max(F.when((kind == "progress") & (F.col("stage") == "NATIVE_PARSE"), F.least(F.col("completed") / F.col("total"), F.lit(1.0))))
    code = F.min_by("code", F.when(kind == "error", F.col(seq)))
    g = events.filter("valid").groupBy(F.col("jobId").alias("id")).agg(share.alias("progress"), ended.alias("_end"), code.alias("_code"))
    status = F.when(F.col("_end") == "completed", "COMPLETED").when(F.col("_end") == "cancelled", "CANCELLED").when(F.col("_end") == "error", "FAILED")
    return g.select("id", F.when(status == "COMPLETED", 1.0).otherwise(F.col("progress")).alias("progress"), status.alias("status"), F.when(status == "FAILED", F.col("_code")).alias("error"))


def with_progress(jobs: DataFrame, latest: DataFrame, now: int, seal: Callable[[Column, Column], Column]) -> DataFrame:
    """``jobs`` with their latest progress; it never goes back, and a job that has ended stays as it is.

    ``seal`` makes the envelope of an error's code from it and the job's id.
    """
    new = latest.select("id", F.col("progress").alias("_p"), F.col("status").alias("_s"), F.col("error").alias("_e"))
    j = jobs.join(new, "id", "left")
    live = F.col("status").isin("PENDING", "RUNNING") & (F.col("_p").isNotNull() | F.col("_s").isNotNull())
    changes = {
        "progress": F.greatest("progress", F.coalesce("_p", F.lit(0.0))),
        "status": F.coalesce("_s", F.lit("RUNNING")),
        "error_cipher": F.when(F.col("_s") == "FAILED", seal(F.coalesce("_e", F.lit("INTERNAL_ERROR")), F.col("id"))),
        "started_at": F.coalesce("started_at", F.lit(now)),
        "finished_at": F.when(F.col("_s").isNotNull(), F.greatest(F.lit(now), F.coalesce("started_at", F.lit(now)))).otherwise(F.col("finished_at")),
    }
    return j.select(*[F.when(live, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in jobs.columns])


def progress_sink(store: Store, query: str, clock: Callable[[], int], seal: Callable[[Column, Column], Column], seq: str = "seq") -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: progress of jobs into ``processing_jobs``, exactly once.

    The number of the batch is a row of the same commit.  A batch that comes again after its
    commit, as the acknowledgement was lost, is found there and changes nothing; of two
    runs of one batch at the same time the store refuses the second.
    """

    def write(batch: DataFrame, number: int) -> None:
        if store.batch(query) >= number:
            return
        base = store.version()
        latest = settled(latest_progress(batch, seq))
        mine = store.lookup("processing_jobs", "id", latest.select(F.col("id").alias("key")), scoped=True)
        scopes = sorted(r.scope for r in mine.select("scope").distinct().collect())
        replace = {}
        if scopes:
            jobs = store.read("processing_jobs", scopes, scoped=True)
            replace["processing_jobs"] = settled(with_progress(jobs, latest, clock(), seal))
        store.commit(replace=replace, scopes=scopes, base=base, rules=I.commit_violations, batch=(query, number))

    return write
