"""The worker protocol: JSON lines of requests and events, checked, routed and put together.

All of it works on a batch of lines and on a stream of them alike; what keeps state over a
stream is in ``stateful``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.sources import files

# Version, event kinds, stages, error codes.
VERSION = 1
KINDS = ("started", "progress", "page_result", "completed", "cancelled", "error")
TERMINAL = ("completed", "cancelled", "error")
STAGES = ("INSPECT", "NATIVE_PARSE", "RENDER", "PREPROCESS", "OCR", "LAYOUT", "FINALIZE")
ERRORS = ("UNSUPPORTED_DOCUMENT", "INVALID_REQUEST", "FILE_NOT_FOUND", "PDF_PARSE_FAILURE", "RENDER_FAILURE", "OCR_ENGINE_FAILURE", "MODEL_LOAD_FAILURE", "CANCELLED", "INTERNAL_ERROR")

_BOX = "struct<x:double,y:double,width:double,height:double>"
_BLOCK = f"struct<localId:string,blockType:string,text:string,bbox:{_BOX},confidence:double,source:string,readingOrder:int>"
_PAGE = f"struct<pageNo:int,originalWidth:double,originalHeight:double,rotation:int,sourceType:string,blocks:array<{_BLOCK}>>"
EVENT = f"protocolVersion int, type string, jobId string, documentId string, stage string, completed int, total int, pageNo int, page {_PAGE}, pageCount int, processedPages int, lastCompletedPage int, code string, message string, retryable boolean"
#: Milliseconds between two looks at a status in flight.
POLL_MS = 1000
REQUEST = "protocolVersion int, type string, jobId string, documentId string, filePath string, pageStart int, pageEnd int, ocr boolean, detectLayout boolean"


def _named(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.length(c) > 0, F.lit(False))
    return out


def _besides(lines: DataFrame, column: str, fields: str) -> list[str]:
    """Columns of ``lines`` that stay beside the fields read from ``column``."""
    known = {column, *T.StructType.fromDDL(fields).names}
    return [c for c in lines.columns if c not in known]


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Columns of EVENT and ``valid``; a line that is no event of version 1 is not valid."""
    e = lines.select(*_besides(lines, column, EVENT), F.from_json(F.col(column), EVENT).alias("_e")).select("*", "_e.*").drop("_e")
    c = F.col
    page_ok = (
        (c("page.pageNo") >= 1)
        & (c("page.originalWidth") > 0)
        & (c("page.originalHeight") > 0)
        & c("page.sourceType").isin("NATIVE", "RASTER", "MIXED")
        & c("page.blocks").isNotNull()
        & F.forall(
            "page.blocks",
            lambda b: (F.length(b["localId"]) > 0)
            & b["blockType"].isin("TEXT", "TABLE", "IMAGE")
            & b["source"].isin("NATIVE", "OCR")
            & (b["readingOrder"] >= 0)
            & (b["bbox"]["x"] >= 0)
            & (b["bbox"]["y"] >= 0)
            & (b["bbox"]["width"] >= 0)
            & (b["bbox"]["height"] >= 0)
            & (b["bbox"]["x"] + b["bbox"]["width"] <= 1)
            & (b["bbox"]["y"] + b["bbox"]["height"] <= 1)
            & (b["confidence"].isNull() | b["confidence"].between(0, 1)),
        )
    )
    kind = (
        F.when(c("type") == "started", F.lit(True))
        .when(c("type") == "progress", c("stage").isin(*STAGES) & (c("completed") >= 0) & (c("total") > 0) & (c("pageNo").isNull() | (c("pageNo") >= 1)))
        .when(c("type") == "page_result", page_ok)
        .when(c("type") == "completed", (c("pageCount") >= 0) & (c("processedPages") >= 0))
        .when(c("type") == "cancelled", c("lastCompletedPage") >= 0)
        .when(c("type") == "error", c("code").isin(*ERRORS) & (F.length("message") > 0) & c("retryable").isNotNull() & (c("pageNo").isNull() | (c("pageNo") >= 1)))
    )
    return e.withColumn("valid", F.coalesce((c("protocolVersion") == VERSION) & _named("jobId", "documentId") & kind, F.lit(False)))


def valid_requests(lines: DataFrame, column: str = "value") -> DataFrame:
    """Requests (process_document, cancel_job) with ``valid``."""
    r = lines.select(*_besides(lines, column, REQUEST), F.from_json(F.col(column), REQUEST).alias("_r")).select("*", "_r.*").drop("_r")
    c = F.col
    ranged = (c("pageStart") >= 1) & (c("pageEnd").isNull() | (c("pageEnd") >= c("pageStart")))
    kind = F.when(c("type") == "process_document", _named("documentId", "filePath") & ranged & c("ocr").isNotNull() & c("detectLayout").isNotNull()).when(c("type") == "cancel_job", F.lit(True))
    return r.withColumn("valid", F.coalesce((c("protocolVersion") == VERSION) & _named("jobId") & kind, F.lit(False)))


def route(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """Events with ``problem``: UNKNOWN_JOB, WRONG_DOCUMENT or INVALID, else null.  ``jobs``: job_id, document_id."""
    j = jobs.select(F.col("job_id").alias("_j"), F.col("document_id").alias("_d"))
    out = events.join(j, events["jobId"] == j["_j"], "left")
    problem = F.when(~F.col("valid"), "INVALID").when(F.col("_j").isNull(), "UNKNOWN_JOB").when(F.col("_d") != F.col("documentId"), "WRONG_DOCUMENT")
    return out.withColumn("problem", problem).drop("_j", "_d")


def strict(routed: DataFrame) -> DataFrame:
    """Events of ``route``; the first one with a problem fails the query or stream that reads them."""
    said = F.concat_ws(" ", F.lit("worker event refused:"), "problem", "jobId")
    return routed.filter(F.assert_true(F.col("problem").isNull(), said).isNull()).drop("problem")


def in_order(events: DataFrame, seq: str = "seq") -> DataFrame:
    """Events of each job together and in order."""
    return events.repartition("jobId").sortWithinPartitions("jobId", seq)


def active_once(requests: DataFrame, seq: str = "seq") -> DataFrame:
    """Valid requests to process, with ``active``: the first of each job is; another one for its job is refused."""
    first = Window.partitionBy("jobId").orderBy(seq)
    return requests.filter("valid and type = 'process_document'").withColumn("active", F.row_number().over(first) == 1)


def _event(kind: str, **fields: Column) -> Column:
    all_ = {"protocolVersion": F.lit(VERSION), "type": F.lit(kind), "jobId": F.col("jobId"), "documentId": F.col("documentId"), **fields}
    return F.to_json(F.struct(*[v.alias(k) for k, v in all_.items()]))


def serve(requests: DataFrame, pages: DataFrame, cancels: DataFrame | None = None, seq: str = "seq") -> DataFrame:
    """(jobId, seq, value): the events of a worker that answers ``requests``, in order within a job.

    ``requests``: rows of ``valid_requests`` with ``seq``; ``pages``: in the form of
    files.PAGE; ``cancels``: (jobId, after), the number of pages a job has handed over when
    it is cancelled.  A range is cut at the last page; one that begins behind it, a file
    without pages and a second request for a job are errors.  A cancelled job ends at the
    next page boundary.
    """
    c = F.col
    counts = pages.groupBy("path").agg(F.max("page_no").alias("_n"))
    jobs = active_once(requests, seq).select("jobId", "documentId", "filePath", "pageStart", "pageEnd", "active", c(seq).alias("_asked"))
    jobs = jobs.join(counts, jobs["filePath"] == counts["path"], "left").drop("path")
    after = cancels.groupBy("jobId").agg(F.min("after").alias("_after")) if cancels is not None else None
    jobs = jobs.join(after, "jobId", "left") if after is not None else jobs.withColumn("_after", F.lit(None).cast("int"))
    wrong = F.when(~c("active"), F.struct(F.lit("INVALID_REQUEST").alias("code"), F.lit("the job is active already").alias("message")))
    wrong = wrong.when(c("_n").isNull(), F.struct(F.lit("FILE_NOT_FOUND").alias("code"), F.lit("the file was not found").alias("message")))
    wrong = wrong.when(c("pageStart") > c("_n"), F.struct(F.lit("INVALID_REQUEST").alias("code"), F.lit("the range is outside the document").alias("message")))
    jobs = jobs.withColumn("_wrong", wrong).withColumn("_last", F.least(F.coalesce("pageEnd", "_n"), "_n")).withColumn("_total", c("_last") - c("pageStart") + 1)
    jobs = jobs.withColumn("_done", F.least("_total", F.coalesce("_after", "_total"))).withColumn("_cut", F.coalesce(c("_after") < c("_total"), F.lit(False)))
    # most requests may ask for active jobs, so all events but those of pages come from one pass
    at = lambda seq, value: F.struct(seq.cast("long").alias("seq"), value.alias("value"))
    error = at(F.when(c("active"), 2).otherwise(c("_asked")), _event("error", code=c("_wrong.code"), message=c("_wrong.message"), retryable=F.lit(False)))
    began = [at(F.lit(0), _event("started")), at(F.lit(1), _event("progress", stage=F.lit("INSPECT"), completed=F.lit(0), total=F.lit(1)))]
    last = 2 + 2 * c("_done")
    cut = at(last, _event("cancelled", lastCompletedPage=F.when(c("_done") > 0, c("pageStart") + c("_done") - 1).otherwise(0)))
    ends = [at(last, _event("progress", stage=F.lit("FINALIZE"), completed=F.lit(1), total=F.lit(1))), at(last + 1, _event("completed", pageCount=c("_n"), processedPages=c("_total")))]
    told = F.when(~c("active"), F.array(error)).when(c("_wrong").isNotNull(), F.array(*began, error)).when(c("_cut"), F.array(*began, cut)).otherwise(F.array(*began, *ends))
    told = jobs.select("jobId", F.inline(told))
    good = jobs.filter("active and _wrong is null")
    block = F.struct(
        c("reading_order").alias("readingOrder"),
        F.concat(F.lit("p"), c("page_no"), F.lit("b"), c("reading_order")).alias("localId"),
        F.lit("TEXT").alias("blockType"),
        "text",
        F.struct("x", "y", "width", "height").alias("bbox"),
        F.lit("NATIVE").alias("source"),
    )
    built = files.page_blocks(pages).groupBy("path", "page_no", "source_type", "rotation").agg(F.array_sort(F.collect_list(F.when(c("reading_order").isNotNull(), block))).alias("blocks"))
    built = built.join(pages.select("path", "page_no", "original_width", "original_height"), ["path", "page_no"])
    model = F.struct(c("page_no").alias("pageNo"), c("original_width").alias("originalWidth"), c("original_height").alias("originalHeight"), (c("rotation") % 360).alias("rotation"), c("source_type").alias("sourceType"), "blocks")
    handed = good.join(built, (good["filePath"] == built["path"]) & (built["page_no"] >= good["pageStart"]) & (built["page_no"] < good["pageStart"] + good["_done"]))
    nth = c("page_no") - c("pageStart")
    each = F.array(_event("page_result", page=model), _event("progress", stage=F.lit("NATIVE_PARSE"), completed=nth + 1, total=F.greatest("_total", F.lit(1)), pageNo=c("page_no")))
    handed = handed.select("jobId", (2 + 2 * nth).alias("_at"), F.posexplode(each).alias("_k", "value")).select("jobId", (c("_at") + c("_k")).alias("seq"), "value")
    return told.union(handed.select("jobId", c("seq").cast("long"), "value"))


def poll(status: Callable[[], str], in_flight: tuple[str, ...] = ("PARSING", "DETECTING", "RESOLVING", "SANITIZING"), every_ms: int = POLL_MS, sleep: Callable[[float], None] = time.sleep) -> Iterator[str]:
    """Statuses as they are looked up, until one is no longer in flight."""
    while True:
        now = status()
        yield now
        if now not in in_flight:
            return
        sleep(every_ms / 1000)


def job_results(events: DataFrame, seq: str = "seq") -> DataFrame:
    """What each job came to: (jobId, outcome, n_pages, pageCount, last_stage, last_completed, last_total).

    A completed job whose pages are not exactly 1 to pageCount, or where a page or a
    block's localId comes twice, is INCOMPLETE; without a last event it is RUNNING.
    """
    c = F.col
    page = c("type") == "page_result"
    g = events.filter("valid").groupBy("jobId").agg(
        F.count_if(page).alias("n_pages"),
        F.count_distinct(F.when(page, c("page.pageNo"))).alias("_distinct"),
        F.max(F.when(page, c("page.pageNo"))).alias("_last"),
        F.max(F.when(page, F.size(F.array_distinct(F.transform("page.blocks", lambda b: b["localId"]))) < F.size("page.blocks"))).alias("_double"),
        F.min_by("type", F.when(c("type").isin(*TERMINAL), c(seq))).alias("_end"),
        F.max("pageCount").alias("pageCount"),
        F.max("processedPages").alias("_processed"),
        F.max_by(F.struct("stage", "completed", "total"), F.when(c("type") == "progress", c(seq))).alias("_p"),
    )
    whole = (c("n_pages") == c("_distinct")) & (c("n_pages") == c("pageCount")) & (c("_processed") == c("pageCount")) & (F.coalesce("_last", F.lit(0)) == c("pageCount")) & ~F.coalesce("_double", F.lit(False))
    outcome = F.when(c("_end").isNull(), "RUNNING").when(c("_end") == "completed", F.when(whole, "COMPLETED").otherwise("INCOMPLETE")).when(c("_end") == "cancelled", "CANCELLED").otherwise("FAILED")
    return g.select("jobId", outcome.alias("outcome"), "n_pages", "pageCount", c("_p.stage").alias("last_stage"), c("_p.completed").alias("last_completed"), c("_p.total").alias("last_total"))


def read_lines(spark: SparkSession, folder: str, stream: bool = True) -> DataFrame:
    """Lines of files in a folder, as a stream or once."""
    return (spark.readStream if stream else spark.read).text(folder)


def add_page(ranges: list[list[int]], page: int) -> bool:
    """Add a page to sorted ranges [first, last]; whether it is new."""
    for k, (lo, hi) in enumerate(ranges):
        if lo <= page <= hi:
            return False
        if page < lo - 1:
            ranges.insert(k, [page, page])
            return True
        if page == lo - 1:
            ranges[k][0] = page
            return True
        if page == hi + 1:
            ranges[k][1] = page
            if k + 1 < len(ranges) and ranges[k + 1][0] == page + 1:
                ranges[k][1] = ranges.pop(k + 1)[1]
            return True
    ranges.append([page, page])
    return True
