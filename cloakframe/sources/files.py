"""Source files: inspection, types by extension, and the page model."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from typing import Any, BinaryIO, Protocol
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Media types by extension.
MEDIA_TYPES = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".doc": "application/msword",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".tif": "image/tiff",
    ".tiff": "image/tiff",
}
OTHER_TYPE = "application/octet-stream"

PAGE = "path string, page_no int, original_width double, original_height double, rotation int, items array<struct<kind:string,text:string,x0:double,y0:double,x1:double,y1:double>>"


#: Bytes that are read at once for a digest.
CHUNK = 64 << 10
#: Schemes whose files tasks can open piece by piece; others come as one value.
OPENED = ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")
#: Pages that one task reads.
PAGES = 32


def opened(path: str) -> BinaryIO:
    """A file for reading at any place, by its path as Spark lists it."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    system, inner = fs.FileSystem.from_uri(quote(path.replace("s3a:", "s3:", 1), safe=":/@"))
    return system.open_input_file(inner)


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for path in b.column(0).to_pylist():
            h = hashlib.sha256()
            with opened(path) as f:
                while piece := f.read(CHUNK):
                    h.update(piece)
            out.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], ["path", "length", "file_hash"])


def media_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    out = F.lit(OTHER_TYPE)
    for k, v in MEDIA_TYPES.items():
        out = F.when(ext == k, F.lit(v)).otherwise(out)
    return out


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, original_name, file_hash, mime_type, byte_size) of files; paths of directories are read recursively.

    Spark lists the files, empty ones left out; tasks read them in pieces of ``CHUNK`` bytes, so that a file's
    size is no matter.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    scheme = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri().getScheme()
    if scheme in OPENED:
        listed = f.select("path", "length").mapInArrow(_digests, "path string, length long, file_hash string")
    else:
        listed = f.select("path", "length", F.sha2("content", 256).alias("file_hash"))
    return listed.select(
        F.col("path").alias("source_path"),
        F.regexp_extract("path", r"([^/\\]+)$", 1).alias("original_name"),
        "file_hash",
        media_type(F.col("path")).alias("mime_type"),
        F.col("length").alias("byte_size"),
    )


def unchanged(documents: DataFrame, inspected: DataFrame) -> DataFrame:
    """Documents whose source still has the hash they were imported with."""
    return documents.join(inspected.select("source_path", "file_hash"), ["source_path", "file_hash"], "left_semi")


def relative_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> dict[str, Column]:
    """Box in page shares from the top left, from points from the bottom left, kept inside the page."""
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    left, top = unit(x0 / width), unit((height - y1) / height)
    right, bottom = F.greatest(left, unit(x1 / width)), F.greatest(top, unit((height - y0) / height))
    return {"x": left, "y": top, "width": right - left, "height": bottom - top}


def page_source_type(has_text: Column, has_image: Column) -> Column:
    return F.when(has_text & has_image, "MIXED").when(has_image, "RASTER").otherwise("NATIVE")


def page_blocks(pages: DataFrame) -> DataFrame:
    """Text blocks of pages in the form of PAGE: from the top, then from the left, numbered from 0."""
    top = lambda i: F.col("original_height") - i["y1"]
    kept = F.filter("items", lambda i: (i["kind"] == "text") & (F.trim(i["text"]) != ""))
    keyed = F.array_sort(F.transform(kept, lambda i: F.struct(top(i).alias("top"), i["x0"].alias("x0"), (-i["y0"]).alias("bottom"), i.alias("item"))))
    typed = page_source_type(F.size(kept) > 0, F.exists("items", lambda i: i["kind"] == "image"))
    rows = pages.select("path", "page_no", "original_width", "original_height", "rotation", typed.alias("source_type"), F.posexplode_outer(keyed).alias("reading_order", "k"))
    i = "k.item"
    box = relative_box(F.col(f"{i}.x0"), F.col(f"{i}.y0"), F.col(f"{i}.x1"), F.col(f"{i}.y1"), F.col("original_width"), F.col("original_height"))
    return rows.select("path", "page_no", "source_type", "rotation", "reading_order", F.trim(F.col(f"{i}.text")).alias("text"), *[v.alias(k) for k, v in box.items()])


class DocumentSource(Protocol):
    """Anything that reads files to pages in the form of PAGE."""

    parser_type: str

    def pages(self, spark: SparkSession, path: str, first: int = 1, last: int | None = None) -> DataFrame: ...


def _flat(node, container: type, text: type) -> Iterator:
    """Items of a layout; figures and other containers are opened, text boxes are not."""
    for x in node:
        if isinstance(x, container) and not isinstance(x, text):
            yield from _flat(x, container, text)
        else:
            yield x


def layout_page(page: Any, number: int, kinds: tuple[type, type, type]) -> dict:
    """A row of PAGE without the path; ``kinds``: container, text, image."""
    container, text, image = kinds
    items = []
    for x in _flat(page, container, text):
        if isinstance(x, (text, image)):
            said = isinstance(x, text)
            items.append({"kind": "text" if said else "image", "text": x.get_text() if said else "", "x0": x.x0, "y0": x.y0, "x1": x.x1, "y1": x.y1})
    return {"page_no": number, "original_width": page.width, "original_height": page.height, "rotation": page.rotate % 360, "items": items}


class Parser(Protocol):
    """Reads pages of an open file; it is sent to tasks, so it imports what it needs there."""

    def count(self, file: BinaryIO) -> int: ...

    def layouts(self, file: BinaryIO, numbers: Sequence[int]) -> Iterator[Any]:
        """Layouts of the pages of these numbers, from 1, ascending; no others are read."""

    def kinds(self) -> tuple[type, type, type]:
        """Classes of containers, texts and images in layouts."""


class PdfMiner:
    """PDF files by pdfminer, which is not part of this package."""

    def count(self, file: BinaryIO) -> int:
        from pdfminer.pdfpage import PDFPage

        return sum(1 for _ in PDFPage.get_pages(file))

    def layouts(self, file: BinaryIO, numbers: Sequence[int]) -> Iterator[Any]:
        from pdfminer.high_level import extract_pages

        return extract_pages(file, page_numbers=[n - 1 for n in numbers])

    def kinds(self) -> tuple[type, type, type]:
        from pdfminer.layout import LTContainer, LTImage, LTTextContainer

        return LTContainer, LTTextContainer, LTImage


class PagedSource:
    """Pages of files, read by ranges: a task opens a file and reads the pages of its range only.

    The range asked for is cut at a file's last page; one that begins behind it is refused.
    """

    parser_type = "NATIVE_PDF"

    def __init__(self, parser: Parser | None = None, pages_a_task: int = PAGES) -> None:
        if parser is None:
            try:
                import pdfminer  # noqa: F401
            except ImportError as e:
                raise RuntimeError("reading PDF files needs pdfminer") from e
            parser = PdfMiner()
        self.parser, self.pages_a_task = parser, pages_a_task

    def pages(self, spark: SparkSession, path: str, first: int = 1, last: int | None = None) -> DataFrame:
        if first < 1 or (last is not None and last < first):
            raise ValueError("INVALID_REQUEST")
        parser = self.parser

        def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for p in f["path"]:
                    with opened(p) as file:
                        out.append((p, parser.count(file)))
                yield pd.DataFrame(out, columns=["path", "n"])

        def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kinds = parser.kinds()
            for f in frames:
                for p, a, b in zip(f["path"], f["a"], f["b"], strict=True):
                    numbers = range(int(a), int(b) + 1)
                    with opened(p) as file:
                        for number, layout in zip(numbers, parser.layouts(file, numbers), strict=True):
                            yield pd.DataFrame([{"path": p, **layout_page(layout, number, kinds)}])

        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
        sizes = listed.mapInPandas(counted, "path string, n int")
        within = F.col("n").isNull() | (F.col("n") == 0) | (F.col("n") >= first)
        sizes = sizes.filter(F.assert_true(within, F.lit("INVALID_REQUEST")).isNull() & (F.col("n") > 0))
        to = F.least(F.col("n"), F.lit(last)) if last is not None else F.col("n")
        ranges = sizes.select("path", to.alias("to"), F.explode(F.sequence(F.lit(first), to, F.lit(self.pages_a_task))).alias("a"))
        ranges = ranges.select("path", "a", F.least(F.col("a") + self.pages_a_task - 1, "to").alias("b"))
        return ranges.repartition("path", "a").mapInPandas(read, PAGE)


class FixtureSource:
    """One page for each path, made of its name; for tests of what follows."""

    parser_type = "MOCK"

    def pages(self, spark: SparkSession, path: str, first: int = 1, last: int | None = None) -> DataFrame:
        one = F.struct(F.lit("text").alias("kind"), F.lit(path).alias("text"), *[F.lit(float(v)).alias(k) for k, v in (("x0", 10), ("y0", 700), ("x1", 200), ("y1", 720))])
        return spark.range(1).select(F.lit(path).alias("path"), F.lit(1).alias("page_no"), F.lit(600.0).alias("original_width"), F.lit(800.0).alias("original_height"), F.lit(0).alias("rotation"), F.array(one).alias("items"))
