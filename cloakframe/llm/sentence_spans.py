"""Substring dedup over sliding spans of sentences.

Texts are cut into sentences, and these at commas, colons and semicolons, as a shared
passage seldom begins and ends with whole sentences.  A span is a run of ``SPAN``
consecutive pieces, lengthened piece by piece until it has ``WORDS`` words.  One begins at
every piece from which that many words are left; the last of them also comes to the text's
end, and a text with fewer words is one span.  So every piece of a text is in some span.
A repeated run of pieces with fewer words in all than ``WORDS`` is found only where the
words around it repeat too: shorter runs recur by chance, and removing these hurts texts
that share nothing else.  ``words=0`` hashes every run of ``span`` pieces as it is.

Spans are hashed (XXH128 of the pieces with white space made even) and joined globally.
The first place of a hash, in order of doc_id and position, keeps its pieces; at every
other place all pieces of the span are removed.  Repeats inside a document are told where
it is parsed, so only the first place of a hash in each document takes part in the join.

A piece ends after one of ``.!?,;:`` and further signs before white space, or at a line's
end.

Null and empty texts have no sentences and stay.  Rows that repeat wholly are one document
and all get its result; rows with one id but other texts do not remove from each other, nor
do rows with a null id, which come last.  Ties cannot occur: places in a document differ.
Very long texts are parsed as a whole, in memory in proportion to their length.  Further
columns are left out whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.scratch import configure, materialize
from cloakframe.llm.streams import texts

SPAN = 3
#: Words that a span has at least, where the text has as many.
WORDS = 30
_ENDS = re.compile(rb"[.!?,;:][^A-Za-z0-9\x80-\xff\s]*(?=\s)|\n+")


def sentences(text: bytes) -> list[tuple[int, int]]:
    """(start, end) of each piece in bytes, without white space around it."""
    out = []
    at = 0
    for m in _ENDS.finditer(text):
        out.append((at, m.end()))
        at = m.end()
    out.append((at, len(text)))
    found = []
    for s, e in out:
        part = text[s:e]
        if part and not part.isspace():
            s += len(part) - len(part.lstrip())
            found.append((s, s + len(part.strip())))
    return found


def ends(counts: list[int], span: int = SPAN, words: int = WORDS) -> list[int]:
    """End (number of the piece behind) of the span that begins at each of the first pieces.

    ``counts``: words of each piece.  Spans begin at the pieces from which ``span`` pieces
    and ``words`` words are left, and at the first piece in any case.
    """
    n = len(counts)
    total = np.concatenate(([0], np.cumsum(counts)))
    last = min(n - span, int(np.searchsorted(total, total[-1] - words, "right")) - 1)
    starts = np.arange(max(1, last + 1)) if n else np.empty(0, np.int64)
    reach = np.searchsorted(total, total[starts] + words)
    return np.minimum(n, np.maximum(reach, starts + span)).tolist()


def spans(text: bytes, span: int = SPAN, words: int = WORDS) -> list[tuple[int, bytes]]:
    """(place, hash) of each span; place is twice the first piece, plus 1 for one that comes to the text's end."""
    pieces = [text[s:e].split() for s, e in sentences(text)]
    joined = [b" ".join(p) for p in pieces]
    to = ends([len(p) for p in pieces], span, words)
    out = [(2 * i, xxhash.xxh128_digest(b"\n".join(joined[i:k]))) for i, k in enumerate(to)]
    if to and to[-1] < len(joined):
        out.append((2 * len(to) - 1, xxhash.xxh128_digest(b"\n".join(joined[len(to) - 1 :]))))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """Order keys of a row: doc_id (nulls last) and the text's hash."""
    last = F.lit((1 << 63) - 1)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), last).alias("d"), F.shiftrightunsigned(F.xxhash64("text"), 33).alias("h"), F.col("doc_id").isNull().alias("unnamed"), F.col("text"))


def covered(docs: DataFrame, span: int = SPAN, words: int = WORDS) -> DataFrame:
    """(d, h, starts) with the places of the spans to remove, for documents that lose any.

    Texts are read twice, first for the hashes that occur again, of which each task sends
    one count, then for their places.  What is sent twice is hashes and places, not texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, place, hashes = [], [], []
            for row, t in enumerate(texts(b.column(2))):
                seen = set()
                for at, digest in spans(t, span, words):
                    who.append(row)
                    # the lowest bit tells a repeat inside the document
                    place.append(at << 1 | (digest in seen))
                    hashes.append(digest)
                    seen.add(digest)
            pair = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            who_at = pa.array(who, pa.int64())
            h = np.asarray(b.column(1).to_numpy())[np.array(who, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), b.column(0).take(who_at), pa.array(h << 32 | np.array(place, np.int64))], ["x", "y", "d", "place"])

    found = docs.select("d", "h", "text").mapInArrow(run, "x long, y long, d long, place long")
    # partial counts bring a frequent span to one row a task; written, so that the join below
    # reads two plain shuffles, which lets Spark split a frequent span's partition
    counted = found.groupBy("x", "y").agg(F.count("*").alias("n"), F.min("d").alias("first")).filter("n > 1")
    known = materialize(counted.select("x", "y", "first"), "repeated")
    again = found.join(known, ["x", "y"]).filter((F.col("d") > F.col("first")) | (F.col("place").bitwiseAND(1) == 1))
    each = again.select("d", F.shiftright("place", 32).alias("h"), F.shiftright(F.col("place").bitwiseAND(0xFFFFFFFF), 1).cast("int").alias("i"))
    return each.groupBy("d", "h").agg(F.collect_set("i").alias("starts"))


def cut(text: bytes, starts: list[int], span: int = SPAN, words: int = WORDS) -> tuple[bytes, int, int, int]:
    """What is left of a text, its number of pieces, of removed ones, and of removed runs of them."""
    where = sentences(text)
    if not starts:
        return text, len(where), 0, 0
    to = ends([len(text[s:e].split()) for s, e in where], span, words)
    gone = np.zeros(len(where) + 1, bool)
    for place in starts:
        gone[place >> 1 : len(where) if place & 1 else to[place >> 1]] = True
    # a removed run takes the white space after it along
    pieces, at = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone[:-1], [False])).astype(np.int8)))
    for s, e in zip(edges[::2], edges[1::2], strict=True):
        pieces.append(text[at : where[s][0]])
        at = where[e][0] if e < len(where) else len(text)
    pieces.append(text[at:])
    return b"".join(pieces).rstrip() if not len(text) - at else b"".join(pieces), len(where), int(gone.sum()), len(edges) // 2


def deduplicate(docs: DataFrame, span: int = SPAN, words: int = WORDS) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed, n_spans, kept_sha256) for each row of ``docs`` (doc_id, text, ...)."""
    configure(docs.sparkSession)
    rows = _keyed(docs)
    found = covered(rows, span, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [cut(t, s or [], span, words) for t, s in zip(texts(b.column(1)), b.column(2).to_pylist(), strict=True)]
            kept = [t if was else None for (t, *_), was in zip(out, b.column(1).is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    *(pa.array([o[k] for o in out], pa.int64()) for k in (1, 2, 3)),
                    pa.array([hashlib.sha256(o[0]).hexdigest() for o in out], pa.string()),
                ],
                ["doc_id", "text", "n_sentences", "n_removed", "n_spans", "kept_sha256"],
            )

    joined = rows.join(found, ["d", "h"], "left").select(F.when(~F.col("unnamed"), F.col("d")).alias("doc_id"), "text", "starts")
    return joined.mapInArrow(run, "doc_id long, text string, n_sentences long, n_removed long, n_spans long, kept_sha256 string")
