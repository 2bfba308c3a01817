"""Vectors as short codes: a codebook for each part of a vector, by weighted Lloyd rounds over distinct parts.

Components become integers and vectors are cut into equal consecutive parts.  Equal parts
of a position are one row with a weight, counted before anything is shuffled, so that
rounds cost what distinct parts cost, whatever their copies.  A round assigns each distinct
part to the nearest entry of its position's codebook and adds weighted components up; only
these sums, ``ENTRIES`` a position, reach the driver.  All arithmetic is that of integers.
Codes and errors are then joined back to the vectors by position and part.

A part that ``parts / HOT`` or more of the rows hold would meet in one task there; there are
at most ``HOT`` of them for each position, so that they are joined as a broadcast table of proven size
and the others by shuffle.  The same goes for labels.

Defined cases: rows whose vector is null or empty or holds null or non-finite components are
left out; so are rows whose vector has not the commonest length (the smaller of equally
common ones).  Where the parts do not divide that length, zeros fill it up.  Numbers beyond
``CLIP`` in size count as that much, so that sums stay in 64 bits.  Rows with equal ids, or
no id, are rows of their own; initial entries are taken by id (nulls last), then by parts,
and entries past the number of rows do not exist.  Null labels are one label.  An empty table
gives an empty result.  Columns beside id, vector and label are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.scratch import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: A value is hot if more than one row of so many holds it.
HOT = 256
#: Largest size of an integer component.
CLIP = 1 << 24


def integers(vector: Column, parts: int = PARTS, scale: int = SCALE) -> Column:
    """``vector`` as an array of ``parts`` arrays of floor(scale * x)."""
    whole = F.transform(vector, lambda x: F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), F.floor(x.cast("double") * scale))).cast("int"))
    size = F.ceil(F.size(vector) / parts).cast("int")
    full = F.concat(whole, F.array_repeat(F.lit(0), size * parts - F.size(vector)))
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.slice(full, k * size + 1, size))


def usable(vector: Column) -> Column:
    """Vectors with components, all of them finite numbers."""
    sound = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & sound, F.lit(False))


def _prepared(vectors: DataFrame, parts: int, scale: int) -> DataFrame:
    """(row, vec_id, label, parts) of rows that take part, written once so that row numbers hold."""
    kept = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).filter(usable(F.col("v")))
    kept = kept.withColumn("size", F.size("v"))
    common = kept.groupBy("size").count().orderBy(F.desc("count"), "size").limit(1).select(F.col("size").alias("common"))
    kept = kept.join(F.broadcast(common), F.col("size") == F.col("common"))
    return materialize(kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", integers(F.col("v"), parts, scale).alias("parts")), "vector_parts")


def _nearest(distinct: DataFrame, books: np.ndarray, used: np.ndarray) -> DataFrame:
    """``distinct`` (pos, part, weight) with ``code`` and ``error``: number and squared distance of the nearest entry, the lower of equals."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos = b.column(0).to_numpy()
            x = b.column(1).flatten().to_numpy().reshape(len(pos), -1).astype(np.int64)
            code, error = np.zeros(len(pos), np.int32), np.zeros(len(pos), np.int64)
            for p in np.unique(pos):
                mine = pos == p
                book = books[p][: used[p]]
                far = np.stack([((x[mine] - entry) ** 2).sum(1) for entry in book], 1)
                code[mine] = far.argmin(1)
                error[mine] = far.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code), pa.array(error)], ["pos", "part", "weight", "code", "error"])

    return distinct.mapInArrow(run, "pos int, part array<int>, weight long, code int, error long")


def codebooks(rows: DataFrame, distinct: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Entries (position, entry, component) after ``rounds`` rounds over the distinct parts; None without rows."""
    first = [r.parts for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(entries).select("parts").collect()]
    if not first:
        return None
    books = np.array(first, np.int64).transpose(1, 0, 2)
    used = np.full(len(books), len(first))
    width = books.shape[2]
    for _ in range(rounds):
        sums = [F.sum(F.col("weight") * F.col("part")[k]).alias(f"s{k}") for k in range(width)]
        for r in _nearest(distinct, books, used).groupBy("pos", "code").agg(F.sum("weight").alias("n"), *sums).collect():
            books[r.pos, r.code] = [r[f"s{k}"] // r.n for k in range(width)]
    return books


def joined_by_weight(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, per: int = 1) -> DataFrame:
    """Equi-join of ``left`` with ``right``, whose ``weight`` tells how many rows of ``left`` hold a key (at most ``total`` for each of ``per``).

    Keys above ``total / HOT``, fewer than ``HOT * per``, are broadcast; rows that find none of them are shuffled.
    """
    hot = F.col(weight) * HOT > total
    few = right.filter(hot).drop(weight)
    added = [c for c in few.columns if c not in on]
    tried = left.join(F.broadcast(few.withColumn("_hot", F.lit(True))), on, "left")
    rest = tried.filter(F.col("_hot").isNull()).drop("_hot", *added).join(right.filter(~hot).drop(weight).hint("shuffle_merge"), on)
    return tried.filter("_hot").drop("_hot").unionByName(rest)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, codes, error), entries): each kept vector's entry numbers by part and summed squared distance, and all codebooks."""
    rows = _prepared(vectors, parts, scale)
    exploded = rows.select("row", F.posexplode("parts").alias("pos", "part"))
    distinct = materialize(exploded.groupBy("pos", "part").agg(F.count("*").alias("weight")), "distinct_parts")
    books = codebooks(rows, distinct, entries, rounds)
    if books is None:
        return rows.select("vec_id", "label", F.array(F.lit(0)).alias("codes"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    coded = materialize(_nearest(distinct, books, np.full(len(books), books.shape[1])), "coded_parts")
    back = joined_by_weight(exploded, coded, ["pos", "part"], "weight", rows.count(), len(books))
    whole = back.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("found"), F.sum("error").alias("error"))
    return rows.drop("parts").join(whole, "row").select("vec_id", "label", F.col("found.code").alias("codes"), "error"), books


def hex_codes(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` (with ``label`` and ``error``), written once, with the sum of ``error`` over equal labels, nulls together, as ``label_error``."""
    w = materialize(coded.withColumn("known", F.col("label").isNotNull()).withColumn("label", F.coalesce("label", F.lit(0).cast("int"))), "coded_vectors")
    sums = materialize(w.groupBy("known", "label").agg(F.sum("error").alias("label_error"), F.count("*").alias("weight")), "label_errors")
    return joined_by_weight(w, sums, ["known", "label"], "weight", w.count()).drop("known", "label")
