"""SimHash near-duplicate groups with bit-sliced comparison.

A text's fingerprint has a bit set where more than half of its shingle hashes have it.
Two fingerprints within ``radius`` differing bits agree wholly on at least one of
``radius + 1`` bands of bits, so only members of a band's bucket are compared.  A bucket
with more than ``BUCKET`` fingerprints is cut again by bands of the bits that are still
free (again ``radius + 1`` of them, so no link is lost) until it is small enough.

Within a bucket, candidates stand in blocks of 64: bit plane ``p`` of a block is one
word with bit ``p`` of each candidate.  All queries walk the planes together; a
carry-save counter (ones, twos, and so on up to the radius, then overflow) holds 64
distances in a few words, and a query leaves a block as soon as every lane exceeds the
radius.

Buckets return the edges of a spanning forest, never all pairs, and equal fingerprints
count once.  Null texts are empty texts, texts without words have fingerprint zero and
are linked like any other; rows with a null id link like any other, but never name a
component (one that only they reach is null); ids are below 2^62; repeated rows come back
repeated; rows with one id link what each of their texts links; very long texts are hashed
as a whole, with memory in proportion; further columns are left out whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.components import connected_components
from cloakframe.llm.scratch import configure, materialize
from cloakframe.llm.streams import group_starts, texts, whole_groups

#: Fingerprints that a bucket may hold before it is cut again.
BUCKET = 4096
#: Planes between two looks at which queries can leave a block.
STRIDE = 8
#: Ids from here on stand for rows without an id.
NAMELESS = 1 << 62
_ONE = np.uint64(1)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def text_fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of one text (UTF-8); A-Z are lower-cased, other letters kept."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        last = ends[width - 1 :].tolist()
        hashes = [digest(joined[i:j], seed) for i, j in zip(starts[: len(last)].tolist(), last, strict=True)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; zero without hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) for each row of ``docs``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([text_fingerprint(t, width) for t in texts(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _near(fp: np.ndarray, starts: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, firsts, hits): each row, the first member of a block of its group, and the lanes of that block within the radius.

    ``fp``: uint64 fingerprints, groups laid one after another from ``starts``.  A row is
    no hit of its own.
    """
    n = len(fp)
    sizes = np.diff(np.append(starts, n))
    group = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(n) - starts[group]
    # blocks of up to 64 candidates
    blocks = (sizes + 63) // 64
    first_block = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    block_of = first_block[group] + place // 64
    lane = (place % 64).astype(np.uint64)
    block_start = np.flatnonzero(np.concatenate(([True], block_of[1:] != block_of[:-1])))
    planes = np.empty((64, len(block_start)), np.uint64)
    for p in range(64):
        planes[p] = np.bitwise_or.reduceat(((fp >> np.uint64(p)) & _ONE) << lane, block_start)
    valid = np.bitwise_or.reduceat(_ONE << lane, block_start)
    queries = np.flatnonzero(sizes[group] > 1)
    # one entry for each query and block of its group, in slices of bounded size
    reps = blocks[group[queries]]
    bounds = np.cumsum(reps)
    at = 0
    while at < len(queries):
        base = bounds[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(bounds, base + (1 << 19), "right")))
        q = np.repeat(queries[at:to], reps[at:to])
        inner = np.arange(len(q)) - np.repeat(bounds[at:to] - reps[at:to] - base, reps[at:to])
        block = first_block[group[q]] + inner
        at = to
        own = fp[q]
        # a bit-sliced number for each lane, and whether it overflowed
        digits = [np.zeros(len(q), np.uint64) for _ in range(radius.bit_length())]
        over = np.zeros(len(q), np.uint64)
        for p in range(64):
            carry = planes[p, block] ^ np.where(own >> np.uint64(p) & _ONE, _ALL, np.uint64(0))
            for d in digits:
                more = d & carry
                d ^= carry
                carry = more
            over |= carry
            if p % STRIDE == STRIDE - 1:
                live = (valid[block] & ~_beyond(digits, over, radius)) != 0
                if not live.all():
                    q, block, own, over, *digits = (v[live] for v in (q, block, own, over, *digits))
                if not len(q):
                    break
        if len(q):
            hits = valid[block] & ~_beyond(digits, over, radius)
            hits &= ~np.where(block == block_of[q], _ONE << lane[q], np.uint64(0))
            some = hits != 0
            yield q[some], block_start[block[some]], hits[some]


def _lanes(hits: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(hits).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)


def bit_sliced_links(fp: np.ndarray, starts: np.ndarray, radius: int) -> np.ndarray:
    """Labels of rows: equal for rows of a group that are linked directly or by others.

    The label is the first linked row's number.
    """
    n = len(fp)
    label = np.arange(n)
    found = list(_near(fp, starts, radius))
    if not found:
        return label
    rows, first, hits = (np.concatenate(v) for v in zip(*found, strict=True))
    while True:
        before = label.copy()
        for s in range(0, len(rows), 1 << 16):
            r, b, h = rows[s : s + (1 << 16)], first[s : s + (1 << 16)], hits[s : s + (1 << 16)]
            member = np.minimum(b[:, None] + np.arange(64), n - 1)
            np.minimum.at(label, r, np.where(_lanes(h), label[member], n).min(1))
        label = label[label]
        if (label == before).all():
            return label


def bit_sliced_pairs(fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of (i, j), i > j, of all rows of one group within the radius of each other."""
    for rows, first, hits in _near(fp, np.zeros(1, np.int64), radius):
        for s in range(0, len(rows), 1 << 14):
            k, lane = np.nonzero(_lanes(hits[s : s + (1 << 14)]))
            i, j = rows[s : s + (1 << 14)][k], first[s : s + (1 << 14)][k] + lane
            yield i[i > j], j[i > j]


def _beyond(digits: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count, held in binary digits and an overflow, exceeds the radius."""
    more, same = over, _ALL
    for k in range(len(digits) - 1, -1, -1):
        if radius >> k & 1:
            same = same & digits[k]
        else:
            more, same = more | (same & digits[k]), same & ~digits[k]
    return more


def _bands(free: list[int], radius: int) -> list[list[int]]:
    parts = np.array_split(np.array(free), radius + 1)
    return [p.tolist() for p in parts]


def _mask(bits: list[int]) -> int:
    v = sum(1 << b for b in bits)
    return v - (1 << 64) if v >= 1 << 63 else v


def links(distinct: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect all of ``distinct`` (fp, rep) within ``radius`` bits."""
    if not 0 <= radius <= 3:
        raise ValueError("radius must be from 0 to 3")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["band", "k1"]):
            starts = group_starts(t, ["band", "k1"])
            rep = t.column("rep").to_numpy()
            label = bit_sliced_links(t.column("fp").to_numpy().view(np.uint64), starts, radius)
            moved = label != np.arange(len(label))
            yield pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[label[moved]])], ["a", "b"])

    # paths: number of a bucket family -> bits that are still free in it
    paths = {0: list(range(64))}
    level = distinct.select("fp", "rep", F.lit(0).alias("band"), F.lit(0).cast("long").alias("k1"))
    edges = None
    while True:
        nxt: dict[int, list[int]] = {}
        choices = []
        for old, free in paths.items():
            for part in _bands(free, radius):
                new = len(nxt) + 1
                nxt[new] = [b for b in free if b not in part]
                fixed = [b for b in range(64) if b not in nxt[new]]
                choices.append((old, new, _mask(fixed)))
        cut = F.array(*[F.when(F.col("band") == old, F.struct(F.lit(new).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("k1"))) for old, new, m in choices])
        rows = level.select("fp", "rep", F.explode(F.filter(cut, lambda x: x.isNotNull())).alias("c")).select("fp", "rep", "c.band", "c.k1")
        small = min(map(len, nxt.values())) <= bucket.bit_length() - 1
        hot = None
        if not small:
            hot = materialize(rows.groupBy("band", "k1").count().filter(F.col("count") > bucket).select("band", "k1"), "hot")
            if hot.isEmpty():
                hot = None
        calm = rows.join(hot, ["band", "k1"], "left_anti") if hot is not None else rows
        found = calm.repartition("band", "k1").sortWithinPartitions("band", "k1", "rep").mapInArrow(run, "a long, b long")
        edges = found if edges is None else edges.union(found)
        if hot is None:
            return edges
        level, paths = rows.join(hot, ["band", "k1"], "left_semi"), nxt


def near_duplicate_groups(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text, ...).

    component_id is the smallest doc_id reachable over links of at most ``radius`` bits.
    """
    configure(docs.sparkSession)
    fps = materialize(fingerprints(docs, width), "fingerprints")
    # fingerprints that only rows without an id have are linked under ids above all others
    least = F.coalesce(F.min("doc_id"), F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64("fp"), 3))
    distinct = materialize(fps.groupBy("fp").agg(least.alias("rep")), "distinct")
    found = connected_components(links(distinct, radius))
    named = distinct.join(found, distinct["rep"] == found["node"], "left").withColumn("c", F.coalesce("component", "rep"))
    of = named.select("fp", F.when(F.col("c") < NAMELESS, F.col("c")).alias("component_id"))
    return fps.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
