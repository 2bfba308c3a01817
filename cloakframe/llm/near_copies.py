"""One document of each group of near copies: SimHash comparison and exact Jaccard similarity.

A text's shingles are the runs of ``WIDTH`` words (a shorter text is one shingle), A-Z
lower-cased, as XXH64.  Documents whose sets have a Jaccard similarity of at least
``SIMILARITY`` are linked, and groups are the components of links.

At a similarity of 0.8, 64-bit SimHash fingerprints differ in some ten bits, too many for
buckets by agreeing bits.  Buckets therefore come from ``BANDS`` bands of ``DEPTH``
min-hashes; a pair at exactly 0.8 meets in at least one with probability 0.99993, a closer
one with more.  Within a group of comparisons the bit-sliced SimHash comparison finds the
pairs within ``RADIUS`` bits (more than five deviations above the mean at 0.8), and these
are confirmed on their whole shingle sets, computed from the texts.

First each document is compared with the least document of its buckets.  Buckets whose
members are then still in several components are compared in full, except pairs that are
linked already.  Groups of comparisons hold at most two blocks of about ``BLOCK`` texts,
so no bucket is capped and none needs one task.

Null texts are empty texts; texts without words are copies of each other.  Rows without an
id are linked like any other under ids above all others (real ids are below 2^62), one for
each text.  Rows of one id are in one group.  Very long texts are parsed as a whole, with
memory in proportion.  Further columns are kept whatever their names.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.components import connected_components
from cloakframe.llm.scratch import columns, configure, fresh, materialize
from cloakframe.llm.simhash import NAMELESS, bit_sliced_pairs, majority
from cloakframe.llm.streams import group_starts, texts, tidy, whole_groups

WIDTH = 5
SIMILARITY = 0.8
BANDS, DEPTH = 24, 5
#: Differing bits of the fingerprints of pairs that are confirmed.
RADIUS = 28
#: Texts in a block of a group of comparisons, about.
BLOCK = 256
_SEED = 42
_draw = np.random.default_rng(_SEED)
_XOR = _draw.integers(0, 1 << 64, BANDS * DEPTH, np.uint64)
_TIMES = _draw.integers(0, 1 << 64, BANDS * DEPTH, np.uint64) | np.uint64(1)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[i:j], _SEED) for i, j in zip(starts[: len(last)].tolist(), last, strict=True)], np.uint64))


def set_digest(shingle_set: np.ndarray) -> int:
    """Signed 64-bit digest of a set; equal sets have equal ones."""
    v = xxhash.xxh64_intdigest(shingle_set.tobytes(), _SEED)
    return v - (1 << 64) if v >> 63 else v


def band_keys(shingle_set: np.ndarray) -> np.ndarray:
    """One signed key for each band of min-hashes."""
    least = np.full(BANDS * DEPTH, ~np.uint64(0))
    for at in range(0, len(shingle_set), 1024):
        part = shingle_set[at : at + 1024, None]
        np.minimum(least, ((part ^ _XOR) * _TIMES).min(0), out=least)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, DEPTH))], np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets have at least this Jaccard similarity; two empty ones have."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _key() -> F.Column:
    """A row's id; one above all others for a text without an id."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64("text"), 3))


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp, keys) of each row: the set's digest and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, width) for t in texts(b.column(1))]
            keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([set_digest(s) for s in sets], pa.int64()), keys], ["doc_id", "fp", "keys"])

    return docs.select(_key().alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, fp long, keys array<long>")


def _confirmed(groups: DataFrame, found: DataFrame, width: int, similarity: float) -> DataFrame:
    """Edges (a, b) between similar members of ``groups`` (g1, g2, rep, fp, label, rest).

    Members with the same label, or both without ``rest``, are not compared; of the
    others every pair that links found before do not join already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["g1", "g2"], 2 * BLOCK):
            starts = group_starts(t, ["g1", "g2"])
            rep, fp, label, rest = (t.column(c).to_numpy() for c in ("rep", "fp", "label", "rest"))
            body = t.column("text")
            left, right = [], []
            for s, e in zip(starts, np.append(starts[1:], t.num_rows), strict=True):
                sets = [shingles(x, width) for x in texts(body.slice(s, e - s).combine_chunks())]
                # rows of one id with other texts come along
                own = [k for k in range(e - s) if set_digest(sets[k]) == fp[s + k]]
                # component of each member, named by its label
                of = label[s:e][own]
                marks = np.array([majority(sets[k]) for k in own], np.uint64)
                first = rest[s:e][own]
                for near in bit_sliced_pairs(marks, RADIUS):
                    for i, j in zip(*(x.tolist() for x in near), strict=True):
                        if of[i] != of[j] and (first[i] or first[j]) and similar(sets[own[i]], sets[own[j]], similarity):
                            left.append(rep[s + own[i]])
                            right.append(rep[s + own[j]])
                            of[of == of[j]] = of[i]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    rows = groups.join(found, groups["rep"] == found["doc_id"]).select("g1", "g2", "rep", "fp", "label", "rest", "text")
    return rows.repartition("g1", "g2").sortWithinPartitions("g1", "g2", "rep").mapInArrow(tidy(run), "a long, b long")


def _blocks(n: F.Column) -> F.Column:
    return F.ceil(n / BLOCK).cast("int")


def _links(docs: DataFrame, distinct: DataFrame, width: int, similarity: float) -> DataFrame:
    """Edges (a, b) that connect all similar sets of ``distinct`` (fp, rep, keys)."""
    rows = distinct.select(F.explode("keys").alias("k"), F.struct("rep", "fp").alias("m"))
    shared = rows.groupBy("k").agg(F.min("m").alias("c"), F.max("m").alias("x")).filter("c <> x").select("k", "c")
    buckets = materialize(rows.join(shared, "k"), "buckets")
    ids = buckets.select(F.col("m.rep").alias("doc_id")).distinct()
    found = materialize(docs.select(_key().alias("doc_id"), "text").join(ids, "doc_id", "left_semi"), "candidates")

    # each document and the least one of its buckets
    nearest = buckets.groupBy("m").agg(F.min("c").alias("c")).filter("c <> m")
    counts = nearest.groupBy("c").agg(_blocks(F.count("*")).alias("n"))
    members = nearest.join(counts, "c").select("c", F.pmod(F.xxhash64("m"), "n").cast("long").alias("g2"), "m", F.lit(False).alias("rest"))
    centers = counts.select("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("g2"), F.col("c").alias("m"), F.lit(True).alias("rest"))
    # an id may stand for several sets: groups and labels go by set
    groups = members.union(centers).select(F.xxhash64("c").alias("g1"), "g2", "m.rep", "m.fp", F.xxhash64("m").alias("label"), "rest")
    first = materialize(_confirmed(groups, found, width, similarity), "links")

    # whole buckets that are still in several components
    of = connected_components(first)
    named = buckets.join(of, F.col("m.rep") == of["node"], "left").select("k", "m", F.coalesce("component", "m.rep").alias("label"))
    mixed = named.groupBy("k").agg(F.min("label").alias("main"), F.max("label").alias("x"), F.count("*").alias("all"), F.bit_xor(F.xxhash64("m")).alias("sign")).filter("main <> x")
    # bands whose buckets have the same members need one comparison
    mixed = mixed.groupBy("all", "sign", "main").agg(F.min("k").alias("k")).select("k", "main", "all")
    open_ = materialize(named.join(mixed, "k").withColumn("rest", F.col("label") != F.col("main")), "open")
    sizes = open_.groupBy("k").agg(_blocks(F.sum((~F.col("rest")).cast("int"))).alias("nb"), _blocks(F.sum(F.col("rest").cast("int"))).alias("sb"))
    # blocks 0 to nb - 1 hold the main component, sb others the rest; every block meets each block of the rest
    own = F.when(F.col("rest"), F.col("nb") + F.pmod(F.xxhash64("m"), "sb")).otherwise(F.pmod(F.xxhash64("m"), "nb")).cast("int")
    dealt = open_.join(sizes, "k").withColumn("own", own).withColumn("to", F.sequence(F.when(F.col("rest"), 0).otherwise(F.col("nb")), F.col("nb") + F.col("sb") - 1))
    dealt = dealt.withColumn("to", F.explode(F.filter("to", lambda j: j != F.col("own"))))
    pair = F.shiftleft(F.least("own", "to").cast("long"), 32) + F.greatest("own", "to").cast("long")
    groups = dealt.select(F.col("k").alias("g1"), pair.alias("g2"), "m.rep", "m.fp", "label", "rest")
    return first.union(materialize(_confirmed(groups, found, width, similarity), "links"))


def _groups(docs: DataFrame, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each row, and (fp, component_id) of each set; ids stand in for null ones."""
    configure(docs.sparkSession)
    rows = materialize(_sketches(docs, width), "sketches")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "distinct")
    found = connected_components(_links(docs, distinct, width, similarity))
    return rows.select("doc_id", "fp"), distinct.join(found, distinct["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))


def groups(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) for each row of ``docs``; component_id is the smallest doc_id of the group, null if it has none."""
    rows, of = _groups(docs, width, similarity)
    named = lambda c: F.when(F.col(c) < NAMELESS, F.col(c)).alias(c)
    return rows.join(of, "fp").select(named("doc_id"), named("component_id"))


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with all their columns, one row of each group of near copies: that of the smallest doc_id.

    Of several rows with that id the one with the least hash of its columns stays, so
    reruns agree.  Of a group without any id one row stays.
    """
    rows, of = _groups(docs, width, similarity)
    key, n, row, order = fresh(docs, "key", "n", "row", "order")
    named = rows.join(of, "fp").groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias(n)).withColumnRenamed("doc_id", key)
    # ids that go and ids that several rows have are few, so mostly nothing but them is moved
    gone = named.filter(F.col("c") < F.col(key)).select(key)
    several = materialize(named.filter((F.col("c") == F.col(key)) & (F.col(n) > 1)).select(key), "several")
    left = docs.withColumn(key, _key()).join(materialize(gone, "gone"), key, "left_anti")
    if several.isEmpty():
        return left.select(*columns(docs))
    hashed = [c for c, f in zip(columns(docs), docs.schema.fields, strict=True) if "map<" not in f.dataType.simpleString()]
    repeated = left.join(several, key, "left_semi").select(key, F.struct(*columns(docs)).alias(row), F.xxhash64(*hashed).alias(order))
    one = repeated.groupBy(key).agg(F.min_by(row, order).alias(row)).select(f"{row}.*")
    return left.join(several, key, "left_anti").select(*columns(docs)).union(one)
