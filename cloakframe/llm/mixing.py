"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share, by weight, of all words; targets stop at ``cap`` times
the source's own words, the excess going to the others by weight.  A source first gives
as many complete epochs as fit.  The rest comes from a weighted sample without
replacement: each document has the exponential key ``-ln(u) / quality`` with ``u`` from
the MD5 of its id, keys are sorted within the source and sizes summed up to the budget;
the document at the edge gives the words that are still missing.

Keys are mapped to bins of equal width first, more of them the more rows there are.  Word
counts are added by source and bin, and only the bin at a source's edge is sorted, so no
source meets in one task.  Nothing but a row count reaches the driver; what is known of
the sources is a table of one row each.

Null texts have no words; a null source is a source of its own, last in order; a null
doc_id takes its key from the text; equal keys are taken in order of doc_id and size,
which leaves repeated rows alike; without words nothing is taken; very long texts are
counted as a whole; further columns are left out whatever their names (``apply`` keeps
them); an empty table gives an empty result.  Qualities that are null, not finite or not
above zero count as 1.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.scratch import columns, configure, fresh, materialize, numbered
from cloakframe.llm.streams import texts

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
#: Bins of keys, at least; above, one for so many rows.
BINS = 4096
BIN_ROWS = 20_000
SEED = 97
#: Quality of documents by label; those without a label count as 1.
LABEL_QUALITY = {1: 2.0, 0: 0.5}


def unit(doc_id: F.Column, text: F.Column, seed: int = SEED) -> F.Column:
    """A number above 0 and up to 1 from a document's id, or from its text if it has none."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 1) / F.lit(float(1 << 52))


def words(text: F.Column) -> F.Column:
    """Number of runs of other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(src, source_size, target) for each row of ``sizes`` (source, words).

    Weights repeat over the sources by code point, null last.  With sources in order of
    the words at which they are full, by weight, the level that the others share is the
    highest of what is left over the weight that is left.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())  # a row a source
    number = (F.row_number().over(everything) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), number + 1)
    s = sizes.select("source", F.col("words").alias("source_size"), w.alias("w"), (F.lit(float(cap)) * F.col("words")).alias("full"))
    before = Window.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0.0)
    s = s.withColumns({"given": F.coalesce(F.sum("full").over(before), none), "weighed": F.coalesce(F.sum("w").over(before), none)})
    whole = Window.partitionBy()
    s = s.withColumn("all_words", F.sum("source_size").over(whole)).withColumn("all_weights", F.sum("w").over(whole))
    s = s.withColumn("level", F.max((F.col("all_words") - F.col("given")) / (F.col("all_weights") - F.col("weighed"))).over(whole))
    return s.select(F.col("source").alias("src"), "source_size", F.least("full", F.col("w") * F.col("level")).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of ``docs`` (doc_id, source, text, ...).

    ``quality`` (doc_id, quality) is optional.  ``weights`` repeat over the sources by
    code point.
    """
    configure(docs.sparkSession)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), unit(F.col("doc_id"), F.col("text"), seed).alias("u"))
    if quality is not None:
        q = quality.select(F.col("doc_id").alias("qid"), F.col("quality").cast("double").alias("q")).groupBy("qid").agg(F.max("q").alias("q"))
        sized = sized.join(q, sized["doc_id"] == q["qid"], "left").drop("qid")
    else:
        sized = sized.withColumn("q", F.lit(1.0))
    q = F.when((F.col("q") > 0) & ~F.isnan("q") & (F.col("q") < float("inf")), F.col("q")).otherwise(1.0)
    sized = materialize(sized.select("doc_id", "source", "size", (-F.log("u") / q).alias("key")), "sizes")
    bins = max(BINS, math.ceil(sized.count() / BIN_ROWS))
    sized = sized.withColumn("bin", F.floor(F.col("key") / (F.col("key") + 1) * bins))
    filled = materialize(sized.groupBy("source", "bin").agg(F.sum("size").alias("words")), "bins")
    goal = targets(filled.groupBy("source").agg(F.sum("words").alias("words")), weights, cap)
    # a budget that fills one more epoch is one
    size, full = F.col("source_size"), F.floor(F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).cast("long")
    goal = goal.withColumn("epochs", F.when(size > 0, full).otherwise(0)).withColumn("budget", F.floor(F.col("target") - F.col("epochs") * size + 0.5).cast("long"))
    more = (size > 0) & (F.col("budget") >= size)
    goal = goal.withColumns({"epochs": F.col("epochs") + F.when(more, 1).otherwise(0), "budget": F.when(more | (F.col("epochs") >= cap), 0).otherwise(F.col("budget"))})
    goal = materialize(goal, "goals")
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    edge = filled.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    edge = edge.join(goal, edge["source"].eqNullSafe(goal["src"])).filter("before < budget and before + words >= budget").select(F.col("source").alias("at"), F.col("bin").alias("edge"), "before")
    # written, so that Spark knows its size when it picks the join with the rows
    known = materialize(goal.join(edge, goal["src"].eqNullSafe(edge["at"]), "left").select("src", "source_size", "target", "epochs", "budget", F.coalesce("edge", F.lit(-1)).alias("edge"), F.coalesce("before", F.lit(0)).alias("before")), "sources")
    joined = sized.join(known, sized["source"].eqNullSafe(known["src"])).drop("src")
    base = F.col("epochs") * F.col("size")
    plain = joined.filter("bin <> edge").withColumn("taken", base + F.when(F.col("bin") < F.col("edge"), F.col("size")).otherwise(0))
    order = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("before")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - gone))
    at_edge = joined.filter("bin = edge").withColumn("taken", base + part)
    cols = ["doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken")]
    return plain.select(*cols).union(at_edge.select(*cols))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _first_words(text: bytes, n: int) -> bytes:
    """The text up to the end of its nth word."""
    for k, m in enumerate(_WORD.finditer(text), 1):
        if k == n:
            return text[: m.end()]
    return text


def apply(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: ``docs`` with all their columns, each row as often as the mix takes it.

    A document taken in part comes once more, cut after the words taken; a column
    n_chars follows the text.  Of rows with one doc_id each goes by its own size: those
    of equal size, of which the mix may take one more than the other, are taken alike, as
    often as the one taken most.
    """
    configure(docs.sparkSession)
    names = docs.columns
    at = names.index("text")
    key, size, taken = fresh(docs, "key", "size", "taken")
    # rows of one id are told apart by their sizes
    count = mixed.filter("taken > 0").groupBy("doc_id", "size").agg(F.max("taken").alias(taken)).withColumnsRenamed({"doc_id": key, "size": size})
    joined = docs.join(count, docs["doc_id"].eqNullSafe(count[key]) & (words(docs["text"]) == count[size])).select(*columns(docs), size, taken)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words_in, found = b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist()
            rows = b.select(list(range(len(names))))
            copies = np.repeat(np.arange(b.num_rows), [t // n for t, n in zip(found, words_in, strict=True)])
            for s in range(0, len(copies), 2048):
                yield pa.RecordBatch.from_arrays(rows.take(pa.array(copies[s : s + 2048])).columns, names)
            part = [i for i, (t, n) in enumerate(zip(found, words_in, strict=True)) if t % n]
            if part:
                cut = rows.take(pa.array(part))
                text = [_first_words(x, found[i] % words_in[i]).decode() for x, i in zip(texts(cut.column(at)), part, strict=True)]
                changed = list(cut.columns)
                changed[at] = pa.array(text, pa.string())
                if "n_chars" in names:
                    k = names.index("n_chars")
                    changed[k] = pa.array([len(x) for x in text]).cast(cut.schema.field(k).type)
                yield pa.RecordBatch.from_arrays(changed, names)

    return numbered(joined).mapInArrow(run, docs.schema)


def label_quality(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) from a table of labels (doc_id, quality 0 or 1)."""
    q = F.lit(1.0)
    for k, v in LABEL_QUALITY.items():
        q = F.when(F.col("quality") == k, F.lit(v)).otherwise(q)
    return labels.filter("doc_id is not null").select("doc_id", q.alias("quality"))
