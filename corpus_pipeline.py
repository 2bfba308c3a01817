"""A corpus from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents.  The stages work on everything that the one before has kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakframe.llm import mixing, near_copies, packing, suffix_dedup, toxicity
from cloakframe.llm.queries import tokenizer_path
from cloakframe.llm.scratch import mark, materialize, release


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field, fitted to the labelled ones, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.train(docs, labels))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8)."""
    return near_copies.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has."""
    return suffix_dedup.keep_first(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.apply(docs, mixing.mix(docs, mixing.label_quality(labels)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences of tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", one_of_each),
    ("suffix_array_dedup", without_repeats),
    ("source_mixing", mixed),
    ("packing", packed),
]

#: No SQL expresses the trained field and the tokenizer; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, over all documents; what a stage has written on its way goes with its end."""
    out, began = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark(spark)
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if k < len(STAGES) - 1:
            out = materialize(out, name)
            release(spark, began, but=out)
    return out
