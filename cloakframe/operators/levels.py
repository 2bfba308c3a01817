"""Levels of documents that have to be taken one after another.

Documents of a matter depend on one another where they share a key: the younger one sees
what the older one made.  A document's level is the longest chain of documents, each older
than and sharing a key with the next, that ends at it; documents of a level share nothing
and go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.sources.store import settled


def levels(members: DataFrame, most: int = 1_000) -> DataFrame:
    """(matter_id, document_id, level) of documents in ``members`` (matter_id, document_id, created_at, key).

    Along one key the documents are a chain by age.  A round raises every document to what
    its chains ask for: at place p of a chain p + max(level - place) over the places up to
    p, a running maximum; of a document's chains the highest counts.  A round so runs along
    whole chains, and there are as many as the longest path changes its key, not as it has
    documents.  Keys that one document holds ask for nothing and are left out first.

    A null key is none; repeated rows count once; documents of equal age go by id; a document
    without a shared key is at level 1; no rows give no rows.  A chain is one window's rows,
    an id and two numbers each.
    """
    of = ["matter_id", "document_id"]
    docs = settled(members.groupBy(*of).agg(F.min("created_at").alias("created_at")))
    held = members.filter("key is not null").select(*of, "key").distinct().join(docs, of)
    chain = Window.partitionBy("matter_id", "key").orderBy("created_at", "document_id")
    placed = held.withColumn("n", F.count("*").over(Window.partitionBy("matter_id", "key"))).filter("n > 1")
    placed = settled(placed.select(*of, "key", "created_at", F.row_number().over(chain).alias("place")))
    now = settled(docs.select(*of, F.lit(1).alias("level")))
    total = docs.count()
    upto = Window.partitionBy("matter_id", "key").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    for _ in range(most):
        asked = placed.join(now, of).withColumn("asked", F.col("place") + F.max(F.col("level") - F.col("place")).over(upto))
        raised = asked.groupBy(*of).agg(F.max("asked").alias("asked"))
        now = settled(now.join(raised, of, "left").select(*of, F.greatest("level", "asked").alias("level")))
        after = now.agg(F.sum("level")).first()[0] or 0
        if after == total:
            return now
        total = after
    raise RuntimeError("levels did not settle")
