"""Document fingerprints: bottom-k sketches of shingle hashes, DataFrame functions only.

A sketch is the sorted array of the ``K`` smallest distinct hashes of a text's shingles
of five words (a shorter text is one shingle; a text without words has an empty
sketch).  Sketches of parts merge to the sketch of the whole.  From two sketches follow
estimates of resemblance and containment, from one the number of distinct shingles;
below ``K`` hashes the answers are exact.

Words are runs of other than white space; hashes are the upper 40 bits of XXH64 (seed 42)
of a shingle's words, joined by spaces.  Null texts are empty texts.  Two empty sketches
resemble each other wholly, an empty and another one not at all.  A null doc_id comes last in descending order, repeated rows and
rows of one id are told apart by their texts, ties cannot occur otherwise.  Very long
texts are hashed as a whole, with memory in proportion.  Further columns are left out
whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.scratch import materialize

K = 128
WIDTH = 5
BITS = 40
#: Stands for a null doc_id in keys; no document has this id.
NO_ID = -(1 << 63)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _of_words(w: Column, k: int, width: int) -> Column:
    n = F.size(w)
    hashed = lambda words: F.shiftrightunsigned(F.xxhash64(F.array_join(words, " ")), 64 - BITS)
    many = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: hashed(F.slice(w, i, width)))
    one = F.array(hashed(w))
    hashes = F.when(n >= width, many).when(n > 0, one).otherwise(F.array().cast("array<bigint>"))
    return bottom(hashes, k)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """``df`` with the sketch of column ``text`` as ``name``."""
    # the words are bound by a one-element transform, so that they are split once
    return df.withColumn(name, F.transform(F.array(words(F.col(text))), lambda w: _of_words(w, k, width))[0])


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return bottom(F.concat(a, b), k)


def merge_by(df: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each value of ``keys``; each task keeps k hashes of a key before the shuffle."""
    h = df.select(*keys, F.explode(sketch).alias("_h")).groupBy(*keys, "_h").agg(F.lit(1).alias("_one"))
    top = h.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).filter(F.col("_r") <= k)
    return top.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of both that each of them has (0 to 1)."""
    union = merged(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(common / F.size(union)).cast("double")


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too."""
    joint = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), joint / distinct_count(a, k)))


def distinct_count(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    full = (k - 1) * float(1 << BITS) / (F.element_at(sketch, -1) + 1)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(full)


def encoded(sketch: Column) -> Column:
    """The sketch as text, on one line."""
    digits = F.transform(sketch, lambda h: F.lpad(F.hex(h), BITS // 4, "0"))
    return F.translate(F.base64(F.unhex(F.array_join(digits, ""))), "\r\n", "")


def decoded(text: Column) -> Column:
    """The sketch that ``encoded`` has written."""
    digits = F.hex(F.unbase64(text))
    at = F.sequence(F.lit(0), (F.length(digits) / (BITS // 4)).cast("int") - 1)
    return F.when(F.length(digits) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(at, lambda i: F.conv(F.substring(digits, i * (BITS // 4) + 1, F.lit(BITS // 4)), 16, 10).cast("bigint")))


def _neighbours(docs: DataFrame) -> tuple[DataFrame, bool]:
    """For each distinct (k1, k2): the keys of the document before it in descending order, and that one's length.

    Also whether rows repeat.  Only ids and lengths are sorted and joined.
    """
    ids = docs.groupBy("k1", "k2").agg(F.max(F.char_length("text")).alias("n"), F.count("*").alias("c"))
    # written once: the numbers below depend on how rows fell into partitions
    ids = materialize(ids.orderBy(F.desc("k1"), "k2").withColumn("m", F.monotonically_increasing_id()), "order")
    at = ids.withColumn("part", F.shiftright("m", 33)).withColumn("place", F.col("m").bitwiseAND((1 << 33) - 1))
    parts = at.groupBy("part").agg(F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = parts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    ranked = at.join(parts, "part").select("k1", "k2", "n", (F.col("base") + F.col("place")).alias("rank"))
    total, most = ids.agg(F.count("*"), F.max("c")).first()
    left = ranked.select("k1", "k2", F.when(F.col("rank") == 0, F.lit(total - 1)).otherwise(F.col("rank") - 1).alias("r"))
    prev = ranked.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("n") / 3).cast("int").alias("need"), F.col("rank").alias("r"))
    return left.join(prev, "r").drop("r"), bool(most and most > 1)


def fingerprint_documents(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Sketches of every text and of its edited text, and how alike they are.

    The edited text has its last third replaced by the start of the next document's
    text, in descending order of doc_id (after the last, the first).  Rows with one id
    but different texts are different documents; rows that repeat wholly are one
    document and all get its result.  A null doc_id comes last.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k1"), F.xxhash64(text).alias("k2"), text.alias("text"))
    near, repeated = _neighbours(rows)
    starts = with_sketch(rows.join(near, ["k1", "k2"]), "text", "next_sketch", k, width)
    starts = starts.select("p1", "p2", F.substring("text", F.lit(1), F.col("need")).alias("start"), "next_sketch")
    if repeated:
        starts = starts.groupBy("p1", "p2").agg(F.min(F.struct("start", "next_sketch")).alias("s")).select("p1", "p2", "s.*")
    starts = starts.withColumnsRenamed({"p1": "k1", "p2": "k2"})
    n = F.char_length("text")
    whole = rows.join(starts, ["k1", "k2"]).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - (n / 3).cast("int")), "start"))
    whole = with_sketch(with_sketch(whole, "text", "s", k, width), "edited", "e", k, width)
    return whole.select(
        F.when(F.col("k1") != NO_ID, F.col("k1")).alias("doc_id"),
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        encoded(F.col("s")).alias("fingerprint"),
        encoded(F.col("e")).alias("edited_fingerprint"),
        resemblance(F.col("s"), F.col("e"), k).alias("near_edited"),
        resemblance(F.col("s"), F.col("next_sketch"), k).alias("near_next"),
        distinct_count(F.col("s"), k).alias("distinct_shingles"),
        containment(F.col("e"), F.col("s"), k).alias("edited_contained"),
    )
