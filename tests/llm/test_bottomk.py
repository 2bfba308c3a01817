import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cloakframe.llm import bottomk as bk


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def _rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)] + ["été", "日本語", "😀"]
    rows = [(i * 7 % 101 * 10, " ".join(rng.choices(words, k=rng.choice([1, 3, 5, 9, 60, 900])))) for i in range(101)]
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "a\tb")]
    return rows


def test_against_sets(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "1 n", "2 s", "3 k1")
    got = {r.doc_id: r for r in bk.fingerprint_documents(df).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + nxt[:m]
        r = got[d]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        exact = len(shingles(t) | shingles(edited)) <= bk.K
        assert r.near_edited == pytest.approx(jaccard(t, edited), abs=1e-9 if exact else 0.16)
        assert r.near_next == pytest.approx(jaccard(t, nxt), abs=1e-9 if len(shingles(t) | shingles(nxt)) <= bk.K else 0.16)
        assert r.distinct_shingles == pytest.approx(len(shingles(t)), rel=0.35)
        assert 0 <= r.edited_contained <= 1


def test_ties_nulls_and_empty(spark):
    assert bk.fingerprint_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = bk.fingerprint_documents(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    rows = [(1, "x y z"), (1, "x y z"), (1, "other text here"), (None, "n"), (2, "q r s t u v w")]
    got = bk.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "1", "2", "None"]
    assert len({r.fingerprint for r in got}) == 4


def test_merging_and_text_form(spark):
    df = spark.createDataFrame(_rows(), "doc_id long, text string")
    s = bk.with_sketch(df, "text", "sketch").withColumn("g", F.col("doc_id") % 3)
    assert s.filter(bk.decoded(bk.encoded(F.col("sketch"))) != F.col("sketch")).count() == 0
    by = {r.g: r.sketch for r in bk.merge_by(s, ["g"]).collect()}
    hashes = {}
    for r in s.select("g", "sketch").collect():
        hashes.setdefault(r.g, set()).update(r.sketch)
    assert by == {g: sorted(h)[: bk.K] for g, h in hashes.items()}
    pair = spark.createDataFrame([([1, 3, 9], [2, 3, 8])], "a array<bigint>, b array<bigint>")
    r = pair.select(bk.merged(F.col("a"), F.col("b"), 4).alias("m"), bk.containment(F.col("a"), F.col("b")).alias("c")).first()
    assert r.m == [1, 2, 3, 8] and r.c == pytest.approx(1 / 3)


def test_very_long_text_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    df = spark.createDataFrame([(1, long, 1, 2, 3), (2, long[: len(long) // 2], 4, 5, 6)], "doc_id long, text string, k1 long, n long, fingerprint long")
    got = {r.doc_id: r for r in bk.fingerprint_documents(df).collect()}
    assert got[1].n_chars == len(long) and got[1].distinct_shingles == pytest.approx(149_996, rel=0.35)
    assert got[1].near_next == got[2].near_next == pytest.approx(0.5, abs=0.2)
