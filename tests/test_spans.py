"""Matches, selection and offsets against plain Python, and their time on one long block."""

import random
import re
import time

from pyspark.sql import functions as F

from cloakframe.functions import spans as S


def greedy(found):
    out, reach = [], 0
    for s, e, r in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if s >= reach:
            out.append((s, e, r))
            reach = e
    return out


def test_against_python(spark):
    rng = random.Random(4)
    texts = ["", "x", "👍", "a👍1", *("".join(rng.choice("ab1 👍é𝔸") for _ in range(rng.choice([5, 40, 900, 3000]))) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").withColumn("m", S.matches("t", "a+|1")).withColumn("w", S.wide_places("t"))
    at = F.transform(F.col("m"), lambda m: F.struct(S.to_units(F.col("w"), m["start"]).alias("u"), m["start"].alias("s")))
    df = df.withColumn("u", at).withColumn("back", F.transform("u", lambda x: S.from_units(F.col("w"), x["u"])))
    for r in df.collect():
        want = [(m.start(), m.end(), m.group()) for m in re.finditer("a+|1", r.t)]
        assert [tuple(x) for x in r.m] == want
        assert r.w == [i for i, c in enumerate(r.t) if ord(c) > 0xFFFF]
        assert [x.u for x in r.u] == [len(r.t[:s].encode("utf-16-le")) // 2 for s, _, _ in want]
        assert r.back == [s for s, _, _ in want]


def test_selection(spark):
    rng = random.Random(5)
    rows = []
    for n in (0, 1, 3, 255, 256, 257, 700):
        found = []
        for _ in range(n):
            s = rng.randint(0, n)
            found.append((s, s + rng.randint(1, 5), rng.randint(0, 2)))
        rows.append((n, found))
    df = spark.createDataFrame(rows, "n int, v array<struct<start:int,end:int,rule:int>>").withColumn("g", S.select_greedy(F.col("v")))
    for r in df.collect():
        assert [tuple(x) for x in r.g] == greedy([tuple(x) for x in r.v])


def test_one_long_block(spark):
    n = 100_000
    df = spark.range(1).select(F.repeat(F.lit("ab 1 "), n).alias("t"))
    began = time.time()
    found = df.select(S.select_greedy(F.transform(S.matches("t", "a|1"), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(0).alias("rule")))).alias("g")).select(F.size("g"), F.element_at("g", -1)["end"]).first()
    assert tuple(found) == (2 * n, 5 * n - 1) and time.time() - began < 120
