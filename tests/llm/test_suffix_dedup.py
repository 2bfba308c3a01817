import random

import numpy as np
from pyspark.sql import functions as F

from cloakframe.llm import suffix_dedup as sd


def brute(rows, n=50):
    least = {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    key = lambda d: float("inf") if d is None else d
    for d, b in raw:
        for i in range(len(b) - n + 1):
            s = b[i : i + n]
            least[s] = min(least.get(s, float("inf")), key(d))
    out = []
    for d, b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if least[b[i : i + n]] < key(d):
                gone[i : i + n] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((str(d), len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return sorted(out)


def _rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["été", "日本語", "aaaa"]
    passages = [" ".join(rng.choices(words, k=rng.randint(8, 40))) for _ in range(12)]
    line = "Terms and conditions of this licence apply to all."
    rows = []
    for i in range(150):
        t = " ".join(rng.choices(words, k=rng.randint(0, 60)))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a, b = sorted(rng.sample(range(len(p) + 1), 2)) if rng.random() < 0.5 else (0, len(p))
            at = rng.randint(0, len(t))
            t = t[:at] + p[a:b] + t[at:]
        if rng.random() < 0.4:
            t += line + str(i)
        rows.append((rng.randrange(100_000), t))
    rows += [(rng.randrange(100_000), rows[k][1]) for k in (3, 3, 4)]
    rows += [(200_000, None), (200_001, ""), (200_002, "a" * 300), (200_003, "a" * 80), (200_004, "ab" * 100), (200_005, "x" + "ab" * 40), (200_006, "a" * 49)]
    rows += [rows[9], rows[9], (None, passages[0]), (None, passages[0] + "z"), (rows[10][0], passages[1] * 2), (200_007, "\x00" * 70), (200_008, "q" + "\x00" * 60)]
    return rows


def collected(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect())


def test_against_brute_force(spark, monkeypatch):
    rows = _rows(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "1 d", "2 t", "3 data")
    assert collected(sd.deduplicate(df, 3)) == brute(rows)
    assert collected(sd.deduplicate(df, 3, hot=3)) == brute(rows)  # most anchors are hot


def test_suffix_order_is_sorted():
    rng = np.random.default_rng(0)
    cell = rng.integers(97, 100, (300, sd.WIDTH), dtype=np.uint8)
    cell[:40] = 97
    cell[40:60, 30:] = 0
    cell[60:80] = cell[80:100]
    order = sd.suffix_order(cell)
    text = [bytes(r) + bytes(60) for r in cell]
    at = [divmod(int(o), sd.WIDTH + 1) for o in order]
    keys = [text[r][j : j + sd.LENGTH] for r, j in at if j < sd.STARTS]
    assert keys == sorted(keys) and len(keys) == 300 * sd.STARTS


def test_equal_strings_have_equal_anchors():
    rng = random.Random(5)
    for _ in range(200):
        s = bytes(rng.choices(b"abc", k=sd.LENGTH))
        found = []
        for _ in range(2):
            t = bytes(rng.choices(b"abc", k=rng.randint(0, 90))) + s + bytes(rng.choices(b"abc", k=rng.randint(0, 90)))
            pos, h = sd.anchors(np.frombuffer(t, np.uint8))
            i = t.index(s)
            found.append({int(x) for p, x in zip(pos, h, strict=True) if i <= p <= i + sd.LENGTH - sd.GRAM})
        assert found[0] & found[1]


def test_long_texts_in_steps(monkeypatch):
    rng = np.random.default_rng(2)
    t = rng.integers(97, 123, 5000, dtype=np.uint8)
    whole = sd.anchors(t)
    monkeypatch.setattr(sd, "STEP", 97)
    parts = sd.anchors(t)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_edges(spark):
    assert sd.deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(2, "x" * 60), (1, "x" * 55)], "doc_id long, text string")
    assert collected(sd.deduplicate(df).withColumn("z", F.lit(1)))[1][2] == 60


def test_very_long_text(spark):
    rng = np.random.default_rng(4)
    long = rng.integers(97, 123, 3_000_000, dtype=np.uint8).tobytes().decode()
    df = spark.createDataFrame([(1, long), (2, "z" + long[:2_000_000] + "y"), (3, long[500:600])], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in sd.deduplicate(df).collect()}
    assert got == {1: (0, long.encode()), 2: (2_000_000, b"zy"), 3: (100, b"")}


def test_partitions_are_dealt_one_number_each(spark):
    rows = sd.dealt(spark.range(700).selectExpr("id % 37 as q", "id"), "q", 37).select("q", F.spark_partition_id().alias("part")).distinct().collect()
    assert len(rows) == 37 and len({r.part for r in rows}) == 37
