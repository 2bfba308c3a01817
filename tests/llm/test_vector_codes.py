"""Codes against a plain loop over all vectors, and the cases of the docstring."""

import math

import numpy as np
import pytest

from cloakframe.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors, parts=16, entries=64, rounds=2):
    x = [[[math.floor(256 * c) for c in v[k * len(v) // parts : (k + 1) * len(v) // parts]] for k in range(parts)] for v in vectors]
    books = [[x[i][k] for i in range(min(entries, len(x)))] for k in range(parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for k in range(parts):
            held = {}
            for v in x:
                held.setdefault(near(v[k], books[k])[1], []).append(v[k])
            for i, mine in held.items():
                books[k][i] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [[near(v[k], books[k]) for k in range(parts)] for v in x]
    return [([i for _, i in f], sum(d for d, _ in f)) for f in found], books


def test_against_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    made = np.round(rng.normal(size=(150, 32)) / 8, 2).astype(np.float32)
    made[40:110] = made[40]  # a hot vector
    rows = [(i, v.tolist(), None if i % 3 else i % 2) for i, v in enumerate(made)]
    coded, books = V.compress(spark.createDataFrame(rows, SCHEMA))
    want, entries = brute([v.astype(float).tolist() for v in made])
    assert books.tolist() == entries
    got = {r.vec_id: (r.codes, r.error) for r in coded.collect()}
    assert [got[i] for i in range(150)] == want
    sums = {}
    for (i, _, label), (_, e) in zip(rows, want, strict=True):
        sums[label] = sums.get(label, 0) + e
    assert {r.vec_id: r.label_error for r in V.with_label_errors(coded).collect()} == {i: sums[label] for i, _, label in rows}


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [nan] * 16, 0), (4, [inf] * 16, 0), (5, [0.1] * 15 + [None], 0), (6, [0.5] * 20, 0), (7, [0.5] * 16, 1), (7, [0.5] * 16, 1), (None, [3e38] * 16, None), (8, [-0.001] * 16, 2)]
    coded, books = V.compress(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", codes int"))
    assert books[0, :, 0].tolist() == [128, 128, -1, V.CLIP]
    got = sorted((r.vec_id or 0, r.codes[0], r.error) for r in coded.collect())
    assert [x[0] for x in got] == [0, 7, 7, 8] and all(x[2] == 0 for x in got)
    # lengths that the parts do not divide are filled with zeros
    coded, books = V.compress(spark.createDataFrame([(1, [0.5] * 20, 0), (2, [0.25] * 20, 0)], SCHEMA))
    assert books.shape == (16, 2, 2) and books[15, 0].tolist() == [0, 0] and coded.count() == 2
    coded, books = V.compress(spark.createDataFrame([], SCHEMA))
    assert coded.collect() == [] and books.size == 0 and V.with_label_errors(coded).collect() == []


@pytest.mark.parametrize("hot", [1, 4, 1000])
def test_join_is_whole_whatever_is_hot(spark, hot, monkeypatch):
    monkeypatch.setattr(V, "HOT", hot)
    left = spark.createDataFrame([(i % 7 if i % 2 else 0, i) for i in range(200)], "k int, i int")
    right = left.groupBy("k").count().withColumnRenamed("count", "w").selectExpr("k", "w", "k * 10 as v")
    got = sorted((r.i, r.v) for r in V.joined_by_weight(left, right, ["k"], "w", 200).collect())
    assert got == sorted((r.i, r.k * 10) for r in left.collect())
