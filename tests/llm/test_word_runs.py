"""Runs against a brute force over all distances, sieve and automaton apart."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cloakframe.llm import queries as Q
from cloakframe.llm import word_runs as W

SCHEMA = "doc_id long, text string"


def brute(w, exponent=4, least=6):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((a, n, q) for (a, n), q in found.items())


def some_words(rng):
    s = [rng.randint(0, rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 40))]
    if s and rng.random() < 0.6:
        a, p = rng.randrange(len(s)), rng.randint(1, 5)
        s = [s[i] if i < a else s[min(a + (i - a) % p, len(s) - 1)] for i in range(len(s))]
    return s


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (2, 6), (3, 6), (5, 3), (4, 2)])
def test_runs_and_collapse(exponent, least):
    rng = random.Random(exponent * 100 + least)
    for _ in range(300):
        s = some_words(rng)
        want = brute(s, exponent, least)
        assert W.runs(s, exponent, least) == want
        found, collapsed = W._collapse([b" a\n", " ".join("abcd"[c] for c in s).encode(), b""], exponent, least)
        assert found == [[], want, []]
        gone = {i for a, n, q in want for i in range(a + q, a + n)}
        assert collapsed == [b"a", " ".join("abcd"[c] for i, c in enumerate(s) if i not in gone).encode(), b""]


def test_long_texts():
    assert W.runs([7] * 50_000) == [(0, 50_000, 1)]
    rng = random.Random(5)
    s = [rng.randint(0, 9) for _ in range(2_000)] * 5
    assert (0, 10_000, 2_000) in W.runs(s)


def test_ordered_set_over_many_blocks():
    rng, ends, plain = random.Random(1), W.Ends(50_000), [50_000]
    for x in rng.sample(range(50_000), 9_000):
        below, above = ends.add(x)
        assert below == max((y for y in plain if y < x), default=None) if len(plain) < 200 else True
        assert above == min((y for y in plain if y > x), default=None) if len(plain) < 200 else True
        plain.append(x)
    assert list(ends) == sorted(plain) and ends.size == len(plain)


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b a b a b a b"), (4, "a b a b a b a b"), (None, "x x x x x x"), (5, "é é é é é é y")]
    got = W.find_runs(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA + ", runs int")).collect()
    assert sorted((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in got) == [
        (0, [(0, 6, 1)], "x"), (1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 8, 2)], "a b"), (4, [(0, 8, 2)], "a b"), (5, [(0, 6, 1)], "é y"),
    ]
    assert W.find_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_greatest_is_exact(spark):
    kind = "array<struct<start:bigint,length:bigint,period:bigint>>"
    data = [([(0, 9, 2), (20, 18, 4), (3, 27, 6)],), ([(5, 8, 2), (0, 8, 2)],), ([],)]
    got = [r[0] for r in spark.createDataFrame(data, f"runs {kind}").select(W.greatest(F.col("runs"))).collect()]
    assert [tuple(x) if x else None for x in got] == [(0, 9, 2), (0, 8, 2), None]


def test_query_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in Q.QUERIES["op11_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    white = {chr(c) for c in [*range(9, 14), 32]}
    for d in docs:
        w = "".join(" " if c in white else c for c in d.text or "").split(" ")
        w = [x for x in w if x]
        h, n = zlib.crc32(str(d.doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 2_000:
            continue
        want, r = brute(w), got[d.doc_id]
        gone = {i for a, m, q in want for i in range(a + q, a + m)}
        assert r.n_runs == len(want)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
        best = max(want, key=lambda x: (x[1] / x[2], -x[0]), default=(None,) * 3)
        assert (r.start, r.length, r.period) == best and r.exponent_milli == (1000 * best[1] // best[2] if want else None)
