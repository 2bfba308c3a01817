import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cloakframe.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, got, window):
    t = Tokenizer.from_file(PATH)
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 2] for d, x in rows}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(own) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert set(by_doc) == set(ids)
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0
            at += p.length
        assert at == len(ids[d])
    padding = total = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0, padding
    return total


def _rows(n=300, seed=0):
    rng = random.Random(seed)
    words = ["Hello", "naïve", "it's", "x1y2", "été", "<|endoftext|>", "a b", "İstanbul", "ΣΑΣ", "日本", "!!", "é", "a\x1cb", "\x85"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 7, 7, 7, 30, 500])))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "word " * 9000), (n + 4, "w" * 5000)]


@pytest.mark.parametrize("window", [4096, 256])
def test_round_trip(spark, window):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 n", "2 ids", "3 rank")
    check(rows, packing.pack(df, PATH, window).collect(), window)


@pytest.mark.parametrize("seed, most, window", [(3, 400, 256), (4, 3, 256), (5, 1, 256), (6, 50, 64), (7, 5000, 512)])
def test_plan_covers_every_rank_once(seed, most, window):
    rng = random.Random(seed)
    hist = {rng.randint(1, window - 1): rng.randint(1, most) for _ in range(90)}
    plan = packing.Plan(hist, window)
    total = sum(k * v for k, v in hist.items())
    sums, pieces = defaultdict(int), defaultdict(list)
    for length, count in hist.items():
        for rank in {0, count - 1, *range(0, count, max(1, count // 400))} if most > 1000 else range(count):
            at = 0
            for start, m, q, o in plan.place(length, rank):
                assert start == at and m > 0 and 0 <= q < plan.after
                at += m
                sums[q] += m
                pieces[q].append((o, m))
            assert at == length
    if most <= 1000:
        for q, v in pieces.items():
            assert [o for o, _ in sorted(v)] == np.cumsum([0, *(m for _, m in sorted(v))])[:-1].tolist()
        assert sum(sums.values()) == total and set(sums) == set(range(plan.after))
        assert all(n == window or n & (n - 1) == 0 for n in sums.values())


def test_most_tokens_are_placed_by_the_counts():
    rng = random.Random(8)
    lengths = [min(4095, max(1, int(rng.lognormvariate(6.2, 0.9)))) for _ in range(20_000)]
    hist = Counter(lengths)
    plan = packing.Plan(hist)
    total = sum(lengths)
    assert plan.solved > 0.7 * total and plan.loose < 0.01 * total


def test_a_full_histogram_is_solved_in_seconds():
    began = time.time()
    plan = packing.Plan({k: 100_000 // k + 1 for k in range(1, 4096)})
    assert time.time() - began < 60 and plan.solved > 0


def test_least_squares():
    hist = {200: 50, 100: 80, 56: 90}
    columns = packing.combinations(hist, 256, 0)
    assert ((1, 200), (1, 56)) in columns and ((2, 100), (1, 56)) in columns
    x = packing.solve(columns, hist)
    fit = defaultdict(float)
    for k, column in zip(x, columns, strict=True):
        for m, a in column:
            fit[a] += m * k
    assert abs(fit[200] - 50) < 1 and abs(fit[100] - 80) < 1 and abs(fit[56] - 90) < 1


def test_hot_lengths_are_salted(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL", 20)
    rows = [(i, "one two three") for i in range(150)] + [(None, f"four five {i}") for i in range(60)] + [(999, "word " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(df, PATH).collect()
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        assert [o for o, _ in sorted(v)] == np.cumsum([0, *(m for _, m in sorted(v))])[:-1].tolist()
    again = packing.pack(df.repartition(5), PATH).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_edges(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    rows = [(None, "a b"), (1, "a b"), (1, "a b")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert sum(r.length for r in got) == 9 and sum(r.doc_id is None for r in got) >= 1
