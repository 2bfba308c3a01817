import itertools
import random
import zlib

import numpy as np
import pytest

from cloakframe.llm import crf, toxicity


def brute(scores, chain):
    """Marginals and the best labels of one sequence by trying all labellings."""
    n = len(scores)
    move = {(0, 0): 0.0, (0, 1): chain.enter, (1, 0): chain.leave, (1, 1): chain.stay}
    total, m, best = 0.0, np.zeros(n), (-np.inf, None)
    for y in itertools.product((0, 1), repeat=n):
        s = sum(a * b for a, b in zip(scores, y, strict=True)) + sum(move[p] for p in itertools.pairwise(y))
        total += np.exp(s)
        m += np.exp(s) * np.array(y)
        best = max(best, (s, y))
    return m / total, np.array(best[1], bool)


def test_marginals_and_decoding_against_all_labellings():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 2, 5, 7])
    scores = rng.normal(0, 2, (7, 4))
    chain = crf.Chain(-1.0, 0.3, 0.8)
    m, y = crf.marginals(scores, lengths, chain), crf.decode(scores, lengths, chain)
    for j, n in enumerate(lengths):
        want, labels = brute(scores[:n, j], chain)
        assert m[:n, j] == pytest.approx(want) and (y[:n, j] == labels).all()
        assert not m[n:, j].any() and not y[n:, j].any()


def test_fit_has_a_vanishing_gradient():
    rng = np.random.default_rng(1)
    shape, lengths = (6, 200), rng.integers(1, 7, 200)
    place = np.flatnonzero(rng.random(shape).reshape(-1) < 0.7)
    feature = rng.integers(0, 3, len(place))
    labels = np.zeros(shape)
    labels.reshape(-1)[place] = rng.random(len(place)) < np.array([0.1, 0.5, 0.9])[feature]
    labels[np.arange(6)[:, None] >= lengths] = 0
    theta, bias, chain = crf.fit(feature, np.arange(len(place)), place, shape, lengths, labels, np.ones(200), 3, rounds=600)
    scores = np.full(shape, bias)
    scores.reshape(-1)[place] += theta[feature]
    m = crf.marginals(scores, lengths, chain)
    inside = (np.arange(6)[:, None] < lengths).reshape(-1)[place]
    for f in range(3):
        at = place[(feature == f) & inside]
        assert m.reshape(-1)[at].mean() == pytest.approx(labels.reshape(-1)[at].mean(), abs=0.02)


def _corpus(n=900, seed=0):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "su") for b in ("na", "ko", "vi", "den", "st")]
    rude = ["grob", "fiesl"]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(5, 80))
        y = rng.random() < 0.2
        if y:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randint(0, len(words)), rng.choice(rude) + rng.choice(["", "er", "isch", f"x{rng.randint(0, 30)}"]) + rng.choice(["", ",", "!"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(y)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = _corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 toxic", "2 id")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    scorer = toxicity.train(docs, lab, sample=150)
    got = {r.doc_id: r for r in toxicity.score(docs, scorer).collect()}
    y = dict(labels)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    out = [d for d, r in got.items() if r.held_out]
    assert sum(got[d].predicted == y[d] for d in out) / len(out) > 0.95
    text = dict(rows)
    for d in out:
        assert 0 <= got[d].score <= 1 and got[d].predicted == int(got[d].score >= 0.3)
        for s in got[d].spans:
            assert text[d][s.start : s.end] and not text[d][s.start].isspace()
    bad = next(d for d in out if y[d] and got[d].predicted)
    assert any(text[bad][s.start : s.end].startswith(("grob", "fiesl")) for s in got[bad].spans)


def test_labels_of_held_out_rows_are_not_used(spark):
    rows, labels = _corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    other = [(d, 1 - y if zlib.crc32(str(d).encode()) % 4 == 2 else y) for d, y in labels]
    a, b = (toxicity.train(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, other))
    assert a.model == b.model and (a.document == b.document).all()


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    empty = spark.createDataFrame([], "doc_id long, text string")
    scorer = toxicity.train(empty, none)
    assert toxicity.score(empty, scorer).collect() == []
    rows, labels = _corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scorer = toxicity.train(docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"))
    odd = spark.createDataFrame([(None, "grob fieslx"), (1, None), (2, ""), (2, ""), (3, "grob " * 30_000), (4, "\x85 \x1c")], "doc_id long, text string")
    got = [(r.doc_id, r.predicted) for r in toxicity.score(odd, scorer).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(None, 1), (1, 0), (2, 0), (2, 0), (3, 1), (4, 0)]))


def test_long_labelled_texts_are_not_collected(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LONGEST", 2000)
    rows, labels = _corpus(200)
    more = [(10_000 + i, "grob " * 5000) for i in range(4)]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string").selectExpr("*", "'x' id", "1 score")
    a = toxicity.train(docs, spark.createDataFrame(labels + [(d, 0) for d, _ in more], "doc_id long, toxic int"))
    b = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert a.model == b.model
