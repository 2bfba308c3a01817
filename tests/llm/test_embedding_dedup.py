import math

import numpy as np

from cloakframe.llm import embedding_dedup as ed


def brute(rows, threshold):
    good = [i for i, (_, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in good:
        for j in good:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if i != j and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links[i].add(j)
    out = []
    for i, (v, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        c = min(rows[k][0] for k in seen)
        out.append((v, len(links[i]), c, v == c))
    return sorted(out)


def _rows(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(12):
        center = rng.standard_normal(24)
        for _ in range(rng.integers(1, 25)):
            v = (center + rng.standard_normal(24) * rng.choice([0.05, 0.2, 0.35])).astype(np.float32)
            rows.append([float(x) for x in v])
    rows += [rows[3]] * 30 + [None, [0.0] * 24, [float("nan")] * 24, [1.0] + [None] * 23, [1.0, 2.0], [2.0, 4.0], [], [x * 3 for x in rows[5]]]
    ids = rng.permutation(len(rows) * 2)[: len(rows)]
    return [(int(i), r) for i, r in zip(ids, rows, strict=True)]


def test_against_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' a", "1 n", "2 e", "3 x", "4 id", "5 rep")
    for bucket in (1024, 16):
        got = sorted(map(tuple, ed.near_duplicates(df, bucket=bucket).collect()))
        assert got == brute(rows, 0.95)


def _pairs(dim, cos, n, seed=5):
    rng = np.random.default_rng(seed)
    a = ed._unit(rng.standard_normal((n, dim)))
    u = rng.standard_normal((n, dim))
    u = ed._unit(u - (u * a).sum(1, keepdims=True) * a)
    return a, cos * a + math.sqrt(1 - cos**2) * u


def test_estimates_are_unbiased_and_bounded():
    for dim in (24, 64, 200):
        bits = len(ed.embedding(dim))
        for cos in (0.3, 0.7, 0.95):
            a, b = _pairs(dim, cos, 4000)
            code, factor = ed.encode(a)
            signs = np.unpackbits(code, axis=1, count=bits) * 2.0 - 1
            estimate = (signs * (b @ ed.embedding(dim).T)).sum(1) / math.sqrt(bits) / factor
            spread = np.sqrt(1 - factor**2) / factor / math.sqrt(bits - 1)
            assert abs(estimate.mean() - cos) < 0.01 and (np.abs(estimate - cos) <= ed.EPSILON * spread).mean() > 0.9995
            angle = np.bitwise_count(code ^ ed.encode(b)[0]).sum(1) / bits * math.pi
            assert abs(angle.mean() - math.acos(cos)) < 0.01


def test_only_undecided_pairs_are_recomputed():
    a, b = _pairs(64, 0.95 + 1e-9, 500)
    code, factor = ed.encode(a)
    i, j, recomputed = ed.linked(code, factor, a, b, 0.95)
    assert {(x, y) for x, y in zip(i, j)} == set(zip(*np.nonzero(a @ b.T >= 0.95))) and 500 <= recomputed < 5000
    left, right = ed.open_rows(code.view(np.uint64), ed.encode(b)[0].view(np.uint64), 64, 0.95)
    assert left.all() and right.all() and not ed.open_rows(code.view(np.uint64)[:50], None, 64, 0.95)[0].any()


def test_stored_codes(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = ed._read(df).filter(ed._usable("e"))
    got = ed.codes(good, len(rows)).collect()
    assert sum(r.mult for r in got) == good.count() and len({(r.x, r.y) for r in got}) == len(got)
    for r in got:
        v = np.array([next(e for i, e in rows if i == r.rep)], float)
        code, factor = ed.encode(ed._unit(v))
        assert bytes(r.code) == code[0].tobytes() and abs(r.factor - factor[0]) < 1e-6 and r.dim == v.shape[1]


def test_edges(spark):
    assert ed.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    rows = [(None, [1.0, 0.0]), (4, [1.0, 0.01]), (None, [0.0, 1.0]), (9, None)]
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in ed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {(None, 1, 4, False), (4, 1, 4, True), (None, 0, None, False), (9, 0, 9, True)}


def test_tables_follow_the_recall():
    for n in (10, 10_000, 10**9):
        for dim in (1, 2, 64, 300):
            tops, signs, tables = ed.plan(n, dim, 0.95, 0.999)
            agree = ed._top_agrees(dim, 0.95) ** tops * (1 - math.acos(0.95) / math.pi) ** signs
            assert 1 - (1 - agree) ** tables >= 0.999 and (2 * dim) ** tops * 2**signs >= n / ed.FILL


def test_recall_at_the_threshold(spark):
    a, b = _pairs(64, 0.9501, 1500)
    rows = [(2 * i + k, [float(x) for x in v]) for i in range(1500) for k, v in enumerate((a[i], b[i]))]
    got = ed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), bucket=256).collect()
    assert sum(r.n_links for r in got) >= 0.99 * 3000
    assert all(r.component_id in (r.vec_id, r.vec_id - 1) for r in got)
