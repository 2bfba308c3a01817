import random
import re

from cloakframe.llm import mixing


def _rows(seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        s = "big" if rng.random() < 0.5 else rng.choice(["a", "b", "é", "Z", None, "tiny"]) if rng.random() < 0.95 else "x"
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 200])) if rng.random() < 0.97 else None, s))
    return rows + [rows[5]] * 3


def check(rows, got):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total, by = 0, {}
    for _, t, s in rows:
        by[s] = by.get(s, 0) + size(t)
        total += size(t)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), float(total)
    while free:
        share = {s: w[s] / sum(w[x] for x in free) * rest for s in free}
        full = {s for s in free if share[s] > 3 * by[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * by[s]
            rest -= target[s]
        free -= full
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == by[r.source]
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
        e = int(r.target // r.source_size) if r.source_size else 0
        assert e * r.size <= r.taken <= (e + 1) * r.size  # whole epochs first
    for s in names:
        assert abs(taken[s] - target[s]) <= 1, (s, taken[s], target[s])


def test_targets_epochs_and_budgets(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 size", "2 target")
    got = mixing.mix(df).collect()
    check(rows, got)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_quality_raises_the_odds(spark):
    rows = [(i, "w " * 10, "a" if i % 2 else "b") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    q = spark.createDataFrame([(i, 4.0 if i % 4 < 2 else 1.0) for i in range(4000)], "doc_id long, quality double")
    got = [r for r in mixing.mix(df, q).collect() if r.source == "b"]
    high = sum(r.taken for r in got if r.doc_id % 4 < 2)
    assert high > 1.5 * sum(r.taken for r in got if r.doc_id % 4 >= 2)


def test_edges(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    r = mixing.mix(spark.createDataFrame([(1, None, None), (None, " ", "a")], "doc_id long, text string, source string")).collect()
    assert {(x.doc_id, x.taken, x.target) for x in r} == {(1, 0, 0.0), (None, 0, 0.0)}
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "doc_id long, quality int")
    assert {(x.doc_id, x.quality) for x in mixing.label_quality(labels).collect()} == {(1, 2.0), (2, 0.5), (3, 1.0)}


def test_apply_takes_what_the_mix_says(spark):
    rows = [(i, " ".join(f"w{i}" for _ in range(1 + i % 7)), "a" if i % 3 else "b", i, -i, "x", 0) for i in range(60)]
    rows += [(3, "one two", "a", 1, 1, "y", 7), (3, "one two three four five six", "b", 2, 2, "z", 13), (None, "n u l l", "b", 0, 0, "", 7), (None, "null", "a", 0, 0, "", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _id long, size long, taken string, n_chars int")
    mix = mixing.mix(df)
    got = mixing.apply(df, mix)
    assert got.columns == df.columns
    out = got.collect()
    count = lambda rs: sum(len(r["text"].split()) for r in rs)
    assert count(out) == sum(r.taken for r in mix.collect())
    for d, t in {(r.doc_id, r.text) for r in df.collect()}:
        mine = [r for r in out if r.doc_id == d and t.startswith(r.text)]
        assert all(r.n_chars == len(r.text) for r in mine if r.text != t)
    one = [r for r in out if r.doc_id is None and r["size"] == 0]
    assert all(r.text in ("n u l l", "n u l", "n u", "n", "null") for r in one)
    assert mixing.apply(df.limit(0), mix).collect() == []


def test_null_ids_have_keys_of_their_own(spark):
    rows = [(None, f"text number {i} here", "a") for i in range(400)] + [(1, "w " * 4000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keys = df.select(mixing.unit(df["doc_id"], df["text"]).alias("u")).distinct()
    assert keys.count() == 401
    check(rows, mixing.mix(df).collect())


def test_many_sources_and_very_long_texts(spark):
    rows = [(i, "a b c", f"http://s{i}") for i in range(3000)] + [(9000, "word " * 400_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    check(rows, got)
    assert next(r for r in got if r.doc_id == 9000).size == 400_000
