import random

import corpus_pipeline
from cloakframe.llm import near_copies, simhash


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    label = [d for d, _ in rows]
    changed = True
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    while changed:
        changed = False
        for i, j in pairs:
            low = min(label[i], label[j])
            changed |= label[i] != label[j]
            label[i] = label[j] = low
    return {d: c for (d, _), c in zip(rows, label, strict=True)}


def planted(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for b in range(12):
        base = rng.choices(words, k=rng.randint(60, 300))
        rows.append((b * 100 + 50, " ".join(base)))
        for k in range(8):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((b * 100 + k, " ".join(t)))
    rows += [(5000, None), (5001, " "), (5002, "one two"), (5003, "One  two"), (5004, "a b c d e f g h i"), (5005, "a b c d e f g h"), (5006, "a b c d e f g")]
    return rows


def test_stage_keeps_one_of_near_copies(spark, tmp_path):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    # copies that differ in more than two bits of op2's fingerprint
    text = dict(rows)
    bits = [(simhash.text_fingerprint(text[d].encode()) ^ simhash.text_fingerprint(text[c].encode())).bit_count() for d, c in want.items() if d != c and text[d] and text[c]]
    assert sum(b > 2 for b in bits) > 20
    got = {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, str(tmp_path)).collect()}
    assert got == set(want.values()) and len(got) < len(rows)


def test_groups_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 3)
    rows = planted(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.groups(docs).collect()} == brute(rows)


def test_edges(spark):
    schema = "doc_id long, text string"
    assert near_copies.keep_one(spark.createDataFrame([], schema)).collect() == []
    t = "k l m n o p q r s t"
    rows = [(None, t), (5, t), (7, t + " u"), (7, "quite another text of its own here"), (None, "zz"), (None, "zz")]
    got = near_copies.keep_one(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("5", t), ("None", "zz")]


def test_rows_without_an_id_are_linked(spark):
    words = [f"v{i}" for i in range(60)]
    near = lambda k: " ".join([*words[:k], "other", *words[k + 1 :]])
    rows = [(None, near(20)), (9, " ".join(words)), (None, "u1 u2 u3 u4 u5 u6"), (None, "u1 u2 u3 u4 u5 u6"), (11, near(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in near_copies.groups(docs).collect())
    assert got == [("11", "9"), ("9", "9"), ("None", "9"), ("None", "None"), ("None", "None")]
    assert sorted((str(r.doc_id), r.text) for r in near_copies.keep_one(docs).collect()) == [("9", rows[1][1]), ("None", rows[2][1])]


def test_clashing_columns_and_repeated_ids(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(1, t, 5, "a", 1, "x"), (1, t, 5, "b", 2, "y"), (2, t, 6, "c", 3, "z"), (3, "alone it is", 7, "d", 4, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long, n string, `row` int, `a.b` string")
    got = near_copies.keep_one(docs)
    assert got.columns == docs.columns
    first = sorted(map(tuple, got.collect()))
    assert len(first) == 2 and first[0][0] == 1 and first[1] == rows[3]
    assert sorted(map(tuple, near_copies.keep_one(docs.repartition(7)).collect())) == first


def test_very_long_texts(spark):
    t = " ".join(f"w{i}" for i in range(200_000))
    docs = spark.createDataFrame([(1, t), (2, t + " end"), (3, t[: len(t) // 2])], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == [1, 3]
