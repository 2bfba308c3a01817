import random
import re

import numpy as np
import pytest
import xxhash

from cloakframe.llm import simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fp = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return sorted((d, f"{fp[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows))


def test_against_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)] + ["Été", "ÉTÉ", "UPPER"]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(40)]
    rows = []
    for i in range(240):
        t = rng.choice(base).split(" ")
        if rng.random() < 0.6:
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i * 3 + 1, " ".join(t)))
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one"), (2004, "one two"), (2003, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 fp", "2 component")
    got = sorted(map(tuple, simhash.near_duplicate_groups(df).collect()))
    assert got == brute(rows)


def test_hot_buckets_are_cut_without_losing_links(spark):
    rng = random.Random(2)
    fps = set()
    for _ in range(3):
        f = rng.getrandbits(64)
        for _ in range(60):
            g = f
            for _ in range(rng.randint(0, 3)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    from cloakframe.llm.components import connected_components

    found = {r.node: r.component for r in connected_components(simhash.links(df, 2, bucket=8)).collect()}
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if bin(fps[i] ^ fps[j]).count("1") <= 2 and label[j] < label[i]:
                    label[i], changed = label[j], True
    assert [found.get(i, i) for i in range(len(fps))] == label


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicate_groups(empty).collect() == []
    nulls = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "zz")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicate_groups(nulls).collect()}
    assert got == {(None, 5), (5, 5), (None, None)}
    # a text that only a row without an id has links like any other, and connects others
    rng = random.Random(3)
    base = [f"w{i}" for i in range(40)]
    near = {}
    while len(near) < 3:
        t = " ".join(w if rng.random() < 0.97 else w + "x" for w in base * 8)
        bits = [(simhash.text_fingerprint(t.encode()) ^ simhash.text_fingerprint(x.encode())).bit_count() for x in near.values()]
        if not bits or 0 < bits[0] <= 2 and (len(bits) < 2 or bits[1] > 2):
            near[len(near)] = t
    rows = [(None, near[0]), (9, near[1]), (7, near[2])]
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, 7), (9, 7), (7, 7)}
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "fp long, rep long"), 9)


def test_pairs_at_any_radius():
    rng = random.Random(7)
    base = rng.getrandbits(64)
    fps = []
    for _ in range(150):
        g = base
        for _ in range(rng.randint(0, 40)):
            g ^= 1 << rng.randrange(64)
        fps.append(g)
    v = np.array(fps, np.uint64)
    for radius in (0, 1, 2, 3, 7, 8, 20, 28, 63):
        got = {(int(a), int(b)) for i, j in simhash.bit_sliced_pairs(v, radius) for a, b in zip(i, j)}
        assert got == {(i, j) for i in range(150) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius}


def test_very_long_text():
    words = [f"w{i % 999}" for i in range(300_000)]
    assert simhash.text_fingerprint(" ".join(words).encode()) == brute_fingerprint(" ".join(words))
