import hashlib
import random

import pytest

from cloakframe.llm import sentence_spans as ss


def pieces_of(text):
    """Pieces of a text by a walk over its letters, apart from the operator's own splitting."""
    sign = lambda c: not (c.isascii() and c.isalnum() or not c.isascii() or c in " \t\n\r\x0b\x0c")
    out, now, i = [], "", 0
    while i < len(text):
        now += text[i]
        if text[i] == "\n":
            out.append(now)
            now = ""
        elif text[i] in ".!?,;:":
            k = i + 1
            while k < len(text) and sign(text[k]):
                k += 1
            if k < len(text) and text[k] in " \t\n\r\x0b\x0c":
                out.append(now + text[i + 1 : k])
                now, i = "", k - 1
        i += 1
    return [p.strip() for p in [*out, now] if p.strip()]


def spans_of(pieces, span, words):
    n, size = len(pieces), [len(p.split()) for p in pieces]
    out = []
    for i in range(n):
        if i and (n - i < span or sum(size[i:]) < words):
            break
        k = i
        while k < n and (k - i < span or sum(size[i:k]) < words):
            k += 1
        out.append((i, k))
    if out and out[-1][1] < n:
        out.append((out[-1][0], n))
    return out


def brute(rows, span, words):
    first, parsed = {}, {}
    for d, t in rows:
        p = pieces_of(t or "")
        keyed = [(i, k, tuple(" ".join(x.split()) for x in p[i:k])) for i, k in spans_of(p, span, words)]
        parsed[d, t] = p, keyed
        for _, _, key in keyed:
            first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        p, keyed = parsed[d, t]
        gone, here = set(), set()
        for i, k, key in keyed:
            if first[key] < d or key in here:
                gone |= set(range(i, k))
            here.add(key)
        out.append((d, len(p), len(gone), " ".join(" ".join(x for i, x in enumerate(p) if i not in gone).split())))
    return sorted(out)


def _made(seed, n=120):
    rng = random.Random(seed)
    pool = [" ".join(rng.choices([f"w{i}" for i in range(40)] + ["été", "Ä*b"], k=rng.randint(1, 9))).capitalize() + rng.choice([".", "!", "?", ",", ";", ":", ".%%%", '!"', "...", ""]) for _ in range(40)]
    rows = []
    for i in range(n):
        parts = rng.choices(pool, k=rng.randint(0, 12))
        if rng.random() < 0.5:
            at = rng.randint(0, len(parts))
            parts[at:at] = pool[:5]
        rows.append((i * 3, rng.choice([" ", "\n", "  ", "\r\n"]).join(parts)))
    return rows


@pytest.mark.parametrize("span, words", [(3, 12), (2, 1), (3, 30)])
def test_against_brute_force(spark, span, words):
    rows = _made(3)
    rows += [(900, None), (901, "  "), (902, "Einzig été."), rows[7], rows[7], (903, rows[7][1]), (903, rows[8][1]), (903, rows[7][1] + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 d", "2 h", "3 starts", "4 x", "5 place")
    got = ss.deduplicate(df, span, words).collect()
    assert sorted((r.doc_id, r.n_sentences, r.n_removed, " ".join((r.text or "").split())) for r in got) == brute(rows, span, words)
    assert all(r.kept_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() for r in got)
    assert any(r.n_removed for r in got) and any(not r.n_removed for r in got)


def test_pieces_end_behind_signs():
    text = b"Eronha.%%% This*** goes, on: 3.5 units; e.g.this\nnext line!\" end"
    assert [text[s:e].decode() for s, e in ss.sentences(text)] == ["Eronha.%%%", "This*** goes,", "on:", "3.5 units;", "e.g.this", 'next line!"', "end"] == pieces_of(text.decode())


def test_a_shared_passage_goes_once(spark):
    passage = "One fine day the fox went out to look for some food. It found a hen and a duck by the pond. Then it went home again with nothing at all."
    rows = [(1, f"Alpha words stand here before. {passage} The end of one."), (2, f"Beta text is different from it. {passage} The end of two."), (3, "Clean text without any of it. Nothing is shared in here. Really nothing at all is.")]
    got = {r.doc_id: r for r in ss.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1]
    assert got[2].text == "Beta text is different from it. The end of two." and got[2].n_spans == 1


def test_identical_texts_of_any_form_go_wholly(spark):
    lines = "Yes.\nNo.\nMaybe so.\nNot now.\nWait here.\nGo on."
    uneven = " ".join(["word"] * 50) + ". a. b. c. d."
    rows = [(1, lines), (2, lines), (3, "Only four words here."), (4, "Only four words here."), (5, "Only three words."), (6, uneven), (7, uneven)]
    got = {r.doc_id: r for r in ss.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: r.text for d, r in got.items()} == {1: lines, 2: "", 3: rows[2][1], 4: "", 5: rows[4][1], 6: uneven, 7: ""}
    assert got[2].n_removed == got[2].n_sentences == 6


def test_every_piece_is_in_a_span():
    for seed in range(5):
        for _, t in _made(seed, 40):
            where = ss.sentences(t.encode())
            to = ss.ends([len(t.encode()[s:e].split()) for s, e in where])
            seen = set()
            for place, _ in ss.spans(t.encode()):
                seen |= set(range(place >> 1, len(where) if place & 1 else to[place >> 1]))
            assert seen == set(range(len(where)))


def test_edges(spark):
    assert ss.deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    t = "a b c d. e f g h. i j k l."
    got = ss.deduplicate(spark.createDataFrame([(None, t), (None, t), (4, t)], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("4", 0), ("None", 3), ("None", 3)]
    alone = ss.deduplicate(spark.createDataFrame([(None, t), (None, t + " more")], "doc_id long, text string")).collect()
    assert [r.n_removed for r in alone] == [0, 0]


def test_very_long_text(spark):
    part = " ".join(f"Sentence {i} of the long one stands here, and goes on." for i in range(40_000))
    rows = [(1, part), (2, "Before it. " + part)]
    got = {r.doc_id: r for r in ss.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 80_000 and got[2].text == "Before it."
