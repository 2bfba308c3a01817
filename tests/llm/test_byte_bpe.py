"""Ids against the library of the vocabulary's format, and exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from cloakframe.llm import byte_bpe as B
from cloakframe.llm import queries as Q

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SIGNS = "ab'stmdrevl  \n\t1é2!.¿'’中 　\x85​𝔸👍"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def made(n, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def check(library, known, given):
    for text, ids in zip(given, known.encode([x.encode() for x in given]), strict=True):
        assert library.encode_ordinary(text) == ids.tolist(), repr(text)
        assert known.decode(ids, known.ends(ids)) == text.encode()


def test_texts_of_all_signs(library):
    check(library, B.vocabulary(PATH), [*made(20_000, 30, 1), "", "don't I'll we've 'S 's's ''s !'ll", "  x", "\n\nx", " \nx", "x \n", "a" * 3000])


def test_classes_of_all_code_points(library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    check(library, B.vocabulary(PATH), [f"a{chr(c)}1 {chr(c)}b{chr(c)} 2" for c in points if c < 0x3400 or c % 53 == 0 or 0xA000 <= c < 0x12000])


def test_windows(library, monkeypatch):
    monkeypatch.setattr(B, "WINDOW", 37)
    check(library, B.Vocabulary(PATH), [*made(200, 600, 2), "a" * 500 + " b", " " * 300, " " * 300 + "x", "中" * 200, "\n" * 90 + "'s"])


def test_long_slices_merge_alike():
    known, rng = B.vocabulary(PATH), random.Random(3)
    for _ in range(500):
        piece = bytes(rng.choice(b"abc e'lstin") for _ in range(rng.randint(1, B.LONGEST)))
        assert known.merge(piece) == known._merge_long(piece)
    assert b"".join(known.bytes[i] for i in known.merge(b"ab" * 20_000)) == b"ab" * 20_000


def test_functions_compose():
    rng = np.random.default_rng(4)
    symbols = rng.integers(0, 2 * B.FIRST, 5000).astype(np.uint8)
    state, want = B.FRESH, []
    for s in symbols:
        want.append(state)
        state = B.NEXT[state, s]
    assert B._states(symbols).tolist() == want
    a, b, c = rng.integers(0, len(B.THEN), (3, 500))
    assert (B.THEN[B.THEN[a, b], c] == B.THEN[a, B.THEN[b, c]]).all()


def test_cases(spark, library):
    rows = [(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (None, " x")]
    coded = B.encode(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, ids string"), PATH)
    for r in coded.collect():
        text = {None: " x", 1: "", 2: "", 3: "hello world"}[r.doc_id]
        ids = library.encode_ordinary(text)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        ends = np.frombuffer(r.ends, "<i8")
        assert [text.encode()[a:b] for a, b in zip([0, *ends], ends, strict=False)] == [library.decode_single_token_bytes(i) for i in ids]
    assert sorted(bytes(r.decoded) for r in B.decode(coded, PATH).collect()) == [b"", b"", b" x", b"hello world", b"hello world"]
    assert B.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_query(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in Q.QUERIES["op13_byte_bpe"](spark, "/root/testdata/sf0.001").collect()}
    for d in docs:
        ids = np.array(library.encode_ordinary(d.text or ""), "<u4")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())
