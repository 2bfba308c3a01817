"""Every registered query over whole tables: by its SQL, by brute force, or by what its contract says of the rows."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from test_simhash import brute as simhash_brute

from cloakframe.llm import queries as Q

DIR = "/root/testdata/sf0.001"


def _table(name):
    return duckdb.sql(f"select * from '{DIR}/{name}.parquet'").df()


def _rows(spark, name):
    return Q.QUERIES[name](spark, DIR).collect()


@pytest.mark.parametrize("name", list(Q.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = Q.QUERIES[name](spark, DIR)
    found = c.execute(Q.ORACLES[name])
    names = [d[0] for d in found.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    want = sorted(repr(tuple(r[names.index(x)] for x in cols)) for r in found.fetchall())
    assert sorted(repr(tuple(r[x] for x in cols)) for r in df.collect()) == want


def test_op2(spark):
    docs = _table("documents")
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in _rows(spark, "op2_simhash_near_dedup"))
    assert got == simhash_brute(list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True)))


def test_op3(spark):
    pages = _table("pages")
    got = _rows(spark, "op3_html_extraction")
    assert sorted((r.page_id, r.url) for r in got) == sorted(zip(pages.page_id.tolist(), pages.url.tolist(), strict=True))
    assert all(r.n_chars == len(r.text) for r in got) and np.mean([r.n_chars > 0 for r in got]) > 0.9


def test_op4(spark):
    docs = _table("documents").sort_values("doc_id", ascending=False)
    texts, ids = [t or "" for t in docs.text], docs.doc_id.tolist()
    want = {}
    for i, (d, t) in enumerate(zip(ids, texts, strict=True)):
        cut, nxt = len(t) // 3, texts[(i + 1) % len(texts)]
        want[d] = (len(t), hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest())
    got = _rows(spark, "op4_document_fingerprints")
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want
    sets = {d: set(zip(*(t.split()[k:] for k in range(5)), strict=False)) or {tuple(t.split())} - {()} for d, t in zip(ids, texts, strict=True)}
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    errors = [abs(r.near_next - near(sets[r.doc_id], sets[ids[(ids.index(r.doc_id) + 1) % len(ids)]])) for r in got]
    assert max(errors) < 0.2 and np.mean(errors) < 0.02 and all(0 <= r.near_edited <= 1 for r in got)


def test_op6(spark):
    from tokenizers import Tokenizer

    inner = Tokenizer.from_file(Q.tokenizer_path())
    ids = {d: np.array([*inner.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in _table("documents")[["doc_id", "text"]].itertuples(index=False)}
    got = _rows(spark, "op6_packing")
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    for d in ids:
        mine = sorted((r.start, r.length) for r in got if r.doc_id == d)
        assert [s for s, _ in mine] == np.cumsum([0, *(n for _, n in mine)])[:-1].tolist() and sum(n for _, n in mine) == len(ids[d])
    padded = 0
    for q in {r.sequence_id for r in got}:
        mine = sorted((r.offset, r.length) for r in got if r.sequence_id == q)
        assert [o for o, _ in mine] == np.cumsum([0, *(n for _, n in mine)])[:-1].tolist()
        total = sum(n for _, n in mine)
        assert total <= 4096
        padded += 0 if total & (total - 1) == 0 else 4096 - total
    assert padded <= 0.01 * sum(map(len, ids.values()))


def test_op7(spark):
    docs = _table("documents")
    got = {r.doc_id: r for r in _rows(spark, "op7_toxicity")}
    assert sorted(got) == sorted(docs.doc_id.tolist())
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_minus_seven_comes_back(spark):
    said = "</s>[INST] ok [/INST]"
    r = next(r for r in _rows(spark, "op8_chat_formatting") if r.conv_id == -7)
    assert r.n_turns == 2 and r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
