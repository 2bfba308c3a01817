import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

from cloakframe.llm import mixing, simhash, suffix_dedup, toxicity


def _write(spark, tmp_path):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    rows, labels = [], []
    for i in range(160):
        t = " ".join(rng.choices(words, k=rng.randint(20, 120)))
        y = i % 5 == 0
        if y:
            t += " grobian grobes!"
        if i % 9 == 1:
            t += " " + passage + " " + rng.choice(words)
        rows.append((i, t, "en", f"src{i % 3}", len(t)))
        if i % 2 == 0 or y:
            labels.append((i, 1, int(y)))
    rows += [(500 + i, rows[i][1], "en", "src0", rows[i][4]) for i in (1, 2, 3)]
    rows += [(600, None, None, None, None), (601, "", "en", None, 0), (None, "only here " * 9, "en", "src1", 90)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows, passage


def test_stages(spark, tmp_path):
    d, rows, passage = _write(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], d)
        assert out.columns == docs.columns
        rows_out = out.collect()
        seen.append(spark.createDataFrame(rows_out, docs.schema))
    clean, single, cut, mix = ([r.asDict() for r in s.collect()] for s in seen[1:])
    ids = [r["doc_id"] for r in clean]
    assert not any("grobian" in (r["text"] or "") for r in clean) and len(clean) == len(rows) - 32
    assert sorted(ids, key=str) == sorted((r[0] for r in rows if "grobian" not in (r[1] or "")), key=str)
    left = {r["doc_id"] for r in single}
    assert not left & {501, 502, 503} and {1, 2, 3} <= left and None in left
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(seen[1]).collect()}
    assert left - {None} == {c for d_, c in groups.items() if d_ is not None}
    assert sum(passage[:80] in (r["text"] or "") for r in cut) == 1
    kept = {r.doc_id: bytes(r.kept).decode(errors="ignore") for r in suffix_dedup.deduplicate(seen[2]).collect()}
    assert {r["doc_id"]: r["text"] or "" for r in cut} == kept and all(r["n_chars"] == len(r["text"]) for r in cut if r["text"] is not None)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken = {r.doc_id: r.taken for r in mixing.mix(seen[3], mixing.label_quality(spark.read.parquet(f"{d}/labels.parquet"))).collect()}
    words = {}
    for r in mix:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + size(r["text"])
        assert r["n_chars"] is None or r["n_chars"] == len(r["text"])
    assert words == {k: v for k, v in taken.items() if v}


def test_run(spark, tmp_path):
    d, _, _ = _write(spark, tmp_path)
    out = corpus_pipeline.run(spark, d).collect()
    assert out and {"doc_id", "sequence_id", "offset"} <= set(out[0].asDict())


def test_empty_documents(spark, tmp_path):
    _, rows, _ = _write(spark, tmp_path)
    d = str(tmp_path)
    empty = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).collect() == []
    assert toxicity.THRESHOLD == 0.3


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    d, rows, _ = _write(spark, tmp_path)
    names = "_ _id _size _taken kept_id _fp key size taken rest d t covers numbers fp component_id n row order gone a.b".split()
    docs = spark.read.parquet(f"{d}/documents.parquet")
    docs = docs.select("*", *[F.concat(F.lit(f"{k}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(k) for k in names])
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, d)
        assert out.columns == docs.columns
        out = spark.createDataFrame(out.collect(), docs.schema)
    kept = out.collect()
    assert kept and all(r[k] == f"{k}-{'none' if r['doc_id'] is None else r['doc_id']}" for r in kept for k in names)
    assert corpus_pipeline.packed(spark, out, d).count() >= len(kept)
