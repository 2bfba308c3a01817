"""Levels of documents against a walk, and RESOLVE by levels against one by one."""

import itertools
import random
import shutil

from cloakframe.functions.rules import STANDARD, Rule
from cloakframe.operators.levels import levels
from cloakframe.plans.engine import Engine
from cloakframe.sources import files

SCHEMA = "matter_id string, document_id string, created_at long, key string"


def walked(rows):
    held = {}
    for m, d, at, k in rows:
        held.setdefault((m, at, d), set()).add(k)
    out, last = {}, {}
    for m, at, d in sorted(held):
        keys = held[m, at, d] - {None}
        level = 1 + max((last.get((m, k), 0) for k in keys), default=0)
        out[m, d] = level
        for k in keys:
            last[m, k] = max(last.get((m, k), 0), level)
    return out


def test_levels(spark):
    rng = random.Random(2)
    rows = []
    for m in ("m1", "m2", "m3"):
        for d in range(100):
            at = rng.randint(0, 60)
            rows += [(m, f"d{d:03}", at, rng.choice([None, *(f"k{x}" for x in range({"m1": 400, "m2": 60, "m3": 8}[m]))])) for _ in range(rng.randint(1, 4))]
    # one key of all documents of a matter: levels as many as documents
    rows += [("m4", f"d{d:03}", 7, "all") for d in range(220)]
    got = {(r.matter_id, r.document_id): r.level for r in levels(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == walked(rows) and max(got.values()) == 220
    assert levels(spark.createDataFrame([], SCHEMA)).collect() == []


class Text:
    parser_type = "MOCK"

    def __init__(self, text):
        self.text = text

    def pages(self, spark, path, first=1, last=None):
        return files.FixtureSource().pages(spark, self.text)


TEXTS = ["Ann and 13800138000.", "Bob, b@x.org.", "Ann again."]
RULES = [*STANDARD, *(Rule("PERSON", n) for n in ("Ann", "Bob"))]


def _engine(spark, folder):
    tick = itertools.count(1_730_000_000_000)
    return Engine(spark, f"file://{folder}", "09" * 32, "07" * 32, clock=lambda: next(tick))


def _resolved(spark, folder, ids, groups):
    """Rounds that RESOLVE of each group took, and what came of it."""
    engine, rounds = _engine(spark, folder), []
    engine.clock, stage = itertools.count(1_740_000_000_000).__next__, engine._stage
    engine._stage = lambda kind, some, *more: (rounds.append(sorted(ids.index(i) for i in some)), stage(kind, some, *more))[1]
    for group in groups:
        engine.documents_resolve(group, "2024-10-27")
    rows = engine.store.read("mentions").collect()
    found = sorted((ids.index(r.document_id), r.mention_type, r.start_offset, r.entity_id is not None) for r in rows)
    states = {r.parse_status for r in engine.store.read("documents").collect()}
    return rounds, found, engine.store.read("resolution_candidates").count(), engine.store.read("entities").count(), states


def test_rounds_are_levels(spark, tmp_path):
    engine = _engine(spark, tmp_path / "a")
    m, ids = engine.matter_create("A"), []
    for k, text in enumerate(TEXTS):
        (tmp_path / f"{k}.txt").write_text(text)
        ids.append(engine.document_import(m, f"file://{tmp_path}/{k}.txt").first().id)
        engine.document_process(ids[-1], Text(text))
    engine.documents_detect(ids, RULES)
    shutil.copytree(tmp_path / "a", tmp_path / "b")
    rounds, *by_level = _resolved(spark, tmp_path / "a", ids, [ids])
    alone, *one_by_one = _resolved(spark, tmp_path / "b", ids, [[i] for i in ids])
    assert rounds == [[0, 1], [2]] and alone == [[0], [1], [2]]
    assert by_level == one_by_one and by_level[1] == 1 and by_level[3] == {"READY"}
