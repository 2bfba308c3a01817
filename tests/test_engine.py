"""A document's way from import to restored text, and what is refused on it."""

import itertools
import pathlib

import pytest
from pyspark.sql import functions as F

from cloakframe.functions.rules import STANDARD, Rule
from cloakframe.operators import integrity as I
from cloakframe.plans.engine import Engine, EngineError
from cloakframe.sources import files

CARD = "110101199003077774"


class Text:
    """One page with one block of given text."""

    parser_type = "MOCK"

    def __init__(self, text):
        self.text = text

    def pages(self, spark, path, first=1, last=None):
        return files.FixtureSource().pages(spark, self.text)


@pytest.fixture
def engine(spark, tmp_path):
    tick = itertools.count(1_730_000_000_000)
    return Engine(spark, f"file://{tmp_path}/store", "09" * 32, "07" * 32, clock=lambda: next(tick))


def _imported(engine, tmp_path, matter, name, text):
    (tmp_path / name).write_text(text)
    return engine.document_import(matter, f"file://{tmp_path}/{name}").first().id


def _code(f, *a):
    with pytest.raises(EngineError) as e:
        f(*a)
    return e.value.code


def test_end_to_end(engine, tmp_path):
    text = f"Holder {CARD} synthetic@example.test."
    m = engine.matter_create("Matter A")
    assert [(r.id, r.name) for r in engine.matter_list().collect()] == [(m, "Matter A")]
    d = _imported(engine, tmp_path, m, "a.pdf", text)
    assert _code(engine.document_import, m, f"file://{tmp_path}/a.pdf") == "DUPLICATE_DOCUMENT"
    assert _code(engine.document_detect, d) == "INVALID_STATE" and engine.preview_get(d)["status"] == "NOT_READY"
    engine.document_process(d, Text(text))
    engine.document_detect(d)
    engine.document_detect(d)
    engine.document_resolve(d, "2024-10-27")
    assert engine.document_get(d)["parse_status"] == "READY" and engine.document_list(m).first().page_count == 1
    review = engine.review_get_document(d)
    c = review["counts"].first()
    assert (c.mentions, c.resolved, c.needs_review, c.unresolved) == (2, 0, 0, 2)
    mentions = review["mentions"].collect()
    assert [x.mention_type for x in mentions] == ["ID_CARD", "EMAIL"] and mentions[0].value == CARD
    assert {b.reason for b in engine.preview_get(d)["blockers"].collect()} == {"UNRESOLVED"}
    assert _code(engine.preview_generate, d) == "UNRESOLVED_MENTION" and engine.document_get(d)["parse_status"] == "FAILED"
    done = engine.review_create_entity_and_assign(mentions[0].id, "PERSON", "Plaintiff A")
    engine.review_assign(mentions[1].id, done["entity_id"])
    assert _code(engine.review_assign, mentions[1].id, done["entity_id"]) == "NO_CHANGE"
    c = engine.review_get_document(d)["counts"].first()
    assert (c.mentions, c.resolved, c.needs_review, c.unresolved) == (2, 2, 0, 0)
    out = engine.preview_generate(d)
    safe = out["blocks"].first().text
    assert out["status"] == "AVAILABLE" and CARD not in safe and "synthetic@" not in safe and safe.count("Plaintiff A〔@") == 2
    held = engine.preview_rehydrate(out["sanitized_document_id"], safe)
    assert held["text"] == safe and len(held["unresolved_tokens"]) == 2
    back = engine.preview_rehydrate(out["sanitized_document_id"], safe, on_request=True)
    assert back == {"text": f"Holder {CARD} synthetic@example.test.", "unresolved_tokens": []}
    tables = {t: engine.store.read(t) for t in ("documents", "mentions", "entities", "protected_values", "sanitization_mappings")}
    assert I.uniqueness(tables).isEmpty() and I.token_forms(tables["protected_values"]).isEmpty()


def test_second_document_links_by_card(engine, tmp_path):
    m = engine.matter_create("Matter B")
    first = _imported(engine, tmp_path, m, "one.pdf", "1")
    engine.document_process(first, Text(f"Card {CARD} of Ann."))
    rules = [*STANDARD, Rule("PERSON", "Ann")]
    engine.document_detect(first, rules)
    engine.document_resolve(first, "2024-10-27")
    got = {r.mention_type: r for r in engine.review_get_document(first)["mentions"].collect()}
    assert got["PERSON"].decision_status == "AUTO_LINKED" and got["ID_CARD"].entity_id is None
    engine.review_assign(got["ID_CARD"].id, got["PERSON"].entity_id)
    second = _imported(engine, tmp_path, m, "two.pdf", "2")
    engine.document_process(second, Text(f"Again {CARD}."))
    engine.document_detect(second)
    engine.document_resolve(second, "2024-10-27")
    row = engine.review_get_document(second)["mentions"].first()
    assert row.entity_id == got["PERSON"].entity_id and row.decision_status == "AUTO_LINKED"
    other = engine.create_entity(m, "PERSON", "Someone else")
    engine.review_add_constraint(m, other, row.entity_id, "CANNOT_LINK", "they differ")
    assert _code(engine.review_add_constraint, m, row.entity_id, other, "CANNOT_LINK", "again") == "DUPLICATE_CONSTRAINT"
    assert _code(engine.create_entity, m, "PERSON", "Someone else") == "DUPLICATE_ALIAS"
    assert engine.store.read("resolution_candidates").filter("state = 'ACCEPTED'").count() == 1


def test_refused_requests(engine, tmp_path):
    assert _code(engine.matter_create, " ") == "INVALID_REQUEST" and _code(engine.matter_create, "x" * 201) == "INVALID_REQUEST"
    assert _code(engine.document_get, "none") == "NOT_FOUND" and _code(engine.review_confirm, "none") == "NOT_FOUND"
    assert _code(engine.preview_rehydrate, "x", "y" * 1_000_001) == "INVALID_REQUEST"
    m = engine.matter_create("C")
    d = _imported(engine, tmp_path, m, "c.pdf", "before")
    (tmp_path / "c.pdf").write_text("after")
    assert _code(engine.document_process, d, Text("x")) == "SOURCE_CHANGED" and engine.document_get(d)["parse_status"] == "FAILED"
    assert engine.store.read("document_pages").filter(F.lit(True)).isEmpty()


class Failing(Text):
    def pages(self, spark, path, first=1, last=None):
        raise RuntimeError("no reader")


class Meddling(Text):
    """Changes its file while it is read."""

    def pages(self, spark, path, first=1, last=None):
        with open(path.removeprefix("file:").replace("///", "/"), "w") as f:
            f.write("meddled")
        return super().pages(spark, path, first, last)


def test_states_and_retries(engine, tmp_path):
    m = engine.matter_create("States")
    d = _imported(engine, tmp_path, m, "s.pdf", "Mail a@b.co and Ann.")
    with pytest.raises(RuntimeError):
        engine.document_process(d, Failing("x"))
    got = engine.document_get(d)
    assert got["parse_status"] == "FAILED" and [(j["job_type"], j["status"]) for j in got["jobs"]] == [("PARSE", "FAILED")]
    assert _code(engine.document_detect, d) == "INVALID_STATE"  # only the stage that failed may take it up
    other = _imported(engine, tmp_path, m, "meddled.pdf", "as imported")
    assert _code(engine.document_process, other, Meddling("x")) == "SOURCE_CHANGED" and engine.document_get(other)["parse_status"] == "FAILED"
    engine.document_process(d, Text("Mail a@b.co and Ann."))
    assert _code(engine.document_process, d, Text("x")) == "INVALID_STATE"
    seen = []

    def look(text):
        raise RuntimeError("the detector broke")

    with pytest.raises(Exception, match="the detector broke"):
        engine.document_detect(d, detector=look)
    assert engine.document_get(d)["parse_status"] == "FAILED" and engine.store.read("mentions").isEmpty()
    assert _code(engine.document_resolve, d) == "INVALID_STATE"
    assert _code(engine.document_detect, d, STANDARD, lambda t: [{"mention_type": "PERSON", "start": 3, "end": 99}]) == "INVALID_PROPOSAL"
    inner = engine._commit
    engine._commit = lambda *a, **k: (seen.append([r.parse_status for r in a[2]["documents"].filter(F.col("id") == d).collect()]), inner(*a, **k))[1]
    engine.document_detect(d, detector=lambda t: [{"mention_type": "PERSON", "start": 16, "end": 19, "detector": "NER"}])
    engine._commit = inner
    assert seen == [["DETECTING"], ["DETECTED"]]
    row = engine.review_get_document(d)["mentions"].first()
    assert (row.mention_type, row.value, row.start_offset) == ("PERSON", "Ann", 16)
    jobs = {(j.job_type, j.status) for j in engine.store.read("processing_jobs").filter(F.col("document_id") == d).collect()}
    assert jobs == {("PARSE", "FAILED"), ("PARSE", "COMPLETED"), ("DETECT", "FAILED"), ("DETECT", "COMPLETED")}


def test_many_documents_at_once(engine, tmp_path):
    rules = [*STANDARD, Rule("PERSON", "Ann")]
    docs = {}
    for name in ("one", "two"):
        m = engine.matter_create(name)
        for k in range(2):
            docs[name, k] = _imported(engine, tmp_path, m, f"{name}{k}.pdf", f"{name} {k}")
            engine.document_process(docs[name, k], Text(f"Ann wrote {name}{k}@x.org."))
    ids = list(docs.values())
    assert engine.documents_detect([*ids, "none"], rules) == {"none": "NOT_FOUND"}
    assert engine.documents_detect(ids, rules) == dict.fromkeys(ids, "DONE")
    assert engine.documents_resolve(ids, "2024-10-27") == {}
    # the first document of a matter makes the entity, the second one sees it
    status = {k: engine.review_get_document(d)["mentions"].filter("mention_type = 'PERSON'").first().decision_status for k, d in docs.items()}
    assert status == {("one", 0): "AUTO_LINKED", ("one", 1): "NEEDS_REVIEW", ("two", 0): "AUTO_LINKED", ("two", 1): "NEEDS_REVIEW"}
    assert engine.store.read("entities").count() == 2 and engine.store.read("resolution_events").filter("event_type = 'ENTITY_CREATED'").count() == 2
    # one document can be finished, the other ones fail on their own
    mail = engine.review_get_document(docs["one", 0])["mentions"].filter("mention_type = 'EMAIL'").first()
    entity = engine.store.read("entities", [engine.document_get(docs["one", 0])["matter_id"]]).first().id
    engine.review_assign(mail.id, entity)
    assert engine.previews_generate(ids) == {d: "UNRESOLVED_MENTION" for k, d in docs.items() if k != ("one", 0)}
    out = engine.preview_get(docs["one", 0])
    assert out["status"] == "AVAILABLE" and "one0@x.org" not in out["blocks"].first().text
    before = engine.store.read("entities").count()
    other = engine.review_get_document(docs["two", 0])["mentions"].filter("mention_type = 'PERSON'").first()
    assert _code(engine.review_create_entity_and_assign, other.id, "PERSON", "x" * 300) == "INVALID_REQUEST"
    assert _code(engine.review_assign, other.id, entity) == "OTHER_MATTER" and engine.store.read("entities").count() == before
    twin = engine.create_entity(engine.document_get(docs["one", 0])["matter_id"], "PERSON", "Twin")
    engine.merge_entities(twin, entity)
    assert engine.store.read("entities").filter(F.col("id") == twin).first().merged_into_entity_id == entity
    assert _code(engine.merge_entities, twin, entity) == "INVALID_REQUEST"


def _holding(folder, *planted):
    """Files below a folder that hold one of the planted texts, as they are or in UTF-16."""
    marks = [x.encode(e) for x in planted for e in ("utf-8", "utf-16-le", "utf-16-be")]
    return [f for f in folder.rglob("*") if f.is_file() and any(m in f.read_bytes() for m in marks)]


def test_no_text_is_left_on_disk(engine, spark, tmp_path, monkeypatch):
    from cloakframe.sources import store as stored

    name, mail = "private-name.txt", "very.secret@example.test"
    text = f"Holder {CARD} of {mail}."
    folder = pathlib.Path(stored.shared_folder(spark).removeprefix("file:"))
    kept, remove = [], stored._remove
    monkeypatch.setattr(stored, "_remove", lambda spark, folders: kept.append(list(folders)))

    def clean():
        return not _holding(folder, CARD, mail, name) and not _holding(tmp_path / "store", CARD, mail, name)

    m = engine.matter_create("Matter")
    d = _imported(engine, tmp_path, m, name, "x")
    assert clean()
    steps = [lambda: engine.document_process(d, Text(text)), lambda: engine.document_detect(d), lambda: engine.document_resolve(d, "2024-10-27")]
    for step in steps:
        step()
        assert clean()
    mentions = engine.review_get_document(d)["mentions"].collect()
    done = engine.review_create_entity_and_assign(mentions[0].id, "PERSON", "Plaintiff A")
    engine.review_assign(mentions[1].id, done["entity_id"])
    assert CARD not in engine.preview_generate(d)["blocks"].first().text and clean()
    # each stage's checkpoints were handed over, and are gone once they are deleted
    assert len(kept) >= 6
    for folders in kept:
        remove(spark, folders)
    gone = [pathlib.Path(f.removeprefix("file:")) for folders in kept for f in folders]
    assert len(gone) > 20 and not any(f.exists() for f in gone)


def test_a_cluster_without_encryption_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://somewhere")
    with pytest.raises(EngineError) as e:
        Engine(spark, f"file://{tmp_path}/store", "09" * 32, "07" * 32)
    assert e.value.code == "UNSAFE_SESSION"
