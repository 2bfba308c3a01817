"""The engine: one method for each request of the application.

Stages (PARSE, DETECT, RESOLVE, SANITIZE) work on any number of documents at once and go
through three commits at most: one that takes the documents into the stage's state in
flight with a running job each, and one that either stores the results and ends the jobs
or leaves the documents FAILED with the error in their jobs.  A failed document can be
taken up again only by the stage that failed.  Each commit writes the touched matters
only, is checked by the integrity rules, and is refused if another writer was faster.

Texts and values are stored in envelopes.  Checkpoints, which cut lineage, hold rows as they
are; columns with texts or values are sealed before one and opened behind it, and a stage
deletes its checkpoints when it has committed.  A cluster has to encrypt what it shuffles
and spills (spark.io.encryption.enabled).  ``clock`` gives milliseconds and ``new_id`` ids
of single rows; ids and tokens of many rows are random and settled before they are used.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions import security as S
from cloakframe.functions.normalize import choose
from cloakframe.functions.rules import STANDARD, Rule
from cloakframe.operators import detect as D
from cloakframe.operators import integrity as I
from cloakframe.operators import resolve as R
from cloakframe.operators import review as V
from cloakframe.operators import sanitize as SZ
from cloakframe.operators.levels import levels
from cloakframe.schemas import ALGORITHM_VERSION, TABLES
from cloakframe.sources import files
from cloakframe.sources.store import COMMON, Store, passing, settled

# Limits of requests.
MAX_ID, MAX_NAME, MAX_REASON, MAX_TEXT = 64, 200, 500, 1_000_000


class EngineError(Exception):
    """A refused request; ``code`` says why."""

    def __init__(self, code: str, message: str = "") -> None:
        super().__init__(message or code)
        self.code = code


@dataclass(frozen=True)
class Stage:
    """States of a document before, in and after a stage, and those in which it is done already."""

    before: str
    flight: str
    after: str
    done: tuple[str, ...] = ()


STAGES = {
    "PARSE": Stage("IMPORTED", "PARSING", "PARSED"),
    "DETECT": Stage("PARSED", "DETECTING", "DETECTED", ("DETECTED",)),
    "RESOLVE": Stage("DETECTED", "RESOLVING", "READY", ("READY", "SANITIZED")),
    "SANITIZE": Stage("READY", "SANITIZING", "SANITIZED", ("SANITIZED",)),
}


def _checked(value: str, most: int, what: str) -> str:
    if not isinstance(value, str) or not value.strip() or len(value) > most or re.search(r"[\x00-\x1f\x7f]", value):
        raise EngineError("INVALID_REQUEST", f"{what} is not usable")
    return value


def _clearing(request: Callable) -> Callable:
    """A request whose checkpoints go with its end; it returns no frame that reads them."""

    @wraps(request)
    def run(self, *args, **more):
        with passing(self.spark):
            return request(self, *args, **more)

    return run


class Engine:
    def __init__(self, spark: SparkSession, root: str, persistence_key: str, search_key: str, clock: Callable[[], int] | None = None, new_id: Callable[[], str] = S.uuid7) -> None:
        S.check_keys(persistence_key, search_key)
        sc = spark.sparkContext
        if not (sc.master == "local" or sc.master.startswith("local[")) and sc.getConf().get("spark.io.encryption.enabled", "false").lower() != "true":
            raise EngineError("UNSAFE_SESSION", "spark.io.encryption.enabled must be set, as shuffles carry texts")
        self.spark, self.store = spark, Store(spark, root)
        self._persistence, self._search = persistence_key, search_key
        self.clock = clock or (lambda: time.time_ns() // 1_000_000)
        self.new_id = new_id

    # -- helpers

    def _key(self) -> Column:
        return F.unhex(F.lit(self._persistence))

    def _seal(self, value: Column, row_id: Column, field: str) -> Column:
        return S.sealed(value, self._key(), S.context(row_id, field))

    def _open(self, envelope: Column, row_id: Column, field: str) -> Column:
        return S.opened(envelope, self._key(), S.context(row_id, field)).cast("string")

    def _settled(self, df: DataFrame, *secret: str) -> DataFrame:
        """``df`` cut by a checkpoint in which the columns ``secret`` are sealed."""
        kinds = {c: df.schema[c].dataType for c in secret}
        plain = lambda c: F.col(c) if kinds[c].typeName() == "string" else F.to_json(c)
        hidden = df.withColumns({c: F.aes_encrypt(plain(c), self._key()) for c in secret})
        back = {c: F.aes_decrypt(c, self._key()).cast("string") for c in secret}
        out = settled(hidden)
        return out.withColumns({c: back[c] if kinds[c].typeName() == "string" else F.from_json(back[c], kinds[c]) for c in secret})

    def _row(self, table: str, scope: str, **values) -> DataFrame:
        full = {f.name: values.get(f.name) for f in TABLES[table].fields}
        return self.spark.createDataFrame([tuple(full.values())], TABLES[table]).withColumn("scope", F.lit(scope))

    def _commit(self, base: int, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None, scopes: Sequence[str] = ()) -> int:
        return self.store.commit(append, replace, scopes, base, I.commit_violations)

    def _one(self, table: str, row_id: str, what: str):
        """A row of any matter by its id."""
        row = self.store.find(table, "id", [_checked(row_id, MAX_ID, f"{what} id")]).first()
        if row is None:
            raise EngineError("NOT_FOUND", f"no such {what}")
        return row

    # -- matters and documents

    def matter_create(self, name: str) -> str:
        _checked(name, MAX_NAME, "name")
        base, i, now = self.store.version(), self.new_id(), self.clock()
        row = self.spark.createDataFrame([(i, name)], "id string, name string")
        row = row.select("id", self._seal(F.col("name"), F.col("id"), "matter.name").alias("name_cipher"), F.lit("ACTIVE").alias("status"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))
        self._commit(base, {"matters": row})
        return i

    def matter_list(self) -> DataFrame:
        m = self.store.read("matters")
        return m.select("id", self._open(F.col("name_cipher"), F.col("id"), "matter.name").alias("name"), "status", "created_at", "updated_at").orderBy("created_at", "id")

    def document_import(self, matter_id: str, path: str) -> DataFrame:
        """Imports files below ``path``; one whose content the matter has already is refused."""
        _checked(matter_id, MAX_ID, "matter id")
        base = self.store.version()
        if self.store.find("matters", "id", [matter_id]).isEmpty():
            raise EngineError("NOT_FOUND", "no such matter")
        now = self.clock()
        found = self._settled(files.inspect(self.spark, path).dropDuplicates(["file_hash"]).withColumn("id", S.row_id(F.lit(now))), "original_name", "source_path")
        old = self.store.read("documents", [matter_id]).select("file_hash")
        if not found.select("file_hash").join(old, "file_hash", "left_semi").isEmpty():
            raise EngineError("DUPLICATE_DOCUMENT", "the matter has this content already")
        rows = found.select(
            "id",
            F.lit(matter_id).alias("matter_id"),
            self._seal(F.col("original_name"), F.col("id"), "document.originalName").alias("original_name_cipher"),
            self._seal(F.col("source_path"), F.col("id"), "document.sourcePath").alias("source_path_cipher"),
            "file_hash",
            "mime_type",
            F.lit(None).alias("parser_type"),
            F.lit(None).alias("page_count"),
            F.lit("IMPORTED").alias("parse_status"),
            F.lit(now).alias("created_at"),
            F.lit(now).alias("updated_at"),
        )
        self._commit(base, {"documents": rows})
        return found.select("id", "original_name", "file_hash", "mime_type", "byte_size")

    def document_list(self, matter_id: str) -> DataFrame:
        d = self.store.read("documents", [_checked(matter_id, MAX_ID, "matter id")])
        return d.select("id", self._open(F.col("original_name_cipher"), F.col("id"), "document.originalName").alias("original_name"), "parse_status", F.coalesce("page_count", F.lit(0)).alias("page_count"), "created_at").orderBy("created_at", "id")

    def document_get(self, document_id: str) -> dict:
        row = self._one("documents", document_id, "document")
        jobs = V.latest_jobs(self.store.read("processing_jobs", [row.matter_id]).filter(F.col("document_id") == document_id)).select("job_type", "status", "progress", "checkpoint").collect()
        return {"id": row.id, "matter_id": row.matter_id, "parse_status": row.parse_status, "page_count": row.page_count or 0, "jobs": [j.asDict() for j in jobs]}

    # -- stages

    def _gate(self, kind: str, ids: Sequence[str]) -> DataFrame:
        """(id, matter_id, problem) of documents asked for: why the stage may not take them, if so."""
        stage = STAGES[kind]
        for i in ids:
            _checked(i, MAX_ID, "document id")
        asked = self.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")
        d = settled(asked.join(self.store.find("documents", "id", ids), "id", "left"))
        scopes = [r.matter_id for r in d.filter("matter_id is not null").select("matter_id").distinct().collect()]
        of = lambda t: self.store.read(t, scopes).join(asked.withColumnRenamed("id", "document_id"), "document_id", "left_semi")
        d = d.join(V.retryable(d, of("processing_jobs")).select("id", F.col("job_type").alias("_failed")), "id", "left")
        for t in ("document_pages", "mentions"):
            d = d.join(of(t).groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias(f"_{t}")), "id", "left")
        ready = F.coalesce((F.col("parse_status") == stage.before) | F.coalesce(F.col("_failed") == kind, F.lit(False)), F.lit(False))
        problem = F.when(F.col("matter_id").isNull(), "NOT_FOUND").when(F.col("parse_status").isin(*stage.done), "DONE").when(~ready, "INVALID_STATE")
        if kind == "PARSE":
            problem = problem.when(F.col("_document_pages") > 0, "INVALID_STATE")
        if kind == "DETECT":
            whole = F.coalesce(F.col("_document_pages") == F.col("page_count"), F.lit(False))
            problem = problem.when(~whole | (F.col("_mentions") > 0), "INVALID_STATE")
        problem = problem.when(F.col("updated_at") > self._now, "CLOCK_WENT_BACK")
        return d.select("id", "matter_id", "parse_status", problem.alias("problem"))

    def _moved(self, batch: DataFrame, scopes: Sequence[str], status: Column, **more: Column) -> DataFrame:
        """All documents of the scopes, those of ``batch`` with a new state."""
        now = F.greatest(F.col("updated_at"), F.lit(self.clock()))
        changes = {"parse_status": status, "updated_at": now, **more}
        d = self.store.read("documents", scopes).join(batch.drop("matter_id"), "id", "left")
        hit = F.col("job_id").isNotNull()
        return settled(d.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in TABLES["documents"].names]))

    def _ended(self, batch: DataFrame, scopes: Sequence[str], error: Column) -> DataFrame:
        """All jobs of the scopes, those of ``batch`` ended: with an error where there is one."""
        now = F.lit(self.clock())
        j = self.store.read("processing_jobs", scopes, scoped=True).join(batch.drop("id", "matter_id").withColumnRenamed("job_id", "id").withColumn("_mine", F.lit(True)), "id", "left")
        mine, bad = F.coalesce("_mine", F.lit(False)), error.isNotNull()
        changes = {
            "status": F.when(bad, "FAILED").otherwise("COMPLETED"),
            "progress": F.when(bad, F.col("progress")).otherwise(1.0),
            "checkpoint": F.when(~bad, "1/1"),
            "error_cipher": F.when(bad, self._seal(error, F.col("id"), "processingJob.error")),
            "finished_at": F.greatest(now, F.col("started_at")),
        }
        return settled(j.select(*[F.when(mine, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in TABLES["processing_jobs"].names], "scope"))

    @_clearing
    def _stage(self, kind: str, ids: Sequence[str], work: Callable[[DataFrame, list[str], int], tuple], parser: str | None = None) -> dict[str, str]:
        """Run a stage on documents; the codes of those it could not do.

        ``work`` gets (id, matter_id, job_id) of the documents in flight, their matters and
        the time, and returns the tables to append and to replace, (id, error) of documents
        that fail on their own, and changes of documents' columns.
        """
        stage, self._now = STAGES[kind], self.clock()
        base = self.store.version()
        gate = settled(self._gate(kind, ids))
        refused = {r.id: r.problem for r in gate.filter("problem is not null").collect()}  # of the ids asked for
        batch = settled(gate.filter("problem is null").select("id", "matter_id").withColumn("job_id", S.row_id(F.lit(self._now))))
        scopes = [r.matter_id for r in batch.select("matter_id").distinct().collect()]
        if not scopes:
            return refused
        jobs = batch.select(F.col("job_id").alias("id"), F.col("id").alias("document_id"), F.lit(kind).alias("job_type"), F.lit("RUNNING").alias("status"), F.lit(0.0).alias("progress"), F.lit("0/1").alias("checkpoint"), F.lit(None).alias("error_cipher"), F.lit(self._now).alias("created_at"), F.lit(self._now).alias("started_at"), F.lit(None).alias("finished_at"), F.col("matter_id").alias("scope"))
        more = {"parser_type": F.lit(parser), "page_count": F.lit(None).cast("int")} if kind == "PARSE" else {}
        base = self._commit(base, {"processing_jobs": jobs}, {"documents": self._moved(batch, scopes, F.lit(stage.flight), **more)}, scopes)
        try:
            append, replace, errors, changes = work(batch, scopes, self._now)
            errors = settled(errors) if errors is not None else self.spark.createDataFrame([], "id string, error string")
            told = batch.join(errors, "id", "left")
            for c, column in changes.items():
                told = told.join(column, "id", "left").withColumnRenamed(c, f"_{c}")
            told = settled(told)
            ends = self._moved(told, scopes, F.when(F.col("error").isNull(), stage.after).otherwise("FAILED"), **{c: F.coalesce(f"_{c}", c) for c in changes})
            done = self._ended(told.select("id", "matter_id", "job_id", "error"), scopes, F.col("error"))
            self._commit(base, append, {**replace, "documents": ends, "processing_jobs": done}, scopes)
        except Exception as e:
            code = e.code if isinstance(e, EngineError) else "STAGE_FAILED"
            failed = settled(batch.withColumn("error", F.lit(code)))
            self._commit(self.store.version(), None, {"documents": self._moved(batch, scopes, F.lit("FAILED")), "processing_jobs": self._ended(failed, scopes, F.col("error"))}, scopes)
            raise
        return refused | {r.id: r.error for r in errors.collect()}

    def _single(self, kind: str, document_id: str, work: Callable, parser: str | None = None) -> None:
        for code in self._stage(kind, [document_id], work, parser).values():
            if code != "DONE":
                raise EngineError(code, f"{kind} of the document: {code}")

    def document_process(self, document_id: str, source: files.DocumentSource) -> None:
        """PARSE: pages and blocks of the source file, if it is what was imported, before parsing and after."""

        def unchanged(path: str, file_hash: str) -> None:
            if files.inspect(self.spark, path).filter(F.col("file_hash") == file_hash).isEmpty():
                raise EngineError("SOURCE_CHANGED", "the file is not what was imported")

        def work(batch: DataFrame, scopes: list[str], now: int) -> tuple:
            doc = self.store.read("documents", scopes).filter(F.col("id") == document_id)
            doc = doc.select("file_hash", "matter_id", self._open(F.col("source_path_cipher"), F.col("id"), "document.sourcePath").alias("path")).first()
            unchanged(doc.path, doc.file_hash)
            raw = self._settled(source.pages(self.spark, doc.path), "path", "items")
            pages = settled(raw.select("page_no", "original_width", "original_height", "rotation", files.page_source_type(F.exists("items", lambda i: (i["kind"] == "text") & (F.trim(i["text"]) != "")), F.exists("items", lambda i: i["kind"] == "image")).alias("source_type")).withColumn("id", S.row_id(F.lit(now))))
            n = pages.count()
            here = [F.lit(document_id).alias("document_id"), F.lit(doc.matter_id).alias("scope"), F.lit(now).alias("created_at")]
            rows = pages.select("id", "page_no", "original_width", "original_height", "rotation", "source_type", *here)
            counted = self.spark.createDataFrame([(document_id, n)], "id string, page_count int")
            if n < 1 or not I.page_sequence(counted, rows).isEmpty():
                raise EngineError("INCOMPLETE_PAGES", "the pages are not complete")
            b = files.page_blocks(raw).filter("reading_order is not null").join(pages.select("page_no", F.col("id").alias("page_id")), "page_no").withColumn("id", S.row_id(F.lit(now)))
            b = self._settled(b, "path", "text").select("id", "page_id", F.lit("TEXT").alias("block_type"), self._seal(F.col("text"), F.col("id"), "documentBlock.text").alias("text_cipher"), F.lit("NATIVE").alias("source"), F.lit(None).alias("confidence"), "x", "y", "width", "height", "reading_order", *here)
            unchanged(doc.path, doc.file_hash)
            return {"document_pages": rows, "document_blocks": settled(b)}, {}, None, {"page_count": counted}

        self._single("PARSE", document_id, work, source.parser_type)

    def _blocks(self, batch: DataFrame, scopes: Sequence[str]) -> DataFrame:
        """Plain blocks of documents (id) with their pages."""
        b = self.store.read("document_blocks", scopes).join(batch.select(F.col("id").alias("document_id")), "document_id", "left_semi")
        b = V.blocks_with_pages(b, self.store.read("document_pages", scopes))
        return b.select("document_id", "page_id", F.col("id").alias("block_id"), "page_no", "reading_order", self._open(F.col("text_cipher"), F.col("id"), "documentBlock.text").alias("text"))

    def _mentions(self, batch: DataFrame, scopes: Sequence[str]) -> DataFrame:
        """Mentions of documents (id) in reading order, with their plain values."""
        m = self.store.read("mentions", scopes).join(batch.select(F.col("id").alias("document_id")), "document_id", "left_semi")
        m = m.withColumn("value", self._open(F.col("text_cipher"), F.col("id"), "mention.text"))
        return V.in_reading_order(m, self.store.read("document_pages", scopes), self.store.read("document_blocks", scopes))

    def _just(self, document_id: str) -> DataFrame:
        return self.spark.createDataFrame([(document_id,)], "id string")

    def documents_detect(self, ids: Sequence[str], rules: Sequence[Rule] = STANDARD, detector: Callable[[str], Sequence[dict]] | None = None) -> dict[str, str]:
        """DETECT: mentions that the rules, and a detector of one's own, find; done once.  Codes of documents not done."""

        def work(batch: DataFrame, scopes: list[str], now: int) -> tuple:
            blocks = self._settled(self._blocks(batch, scopes).filter(D.bounded("document_id", "page_id", "block_id")), "text")
            found = D.detect(blocks, rules).select("block_id", "mention_type", "mention_strength", "start_cp", "end_cp", "detector", "confidence")
            if detector is not None:
                found = D.detect_with(blocks, detector)
                if not D.proposal_errors(found, blocks).isEmpty():
                    raise EngineError("INVALID_PROPOSAL", "the detector's proposals may not be stored")
            found = found.join(blocks.withColumn("_wide", D.spans.wide_places("text")), "block_id").join(batch.select(F.col("id").alias("document_id"), "matter_id"), "document_id")
            found = found.withColumns({"start_offset": D.spans.to_units("_wide", "start_cp"), "end_offset": D.spans.to_units("_wide", "end_cp"), "value": D.spans.span_text("text", F.col("start_cp"), F.col("end_cp"))})
            found = self._settled(found.drop("text", "_wide").withColumn("id", S.row_id(F.lit(now))), "value")
            m = found.select(
                "id",
                "matter_id",
                "document_id",
                "page_id",
                "block_id",
                *[F.lit(None).alias(c) for c in ("entity_id", "protected_value_id", "fingerprint", "x", "y", "width", "height")],
                "mention_type",
                "mention_strength",
                self._seal(F.col("value"), F.col("id"), "mention.text").alias("text_cipher"),
                "start_offset",
                "end_offset",
                "detector",
                "confidence",
                F.lit("UNREVIEWED").alias("review_status"),
                F.lit(now).alias("created_at"),
            )
            return {"mentions": settled(m)}, {}, None, {}

        return self._stage("DETECT", ids, work)

    def document_detect(self, document_id: str, rules: Sequence[Rule] = STANDARD, detector: Callable[[str], Sequence[dict]] | None = None) -> None:
        for code in self.documents_detect([document_id], rules, detector).values():
            if code != "DONE":
                raise EngineError(code, f"DETECT of the document: {code}")

    # -- resolving

    def _resolve(self, day: Column) -> Callable[[DataFrame, list[str], int], tuple]:
        """RESOLVE of documents of different matters: values, candidates, decisions, new entities; from the state before."""

        def work(batch: DataFrame, scopes: list[str], now: int) -> tuple:
            read = lambda t: self.store.read(t, scopes)
            values = read("protected_values").withColumn("fingerprint", F.lower(F.hex("fingerprint")))
            links, entities, aliases, constraints = (read(t) for t in ("entity_protected_values", "entities", "entity_aliases", "entity_constraints"))
            m = self._settled(R.with_values(self._mentions(batch, scopes).drop("fingerprint"), self._search, day), "value", "normalized")
            planned = self._settled(R.plan_values(m).withColumn("id", S.row_id(F.lit(now))), "value")
            keys = ["matter_id", "value_type", "fingerprint"]
            upsert = self._settled(R.upsert_values(planned, values).join(planned.select(*keys, "value"), keys), "value")
            m = self._settled(m.drop("protected_value_id").join(upsert.select(*keys, F.col("id").alias("protected_value_id")), keys, "left"), "value", "normalized")
            letter = choose(F.col("value_type"), S.VALUE_LETTERS)
            new_values = upsert.filter("not existed").select("id", "matter_id", "value_type", self._seal(F.col("value"), F.col("id"), "protectedValue.value").alias("value_cipher"), F.unhex("fingerprint").alias("fingerprint"), S.token(letter, S.random_hex()).alias("public_token"), F.lit("ALWAYS_RESTORE").alias("restore_policy"), F.lit(now).alias("created_at"))
            open_ = m.filter("entity_id is null")
            both = R.eligible(R.scored_candidates(open_, m, entities, aliases, values, links, constraints), open_, entities)
            scored = settled(both.withColumn("position", F.col("created_at")))
            ranked = settled(R.rank(R.merge_candidates(scored)).withColumn("id", S.row_id(F.lit(now))))
            of = m.select(F.col("id").alias("mention_id"), F.col("matter_id").alias("scope"), F.col("mention_type").alias("entity_type"))
            decided = settled(R.decide(open_, ranked))
            states = R.candidate_states(ranked, decided, F.lit(now)).join(of, "mention_id")
            candidates = states.select("id", "mention_id", F.col("entity_id").alias("candidate_entity_id"), "score", "state", "algorithm_version", F.lit(now).alias("created_at"), "resolved_at", "scope")
            evidence = scored.join(ranked.select("mention_id", "entity_id", F.col("id").alias("candidate_id")), ["mention_id", "entity_id"]).select("mention_id", "candidate_id", F.explode("evidence").alias("e")).distinct().join(of, "mention_id")
            evidence = evidence.select(S.row_id(F.lit(now)).alias("id"), "candidate_id", F.col("e.type").alias("evidence_type"), F.col("e.weight").alias("weight"), F.col("e.score").alias("score"), F.lit(None).alias("details_cipher"), F.lit(now).alias("created_at"), "scope")
            made = decided.filter("decision = 'NEW_ENTITY'").select("mention_id").join(of, "mention_id")
            made = settled(made.withColumn("entity_id", S.row_id(F.lit(now))).withColumn("hex", S.random_hex()).withColumn("hex2", S.random_hex()))
            new_entities = made.select(F.col("entity_id").alias("id"), F.col("scope").alias("matter_id"), "entity_type", S.token(choose(F.col("entity_type"), S.ENTITY_LETTERS), F.col("hex")).alias("public_token"), F.lit("ACTIVE").alias("status"), F.lit(None).alias("merged_into_entity_id"), F.lit(None).alias("resolution_confidence"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))
            new_aliases = made.select(S.row_id(F.lit(now)).alias("id"), F.col("scope").alias("matter_id"), "entity_id", S.synthetic_alias(F.col("entity_type"), F.col("hex2")).alias("alias"), F.lit("PRIMARY").alias("alias_type"), F.lit(None).alias("role"), F.lit(True).alias("is_primary"), F.lit(now).alias("created_at"))
            won = settled(decided.filter("decision = 'AUTO_LINK'").select("mention_id", "entity_id").union(made.select("mention_id", "entity_id")))
            all_mentions = settled(self._assigned(m, won, scopes))
            linked = all_mentions.join(batch.select(F.col("id").alias("document_id")), "document_id", "left_semi").filter("entity_id is not null and protected_value_id is not null")
            new_links = R.new_links(linked.select("entity_id", "protected_value_id", F.col("matter_id").alias("scope")), links).select("entity_id", "protected_value_id", F.lit("OWNER").alias("relationship_type"), F.lit(1.0).alias("confidence"), F.lit(True).alias("is_primary"), F.lit(now).alias("created_at"), "scope")
            told = made.select(F.lit("ENTITY_CREATED").alias("event_type"), "entity_id", "mention_id").union(won.select(F.lit("MENTION_ASSIGNED"), "entity_id", "mention_id"))
            events = self._events(told.join(of.select("mention_id", F.col("scope").alias("matter_id")), "mention_id"), "SYSTEM", now)
            append = {"entities": new_entities, "entity_aliases": new_aliases, "protected_values": new_values, "entity_protected_values": new_links, "resolution_candidates": candidates, "resolution_evidence": evidence, "resolution_events": events}
            return append, {"mentions": all_mentions}, None, {}

        return work

    def documents_resolve(self, ids: Sequence[str], as_of: str | None = None) -> dict[str, str]:
        """RESOLVE in rounds, so that each document sees what older ones of its matter made.

        Documents that share no fingerprint and no candidate entity see nothing of one another
        and go in one round, those that do by their levels; a round is one job over all
        matters.  Codes of documents not done.
        """
        day = F.current_date() if as_of is None else F.lit(as_of).cast("date")
        rounds: dict[int, list[str]] = {}
        for i, level in self._levels(list(dict.fromkeys(ids)), day).items():
            rounds.setdefault(level, []).append(i)
        out: dict[str, str] = {}
        for k in sorted(rounds):
            out |= self._stage("RESOLVE", rounds[k], self._resolve(day))
        return out

    @_clearing
    def _levels(self, ids: list[str], day: Column) -> dict[str, int]:
        """Level of each document asked for; 1 where it is not known."""
        if len(ids) < 2:
            return dict.fromkeys(ids, 1)
        d = settled(self.store.find("documents", "id", ids).select("id", "matter_id", "created_at"))
        scopes = [r.matter_id for r in d.select("matter_id").distinct().collect()]
        read = lambda t: self.store.read(t, scopes)
        m = R.with_values(self._mentions(d, scopes).drop("fingerprint"), self._search, day).filter("entity_id is null or fingerprint is not null")
        values = read("protected_values").withColumn("fingerprint", F.lower(F.hex("fingerprint")))
        open_, links, entities = m.filter("entity_id is null"), read("entity_protected_values"), read("entities")
        met = R.identifier_candidates(open_, values, links, entities).select("matter_id", "document_id", "entity_id")
        met = met.union(R.name_candidates(open_, entities, read("entity_aliases"), values, links).select("matter_id", "document_id", "entity_id"))
        keys = m.select("matter_id", "document_id", F.concat_ws(":", "value_type", "fingerprint").alias("key"), "fingerprint").filter("fingerprint is not null").drop("fingerprint")
        keys = keys.union(met.select("matter_id", "document_id", F.concat(F.lit("entity:"), "entity_id")))
        keys = settled(keys.distinct())
        found = levels(keys.join(d.select(F.col("id").alias("document_id"), "created_at"), "document_id"))
        return dict.fromkeys(ids, 1) | {r.document_id: r.level for r in found.collect()}  # the ids asked for

    def document_resolve(self, document_id: str, as_of: str | None = None) -> None:
        for code in self.documents_resolve([document_id], as_of).values():
            if code != "DONE":
                raise EngineError(code, f"RESOLVE of the document: {code}")

    def _assigned(self, values: DataFrame, won: DataFrame, scopes: Sequence[str]) -> DataFrame:
        """All mentions of the scopes, with the values and entities that some of them got."""
        v = values.select("id", F.col("protected_value_id").alias("_pv"), F.unhex("fingerprint").alias("_fp"))
        w = won.select(F.col("mention_id").alias("id"), F.col("entity_id").alias("_e"))
        m = self.store.read("mentions", scopes).join(v, "id", "left").join(w, "id", "left")
        changed = {"protected_value_id": "_pv", "fingerprint": "_fp", "entity_id": "_e"}
        return m.select(*[F.coalesce(changed[c], c).alias(c) if c in changed else F.col(c) for c in TABLES["mentions"].names])

    def _events(self, rows: DataFrame, actor: str, now: int) -> DataFrame:
        """Audit events of rows (matter_id, event_type, entity_id, mention_id)."""
        payload = F.to_json(F.struct("event_type", "entity_id", "mention_id"))
        rows = settled(rows.withColumn("id", S.row_id(F.lit(now))))
        return rows.select("id", "matter_id", "event_type", "entity_id", "mention_id", F.lit(actor).alias("actor"), self._seal(payload, F.col("id"), "resolutionEvent.payload").alias("payload_cipher"), F.lit(now).alias("created_at"))

    # -- reviewing

    def review_get_document(self, document_id: str) -> dict[str, DataFrame]:
        """Blocks, mentions with decision status and margin, candidates with evidence, counts and latest jobs."""
        one, scope = self._just(document_id), [self._one("documents", document_id, "document").matter_id]
        m = self._mentions(one, scope)
        c = self.store.read("resolution_candidates", scope).join(m.select(F.col("id").alias("mention_id")), "mention_id", "left_semi")
        reviewed = V.decision_status(m, c, self.store.read("resolution_events", scope))
        margin = V.display_margin(c).withColumnRenamed("mention_id", "id")
        mentions = reviewed.join(margin, "id", "left").select("id", "block_id", "page_no", "reading_order", "mention_type", "value", "start_offset", "end_offset", "entity_id", "decision_status", "margin").orderBy(*V.READING)
        return {
            "blocks": self._blocks(one, scope).orderBy("page_no", "reading_order", "block_id"),
            "mentions": mentions,
            "candidates": V.candidate_lists(c, self.store.read("resolution_evidence", scope)),
            "counts": V.counts(reviewed, self.store.read("entities", scope)),
            "jobs": V.latest_jobs(self.store.read("processing_jobs", scope).filter(F.col("document_id") == document_id)),
        }

    def review_confirm(self, mention_id: str) -> dict:
        """The mention as it is stored."""
        row = self._one("mentions", mention_id, "mention")
        return {k: row[k] for k in ("id", "document_id", "mention_type", "entity_id", "review_status")}

    def _assignment(self, mine, target: DataFrame, entity_id: str, now: int) -> tuple[dict, dict]:
        """Tables to append and to replace when a user assigns a mention; ``target``: the entities it may go to."""
        scope = [mine.matter_id]
        m = self.store.read("mentions", scope)
        decision = self.spark.createDataFrame([(mine.id, entity_id)], "mention_id string, target_id string")
        done = settled(V.assign(m.filter(F.col("id") == mine.id), decision, target))
        if error := done.first().error:
            raise EngineError(error)
        mentions = m.withColumn("entity_id", F.when(F.col("id") == mine.id, F.lit(entity_id)).otherwise(F.col("entity_id")))
        new = self.spark.createDataFrame([(entity_id, mine.protected_value_id)], "entity_id string, protected_value_id string").filter("protected_value_id is not null")
        here = F.lit(mine.matter_id).alias("scope")
        links = R.new_links(new, self.store.read("entity_protected_values", scope)).select("*", F.lit("OWNER").alias("relationship_type"), F.lit(1.0).alias("confidence"), F.lit(True).alias("is_primary"), F.lit(now).alias("created_at"), here)
        event = done.select(F.lit(mine.matter_id).alias("matter_id"), "event_type", "entity_id", F.col("id").alias("mention_id"))
        closed = V.close_candidates(self.store.read("resolution_candidates", scope), done, F.lit(now)).withColumn("scope", here)
        return {"entity_protected_values": settled(links), "resolution_events": event}, {"mentions": settled(mentions), "resolution_candidates": settled(closed)}

    @_clearing
    def review_assign(self, mention_id: str, entity_id: str) -> dict:
        """A user's decision: assigns, records the event, links the value and closes the candidates."""
        base, now = self.store.version(), self.clock()
        mine = self._one("mentions", mention_id, "mention")
        target = self.store.find("entities", "id", [_checked(entity_id, MAX_ID, "entity id")])
        append, replace = self._assignment(mine, target, entity_id, now)
        append["resolution_events"] = self._events(append["resolution_events"], "USER", now)
        self._commit(base, append, replace, [mine.matter_id])
        return self.review_confirm(mention_id)

    def _entity(self, matter_id: str, entity_type: str, alias: str, now: int) -> tuple[str, dict[str, DataFrame]]:
        """A new entity's id, its rows, and its event."""
        if entity_type not in S.ENTITY_LETTERS:
            raise EngineError("INVALID_REQUEST", "no such type of entity")
        _checked(alias, MAX_NAME, "alias")
        i = self.new_id()
        token = f"@{S.ENTITY_LETTERS[entity_type]}-{S.generate_key()[:16].upper()}"
        entity = self._row("entities", matter_id, id=i, matter_id=matter_id, entity_type=entity_type, public_token=token, status="ACTIVE", created_at=now, updated_at=now)
        name = self._row("entity_aliases", matter_id, id=self.new_id(), matter_id=matter_id, entity_id=i, alias=alias, alias_type="PRIMARY", is_primary=True, created_at=now)
        if not self.store.read("entity_aliases", [matter_id]).filter(F.col("alias") == alias).isEmpty():
            raise EngineError("DUPLICATE_ALIAS", "the matter has this alias already")
        event = self.spark.createDataFrame([(matter_id, "ENTITY_CREATED", i, None)], "matter_id string, event_type string, entity_id string, mention_id string")
        return i, {"entities": entity, "entity_aliases": name, "resolution_events": event}

    @_clearing
    def create_entity(self, matter_id: str, entity_type: str, alias: str) -> str:
        """An entity with its primary alias and its event."""
        base, now = self.store.version(), self.clock()
        i, rows = self._entity(matter_id, entity_type, alias, now)
        self._commit(base, rows | {"resolution_events": self._events(rows["resolution_events"], "USER", now)})
        return i

    @_clearing
    def review_create_entity_and_assign(self, mention_id: str, entity_type: str, alias: str) -> dict:
        """Both in one commit: a refused assignment leaves no entity."""
        base, now = self.store.version(), self.clock()
        mine = self._one("mentions", mention_id, "mention")
        i, rows = self._entity(mine.matter_id, entity_type, alias, now)
        append, replace = self._assignment(mine, rows["entities"], i, now)
        events = rows["resolution_events"].unionByName(append["resolution_events"])
        self._commit(base, rows | append | {"resolution_events": self._events(events, "USER", now)}, replace, [mine.matter_id])
        return self.review_confirm(mention_id)

    @_clearing
    def merge_entities(self, source_id: str, target_id: str) -> None:
        """The source redirects to the target; both must be active ones of one matter."""
        base, now = self.store.version(), self.clock()
        source = self._one("entities", source_id, "entity")
        e = self.store.read("entities", [source.matter_id])
        merged = settled(I.merge_entity(e, self.spark.createDataFrame([(source_id, target_id, now)], "source_id string, target_id string, at long")))
        if source.status != "ACTIVE" or merged.filter((F.col("id") == source_id) & (F.col("merged_into_entity_id") == target_id)).isEmpty():
            raise EngineError("INVALID_REQUEST", "the entities may not be merged")
        event = self.spark.createDataFrame([(source.matter_id, "ENTITY_MERGED", source_id, None)], "matter_id string, event_type string, entity_id string, mention_id string")
        self._commit(base, {"resolution_events": self._events(event, "USER", now)}, {"entities": merged}, [source.matter_id])

    @_clearing
    def review_add_constraint(self, matter_id: str, entity_a: str, entity_b: str, kind: str, reason: str) -> str:
        """A user's constraint on two active entities of a matter, in the order of their ids."""
        _checked(reason, MAX_REASON, "reason")
        a, b = sorted((_checked(entity_a, MAX_ID, "entity id"), _checked(entity_b, MAX_ID, "entity id")))
        if a == b or kind not in ("MUST_LINK", "CANNOT_LINK"):
            raise EngineError("INVALID_REQUEST")
        base = self.store.version()
        good = self.store.read("entities", [_checked(matter_id, MAX_ID, "matter id")]).filter(F.col("id").isin(a, b) & (F.col("status") == "ACTIVE")).count()
        if good != 2:
            raise EngineError("NOT_FOUND", "both entities must be active ones of the matter")
        old = self.store.read("entity_constraints", [matter_id]).filter((F.col("entity_a_id") == a) & (F.col("entity_b_id") == b) & (F.col("constraint_type") == kind))
        if not old.isEmpty():
            raise EngineError("DUPLICATE_CONSTRAINT")
        i, now = self.new_id(), self.clock()
        event = self.spark.createDataFrame([(matter_id, "CONSTRAINT_CREATED", a, None)], "matter_id string, event_type string, entity_id string, mention_id string")
        row = self._row("entity_constraints", matter_id, id=i, matter_id=matter_id, entity_a_id=a, entity_b_id=b, constraint_type=kind, reason=reason, source="USER", created_at=now)
        self._commit(base, {"entity_constraints": row, "resolution_events": self._events(event, "USER", now)})
        return i

    # -- previews

    def _context(self, batch: DataFrame, scopes: Sequence[str]) -> DataFrame:
        c = SZ.mention_context(self._mentions(batch, scopes), self.store.read("entities", scopes), self.store.read("entity_aliases", scopes), self.store.read("protected_values", scopes))
        # stored offsets count UTF-16 units
        t = self._blocks(batch, scopes).select("block_id", D.spans.wide_places("text").alias("_wide"))
        return c.join(t, "block_id").withColumns({f"{k}_cp": D.spans.from_units("_wide", f"{k}_offset") for k in ("start", "end")}).drop("_wide")

    def preview_get(self, document_id: str) -> dict:
        doc = self._one("documents", document_id, "document")
        scope = [doc.matter_id]
        if doc.parse_status == "SANITIZED":
            s = self.store.read("sanitized_documents", scope).filter(F.col("document_id") == document_id).first()
            b = self.store.read("sanitized_blocks", scope).filter(F.col("sanitized_document_id") == s.id)
            shown = SZ.with_source(b, self._blocks(self._just(document_id), scope)).withColumn("text", self._open(F.col("text_cipher"), F.col("id"), "sanitizedBlock.text"))
            maps = self.store.read("sanitization_mappings", scope).filter(F.col("sanitized_document_id") == s.id).select("mention_id", "alias", "public_token", "restore_policy")
            return {"status": "AVAILABLE", "sanitized_document_id": s.id, "blocks": shown.select("block_id", "page_no", "reading_order", "text").orderBy("reading_order", "block_id"), "mappings": maps}
        if doc.parse_status in ("READY", "FAILED"):
            r = V.readiness(self.store.read("mentions", scope).filter(F.col("document_id") == document_id), self.store.read("entities", scope), self.store.read("entity_aliases", scope), self.store.read("protected_values", scope))
            return {"status": "READY", "blockers": r.select("mention_id", "reason")}
        return {"status": "NOT_READY", "parse_status": doc.parse_status}

    def previews_generate(self, ids: Sequence[str]) -> dict[str, str]:
        """SANITIZE: all blocks of a document or none; codes of documents that failed or were refused."""

        def work(batch: DataFrame, scopes: list[str], now: int) -> tuple:
            context, blocks = self._settled(self._context(batch, scopes), "value"), self._settled(self._blocks(batch, scopes), "text")
            done = self._settled(SZ.sanitize_blocks(blocks, context).withColumn("id", S.row_id(F.lit(now))), "sanitized")
            errors = SZ.document_errors(done).withColumnRenamed("document_id", "id")
            gaps = SZ.coverage_gaps(blocks.select("document_id", "block_id"), done.select("document_id", "block_id"), ["document_id", "block_id"])
            sound = context.join(errors.select(F.col("id").alias("document_id")), "document_id", "left_anti")
            maps = settled(SZ.mappings(sound))
            gaps = gaps.select("document_id").union(SZ.coverage_gaps(sound.select("document_id", F.col("id").alias("mention_id")), maps.select("document_id", "mention_id"), ["document_id", "mention_id"]).select("document_id"))
            errors = settled(errors.union(gaps.distinct().select(F.col("document_id").alias("id"), F.lit("INCOMPLETE").alias("error"))).groupBy("id").agg(F.min("error").alias("error")))
            good = settled(batch.join(errors.select("id"), "id", "left_anti").withColumn("sid", S.row_id(F.lit(now))).withColumnRenamed("id", "document_id"))
            here = [F.col("matter_id").alias("scope"), F.lit(now).alias("created_at")]
            docs = good.select(F.col("sid").alias("id"), "matter_id", "document_id", "job_id", *here)
            kept = SZ.complete_documents(done).join(good.drop("job_id"), "document_id").join(blocks.select("block_id", "page_id"), "block_id")
            kept = kept.select("id", F.col("sid").alias("sanitized_document_id"), "document_id", "page_id", "block_id", self._seal(F.col("sanitized"), F.col("id"), "sanitizedBlock.text").alias("text_cipher"), *here)
            mapped = maps.join(good.drop("job_id"), "document_id").select(S.row_id(F.lit(now)).alias("id"), "matter_id", F.col("sid").alias("sanitized_document_id"), "mention_id", "entity_id", "public_token", "alias", "restore_policy", *here)
            return {"sanitized_documents": docs, "sanitized_blocks": kept, "sanitization_mappings": mapped}, {}, errors, {}

        return self._stage("SANITIZE", ids, work)

    def preview_generate(self, document_id: str) -> dict:
        for code in self.previews_generate([document_id]).values():
            if code != "DONE":
                raise EngineError(code, f"SANITIZE of the document: {code}")
        return self.preview_get(document_id)

    def preview_rehydrate(self, sanitized_document_id: str, text: str, on_request: bool = False) -> dict:
        """``text`` with tokens of the document restored where their policy allows it, and the tokens left."""
        if len(text) > MAX_TEXT:
            raise EngineError("INVALID_REQUEST", "the text is too long")
        found = self.store.find("sanitized_documents", "id", [_checked(sanitized_document_id, MAX_ID, "id")]).first()
        scope = [found.matter_id] if found else []
        m = self.store.read("sanitization_mappings", scope).filter(F.col("sanitized_document_id") == sanitized_document_id)
        vault = SZ.mapping_source(m, self.store.read("mentions", scope), self.store.read("protected_values", scope)).withColumn("document_id", F.col("sanitized_document_id"))
        allowed = SZ.restorable(vault, on_request)
        names = self.store.read("entity_aliases", scope).join(allowed.select("entity_id").distinct(), "entity_id", "left_semi").groupBy("entity_id").agg(F.collect_list("alias").alias("aliases"))
        t = allowed.join(names, "entity_id", "left").select("document_id", F.col("public_token").alias("token"), self._open(F.col("value_cipher"), F.col("protected_value_id"), "protectedValue.value").alias("value"), "aliases")
        one = self.spark.createDataFrame([(sanitized_document_id, text)], "document_id string, text string")
        row = SZ.rehydrate(one, t).select("restored", "unresolved_tokens").first()
        return {"text": row.restored, "unresolved_tokens": list(row.unresolved_tokens)}


__all__ = ["ALGORITHM_VERSION", "COMMON", "STAGES", "Engine", "EngineError"]
