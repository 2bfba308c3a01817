"""Queries of sanitizing, integrity between versions, requests and lookups, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakframe.functions import normalize as N
from cloakframe.functions import pseudonyms as P
from cloakframe.functions import security as S
from cloakframe.functions import spans
from cloakframe.operators import detect as D
from cloakframe.operators import integrity as I
from cloakframe.operators import resolve as RS
from cloakframe.operators import review as V
from cloakframe.operators import sanitize as SZ
from cloakframe.operators.levels import levels
from cloakframe.plans.derive import view
from cloakframe.plans.queries import query
from cloakframe.schemas import TABLES
from cloakframe.sources.store import Store, guarded_update, settled, shared_folder
from cloakframe.streaming import protocol

# -- sanitizing of whole blocks, with several replacements each -----------------

_CELL = """b AS (SELECT block_id, any_value(document_id) AS document_id, any_value(page_no) AS page_no, any_value(reading_order) AS reading_order, any_value(mail) AS mail, any_value(tel) AS tel, any_value(card) AS card,
    arg_min(CASE WHEN mention_type = 'CASE_NUMBER' THEN 'UNSUPPORTED_MENTION_TYPE' WHEN entity_status <> 'ACTIVE' OR value_token IS NULL THEN 'UNRESOLVED_MENTION' END, j) FILTER (WHERE mention_type = 'CASE_NUMBER' OR entity_status <> 'ACTIVE' OR value_token IS NULL) AS problem,
    bool_or(contains(alias, '〔')) AS bad, max(CASE WHEN j = 0 THEN concat(alias, '〔', value_token, '〕') END) AS r0, max(CASE WHEN j = 1 THEN concat(alias, '〔', value_token, '〕') END) AS r1, max(CASE WHEN j = 2 THEN concat(alias, '〔', value_token, '〕') END) AS r2, list(value) AS vals
  FROM v_context GROUP BY block_id),
r AS (SELECT b.*, concat('Holder ', r0, ' tel ', r1, ' card ', r2, substr(t.text, 48 + length(mail))) AS done FROM b JOIN v_texts t USING (block_id)),
s AS (SELECT *, coalesce(problem, CASE WHEN bad THEN 'INVALID_REPLACEMENT' WHEN len(list_filter(vals, lambda x: contains(done, x))) > 0 THEN 'LEAK_DETECTED' END) AS error FROM r)"""


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "v_context").filter("j = 0").select("block_id", "document_id", "page_no", "reading_order")
    return view(spark, d, "v_texts").join(c, "block_id")


def _sanitized(spark: SparkSession, d: str) -> DataFrame:
    return SZ.sanitize_blocks(_blocks(spark, d), view(spark, d, "v_context"))


@query(f"WITH {_CELL} SELECT document_id, block_id, page_no, CAST(reading_order AS BIGINT) AS reading_order, CASE WHEN error IS NULL THEN done END AS sanitized, error FROM s")
def sanitize_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _sanitized(spark, d)


@query(f"WITH {_CELL} SELECT document_id, arg_min(error, (page_no, reading_order, block_id)) AS error FROM s WHERE error IS NOT NULL GROUP BY document_id")
def document_errors(spark: SparkSession, d: str) -> DataFrame:
    return SZ.document_errors(_sanitized(spark, d))


@query(f"WITH {_CELL}, t AS (SELECT * REPLACE (concat('d', CAST(CAST(substr(block_id, 2) AS BIGINT) // 8 AS VARCHAR)) AS document_id) FROM s) SELECT document_id, block_id, page_no, CAST(reading_order AS BIGINT) AS reading_order, done AS sanitized FROM t WHERE document_id NOT IN (SELECT document_id FROM t WHERE error IS NOT NULL)")
def complete_documents(spark: SparkSession, d: str) -> DataFrame:
    """Of small documents, a few blocks each, those without any error."""
    number = F.floor(F.substring("block_id", 2, 20).cast("long") / 8)
    return SZ.complete_documents(_sanitized(spark, d).withColumn("document_id", F.concat(F.lit("d"), number.cast("string"))))


@query(
    """SELECT document_id, id AS mention_id, entity_id, start_offset, value_token AS public_token, alias, CASE mention_type WHEN 'EMAIL' THEN 'RESTORE_ON_REQUEST' WHEN 'PHONE' THEN 'RESTORE_ON_REQUEST' ELSE 'RESTORE_ON_REQUEST' END AS restore_policy, protected_value_id
FROM v_context WHERE mention_type <> 'CASE_NUMBER' AND entity_status = 'ACTIVE' AND value_token IS NOT NULL"""
)
def mappings(spark: SparkSession, d: str) -> DataFrame:
    return SZ.mappings(view(spark, d, "v_context"))


@query(
    """SELECT e.document_id, e.mention_id, CASE WHEN p.mention_id IS NULL THEN 'MISSING' END AS problem FROM (SELECT document_id, id AS mention_id FROM v_context) e
LEFT JOIN (SELECT document_id, id AS mention_id FROM v_context WHERE mention_type <> 'CASE_NUMBER' AND entity_status = 'ACTIVE' AND value_token IS NOT NULL) p USING (document_id, mention_id) WHERE p.mention_id IS NULL"""
)
def mapping_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "v_context")
    return SZ.coverage_gaps(c.select("document_id", F.col("id").alias("mention_id")), SZ.mappings(c).select("document_id", "mention_id"), ["document_id", "mention_id"])


@query("SELECT b.id AS block_id, b.document_id, p.page_no, b.reading_order FROM v_blocks b JOIN v_pages p ON b.page_id = p.id")
def blocks_with_pages(spark: SparkSession, d: str) -> DataFrame:
    b = V.blocks_with_pages(view(spark, d, "v_blocks"), view(spark, d, "v_pages"))
    return b.select(F.col("id").alias("block_id"), "document_id", "page_no", "reading_order")


@query(
    """SELECT t.id, t.block_id, coalesce(s.page_no, 0) AS page_no, coalesce(s.reading_order, 0) AS reading_order FROM v_sblocks t
LEFT JOIN (SELECT b.id AS block_id, p.page_no, b.reading_order FROM v_blocks b JOIN v_pages p ON b.page_id = p.id) s USING (block_id)"""
)
def sanitized_with_source(spark: SparkSession, d: str) -> DataFrame:
    return SZ.with_source(view(spark, d, "v_sblocks"), blocks_with_pages(spark, d)).select("id", "block_id", "page_no", "reading_order")


@query(
    """SELECT g.id, g.mention_id, m.start_offset AS at, v.value, v.fingerprint FROM v_smaps g JOIN v_mentions m ON m.id = g.mention_id JOIN v_values v ON v.id = m.protected_value_id"""
)
def mapping_source(spark: SparkSession, d: str) -> DataFrame:
    maps = view(spark, d, "v_smaps").select("id", "mention_id")
    return SZ.mapping_source(maps, view(spark, d, "v_mentions"), view(spark, d, "v_values")).select("id", "mention_id", F.col("start_offset").alias("at"), "value", "fingerprint")


# -- detectors -------------------------------------------------------------------


@query(
    """WITH k AS (SELECT p.*, t.n AS size, max(end_cp) OVER (PARTITION BY p.block_id ORDER BY start_cp, end_cp DESC, p.n, detector, mention_type, mention_strength, confidence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT * FROM v_proposals) p LEFT JOIN (SELECT block_id, length(text) AS n FROM v_texts) t USING (block_id)),
r AS (SELECT *, CASE WHEN size IS NULL THEN 'BLOCK' WHEN start_cp < 0 OR end_cp > size OR start_cp >= end_cp THEN 'RANGE' WHEN confidence > 1 THEN 'CONFIDENCE' WHEN mention_type = 'SECRET' OR mention_strength = 'SURE' OR detector = 'GUESS' THEN 'ENUM' WHEN start_cp < reach THEN 'OVERLAP' END AS reason FROM k)
SELECT block_id, n, start_cp, end_cp, reason FROM r WHERE reason IS NOT NULL"""
)
def proposal_errors(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "v_proposals").distinct()
    return D.proposal_errors(p, view(spark, d, "v_texts"), "n", "detector", "mention_type", "mention_strength", "confidence").select("block_id", "n", "start_cp", "end_cp", "reason")


@query("SELECT block_id, 'PERSON' AS mention_type, 'EXPLICIT' AS mention_strength, CAST(strpos(text, ' tel ') - 1 AS INTEGER) AS start_cp, CAST(strpos(text, ' tel ') + 4 AS INTEGER) AS end_cp, 'NER' AS detector, CAST(1 AS DOUBLE) AS confidence, ' tel ' AS value FROM v_texts")
def detector_proposals(spark: SparkSession, d: str) -> DataFrame:
    def find(text: str) -> list[dict]:
        at = text.find(" tel ")
        return [{"mention_type": "PERSON", "start": at, "end": at + 5}]

    t = view(spark, d, "v_texts")
    found = D.detect_with(t, find).join(t, "block_id")
    return found.withColumn("value", spans.span_text("text", F.col("start_cp"), F.col("end_cp"))).drop("text")


@query("SELECT id, trim(document_id) <> '' AND trim(matter_id) <> '' AS bounded FROM (SELECT id, CASE WHEN start_offset % 7 = 0 THEN ' ' ELSE document_id END AS document_id, matter_id FROM v_mentions) u")
def bounded_blocks(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "v_mentions").withColumn("document_id", F.when(F.col("start_offset") % 7 == 0, " ").otherwise(F.col("document_id")))
    return m.select("id", D.bounded("document_id", "matter_id").alias("bounded"))


_WIDE = "ＡＢＣａｂｃ０１２３４５６７８９＠．－（）　"
_PLAIN = "ABCabc0123456789@.-() "
_UNWIDE = f"translate(value, '{_WIDE}', '{_PLAIN}')"


@query(
    f"""WITH w AS (SELECT k, mention_type, regexp_replace(trim({_UNWIDE}), ' +', ' ', 'g') AS v FROM (SELECT k, mention_type, translate(value, '{_PLAIN}', '{_WIDE}') AS value FROM v_raw WHERE k % 2 = 0 UNION ALL SELECT k, mention_type, value FROM v_raw WHERE k % 2 = 1) u)
SELECT k, CASE mention_type WHEN 'EMAIL' THEN lower(v) WHEN 'PHONE' THEN CASE WHEN regexp_replace(v, '[^0-9]', '', 'g') LIKE '861__________' THEN substr(regexp_replace(v, '[^0-9]', '', 'g'), 3) ELSE regexp_replace(v, '[^0-9]', '', 'g') END
  WHEN 'ID_CARD' THEN upper(replace(v, ' ', '')) WHEN 'BANK_ACCOUNT' THEN regexp_replace(v, '[^0-9]', '', 'g') ELSE v END AS normalized FROM w"""
)
def normalize_wide_values(spark: SparkSession, d: str) -> DataFrame:
    t = view(spark, d, "v_raw").withColumn("value", F.when(F.col("k") % 2 == 0, F.translate("value", _PLAIN, _WIDE)).otherwise(F.col("value")))
    return t.select("k", N.normalized(F.col("mention_type"), F.col("value")).alias("normalized"))


# -- candidates and jobs -----------------------------------------------------------


@query(
    """SELECT c.id, c.mention_id, c.candidate_entity_id FROM v_candidates c JOIN v_mentions m ON m.id = c.mention_id JOIN v_entities e ON e.id = c.candidate_entity_id
WHERE e.status = 'ACTIVE' AND e.matter_id = m.matter_id AND isfinite(c.score) AND CASE WHEN m.mention_type IN ('PERSON', 'ORGANIZATION') THEN m.mention_type = e.entity_type ELSE m.mention_type IN ('PHONE', 'EMAIL', 'ID_CARD', 'BANK_ACCOUNT', 'ADDRESS') END"""
)
def eligible_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "v_candidates").withColumnRenamed("candidate_entity_id", "entity_id")
    found = RS.eligible(c, view(spark, d, "v_mentions"), view(spark, d, "v_entities"))
    return found.select("id", "mention_id", F.col("entity_id").alias("candidate_entity_id"))


_CHOSEN = "SELECT mention_id, min(candidate_entity_id) AS chosen FROM v_candidates GROUP BY mention_id HAVING min(score) < 50"


@query(f"SELECT c.id, CASE WHEN a.chosen IS NOT NULL AND state = 'PENDING' THEN CASE WHEN candidate_entity_id = a.chosen THEN 'ACCEPTED' ELSE 'REJECTED' END ELSE state END AS state, CASE WHEN a.chosen IS NOT NULL AND state = 'PENDING' THEN CAST(77 AS BIGINT) END AS resolved_at FROM v_candidates c LEFT JOIN ({_CHOSEN}) a USING (mention_id)")
def close_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "v_candidates")
    a = c.groupBy("mention_id").agg(F.min("candidate_entity_id").alias("entity_id"), F.min("score").alias("s")).filter("s < 50").select(F.col("mention_id").alias("id"), "entity_id", F.lit(None).cast("string").alias("error"))
    return V.close_candidates(c, a, F.lit(77).cast("long")).select("id", "state", "resolved_at")


# completed jobs count as failed here, or no document would be left
_LATEST = "SELECT document_id, job_type, status FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) AS r FROM v_jobs) z WHERE r = 1"


@query(f"SELECT d.id, j.job_type FROM v_documents d JOIN ({_LATEST}) j ON j.document_id = d.id WHERE d.parse_status = 'FAILED' AND j.status IN ('FAILED', 'COMPLETED')")
def retry_gate(spark: SparkSession, d: str) -> DataFrame:
    jobs = view(spark, d, "v_jobs").withColumn("status", F.when(F.col("status") == "COMPLETED", "FAILED").otherwise(F.col("status")))
    return V.retryable(view(spark, d, "v_documents"), jobs).select("id", "job_type")


@query("SELECT id, CASE WHEN parse_status IN ('READY', 'FAILED') AND page_count = 3 THEN 'SANITIZING' ELSE parse_status END AS parse_status FROM v_documents")
def guarded_status(spark: SparkSession, d: str) -> DataFrame:
    docs = view(spark, d, "v_documents").select("id", "parse_status", "page_count")
    prior = F.col("parse_status").isin("READY", "FAILED")
    n = docs.filter(prior & (F.col("page_count") == 3)).count()
    return guarded_update(docs, docs.filter("page_count = 3"), prior, {"parse_status": F.lit("SANITIZING")}, n).select("id", "parse_status")


@query("SELECT d.id, d.matter_id, coalesce(d.page_count, 0) AS page_count, CAST(row_number() OVER (PARTITION BY d.matter_id ORDER BY d.created_at, d.id) AS INTEGER) AS place FROM v_documents d WHERE EXISTS (SELECT 1 FROM v_pages p WHERE p.document_id = d.id) AND d.file_hash = 'hash17' OR d.id = 'd0004'")
def document_lookup(spark: SparkSession, d: str) -> DataFrame:
    docs = view(spark, d, "v_documents")
    placed = docs.filter((F.col("file_hash") == "hash17") | (F.col("id") == "d0004"))
    there = placed.join(view(spark, d, "v_pages").select(F.col("document_id").alias("id")), "id", "left_semi").union(placed.filter("id = 'd0004'").select("id", *[c for c in placed.columns if c != "id"])).dropDuplicates(["id"])
    return there.select("id", "matter_id", F.coalesce("page_count", F.lit(0)).alias("page_count"), F.row_number().over(Window.partitionBy("matter_id").orderBy("created_at", "id")).alias("place"))


# -- integrity between versions ----------------------------------------------------


@query(
    """SELECT 'entities' AS "table", n.id, 'matter_id changed' AS rule FROM v_later n JOIN v_entities o USING (id) WHERE n.matter_id <> o.matter_id
UNION ALL SELECT 'entities', n.id, 'public_token changed' FROM v_later n JOIN v_entities o USING (id) WHERE n.public_token <> o.public_token"""
)
def immutable_scope(spark: SparkSession, d: str) -> DataFrame:
    return I.changed_columns(view(spark, d, "v_entities"), view(spark, d, "v_later"), ("matter_id", "public_token"), "entities")


@query("SELECT 'entities' AS \"table\", o.id, 'row lost' AS rule FROM v_entities o WHERE NOT EXISTS (SELECT 1 FROM v_later n WHERE n.id = o.id)")
def append_only(spark: SparkSession, d: str) -> DataFrame:
    return I.lost(view(spark, d, "v_entities"), view(spark, d, "v_later"), "entities")


@query("SELECT 'protected_values' AS \"table\", o.id, 'public_token changed' AS rule FROM v_values o JOIN v_laterv n USING (id) WHERE o.public_token IS NOT NULL AND o.public_token IS DISTINCT FROM n.public_token")
def token_once_set(spark: SparkSession, d: str) -> DataFrame:
    return I.changed_columns(view(spark, d, "v_values"), view(spark, d, "v_laterv"), ("public_token",), "protected_values", once_set=True)


@query(
    """SELECT 'sanitized_documents' AS "table", s.id, 'document_id out of scope' AS rule FROM v_sdocs s WHERE NOT EXISTS (SELECT 1 FROM v_documents d WHERE d.id = s.document_id AND d.matter_id = s.matter_id)
UNION ALL SELECT 'sanitized_documents', s.id, 'job_id out of scope' FROM v_sdocs s WHERE NOT EXISTS (SELECT 1 FROM v_sjobs j WHERE j.id = s.job_id AND j.document_id = s.document_id AND j.job_type = 'SANITIZE')
UNION ALL SELECT 'sanitized_blocks', b.id, 'block_id out of scope' FROM v_sblocks b WHERE NOT EXISTS (SELECT 1 FROM v_blocks k WHERE k.id = b.block_id AND k.document_id = b.document_id AND k.page_id = b.page_id)
UNION ALL SELECT 'sanitized_blocks', b.id, 'sanitized_document_id out of scope' FROM v_sblocks b WHERE NOT EXISTS (SELECT 1 FROM v_sdocs s WHERE s.id = b.sanitized_document_id AND s.document_id = b.document_id)
UNION ALL SELECT 'sanitization_mappings', g.id, 'mention_id out of scope' FROM v_smaps g WHERE NOT EXISTS (SELECT 1 FROM v_mentions m WHERE m.id = g.mention_id AND m.matter_id = g.matter_id)
UNION ALL SELECT 'sanitization_mappings', g.id, 'entity_id out of scope' FROM v_smaps g WHERE NOT EXISTS (SELECT 1 FROM v_entities e WHERE e.id = g.entity_id AND e.matter_id = g.matter_id)
UNION ALL SELECT 'sanitization_mappings', g.id, 'sanitized_document_id out of scope' FROM v_smaps g JOIN v_mentions m ON m.id = g.mention_id WHERE NOT EXISTS (SELECT 1 FROM v_sdocs s WHERE s.id = g.sanitized_document_id AND s.document_id = m.document_id)"""
)
def artifact_scope(spark: SparkSession, d: str) -> DataFrame:
    v = lambda n: view(spark, d, n)
    source = {"documents": v("v_documents"), "processing_jobs": v("v_sjobs"), "document_blocks": v("v_blocks"), "mentions": v("v_mentions"), "entities": v("v_entities")}
    return I.artifact_scope(v("v_sdocs"), v("v_sblocks"), v("v_smaps"), source)


_MERGE = "SELECT id AS source_id, concat('e', lpad(CAST(CAST(substr(id, 2) AS BIGINT) + 25 AS STRING), 9, '0')) AS target_id, CAST(1730000000050 AS BIGINT) AS at FROM v_entities WHERE CAST(substr(id, 2) AS BIGINT) % 3 = 0"
_MAY = "e.status = 'ACTIVE' AND t.status = 'ACTIVE' AND t.matter_id = e.matter_id AND m.at >= e.updated_at"


@query(
    f"""SELECT e.id, CASE WHEN {_MAY} THEN 'MERGED' ELSE e.status END AS status, CASE WHEN {_MAY} THEN m.target_id ELSE e.merged_into_entity_id END AS merged_into_entity_id, CASE WHEN {_MAY} THEN m.at ELSE e.updated_at END AS updated_at
FROM v_entities e LEFT JOIN ({_MERGE}) m ON m.source_id = e.id LEFT JOIN v_entities t ON t.id = m.target_id"""
)
def merge_entity(spark: SparkSession, d: str) -> DataFrame:
    e = view(spark, d, "v_entities")
    k = F.substring("id", 2, 20).cast("long")
    m = e.filter(k % 3 == 0).select(F.col("id").alias("source_id"), F.concat(F.lit("e"), F.lpad((k + 25).cast("string"), 9, "0")).alias("target_id"), F.lit(1730000000050).cast("long").alias("at"))
    return I.merge_entity(e, m).select("id", "status", "merged_into_entity_id", "updated_at")


# -- envelopes, ids and tokens ------------------------------------------------------


@query("SELECT id, value AS opened, CAST(30 + strlen(value) AS INTEGER) AS size, true AS headed, CAST(NULL AS VARCHAR) AS elsewhere, CAST(NULL AS VARCHAR) AS tampered FROM v_values")
def envelopes(spark: SparkSession, d: str) -> DataFrame:
    key = F.unhex(F.lit("09" * 32))
    v = view(spark, d, "v_values").select("id", "value").withColumn("e", S.sealed(F.col("value"), key, S.context(F.col("id"), "protectedValue.value")))
    back = lambda e, field: S.opened(e, key, S.context(F.col("id"), field)).cast("string")
    return settled(v).select(
        "id",
        back(F.col("e"), "protectedValue.value").alias("opened"),
        F.length("e").alias("size"),
        (F.hex(F.substring("e", F.lit(1), F.lit(2))) == S.HEADER).alias("headed"),
        back(F.col("e"), "mention.text").alias("elsewhere"),
        back(F.substring("e", F.lit(1), F.length("e") - 1), "protectedValue.value").alias("tampered"),
    )


@query("SELECT id, created_at AS ms, '7' AS version, true AS variant, true AS formed FROM v_entities")
def row_ids(spark: SparkSession, d: str) -> DataFrame:
    e = settled(view(spark, d, "v_entities").select("id", "created_at").withColumn("u", S.row_id(F.col("created_at"))))
    ms = F.conv(F.concat(F.substring("u", 1, 8), F.substring("u", 10, 4)), 16, 10).cast("long")
    formed = F.col("u").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return e.select("id", ms.alias("ms"), F.substring("u", 15, 1).alias("version"), F.substring("u", 20, 1).isin("8", "9", "a", "b").alias("variant"), formed.alias("formed"))


@query(
    """SELECT id, CASE entity_type WHEN 'PERSON' THEN '@P-' ELSE '@O-' END AS head, CAST(19 AS INTEGER) AS size, true AS formed, concat(CASE entity_type WHEN 'PERSON' THEN 'Person ' ELSE 'Organization ' END) AS named FROM v_entities"""
)
def entity_tokens(spark: SparkSession, d: str) -> DataFrame:
    e = settled(view(spark, d, "v_entities").select("id", "entity_type").withColumns({"a": S.random_hex(), "b": S.random_hex()}))
    token, alias = S.token(N.choose(F.col("entity_type"), S.ENTITY_LETTERS), F.col("a")), S.synthetic_alias(F.col("entity_type"), F.col("b"))
    formed = token.rlike(P.STORED_TOKEN_FORM) & alias.rlike("^[A-Z][a-z]+ [0-9A-F]{16}$")
    return e.select("id", F.substring(token, 1, 3).alias("head"), F.length(token).alias("size"), formed.alias("formed"), F.regexp_replace(alias, "[0-9A-F]{16}$", "").alias("named"))


@query("SELECT id, CAST(row_number() OVER (ORDER BY created_at, id) AS INTEGER) AS place FROM (SELECT concat('m', lpad(CAST(n_nationkey AS VARCHAR), 2, '0')) AS id, n_nationkey % 4 AS created_at FROM nation) m")
def matter_listing(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    m = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("m"), F.lpad(n.cast("string"), 2, "0")).alias("id"), (n % 4).alias("created_at"))
    return m.select("id", F.row_number().over(Window.orderBy("created_at", "id")).alias("place"))  # a row a matter


# -- worker requests and what a worker answers --------------------------------------

_VALID = "page_start >= 1 AND (page_end IS NULL OR page_end >= page_start)"


def _requests(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    s = F.struct(F.lit(protocol.VERSION).alias("protocolVersion"), F.lit("process_document").alias("type"), c("job_id").alias("jobId"), c("document_id").alias("documentId"), c("path").alias("filePath"), c("page_start").alias("pageStart"), c("page_end").alias("pageEnd"), F.lit(False).alias("ocr"), F.lit(True).alias("detectLayout"))
    return protocol.valid_requests(view(spark, d, "v_requests").select("seq", F.to_json(s).alias("value")))


@query(f"SELECT seq, job_id AS \"jobId\", {_VALID} AS valid FROM v_requests")
def valid_requests(spark: SparkSession, d: str) -> DataFrame:
    return _requests(spark, d).select("seq", "jobId", "valid")


_ACTIVE = f"SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) = 1 AS active FROM v_requests WHERE {_VALID}"


@query(f"SELECT seq, job_id AS \"jobId\", active FROM ({_ACTIVE}) a")
def active_requests(spark: SparkSession, d: str) -> DataFrame:
    return protocol.active_once(_requests(spark, d)).select("seq", "jobId", "active")


# files f0 to f24 have 1 to 3 pages, the others none; jobs j0, j7, j14, ... are cancelled after a page
@query(
    f"""WITH a AS (SELECT *, CAST(substr(path, 2) AS INTEGER) AS f, CAST(substr(job_id, 2) AS INTEGER) % 7 = 0 AS cancelled FROM ({_ACTIVE}) q),
n AS (SELECT *, CASE WHEN f < 25 THEN 1 + f % 3 END AS pages FROM a),
j AS (SELECT *, NOT active OR pages IS NULL OR page_start > pages AS bad, least(coalesce(page_end, pages), pages) - page_start + 1 AS total FROM n),
t AS (SELECT *, CASE WHEN cancelled THEN least(total, 1) ELSE total END AS done, cancelled AND total > 1 AS cut FROM j)
SELECT job_id AS "jobId", CAST(CASE WHEN active THEN 2 ELSE seq END AS BIGINT) AS seq, 'error' AS type, CAST(NULL AS INTEGER) AS page, CASE WHEN NOT active OR pages IS NOT NULL THEN 'INVALID_REQUEST' ELSE 'FILE_NOT_FOUND' END AS code FROM t WHERE bad
UNION ALL SELECT job_id, k, CASE k WHEN 0 THEN 'started' ELSE 'progress' END, NULL, NULL FROM t CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) q WHERE active
UNION ALL SELECT job_id, 2 + 2 * p + k, CASE k WHEN 0 THEN 'page_result' ELSE 'progress' END, page_start + p, NULL FROM t CROSS JOIN (SELECT 0 AS p UNION ALL SELECT 1 UNION ALL SELECT 2) x CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) q WHERE NOT bad AND p < done
UNION ALL SELECT job_id, 2 + 2 * done + k, CASE WHEN cut THEN 'cancelled' WHEN k = 0 THEN 'progress' ELSE 'completed' END, CASE WHEN cut THEN page_start + done - 1 WHEN k = 1 THEN total END, NULL FROM t CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) q WHERE NOT bad AND (NOT cut OR k = 0)"""
)
def worker_events(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    item = F.struct(F.lit("text").alias("kind"), F.lit("t").alias("text"), *[F.lit(float(v)).alias(k) for k, v in (("x0", 1), ("y0", 1), ("x1", 2), ("y1", 2))])
    pages = spark.range(25).select(F.concat(F.lit("f"), c("id").cast("string")).alias("path"), F.explode(F.sequence(F.lit(1), (1 + c("id") % 3).cast("int"))).alias("page_no"))
    pages = pages.select("path", "page_no", F.lit(10.0).alias("original_width"), F.lit(10.0).alias("original_height"), F.lit(0).alias("rotation"), F.array(item).alias("items"))
    cancels = spark.range(700).filter("id % 7 = 0").select(F.concat(F.lit("j"), c("id").cast("string")).alias("jobId"), F.lit(1).alias("after"))
    e = protocol.parse(protocol.serve(_requests(spark, d), pages, cancels))
    page = F.coalesce("page.pageNo", F.when(c("type") == "progress", c("pageNo")), "lastCompletedPage", F.when(c("type") == "completed", c("processedPages")))
    return e.select("jobId", "seq", "type", page.cast("int").alias("page"), "code")


# -- lookups by key and levels of documents ---------------------------------------


@query("SELECT id, matter_id, value_type, fingerprint, public_token FROM v_values WHERE id IN (SELECT protected_value_id FROM v_links) OR fingerprint IN (SELECT fingerprint FROM v_mentions WHERE mention_type = 'PHONE')")
def keyed_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Values that links name, and those with the fingerprint of a phone mention, by the index of a store."""
    store = Store(spark, f"{shared_folder(spark)}/lookup-{uuid.uuid4().hex}")
    v = view(spark, d, "v_values").withColumns({"value_cipher": F.unhex("fingerprint"), "fingerprint": F.unhex("fingerprint"), "restore_policy": F.lit("ALWAYS_RESTORE"), "created_at": F.lit(1)})
    store.commit({"protected_values": v.select(*TABLES["protected_values"].names)})
    by_id = store.lookup("protected_values", "id", view(spark, d, "v_links").select(F.col("protected_value_id").alias("key")))
    phones = view(spark, d, "v_mentions").filter("mention_type = 'PHONE'").select(F.col("fingerprint").alias("key"))
    found = by_id.union(store.lookup("protected_values", "fingerprint", phones)).dropDuplicates(["id"])
    return found.select("id", "matter_id", "value_type", F.lower(F.hex("fingerprint")).alias("fingerprint"), "public_token")


@query(
    """SELECT matter_id, document_id, CAST(max(l) AS INTEGER) AS level FROM (
  WITH RECURSIVE k AS (SELECT DISTINCT m.matter_id, m.document_id, d.created_at, concat(m.value_type, ':', m.fingerprint) AS key FROM v_mentions m JOIN v_documents d ON d.id = m.document_id WHERE m.fingerprint IS NOT NULL AND m.mention_type IN ('PHONE', 'EMAIL', 'ID_CARD')),
  e AS (SELECT DISTINCT a.matter_id, a.document_id AS older, b.document_id AS younger FROM k a JOIN k b ON a.matter_id = b.matter_id AND a.key = b.key AND (a.created_at, a.document_id) < (b.created_at, b.document_id)),
  r AS (SELECT DISTINCT matter_id, document_id, 1 AS l FROM k UNION SELECT e.matter_id, e.younger, r.l + 1 FROM r JOIN e ON e.older = r.document_id AND e.matter_id = r.matter_id)
  SELECT * FROM r) q GROUP BY matter_id, document_id"""
)
def resolve_levels(spark: SparkSession, d: str) -> DataFrame:
    docs = view(spark, d, "v_documents").select(F.col("id").alias("document_id"), "created_at")
    m = view(spark, d, "v_mentions").filter("fingerprint is not null and mention_type in ('PHONE', 'EMAIL', 'ID_CARD')").join(docs.withColumnRenamed("created_at", "_at"), "document_id")
    return levels(m.select("matter_id", "document_id", F.col("_at").alias("created_at"), F.concat_ws(":", "value_type", "fingerprint").alias("key")))
