"""Schemas of the 18 tables, their keys, and the enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

# Enumerations of the data model.
PARSE_STATUS = ("IMPORTED", "PARSING", "PARSED", "DETECTING", "DETECTED", "RESOLVING", "READY", "SANITIZING", "SANITIZED", "FAILED")
SOURCE_TYPE = ("NATIVE", "RASTER", "MIXED")
BLOCK_TYPE = ("TEXT", "TABLE", "IMAGE")
BLOCK_SOURCE = ("NATIVE", "OCR")
MENTION_TYPE = ("PERSON", "ORGANIZATION", "PHONE", "EMAIL", "ID_CARD", "BANK_ACCOUNT", "ADDRESS", "CASE_NUMBER", "CONTRACT_NUMBER", "COURT", "LAWYER", "JUDGE")
MENTION_STRENGTH = ("EXPLICIT", "PARTIAL", "REFERENCE")
DETECTOR = ("REGEX", "NER", "DICTIONARY", "USER", "FUSION")
REVIEW_STATUS = ("UNREVIEWED", "CONFIRMED", "REJECTED")
ENTITY_TYPE = ("PERSON", "ORGANIZATION")
ENTITY_STATUS = ("ACTIVE", "MERGED", "DELETED")
ALIAS_TYPE = ("PRIMARY", "GENERIC", "ROLE")
VALUE_TYPE = ("PERSON_NAME", "ORG_NAME", "PHONE", "EMAIL", "ID_CARD", "BANK_ACCOUNT", "ADDRESS")
RESTORE_POLICY = ("ALWAYS_RESTORE", "RESTORE_ON_REQUEST", "NEVER_RESTORE")
CANDIDATE_STATE = ("PENDING", "ACCEPTED", "REJECTED")
CONSTRAINT_TYPE = ("MUST_LINK", "CANNOT_LINK")
ACTOR = ("SYSTEM", "USER")
EVENT_TYPE = ("ENTITY_CREATED", "MENTION_ASSIGNED", "MENTION_REASSIGNED", "ENTITY_MERGED", "ENTITY_SPLIT", "CONSTRAINT_CREATED", "CONSTRAINT_REMOVED")
JOB_TYPE = ("PARSE", "OCR", "DETECT", "RESOLVE", "SANITIZE", "VERIFY")
JOB_STATUS = ("PENDING", "RUNNING", "COMPLETED", "FAILED", "CANCELLED")
MATTER_STATUS = ("ACTIVE", "ARCHIVED", "DELETED")
ALGORITHM_VERSION = "er-v1"

_KINDS = {"s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType(), "b": T.BooleanType(), "x": T.BinaryType()}


def _table(columns: str) -> T.StructType:
    """``name:kind`` words; a question mark makes a column nullable."""
    fields = []
    for word in columns.split():
        name, kind = word.split(":")
        fields.append(T.StructField(name, _KINDS[kind[0]], kind.endswith("?")))
    return T.StructType(fields)


TABLES: dict[str, T.StructType] = {
    "matters": _table("id:s name_cipher:x status:s created_at:l updated_at:l"),
    "documents": _table("id:s matter_id:s original_name_cipher:x source_path_cipher:x? file_hash:s mime_type:s parser_type:s? page_count:i? parse_status:s created_at:l updated_at:l"),
    "document_pages": _table("id:s document_id:s page_no:i original_width:d original_height:d rotation:i source_type:s created_at:l"),
    "document_blocks": _table("id:s document_id:s page_id:s block_type:s text_cipher:x source:s confidence:d? x:d y:d width:d height:d reading_order:i created_at:l"),
    "entities": _table("id:s matter_id:s entity_type:s public_token:s status:s merged_into_entity_id:s? resolution_confidence:d? created_at:l updated_at:l"),
    "protected_values": _table("id:s matter_id:s value_type:s value_cipher:x fingerprint:x public_token:s? restore_policy:s created_at:l"),
    "mentions": _table(
        "id:s matter_id:s document_id:s page_id:s block_id:s entity_id:s? protected_value_id:s? mention_type:s mention_strength:s text_cipher:x fingerprint:x? start_offset:i end_offset:i x:d? y:d? width:d? height:d? detector:s confidence:d review_status:s created_at:l"
    ),
    "entity_aliases": _table("id:s matter_id:s entity_id:s alias:s alias_type:s role:s? is_primary:b created_at:l"),
    "entity_protected_values": _table("entity_id:s protected_value_id:s relationship_type:s confidence:d is_primary:b created_at:l"),
    "entity_relationships": _table("id:s matter_id:s source_entity_id:s relation_type:s target_entity_id:s confidence:d source_document_id:s? source_mention_id:s? created_at:l"),
    "resolution_candidates": _table("id:s mention_id:s candidate_entity_id:s score:d state:s algorithm_version:s created_at:l resolved_at:l?"),
    "resolution_evidence": _table("id:s candidate_id:s evidence_type:s weight:d score:d details_cipher:x? created_at:l"),
    "entity_constraints": _table("id:s matter_id:s entity_a_id:s entity_b_id:s constraint_type:s reason:s source:s created_at:l"),
    "resolution_events": _table("id:s matter_id:s event_type:s entity_id:s? mention_id:s? actor:s payload_cipher:x created_at:l"),
    "processing_jobs": _table("id:s document_id:s job_type:s status:s progress:d checkpoint:s? error_cipher:x? created_at:l started_at:l? finished_at:l?"),
    "sanitized_documents": _table("id:s matter_id:s document_id:s job_id:s created_at:l"),
    "sanitized_blocks": _table("id:s sanitized_document_id:s document_id:s page_id:s block_id:s text_cipher:x created_at:l"),
    "sanitization_mappings": _table("id:s matter_id:s sanitized_document_id:s mention_id:s entity_id:s public_token:s alias:s restore_policy:s created_at:l"),
}

#: Column sets that are unique in a table; rows with a null in them do not count.
UNIQUE: dict[str, list[tuple[str, ...]]] = {
    "documents": [("id",), ("matter_id", "file_hash")],
    "document_pages": [("id",), ("document_id", "page_no")],
    "entities": [("id",), ("matter_id", "public_token")],
    "protected_values": [("id",), ("matter_id", "value_type", "fingerprint"), ("matter_id", "public_token")],
    "entity_aliases": [("id",), ("matter_id", "alias")],
    "entity_protected_values": [("entity_id", "protected_value_id")],
    "resolution_candidates": [("id",), ("mention_id", "candidate_entity_id")],
    "entity_constraints": [("id",), ("matter_id", "entity_a_id", "entity_b_id", "constraint_type")],
    "sanitized_documents": [("id",), ("document_id",)],
    "sanitized_blocks": [("id",), ("sanitized_document_id", "block_id")],
    "sanitization_mappings": [("id",), ("sanitized_document_id", "mention_id")],
    **{t: [("id",)] for t in ("matters", "document_blocks", "mentions", "entity_relationships", "resolution_evidence", "resolution_events", "processing_jobs")},
}

#: Columns that never change once a row is there, and those that may be filled once.
IMMUTABLE: dict[str, tuple[str, ...]] = {
    "documents": ("matter_id",),
    "document_pages": ("document_id",),
    "document_blocks": ("document_id", "page_id"),
    "entities": ("matter_id", "public_token"),
    "protected_values": ("matter_id",),
    "mentions": ("matter_id", "document_id", "page_id", "block_id", "start_offset", "end_offset"),
}
ONCE_SET: dict[str, tuple[str, ...]] = {"protected_values": ("public_token",)}
#: Tables whose rows are never changed or removed.
APPEND_ONLY = ("resolution_events", "sanitized_documents", "sanitized_blocks", "sanitization_mappings")
#: For each table: (column, parent, {column: the parent's column that must be equal}); a null column names nothing.
REFERENCES: dict[str, list[tuple[str, str, dict[str, str]]]] = {
    "documents": [("matter_id", "matters", {})],
    "document_pages": [("document_id", "documents", {})],
    "document_blocks": [("page_id", "document_pages", {"document_id": "document_id"})],
    "mentions": [
        ("document_id", "documents", {"matter_id": "matter_id"}),
        ("page_id", "document_pages", {"document_id": "document_id"}),
        ("block_id", "document_blocks", {"document_id": "document_id", "page_id": "page_id"}),
        ("entity_id", "entities", {"matter_id": "matter_id"}),
        ("protected_value_id", "protected_values", {"matter_id": "matter_id"}),
    ],
    "entity_aliases": [("entity_id", "entities", {"matter_id": "matter_id"})],
    "entity_protected_values": [("entity_id", "entities", {}), ("protected_value_id", "protected_values", {})],
    "entity_relationships": [
        ("source_entity_id", "entities", {"matter_id": "matter_id"}),
        ("target_entity_id", "entities", {"matter_id": "matter_id"}),
        ("source_document_id", "documents", {"matter_id": "matter_id"}),
        ("source_mention_id", "mentions", {"matter_id": "matter_id"}),
    ],
    "resolution_candidates": [("mention_id", "mentions", {}), ("candidate_entity_id", "entities", {})],
    "resolution_evidence": [("candidate_id", "resolution_candidates", {})],
    "entity_constraints": [("entity_a_id", "entities", {"matter_id": "matter_id"}), ("entity_b_id", "entities", {"matter_id": "matter_id"})],
    "resolution_events": [("entity_id", "entities", {"matter_id": "matter_id"}), ("mention_id", "mentions", {"matter_id": "matter_id"})],
    "processing_jobs": [("document_id", "documents", {})],
    "sanitized_documents": [("document_id", "documents", {"matter_id": "matter_id"}), ("job_id", "processing_jobs", {"document_id": "document_id"})],
    "sanitized_blocks": [("block_id", "document_blocks", {"document_id": "document_id", "page_id": "page_id"}), ("sanitized_document_id", "sanitized_documents", {"document_id": "document_id"})],
    "sanitization_mappings": [("mention_id", "mentions", {"matter_id": "matter_id"}), ("entity_id", "entities", {"matter_id": "matter_id"}), ("sanitized_document_id", "sanitized_documents", {"matter_id": "matter_id"})],
}
