"""Integrity rules as queries: each returns (table, id, rule) rows of what breaks it.

Parquet has no keys, triggers or checks; a stage runs these before its result is taken
over, and an empty result is the proof.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe import schemas as S
from cloakframe.functions.pseudonyms import STORED_TOKEN_FORM
from cloakframe.sources.store import settled


def _as(df: DataFrame, table: str, rule: str, key: Column | None = None) -> DataFrame:
    if key is None:
        key = F.col("id") if "id" in df.columns else F.concat_ws("|", *df.columns[:2])
    return df.select(F.lit(table).alias("table"), key.cast("string").alias("id"), F.lit(rule).alias("rule"))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def missing_reference(child: DataFrame, column: str, parent: DataFrame, table: str, scope: dict[str, str] | None = None, key: str = "id") -> DataFrame:
    """Rows of ``child`` whose ``column`` names no row of ``parent``, or one in another scope.

    ``scope``: column of the child -> column of the parent that must be equal.
    """
    scope = scope or {}
    p = parent.select(F.col(key).alias("_k"), *[F.col(v).alias(f"_{v}") for v in scope.values()])
    on = child[column] == p["_k"]
    for c, v in scope.items():
        on = on & child[c].eqNullSafe(p[f"_{v}"])
    return _as(child.filter(F.col(column).isNotNull()).join(p, on, "left_anti"), table, f"{column} out of scope")


def changed(old: DataFrame, new: DataFrame, columns: list[str], table: str, once_set: bool = False) -> DataFrame:
    """Rows whose immutable columns differ between two versions; ``once_set`` lets a null be filled."""
    o = old.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in columns])
    j = new.join(o, new["id"] == o["_id"])
    parts = []
    for c in columns:
        differs = ~F.col(c).eqNullSafe(F.col(f"_{c}"))
        parts.append(_as(j.filter(differs & F.col(f"_{c}").isNotNull() if once_set else differs), table, f"{c} changed"))
    return union(parts)


def lost(old: DataFrame, new: DataFrame, table: str) -> DataFrame:
    """Rows of an append-only table that a new version lacks."""
    return _as(old.join(new.select("id"), "id", "left_anti"), table, "row lost")


def changed_columns(old: DataFrame, new: DataFrame, columns: tuple[str, ...], table: str, once_set: bool = False) -> DataFrame:
    """``changed`` in one join: a row for each column that differs."""
    o = old.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in columns])
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}")) & (F.col(f"_{c}").isNotNull() if once_set else F.lit(True))
    rules = F.array(*[F.when(differs(c), F.lit(f"{c} changed")) for c in columns])
    hit = new.join(o, new["id"] == o["_id"]).select("id", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("rule"))
    return hit.select(F.lit(table).alias("table"), F.col("id").cast("string").alias("id"), "rule")


def repeated(df: DataFrame, columns: tuple[str, ...], table: str) -> DataFrame:
    """Keys that more than one row has; a null in a key does not count."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull())
    g = df.groupBy(*columns).agg(F.count("*").alias("_n")).filter("_n > 1")
    return _as(g, table, "repeated " + ",".join(columns), F.concat_ws("|", *columns))


def uniqueness(tables: dict[str, DataFrame]) -> DataFrame:
    """Repeated keys of tables, all counted in one aggregation."""
    parts = []
    for t, df in tables.items():
        for keys in S.UNIQUE.get(t, []):
            whole = df.dropna(subset=list(keys))
            parts.append(_as(whole, t, "repeated " + ",".join(keys), F.concat_ws("|", *keys)))
    return union(parts).groupBy("table", "id", "rule").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")


def merge_redirects(entities: DataFrame) -> DataFrame:
    """Merged entities that do not lead to another active one of their matter, and others that lead anywhere."""
    merged = entities.filter("status = 'MERGED'")
    target = entities.filter("status = 'ACTIVE'").select(F.col("id").alias("_t"), F.col("matter_id").alias("_m"))
    on = (merged["merged_into_entity_id"] == target["_t"]) & (merged["matter_id"] == target["_m"])
    return union(
        [
            _as(merged.filter("merged_into_entity_id is not null").join(target, on, "left_anti"), "entities", "redirect target"),
            _as(entities.filter("(status = 'MERGED') <> (merged_into_entity_id is not null) or merged_into_entity_id = id"), "entities", "merge state"),
        ]
    )


def redirect_cycles(entities: DataFrame, rounds: int = 64) -> DataFrame:
    """Entities whose redirects lead into a circle.

    Pointers double their reach each round, so chains of any length end after
    logarithmically many joins; what still has a pointer after ``rounds`` doublings, or
    when their number no longer changes, goes around.
    """
    p = entities.filter("merged_into_entity_id is not null").select("id", F.col("merged_into_entity_id").alias("next"))
    step, before = p, -1
    for _ in range(rounds):
        after = step.count()
        if after in (0, before):
            break
        before = after
        far = step.select(F.col("id").alias("next"), F.col("next").alias("_far"))
        step = settled(step.join(far, "next").select("id", F.col("_far").alias("next")))
    return _as(step, "entities", "redirect circle")


def token_forms(values: DataFrame) -> DataFrame:
    return _as(values.filter(F.col("public_token").isNotNull() & ~F.col("public_token").rlike(STORED_TOKEN_FORM)), "protected_values", "token form")


def _box(w: str = "width", h: str = "height") -> Column:
    return F.expr(f"x >= 0 and y >= 0 and {w} >= 0 and {h} >= 0 and x <= 1 and y <= 1 and {w} <= 1 and {h} <= 1 and x + {w} <= 1 and y + {h} <= 1")


#: Rules of single rows: a row breaks one where it is not true.
def checks() -> dict[str, dict[str, Column]]:
    c = F.col
    life = (
        "(status = 'PENDING' and progress = 0 and started_at is null and finished_at is null and error_cipher is null)"
        " or (status = 'RUNNING' and started_at is not null and finished_at is null and error_cipher is null)"
        " or (status = 'COMPLETED' and progress = 1 and started_at is not null and finished_at is not null and error_cipher is null)"
        " or (status = 'FAILED' and started_at is not null and finished_at is not null and error_cipher is not null)"
        " or (status = 'CANCELLED' and started_at is not null and finished_at is not null)"
    )
    confidence = (c("confidence") >= 0) & (c("confidence") <= 1) & ~F.isnan("confidence")
    times = c("updated_at") >= c("created_at")
    said = lambda x: F.length(F.trim(x)) > 0
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    return {
        "matters": {"status": c("status").isin(*S.MATTER_STATUS), "times": times},
        "protected_values": {"type": c("value_type").isin(*S.VALUE_TYPE), "policy": c("restore_policy").isin(*S.RESTORE_POLICY), "token": c("public_token").isNull() | said("public_token"), "fingerprint": F.length("fingerprint") > 0},
        "entity_aliases": {"alias": said("alias"), "type": c("alias_type").isin(*S.ALIAS_TYPE)},
        "entity_protected_values": {"type": said("relationship_type"), "confidence": confidence},
        "entity_relationships": {"type": said("relation_type"), "confidence": confidence},
        "resolution_candidates": {"score": finite("score"), "state": c("state").isin(*S.CANDIDATE_STATE)},
        "resolution_evidence": {"type": said("evidence_type"), "weight": finite("weight"), "score": finite("score")},
        "resolution_events": {"type": c("event_type").isin(*S.EVENT_TYPE), "actor": c("actor").isin(*S.ACTOR)},
        "sanitized_documents": {"created": c("created_at") >= 0},
        "sanitized_blocks": {"created": c("created_at") >= 0, "text": F.length("text_cipher") > 0},
        "documents": {"page count": c("page_count").isNull() | (c("page_count") >= 1), "parse status": c("parse_status").isin(*S.PARSE_STATUS), "times": times},
        "document_pages": {"page number": c("page_no") >= 1, "size": (c("original_width") > 0) & (c("original_height") > 0), "source type": c("source_type").isin(*S.SOURCE_TYPE)},
        "document_blocks": {"box": _box(), "confidence": c("confidence").isNull() | confidence, "reading order": c("reading_order") >= 0},
        "mentions": {
            "offsets": (c("start_offset") >= 0) & (c("end_offset") > c("start_offset")),
            "confidence": confidence,
            "type": c("mention_type").isin(*S.MENTION_TYPE),
            "box": F.expr("x is null and y is null and width is null and height is null") | F.coalesce(_box(), F.lit(False)),
        },
        "entities": {"type": c("entity_type").isin(*S.ENTITY_TYPE), "status": c("status").isin(*S.ENTITY_STATUS), "times": times, "confidence": c("resolution_confidence").isNull() | ((c("resolution_confidence") >= 0) & (c("resolution_confidence") <= 1))},
        "entity_constraints": {"one entity twice": c("entity_a_id") != c("entity_b_id"), "pair order": c("entity_a_id") < c("entity_b_id")},
        "processing_jobs": {
            "progress": (c("progress") >= 0) & (c("progress") <= 1),
            "type": c("job_type").isin(*S.JOB_TYPE),
            "status": c("status").isin(*S.JOB_STATUS),
            "times": F.expr("started_at is null or (started_at >= created_at and (finished_at is null or finished_at >= started_at))"),
            "life cycle": F.expr(life),
        },
        "sanitization_mappings": {"policy": c("restore_policy").isin(*S.RESTORE_POLICY), "token": said("public_token"), "alias": said("alias")},
    }


def check_rows(df: DataFrame, table: str) -> DataFrame:
    """Rows that break rules of single rows, in one scan: each broken rule is a row, and good rows go before any list is made."""
    breaks = {name: ~F.coalesce(ok, F.lit(False)) for name, ok in checks()[table].items()}
    rules = F.array(*[F.when(b, F.lit(name)) for name, b in breaks.items()])
    key = F.col("id") if "id" in df.columns else F.concat_ws("|", *df.columns[:2])
    broken = df.filter(reduce(Column.__or__, breaks.values())).select(key.cast("string").alias("id"), F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("rule"))
    return broken.select(F.lit(table).alias("table"), "id", "rule")


def page_sequence(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents whose pages are not exactly 1 to page_count."""
    g = pages.groupBy("document_id").agg(F.count("*").alias("_n"), F.count_distinct("page_no").alias("_d"), F.min("page_no").alias("_lo"), F.max("page_no").alias("_hi"))
    j = documents.join(g, documents["id"] == g["document_id"], "left")
    good = (F.coalesce("_n", F.lit(0)) == F.coalesce("page_count", F.lit(0))) & (F.col("_n").isNull() | ((F.col("_d") == F.col("_n")) & (F.col("_lo") == 1) & (F.col("_hi") == F.col("_n"))))
    return _as(j.filter(~good), "documents", "page sequence", documents["id"])


def event_bijection(changes: DataFrame, events: DataFrame) -> DataFrame:
    """Mention changes (mention_id, event_type) without exactly one event of their kind, and events without a change."""
    keys = ["mention_id", "event_type"]
    a, b = changes.groupBy(*keys).agg(F.count("*").alias("_c")), events.groupBy(*keys).agg(F.count("*").alias("_e"))
    j = a.join(b, keys, "full").filter(~(F.col("_c").eqNullSafe(1) & F.col("_e").eqNullSafe(1)))
    return _as(j, "mentions", "events", F.concat_ws("|", *keys))


def artifact_scope(documents: DataFrame, blocks: DataFrame, maps: DataFrame, source: dict[str, DataFrame]) -> DataFrame:
    """Sanitized artifacts outside their scope.

    A document must be of its matter and of a SANITIZE job for it; a block one of its
    sanitized document's blocks, on its page; a mapping's mention and entity of its matter,
    and the mention one of its sanitized document's.  ``source``: documents,
    processing_jobs, document_blocks, mentions, entities.
    """
    jobs = source["processing_jobs"].filter("job_type = 'SANITIZE'")
    of = {"document_id": "document_id"}
    return union(
        [
            missing_reference(documents, "document_id", source["documents"], "sanitized_documents", {"matter_id": "matter_id"}),
            missing_reference(documents, "job_id", jobs, "sanitized_documents", of),
            missing_reference(blocks, "block_id", source["document_blocks"], "sanitized_blocks", of | {"page_id": "page_id"}),
            missing_reference(blocks, "sanitized_document_id", documents, "sanitized_blocks", of),
            missing_reference(maps, "mention_id", source["mentions"], "sanitization_mappings", {"matter_id": "matter_id"}),
            missing_reference(maps, "entity_id", source["entities"], "sanitization_mappings", {"matter_id": "matter_id"}),
            foreign_mappings(maps, source["mentions"], documents),
        ]
    )


def foreign_mappings(maps: DataFrame, mentions: DataFrame, documents: DataFrame) -> DataFrame:
    """Mappings whose mention is one of another document than their sanitized document's."""
    here = maps.join(mentions.select(F.col("id").alias("mention_id"), F.col("document_id").alias("document_id")), "mention_id")
    return missing_reference(here, "sanitized_document_id", documents, "sanitization_mappings", {"document_id": "document_id"})


def commit_violations(old: Callable[[str], DataFrame], new: Callable[[str], DataFrame], added: dict[str, DataFrame], replaced: set[str]) -> DataFrame | None:
    """What a commit would break: (table, id, rule).

    ``old`` and ``new`` read a table before and after, ``added`` are the rows that the
    commit writes, ``replaced`` the tables that it writes anew.
    """
    if out := [t for t in S.APPEND_ONLY if t in replaced]:
        raise ValueError(f"{out[0]} is append-only")
    parts = []
    known = checks()
    for t, df in added.items():
        if t in known:
            parts.append(check_rows(df, t))
        for column, parent, scope in S.REFERENCES.get(t, []):
            parts.append(missing_reference(df, column, new(parent), t, scope))
    if added:
        parts.append(uniqueness({t: new(t) for t in added}))
    for t in replaced:
        if t in S.IMMUTABLE:
            parts.append(changed_columns(old(t), new(t), S.IMMUTABLE[t], t))
        if t in S.ONCE_SET:
            parts.append(changed_columns(old(t), new(t), S.ONCE_SET[t], t, once_set=True))
        if "id" in S.TABLES[t].names:
            parts.append(lost(old(t), new(t), t))
    if "entities" in added:
        parts += [merge_redirects(new("entities"))]
        if "entities" in replaced:
            parts.append(redirect_cycles(new("entities")))
    if "protected_values" in added:
        parts.append(token_forms(added["protected_values"]))
    if "entity_protected_values" in added:
        matter = lambda t, c: new(t).select(F.col("id").alias(c), F.col("matter_id").alias(f"_{c}"))
        both = added["entity_protected_values"].join(matter("entities", "entity_id"), "entity_id").join(matter("protected_values", "protected_value_id"), "protected_value_id")
        parts.append(_as(both.filter("_entity_id <> _protected_value_id"), "entity_protected_values", "two matters", F.concat_ws("|", "entity_id", "protected_value_id")))
    if "sanitized_documents" in added:
        jobs = new("processing_jobs").filter("job_type = 'SANITIZE'")
        parts.append(missing_reference(added["sanitized_documents"], "job_id", jobs, "sanitized_documents", {"document_id": "document_id"}))
    if "sanitization_mappings" in added:
        parts.append(foreign_mappings(added["sanitization_mappings"], new("mentions"), new("sanitized_documents")))
    if "mentions" in replaced:
        was = old("mentions").select("id", F.col("entity_id").alias("_was"))
        moved = new("mentions").join(was, "id").filter("entity_id is not null and not (entity_id <=> _was)")
        moved = moved.select(F.col("id").alias("mention_id"), F.when(F.col("_was").isNull(), "MENTION_ASSIGNED").otherwise("MENTION_REASSIGNED").alias("event_type"))
        told = added["resolution_events"] if "resolution_events" in added else new("resolution_events").limit(0)
        parts.append(event_bijection(moved, told.filter(F.col("event_type").isin("MENTION_ASSIGNED", "MENTION_REASSIGNED"))))
    return union(parts) if parts else None


def merge_entity(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """Entities after merges (source_id, target_id, at): the source redirects, where both are active, distinct, in one matter and time does not go back."""
    m = merges.select(F.col("source_id").alias("id"), "target_id", "at")
    t = entities.select(F.col("id").alias("target_id"), F.col("status").alias("_ts"), F.col("matter_id").alias("_tm"))
    j = entities.join(m, "id", "left").join(t, "target_id", "left")
    ok = F.coalesce((F.col("status") == "ACTIVE") & (F.col("_ts") == "ACTIVE") & (F.col("_tm") == F.col("matter_id")) & (F.col("at") >= F.col("updated_at")) & (F.col("id") != F.col("target_id")), F.lit(False))
    return j.select(
        *[
            F.when(ok, {"status": F.lit("MERGED"), "merged_into_entity_id": F.col("target_id"), "updated_at": F.col("at")}[x]).otherwise(F.col(x)).alias(x) if x in ("status", "merged_into_entity_id", "updated_at") else F.col(x)
            for x in entities.columns
        ]
    )
