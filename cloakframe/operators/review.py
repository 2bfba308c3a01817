"""Read models for reviewing: reading order, decisions, margins, latest jobs, blockers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.operators.sanitize import blocker, mention_context


def in_reading_order(mentions: DataFrame, pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Mentions with page_no and reading_order."""
    p = pages.select(F.col("id").alias("page_id"), "page_no")
    b = blocks.select(F.col("id").alias("block_id"), "reading_order")
    return mentions.join(p, "page_id").join(b, "block_id")


def blocks_with_pages(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    return blocks.join(pages.select(F.col("id").alias("page_id"), "page_no"), "page_id")


READING = ("page_no", "reading_order", "start_offset", "id")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row of each key in an order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def latest_jobs(jobs: DataFrame) -> DataFrame:
    return latest(jobs, ["document_id", "job_type"], F.desc("created_at"), F.desc("id"))


def latest_completed(jobs: DataFrame) -> DataFrame:
    return latest(jobs.filter("status = 'COMPLETED'"), ["document_id", "job_type"], F.desc("finished_at"), F.desc("created_at"), F.desc("id"))


def retryable(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Failed documents with the kind of their latest job, where that is what failed: only it may be tried again."""
    last = latest(jobs, ["document_id"], F.desc("created_at"), F.desc("id")).filter("status = 'FAILED'")
    return documents.filter("parse_status = 'FAILED'").join(last.select(F.col("document_id").alias("id"), "job_type"), "id")


def latest_actors(events: DataFrame) -> DataFrame:
    """Actor of each mention's last assignment."""
    e = events.filter(F.col("event_type").isin("MENTION_ASSIGNED", "MENTION_REASSIGNED"))
    return e.groupBy("mention_id").agg(F.max_by("actor", F.struct("created_at", "id")).alias("actor"))


def candidate_lists(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """(mention_id, candidates): each with its evidence, both in order."""
    ev = evidence.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("id", "evidence_type", "weight", "score"))).alias("evidence"))
    c = candidates.join(ev, candidates["id"] == ev["candidate_id"], "left")
    one = F.struct((-F.col("score")).alias("order"), "id", "candidate_entity_id", "score", "state", "evidence")
    return c.groupBy("mention_id").agg(F.array_sort(F.collect_list(one)).alias("candidates"))


def display_margin(candidates: DataFrame) -> DataFrame:
    """(mention_id, margin) between the two best candidates; null below two."""
    w = Window.partitionBy("mention_id").orderBy(F.desc("score"), "id")
    top = candidates.withColumn("_r", F.row_number().over(w)).filter("_r <= 2")
    s = top.groupBy("mention_id").agg(F.max(F.when(F.col("_r") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("_r") == 2, F.col("score"))).alias("b"))
    return s.select("mention_id", (F.col("a") - F.col("b")).alias("margin"))


def decision_status(mentions: DataFrame, candidates: DataFrame, events: DataFrame) -> DataFrame:
    """Mentions with decision_status and has_pending."""
    pending = candidates.filter("state = 'PENDING'").select(F.col("mention_id").alias("id")).distinct().withColumn("has_pending", F.lit(True))
    actors = latest_actors(events).withColumnRenamed("mention_id", "id")
    m = mentions.join(pending, "id", "left").join(actors, "id", "left").withColumn("has_pending", F.coalesce("has_pending", F.lit(False)))
    status = F.when(F.col("has_pending"), "NEEDS_REVIEW").when(F.col("entity_id").isNull(), "UNRESOLVED").when(F.col("actor") == "USER", "USER_ASSIGNED").otherwise("AUTO_LINKED")
    return m.withColumn("decision_status", status).drop("actor")


def counts(reviewed: DataFrame, entities: DataFrame) -> DataFrame:
    """(document_id, mentions, resolved, needs_review, unresolved); the last three may overlap or leave some out."""
    active = entities.filter("status = 'ACTIVE'").select(F.col("id").alias("entity_id"), F.lit(True).alias("_a"))
    m = reviewed.join(active, "entity_id", "left")
    return m.groupBy("document_id").agg(
        F.count("*").alias("mentions"),
        F.count_if(F.coalesce("_a", F.lit(False))).alias("resolved"),
        F.count_if(F.col("decision_status") == "NEEDS_REVIEW").alias("needs_review"),
        F.count_if(F.col("decision_status") == "UNRESOLVED").alias("unresolved"),
    )


def readiness(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, values: DataFrame) -> DataFrame:
    """(document_id, mention_id, reason) of mentions that block sanitizing."""
    return mention_context(mentions, entities, aliases, values).select("document_id", F.col("id").alias("mention_id"), blocker().alias("reason")).filter("reason is not null")


def preview_status(documents: DataFrame) -> DataFrame:
    s = F.when(F.col("parse_status") == "SANITIZED", "AVAILABLE").when(F.col("parse_status").isin("READY", "FAILED"), "READY").otherwise("NOT_READY")
    return documents.withColumn("preview", s)


def assign(mentions: DataFrame, decisions: DataFrame, entities: DataFrame) -> DataFrame:
    """What a batch of user decisions (mention_id, target_id) does to each mention, or why it may not.

    (id, old_entity_id, entity_id, event_type, error)
    """
    d = decisions.select(F.col("mention_id").alias("id"), "target_id")
    e = entities.select(F.col("id").alias("target_id"), F.col("matter_id").alias("_matter"), F.col("status").alias("_status"))
    m = mentions.join(d, "id").join(e, "target_id", "left")
    error = F.when(F.col("_status").isNull(), "UNKNOWN_ENTITY").when(F.col("_status") != "ACTIVE", "INACTIVE_ENTITY").when(F.col("_matter") != F.col("matter_id"), "OTHER_MATTER").when(F.col("entity_id") == F.col("target_id"), "NO_CHANGE")
    m = m.withColumn("error", error)
    ok = F.col("error").isNull()
    event = F.when(ok, F.when(F.col("entity_id").isNull(), "MENTION_ASSIGNED").otherwise("MENTION_REASSIGNED"))
    return m.select("id", F.col("entity_id").alias("old_entity_id"), F.when(ok, F.col("target_id")).otherwise(F.col("entity_id")).alias("entity_id"), event.alias("event_type"), "error")


def close_candidates(candidates: DataFrame, assigned: DataFrame, as_of_ms: Column) -> DataFrame:
    """Pending candidates of assigned mentions: the chosen one accepted, the others rejected."""
    a = assigned.filter("error is null").select(F.col("id").alias("mention_id"), F.col("entity_id").alias("_chosen"))
    c = candidates.join(a, "mention_id", "left")
    touched = F.col("_chosen").isNotNull() & (F.col("state") == "PENDING")
    state = F.when(touched, F.when(F.col("candidate_entity_id") == F.col("_chosen"), "ACCEPTED").otherwise("REJECTED")).otherwise(F.col("state"))
    return c.withColumn("resolved_at", F.when(touched, as_of_ms).otherwise(F.col("resolved_at"))).withColumn("state", state).drop("_chosen")


def progress(units: DataFrame, key: str, done: Column) -> DataFrame:
    """(key, progress, checkpoint): share of units done, and "done/all"."""
    g = units.groupBy(key).agg(F.count_if(done).alias("_d"), F.count("*").alias("_n"))
    return g.select(key, (F.col("_d") / F.col("_n")).alias("progress"), F.concat_ws("/", "_d", "_n").alias("checkpoint"))
