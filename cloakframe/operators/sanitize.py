"""Pseudonymized text, its checks, and what may be restored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.functions import spans
from cloakframe.functions.normalize import value_type
from cloakframe.functions.pseudonyms import REFERENCE, default_policy, leaks, pseudonym, replacements, token_references, unresolved_tokens
from cloakframe.operators.resolve import primary_aliases

#: What makes a block fail, first reason first.
REASONS = ("UNSUPPORTED_MENTION_TYPE", "UNRESOLVED_MENTION", "INVALID_REPLACEMENT", "LEAK_DETECTED")


def mention_context(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, values: DataFrame) -> DataFrame:
    """Mentions with their entity's status, primary alias and their value's token, all by left joins.

    Most mentions may have no entity; their own id deals those to all tasks, where a null would bring them to one.
    """
    c = F.col
    spread = lambda k: F.coalesce(c(k), F.concat(F.lit("\0"), c("id")))
    m = mentions.withColumns({"_e": spread("entity_id"), "_v": spread("protected_value_id")})
    e = entities.select(c("id").alias("_ee"), c("status").alias("entity_status"))
    a = primary_aliases(aliases).withColumnRenamed("entity_id", "_ae")
    v = values.select(c("id").alias("_vv"), c("public_token").alias("value_token"))
    m = m.join(e, (c("_e") == c("_ee")) & c("entity_id").isNotNull(), "left").join(a, (c("_e") == c("_ae")) & c("entity_id").isNotNull(), "left")
    return m.join(v, (c("_v") == c("_vv")) & c("protected_value_id").isNotNull(), "left").drop("_e", "_ee", "_ae", "_v", "_vv")


def mention_problem() -> Column:
    """Why a mention of ``mention_context`` stops its document, if it does."""
    usable = (F.col("entity_status") == "ACTIVE") & F.col("alias").isNotNull() & F.col("value_token").isNotNull()
    return F.when(value_type(F.col("mention_type")).isNull(), REASONS[0]).when(~F.coalesce(usable, F.lit(False)), REASONS[1])


def blocker() -> Column:
    """The same for the preview, in more detail."""
    return (
        F.when(value_type(F.col("mention_type")).isNull(), "UNSUPPORTED_TYPE")
        .when(F.col("entity_id").isNull(), "UNRESOLVED")
        .when(~F.coalesce(F.col("entity_status") == "ACTIVE", F.lit(False)), "INACTIVE_ENTITY")
        .when(F.col("alias").isNull(), "MISSING_ALIAS")
        .when(F.col("value_token").isNull(), "MISSING_TOKEN")
    )


def sanitize_blocks(blocks: DataFrame, context: DataFrame) -> DataFrame:
    """(document_id, block_id, page_no, reading_order, sanitized, error) for each block.

    ``context``: mention_context with start_cp, end_cp and value.  A block with an error
    has no text.
    """
    c = context.withColumn("_problem", mention_problem())
    hit = F.struct(F.col("start_cp").alias("start"), F.col("end_cp").alias("end"), pseudonym(F.col("alias"), F.col("value_token")).alias("value"))
    order = F.struct("start_cp", "id")
    per = c.groupBy("block_id").agg(
        F.min_by("_problem", F.when(F.col("_problem").isNotNull(), order)).alias("_problem"), F.collect_list(hit).alias("_r"), F.collect_list("value").alias("_values")
    )
    b = blocks.join(per, "block_id", "left")
    r = F.coalesce("_r", F.array().cast("array<struct<start:int,end:int,value:string>>"))
    bad = spans.replacement_errors("text", r) | F.exists(r, lambda x: x["value"].isNull())
    b = b.withColumn("_error", F.when(F.col("_problem").isNotNull(), F.col("_problem")).when(bad, REASONS[2]))
    b = b.withColumn("sanitized", F.when(F.col("_error").isNull(), spans.splice("text", r)))
    b = b.withColumn("error", F.when(F.col("_error").isNotNull(), F.col("_error")).when(leaks(F.col("sanitized"), F.coalesce("_values", F.array().cast("array<string>"))), REASONS[3]))
    return b.select("document_id", "block_id", "page_no", "reading_order", F.when(F.col("error").isNull(), F.col("sanitized")).alias("sanitized"), "error")


def document_errors(sanitized: DataFrame) -> DataFrame:
    """(document_id, error) of documents that fail: the first block's error in reading order."""
    order = F.struct("page_no", "reading_order", "block_id")
    return sanitized.filter("error is not null").groupBy("document_id").agg(F.min_by("error", order).alias("error"))


def complete_documents(sanitized: DataFrame) -> DataFrame:
    """Blocks of documents without any error; a document fails as a whole."""
    return sanitized.join(document_errors(sanitized).select("document_id"), "document_id", "left_anti").drop("error")


def mappings(context: DataFrame) -> DataFrame:
    """Rows of the mapping vault: token, alias and policy of each mention."""
    return context.filter(mention_problem().isNull()).select(
        "document_id", F.col("id").alias("mention_id"), "entity_id", "start_offset", F.col("value_token").alias("public_token"), "alias", default_policy(value_type(F.col("mention_type"))).alias("restore_policy"), "protected_value_id"
    )


def coverage_gaps(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are missing, surplus or repeated: (keys, problem)."""
    e = expected.groupBy(*keys).agg(F.count("*").alias("_e"))
    p = present.groupBy(*keys).agg(F.count("*").alias("_p"))
    both = e.join(p, keys, "full")
    problem = F.when(F.col("_p").isNull(), "MISSING").when(F.col("_e").isNull(), "SURPLUS").when(F.col("_p") > 1, "REPEATED")
    return both.select(*keys, problem.alias("problem")).filter("problem is not null")


def with_source(sanitized: DataFrame, blocks: DataFrame) -> DataFrame:
    """Sanitized blocks with page_no and reading_order of the blocks they come from; 0 where there is none."""
    src = blocks.select("block_id", F.col("page_no").alias("_p"), F.col("reading_order").alias("_r"))
    j = sanitized.join(src, "block_id", "left")
    return j.withColumns({"page_no": F.coalesce("_p", F.lit(0)), "reading_order": F.coalesce("_r", F.lit(0))}).drop("_p", "_r")


def mapping_source(maps: DataFrame, mentions: DataFrame, values: DataFrame) -> DataFrame:
    """Mappings with their mention's place and their value, as restoring needs them."""
    m = mentions.select(F.col("id").alias("mention_id"), "protected_value_id", "start_offset")
    keep = [c for c in ("value_cipher", "value", "fingerprint") if c in values.columns]
    v = values.select(F.col("id").alias("protected_value_id"), *keep)
    return maps.join(m, "mention_id").join(v, "protected_value_id")


def restorable(vault: DataFrame, on_request: bool = False) -> DataFrame:
    """For each document and token the last mapping, of those whose policy allows restoring."""
    allowed = ["ALWAYS_RESTORE", *(["RESTORE_ON_REQUEST"] if on_request else [])]
    w = Window.partitionBy("document_id", "public_token").orderBy(F.desc("start_offset"), F.desc("mention_id"))
    return vault.filter(F.col("restore_policy").isin(*allowed)).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def rehydrate(texts: DataFrame, targets: DataFrame) -> DataFrame:
    """Texts (document_id, text) with tokens restored, and the tokens still in them.

    ``targets``: document_id, token, value, aliases, one row for each token.  Each distinct
    token of a text meets its own target by an equi-join, and only the hits of a text come
    together again, so neither a document's texts nor its vault meet in one task.
    """
    # equal texts of a document have equal results, so they may share a key
    key = {"_x": F.xxhash64("document_id", "text"), "_y": F.xxhash64(F.lit(1), "text", "document_id")}
    keyed = texts.withColumns(key)
    asked = keyed.filter(F.contains("text", F.lit("@"))).select("document_id", "_x", "_y", F.explode(F.array_distinct(token_references(F.col("text")))).alias("token")).distinct()
    hits = asked.join(targets.select("document_id", "token", F.struct("token", "value", "aliases").alias("_t")), ["document_id", "token"])
    hits = hits.groupBy("_x", "_y").agg(F.collect_list("_t").alias("_t"))
    out = keyed.join(hits, ["_x", "_y"], "left")
    found = spans.matches("text", REFERENCE)
    out = out.withColumn("_r", F.when(F.col("_t").isNotNull(), replacements(F.col("text"), found, F.col("_t"))))
    out = out.withColumn("restored", F.when(F.size("_r") > 0, spans.splice("text", F.col("_r"))).otherwise(F.col("text")))
    return out.select(*texts.columns, "restored", unresolved_tokens(F.col("restored")).alias("unresolved_tokens"))
