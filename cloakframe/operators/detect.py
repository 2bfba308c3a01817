"""Blocks of text and the mentions that rules find in them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import spans
from cloakframe.functions.rules import STANDARD, Rule

PROPOSAL = "block_id string, mention_type string, mention_strength string, start_cp int, end_cp int, detector string, confidence double"


def bounded(*ids: str) -> Column:
    """Whether none of a block's boundary ids is empty."""
    out = F.lit(True)
    for c in ids:
        out = out & F.coalesce(F.trim(c) != "", F.lit(False))
    return out


def blocks_of_lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One block for each line that is not blank: (document_id, reading_order, block_id, text)."""
    lines = documents.select(F.col(key).cast("string").alias("document_id"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("reading_order", "text"))
    lines = lines.filter(F.trim("text") != "")
    return lines.withColumn("block_id", F.concat_ws(":", "document_id", "reading_order"))


def _found(text: Column, rules: Sequence[Rule]) -> Column:
    def of(k: int, rule: Rule) -> Column:
        return F.transform(spans.matches(text, rule.pattern), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(k).alias("rule"), m["value"].alias("value")))

    parts = [of(k, r) for k, r in enumerate(rules)]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def detect(blocks: DataFrame, rules: Sequence[Rule] = STANDARD, text: str = "text") -> DataFrame:
    """Mentions of each block without overlaps, all columns of ``blocks`` but the text kept.

    Only blocks in which some rule matches at all are looked at closely, which keeps the
    arrays of spans off the others.
    """
    if not rules:
        raise ValueError("at least one rule is needed")
    t = F.col(text)
    likely = F.lit(False)
    for r in rules:
        likely = likely | (F.contains(t, F.lit(r.needle)) & t.rlike(r.pattern) if r.needle else t.rlike(r.pattern))
    near = blocks.filter(likely).withColumn("_wide", spans.wide_places(t))
    hits = near.withColumn("_s", F.explode(spans.select_greedy(_found(t, rules))))
    of_rule = lambda f: F.element_at(F.array(*[F.lit(f(r)) for r in rules]), F.col("_s.rule") + 1)
    return hits.select(
        *[c for c in blocks.columns if c != text],
        of_rule(lambda r: r.type).alias("mention_type"),
        of_rule(lambda r: r.strength).alias("mention_strength"),
        F.col("_s.start").alias("start_cp"),
        F.col("_s.end").alias("end_cp"),
        spans.to_units("_wide", F.col("_s.start")).alias("start_offset"),
        spans.to_units("_wide", F.col("_s.end")).alias("end_offset"),
        F.lit("REGEX").alias("detector"),
        of_rule(lambda r: float(r.confidence)).alias("confidence"),
        F.col("_s.value").alias("value"),
    )


def detect_with(blocks: DataFrame, detector: Callable[[str], Sequence[dict]]) -> DataFrame:
    """Proposals of a Python detector, called with each block's text (block_id, text).

    It returns dicts with mention_type, start, end and, if need be, strength, detector
    and confidence.  ``proposal_errors`` checks the result.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PROPOSAL.split(", ")]
        for f in frames:
            rows = [(b, p["mention_type"], p.get("strength", "EXPLICIT"), p["start"], p["end"], p.get("detector", "NER"), float(p.get("confidence", 1.0))) for b, t in zip(f["block_id"], f["text"], strict=True) for p in detector(t)]
            yield pd.DataFrame(rows, columns=names)

    return blocks.select("block_id", "text").mapInPandas(run, PROPOSAL)


def proposal_errors(proposals: DataFrame, blocks: DataFrame, *ties: str) -> DataFrame:
    """Proposals that may not be stored, with the reason.

    Each is checked for its block, range, confidence and enumerations, and against the
    ones before it in its block for overlaps; ``ties`` order equal ranges.
    """
    from pyspark.sql import Window

    from cloakframe.schemas import DETECTOR, MENTION_STRENGTH, MENTION_TYPE

    known = blocks.select(F.col("block_id"), F.length("text").alias("_n"))
    order = Window.partitionBy("block_id").orderBy("start_cp", F.desc("end_cp"), *ties).rowsBetween(Window.unboundedPreceding, -1)
    checked = proposals.join(known, "block_id", "left").withColumn("_reach", F.max("end_cp").over(order))
    reason = (
        F.when(F.col("_n").isNull(), "BLOCK")
        .when((F.col("start_cp") < 0) | (F.col("end_cp") > F.col("_n")) | (F.col("start_cp") >= F.col("end_cp")), "RANGE")
        .when(F.isnan("confidence") | ~F.col("confidence").between(0, 1), "CONFIDENCE")
        .when(~F.col("mention_type").isin(*MENTION_TYPE) | ~F.col("mention_strength").isin(*MENTION_STRENGTH) | ~F.col("detector").isin(*DETECTOR), "ENUM")
        .when(F.col("start_cp") < F.col("_reach"), "OVERLAP")
    )
    return checked.withColumn("reason", reason).filter("reason is not null").drop("_n", "_reach")
