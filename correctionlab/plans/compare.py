"""From page images to comparison requests, and from model answers to new diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from correctionlab.operators.responses import (
    comparison_prompts, log_confidence, new_diffs, pair_pages, parse_responses,
)
from correctionlab.operators.rules import auto_accept, rule_candidates
from correctionlab.plans.sizing import broadcast_within, cut_lineage


def comparison_requests(scans: DataFrame, renderings: DataFrame, scores: DataFrame) -> DataFrame:
    """What is sent to the vision model: a page pair with media types and the request text."""
    return comparison_prompts(pair_pages(scans, renderings), scores)


def diffs_from_answers(
    answers: DataFrame, logs: DataFrame | None, scores: DataFrame, rules: DataFrame, patterns: DataFrame,
    as_of: Column,
) -> DataFrame:
    """New diff rows with the confidence of their score's log, matched against the active rules."""
    confidences = None if logs is None else log_confidence(logs)
    fresh = new_diffs(parse_responses(answers), confidences, as_of)
    candidates = broadcast_within(cut_lineage(rule_candidates(rules, patterns), "candidates"))
    era = scores.select(F.col("id").alias("score_id"), "era")
    # a score whose row isn't there yet has no era, which rules out nothing
    return auto_accept(fresh.join(era, "score_id", "left"), candidates).select(*fresh.columns)
