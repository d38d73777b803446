"""The learning report and the review and listing views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from correctionlab.functions import fixed_values as V
from correctionlab.functions.expressions import band, ratio, round_half_up, week_key


def report_totals(diffs: DataFrame, scores: DataFrame, rules: DataFrame) -> DataFrame:
    """One row of headline numbers.

    Each input is reduced to a row of partial sums by itself; the rows are then added up, so the
    inputs never meet in a join. `total_rejects` counts every decision that is not an accept.
    """
    decision = F.col("human_decision")

    def tally(df: DataFrame, **sums: Column) -> DataFrame:
        names = ("total_scores", "total_corrections", "total_accepts", "total_edits",
                 "total_rejects_exact", "active_auto_rules")
        return df.agg(*[sums.get(n, F.sum(F.lit(0))).cast("bigint").alias(n) for n in names])

    rows = (
        tally(scores, total_scores=F.count(F.lit(1)))
        .unionByName(tally(
            diffs,
            total_corrections=F.count(decision),
            total_accepts=F.count_if(decision == "accept"),
            total_edits=F.count_if(decision == "edit"),
            total_rejects_exact=F.count_if(decision == "reject"),
        ))
        .unionByName(tally(rules, active_auto_rules=F.count_if("is_active")))
    )
    total = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows.columns])
    return total.select(
        "total_scores", "total_corrections",
        ratio(F.col("total_accepts"), F.col("total_corrections")).alias("accept_rate"),
        "total_accepts",
        (F.col("total_corrections") - F.col("total_accepts")).alias("total_rejects"),
        "total_edits", "total_rejects_exact", "active_auto_rules",
    )


def weekly_trends(diffs: DataFrame, mode: str = "oldest", weeks: int = V.TREND_WEEKS) -> DataFrame:
    """Decided diffs and accept rate per week of creation, ascending.

    'oldest' keeps the first weeks of the data, 'latest' the last ones.
    """
    if mode not in ("oldest", "latest"):
        raise ValueError(f"mode must be oldest or latest, not {mode!r}")
    per_week = (
        diffs.where(F.col("human_decision").isNotNull())
        .groupBy(week_key(F.col("created_at")).alias("week"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("human_decision") == "accept").alias("accepts"),
        )
        .withColumn("accept_rate", ratio(F.col("accepts"), F.col("total")))
    )
    order = F.asc("week") if mode == "oldest" else F.desc("week")
    return per_week.orderBy(order).limit(weeks).orderBy("week")


def review_progress(diffs: DataFrame) -> DataFrame:
    """Reviewed share of each score's diffs, and how many still wait."""
    reviewed = F.col("human_decision").isNotNull() | F.col("auto_accepted")
    return (
        diffs.groupBy("score_id")
        .agg(F.count_if(reviewed).alias("reviewed"), F.count(F.lit(1)).alias("total"))
        .select(
            "score_id", "reviewed", "total",
            (F.col("total") - F.col("reviewed")).alias("pending"),
            round_half_up(F.col("reviewed") / F.col("total") * 100).alias("pct"),
            (F.col("reviewed") == F.col("total")).alias("all_reviewed"),
        )
    )


def prompt_performance(prompt_versions: DataFrame) -> DataFrame:
    return prompt_versions.where("is_active").select(
        "id", "version", "total_uses", "accept_rate", "reject_rate"
    )


def confidence_bands(diffs: DataFrame) -> DataFrame:
    return diffs.select(
        "id",
        band(F.col("omr_confidence")).alias("omr_band"),
        band(F.col("vision_confidence")).alias("vision_band"),
    )


def export_status(scores: DataFrame) -> DataFrame:
    ready = F.when(F.col("status") == "complete", "ready").otherwise(F.col("status"))
    return scores.select(F.col("id").alias("score_id"), ready.alias("export_status"))


def scores_listing(scores: DataFrame) -> DataFrame:
    """Newest first."""
    return scores.orderBy(F.desc("created_at"), "id")


def score_status(scores: DataFrame, wanted: DataFrame) -> DataFrame:
    """Status of the wanted ids; `found` is false for ids no score has."""
    return wanted.select("score_id").distinct().join(
        scores.select(F.col("id").alias("score_id"), "status", "updated_at", F.lit(True).alias("found")),
        "score_id", "left",
    ).withColumn("found", F.coalesce("found", F.lit(False)))


def diffs_of_scores(diffs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Diffs by score and measure number; of the wanted scores when given."""
    if wanted is not None:
        diffs = diffs.join(wanted.select("score_id").distinct(), "score_id", "left_semi")
    return diffs.orderBy("score_id", "measure_number", "id")


def diff_context(diffs: DataFrame, scores: DataFrame) -> DataFrame:
    """Diffs with title, composer and era of their score."""
    return diffs.join(
        scores.select(F.col("id").alias("score_id"), "title", "composer", "era"), "score_id"
    )
