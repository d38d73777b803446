"""Review buckets and the decisions that change diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from correctionlab.functions import fixed_values as V
from correctionlab.plans.sizing import dealt


def decided_diffs(diffs: DataFrame) -> DataFrame:
    return diffs.where(F.col("human_decision").isNotNull())


def bucket_condition(bucket: str) -> Column:
    decision, auto = F.col("human_decision"), F.col("auto_accepted")
    conditions = {
        "all": F.lit(True),
        "pending": decision.isNull() & ~auto,
        "accepted": F.coalesce(decision == "accept", F.lit(False)) | auto,
        "rejected": F.coalesce(decision == "reject", F.lit(False)),
        "edited": F.coalesce(decision == "edit", F.lit(False)),
    }
    return conditions[bucket]


def review_bucket(diffs: DataFrame, bucket: str) -> DataFrame:
    return diffs.where(bucket_condition(bucket))


def review_buckets(diffs: DataFrame) -> DataFrame:
    """Each diff once per bucket it is in; buckets overlap. One scan, no shuffle."""
    names = F.array(*[F.when(bucket_condition(b), b) for b in V.REVIEW_BUCKETS])
    return diffs.select(F.explode(F.array_compact(names)).alias("bucket"), *diffs.columns)


def decision_is_valid() -> Column:
    single = F.col("decision").isin(*V.DECISIONS) & (
        (F.col("decision") != "edit") | (F.coalesce("edit_value", F.lit("")) != "")
    )
    bulk = F.col("decision").isin(*V.BULK_DECISIONS)
    return F.coalesce(F.when(F.col("kind") == "bulk", bulk).otherwise(single), F.lit(False))


def validate_decisions(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of a decision log."""
    return log.where(decision_is_valid()), log.where(~decision_is_valid())


def latest_decisions(log: DataFrame) -> DataFrame:
    """Last decision and last edit value per diff.

    A single decision always sets the edit value, even to nothing; a bulk decision leaves it.
    Both maxima combine on the map side, so a diff decided very often does not pile up.
    """
    single = F.col("kind") == "single"
    return log.groupBy("diff_id").agg(
        F.max(F.struct("ts", "event_id", "decision")).alias("last"),
        F.max(F.when(single, F.struct("ts", "event_id", "edit_value"))).alias("last_single"),
    )


def apply_decisions(diffs: DataFrame, log: DataFrame) -> DataFrame:
    """Put the latest valid decisions onto the diffs."""
    good, _ = validate_decisions(log)
    return with_latest(diffs, latest_decisions(good))


def with_latest(diffs: DataFrame, latest: DataFrame) -> DataFrame:
    joined = diffs.join(latest, diffs.id == latest.diff_id, "left")
    changed = {
        "human_decision": F.coalesce("last.decision", "human_decision"),
        "human_edit_value": F.when(F.col("last_single").isNotNull(), F.col("last_single.edit_value"))
        .otherwise(F.col("human_edit_value")),
        "human_reviewed_at": F.coalesce("last.ts", "human_reviewed_at"),
    }
    return joined.select(*[changed.get(c, diffs[c]).alias(c) for c in diffs.columns])


def bulk_matches(diffs: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests that bulk allows and that name an existing diff of the right score, repeats included."""
    return requests.where(F.col("decision").isin(*V.BULK_DECISIONS)).join(
        diffs.select(F.col("id").alias("diff_id"), "score_id"), ["diff_id", "score_id"], "left_semi"
    )


def bulk_updated_counts(diffs: DataFrame, requests: DataFrame) -> DataFrame:
    """How many list entries took effect, per score; an id listed twice counts twice."""
    return bulk_matches(diffs, requests).groupBy("score_id").agg(F.count(F.lit(1)).alias("updated"))


def bulk_decide(diffs: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """Set decision and time of the requested diffs; their edit values stay.

    Requests with a decision that bulk does not allow are left out. If requests for one diff
    disagree, the last decision in alphabetical order holds, whatever the order of the rows.
    """
    wanted = (
        requests.where(F.col("decision").isin(*V.BULK_DECISIONS))
        .groupBy(F.col("diff_id").alias("id"), "score_id")
        .agg(F.max("decision").alias("_decision"))
    )
    hit = F.col("_decision").isNotNull()
    joined = diffs.join(wanted, ["id", "score_id"], "left")
    changed = {
        "human_decision": F.coalesce("_decision", "human_decision"),
        "human_reviewed_at": F.when(hit, as_of).otherwise(F.col("human_reviewed_at")),
    }
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in diffs.columns])


def delete_scores(
    scores: DataFrame, diffs: DataFrame, training: DataFrame, ids: DataFrame, tasks: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove scores with their diffs and the training rows of those diffs.

    Training rows are found through the diffs that go, not the ones that stay: the small side. The big sides are dealt into `tasks`
    partitions, if given, so that what a task sorts stays bounded.
    """
    gone = ids.select("score_id").distinct()
    diffs_by_score, training = dealt(diffs, tasks, "score_id"), dealt(training, tasks, "flagged_diff_id")
    gone_diffs = diffs_by_score.join(gone, diffs.score_id == gone.score_id, "left_semi").select(
        F.col("id").alias("flagged_diff_id")
    )
    return (
        dealt(scores, tasks, "id").join(gone, scores.id == gone.score_id, "left_anti"),
        diffs_by_score.join(gone, diffs.score_id == gone.score_id, "left_anti"),
        training.join(gone_diffs, training.flagged_diff_id == gone_diffs.flagged_diff_id, "left_anti"),
    )


def scores_without_diffs(scores: DataFrame, diffs: DataFrame) -> DataFrame:
    return scores.join(diffs, scores.id == diffs.score_id, "left_anti")
