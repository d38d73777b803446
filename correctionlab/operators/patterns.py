"""Correction patterns and the knowledge base built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from correctionlab.functions import fixed_values as V
from correctionlab.functions.expressions import hash_id, percent_text, ratio, round_half_up

PATTERN_KEY = ("instrument", "difference_type", "pattern_type")


def decision_counts(diffs: DataFrame) -> DataFrame:
    """Decisions per instrument and difference type.

    One shuffle of partial counts: a hot group costs one row per map task. A `weight` column, when
    there is one, counts each row that many times; -1 takes an earlier decision back.
    """
    weight = F.col("weight") if "weight" in diffs.columns else F.lit(1)
    decision = F.col("human_decision")

    def count_of(value: str) -> Column:
        return F.sum(F.when(decision == value, weight).otherwise(0))

    return diffs.where(decision.isNotNull()).groupBy("instrument", "difference_type").agg(
        F.sum(weight).alias("occurrence_count"),
        count_of("accept").alias("accepts"),
        count_of("reject").alias("rejects"),
        count_of("edit").alias("edits"),
    )


def add_counts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Sum of two count tables; groups that fell to nothing go."""
    return (
        stored.unionByName(new)
        .groupBy("instrument", "difference_type")
        .agg(*[F.sum(c).alias(c) for c in ("occurrence_count", "accepts", "rejects", "edits")])
        .where(F.col("occurrence_count") > 0)
    )


def rate_counts(counts: DataFrame) -> DataFrame:
    """Rates, pattern type and suggested rule of counted decisions."""
    n = F.col("occurrence_count")
    rated = counts.withColumns({
        "accept_rate": F.col("accepts") / n,
        "reject_rate": F.col("rejects") / n,
        "pattern_type": F.when(F.col("instrument") == "unknown", "audiveris_failure")
        .otherwise("instrument_quirk"),
    })
    rule_text = F.format_string(
        V.RULE_TEXT, "difference_type", "instrument", percent_text(F.col("accept_rate")), n
    )
    qualifies = (F.col("accept_rate") >= V.RULE_MIN_RATE) & (n >= V.RULE_MIN_COUNT)
    return rated.withColumn("suggested_rule", F.when(qualifies, rule_text))


def correction_patterns(diffs: DataFrame) -> DataFrame:
    """Decision counts and rates per instrument and difference type."""
    return rate_counts(decision_counts(diffs))


def _pattern_id() -> Column:
    return hash_id("instrument", "difference_type", "pattern_type")


def as_patterns(analysis: DataFrame, as_of: Column) -> DataFrame:
    """Analysis rows in the shape of knowledge base rows.

    Counts are recovered from the rates and truncated, so a count can lose one to the edits;
    `accept_count_exact` keeps the true value.
    """
    n = F.col("occurrence_count")
    accept = (F.col("accept_rate") * n).cast("bigint")
    reject = (F.col("reject_rate") * n).cast("bigint")
    fallback = F.format_string(
        V.FALLBACK_PATTERN_TEXT, "difference_type",
        F.coalesce(F.when(F.col("instrument") != "", F.col("instrument")), F.lit(V.ALL_INSTRUMENTS)),
    )
    return analysis.select(
        _pattern_id().alias("id"),
        *PATTERN_KEY,
        F.lit(None).cast("string").alias("era"),
        F.coalesce("suggested_rule", fallback).alias("pattern_description"),
        n,
        accept.alias("accept_count"),
        reject.alias("reject_count"),
        (n - accept - reject).alias("edit_count"),
        F.col("accepts").alias("accept_count_exact"),
        F.lit(V.DEFAULT_PATTERN_THRESHOLD).alias("confidence_threshold"),
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
    )


REFRESHED = (
    "occurrence_count", "accept_count", "reject_count", "edit_count", "accept_count_exact", "updated_at",
)


def update_knowledge_base(patterns: DataFrame, analysis: DataFrame, as_of: Column) -> DataFrame:
    """Merge a new analysis into the stored patterns.

    Known keys get new counts and keep their id, description, era and creation time; unknown keys
    are inserted; stored patterns the analysis does not mention stay as they are. Columns that only
    the stored patterns have are kept, and are null for new keys. `change` says which of insert, update
    or keep happened.
    """
    new = as_patterns(analysis, as_of)
    kinds = dict(new.dtypes)
    if "accept_count_exact" not in patterns.columns:
        patterns = patterns.withColumn("accept_count_exact", F.lit(None).cast("bigint"))
    # tables written before there was an exact count have the truncated one
    patterns = patterns.withColumn("accept_count_exact", F.coalesce("accept_count_exact", "accept_count"))
    patterns = patterns.select(*[F.col(c).cast(kinds[c]) if kinds.get(c) in ("timestamp", "timestamp_ntz") else F.col(c) for c in patterns.columns])
    more = [c for c in patterns.columns if c not in new.columns]
    old, cur = patterns.alias("old"), new.alias("new")
    on = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in PATTERN_KEY]
    joined = old.join(cur, on, "full_outer")
    has_old, has_new = F.col("old.id").isNotNull(), F.col("new.id").isNotNull()

    def pick(name: str) -> Column:
        stored, fresh = F.col(f"old.{name}"), F.col(f"new.{name}")
        if name in REFRESHED:
            return F.when(has_new, fresh).otherwise(stored).alias(name)
        return F.when(has_old, stored).otherwise(fresh).alias(name)

    change = F.when(~has_old, "insert").when(has_new, "update").otherwise("keep")
    return joined.select(*[pick(c) for c in new.columns], *[F.col(f"old.{c}").alias(c) for c in more], change.alias("change"))


def top_patterns(patterns: DataFrame, n: int = V.TOP_PATTERNS) -> DataFrame:
    """The report's most frequent patterns with their accept rates."""
    return (
        patterns.orderBy(F.desc("occurrence_count"), "instrument", "difference_type", "pattern_type")
        .limit(n)
        .select(
            "instrument", "difference_type",
            F.col("occurrence_count").alias("occurrences"),
            ratio(F.col("accept_count"), F.col("occurrence_count")).alias("accept_rate"),
        )
    )


def patterns_listing(patterns: DataFrame) -> DataFrame:
    return patterns.orderBy(F.desc("occurrence_count"), "instrument", "difference_type")


def suggestions(patterns: DataFrame, limit: int | None = None) -> DataFrame:
    """Improvement texts for clearly good and clearly bad patterns.

    `limit` keeps the most frequent patterns only, as the report does.
    """
    if limit is not None:
        patterns = patterns.orderBy(
            F.desc("occurrence_count"), "instrument", "difference_type", "pattern_type"
        ).limit(limit)
    n = F.col("occurrence_count")
    rate = F.col("accept_count") / n
    instrument = F.coalesce(F.when(F.col("instrument") != "", F.col("instrument")), F.lit(V.ALL_INSTRUMENTS))
    enough = n >= V.SUGGEST_MIN_COUNT
    text = F.when(
        enough & (rate > V.SUGGEST_HIGH_RATE),
        F.format_string(V.SUGGEST_ENABLE_TEXT, "difference_type", instrument, percent_text(rate), n),
    ).when(
        enough & (rate < V.SUGGEST_LOW_RATE),
        F.format_string(V.SUGGEST_REVIEW_TEXT, "difference_type", percent_text(1 - rate), n),
    )
    return (
        patterns.where(n > 0)
        .select("instrument", "difference_type", text.alias("suggestion"))
        .where(F.col("suggestion").isNotNull())
    )


def chart_rows(top: DataFrame) -> DataFrame:
    """Bar chart rows of the report's top patterns."""
    label = F.concat(
        F.col("difference_type"),
        F.when(F.col("instrument") != "", F.concat(F.lit(" ("), "instrument", F.lit(")"))).otherwise(""),
    )
    return top.select(
        label.alias("name"),
        round_half_up(F.col("accept_rate") * 100).alias("accept"),
        round_half_up((1 - F.col("accept_rate")) * 100).alias("reject"),
        F.col("occurrences").alias("count"),
    )
