"""Auto-accept rules: promotion from patterns and matching of new diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from correctionlab.functions import fixed_values as V

RULE_COLUMNS = (
    "id", "pattern_id", "rule_description", "instrument", "difference_type", "min_omr_confidence",
    "min_vision_confidence", "min_confirmations", "current_confirmations", "is_active", "created_at",
)


def promote_rules(
    patterns: DataFrame, rules: DataFrame, as_of: Column, deactivate_below: bool = False
) -> DataFrame:
    """Make rules of patterns seen often enough with a high accept rate; refresh existing ones.

    A rule whose pattern fell under the bar stays as it is, unless `deactivate_below`.
    """
    p = patterns.select(
        F.col("id").alias("p_id"),
        F.col("instrument").alias("p_instrument"),
        F.col("difference_type").alias("p_type"),
        F.col("pattern_description").alias("p_description"),
        F.col("occurrence_count").alias("n"),
        F.col("accept_count").alias("accepted"),
    )
    joined = p.join(rules.select(*RULE_COLUMNS), F.col("p_id") == F.col("pattern_id"), "full_outer")
    n = F.col("n")
    qualifies = F.coalesce(
        (n >= V.RULE_MIN_COUNT) & (F.col("accepted") / n >= V.RULE_MIN_RATE), F.lit(False)
    )
    known = F.col("id").isNotNull()

    def new_or_old(name: str, fresh: Column) -> Column:
        return F.when(known, F.col(name)).otherwise(fresh).alias(name)

    active = F.when(~known, n >= V.RULE_MIN_COUNT).when(qualifies, n >= F.col("min_confirmations"))
    if deactivate_below:
        active = active.when(~qualifies, F.lit(False))
    return joined.where(known | qualifies).select(
        new_or_old("id", F.sha2(F.concat(F.lit("rule|"), "p_id"), 256)),
        new_or_old("pattern_id", F.col("p_id")),
        new_or_old("rule_description", F.col("p_description")),
        new_or_old("instrument", F.col("p_instrument")),
        new_or_old("difference_type", F.col("p_type")),
        new_or_old("min_omr_confidence", F.lit(V.RULE_MIN_OMR_CONFIDENCE)),
        new_or_old("min_vision_confidence", F.lit(V.RULE_MIN_VISION_CONFIDENCE)),
        new_or_old("min_confirmations", F.lit(V.RULE_MIN_COUNT).cast("bigint")),
        F.when(qualifies, n).otherwise(F.col("current_confirmations")).alias("current_confirmations"),
        active.otherwise(F.col("is_active")).alias("is_active"),
        new_or_old("created_at", as_of),
    )


def active_rules(rules: DataFrame) -> DataFrame:
    return rules.where(F.col("is_active"))


def rule_details(rules: DataFrame) -> DataFrame:
    return active_rules(rules).select(
        "id", "instrument", "difference_type",
        F.col("current_confirmations").alias("confirmations"),
        F.col("rule_description").alias("description"),
    )


FRONT_PART = 1_024


def _never_picked(older: Column, rule: Column) -> Column:
    """Whether an older rule of the same key is satisfied by every diff that satisfies `rule`."""
    return (
        (older["min_omr_confidence"] <= rule["min_omr_confidence"])
        & (older["min_vision_confidence"] <= rule["min_vision_confidence"])
        & (older["rule_era"].isNull() | F.coalesce(older["rule_era"] == rule["rule_era"], F.lit(False)))
    )


def pareto_front(rules: Column) -> Column:
    """Of an array of conditions the ones that some diff is first to satisfy, oldest first."""
    by_age = F.array_sort(rules)
    return F.aggregate(
        by_age, F.filter(by_age, lambda _: F.lit(False)),
        lambda front, rule: F.when(F.exists(front, lambda older: _never_picked(older, rule)), front)
        .otherwise(F.concat(front, F.array(rule))),
    )


def rule_candidates(rules: DataFrame, patterns: DataFrame) -> DataFrame:
    """Active rules as one row per (difference_type, instrument) with an ordered candidate list.

    The list is a Pareto front: a rule that an older one of its key makes needless (no higher minima, no
    stricter era) can never be picked and is left out. Fronts are made of parts of at most about
    FRONT_PART conditions first, then of the parts' fronts, so no task gathers all rules of a key.
    A rule without a minimum matches nothing.
    """
    key = ["difference_type", "instrument"]
    eras = patterns.select(F.col("id").alias("pattern_id"), F.expr("nullif(era, '')").alias("rule_era"))
    conditions = (*key, "min_omr_confidence", "min_vision_confidence", "rule_era")
    oldest = (
        active_rules(rules)
        .where(F.col("min_omr_confidence").isNotNull() & F.col("min_vision_confidence").isNotNull())
        .join(eras, "pattern_id", "left")
        .groupBy(*conditions)
        .agg(F.min(F.struct("created_at", "id")).alias("first"))
    )
    many = oldest.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / FRONT_PART).cast("int").alias("parts"))
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"m.{c}")) for c in key]
    dealt = oldest.alias("o").join(many.alias("m"), same).select("o.*", F.pmod(F.xxhash64("first"), "parts").alias("part"))
    rule = F.struct("first", "min_omr_confidence", "min_vision_confidence", "rule_era")
    fronts = dealt.groupBy(*key, "part").agg(pareto_front(F.collect_list(rule)).alias("front"))
    return fronts.groupBy(*key).agg(pareto_front(F.flatten(F.collect_list("front"))).alias("candidates"))


def auto_accept(diffs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Give each diff the oldest active rule it satisfies.

    `candidates` comes from `rule_candidates`; pass it through `broadcast_within` and the diffs
    are not shuffled at all. Both joins keep exactly one row per diff, so nothing has to be grouped
    back by diff id, and a hot difference type only makes a hot join key, which AQE splits.
    """
    omr = F.coalesce("omr_confidence", F.lit(0.0))
    vision = F.coalesce("vision_confidence", F.lit(0.0))
    era = F.expr("nullif(era, '')") if "era" in diffs.columns else F.lit(None).cast("string")

    def first_match(column: str) -> Column:
        fits = F.filter(
            column,
            lambda c: (omr >= c.min_omr_confidence)
            & (vision >= c.min_vision_confidence)
            & (c.rule_era.isNull() | era.isNull() | (c.rule_era == era)),
        )
        return F.get(fits, F.lit(0)).getField("first")

    exact = candidates.where(F.col("instrument").isNotNull()).withColumnRenamed("candidates", "exact_rules")
    general = candidates.where(F.col("instrument").isNull()).select(
        "difference_type", F.col("candidates").alias("any_rules")
    )
    matched = (
        diffs.join(exact, ["difference_type", "instrument"], "left")
        .join(general, "difference_type", "left")
        .withColumn("_rule", F.least(first_match("exact_rules"), first_match("any_rules")))
    )
    kept = [c for c in diffs.columns if c not in ("auto_accepted", "auto_accept_rule_id")]
    return matched.select(
        *kept,
        F.col("_rule").isNotNull().alias("auto_accepted"),
        F.col("_rule.id").alias("auto_accept_rule_id"),
    )
