"""The learning report as a set of small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from correctionlab.functions import fixed_values as V
from correctionlab.operators import patterns as P
from correctionlab.operators import reports as R
from correctionlab.operators.rules import rule_details


def learning_report(
    diffs: DataFrame, scores: DataFrame, patterns: DataFrame, rules: DataFrame,
    prompt_versions: DataFrame | None = None, trend_mode: str = "oldest",
) -> dict[str, DataFrame]:
    """Section name -> lazy table. Totals and trend read only the columns they count."""
    top = P.top_patterns(patterns)
    sections = {
        "totals": R.report_totals(diffs, scores, rules),
        "weekly_trends": R.weekly_trends(diffs, trend_mode),
        "top_patterns": top,
        "chart_rows": P.chart_rows(top),
        "active_auto_rules_detail": rule_details(rules),
        "suggested_improvements": P.suggestions(patterns, limit=V.TOP_PATTERNS),
    }
    if prompt_versions is not None:
        sections["prompt_performance"] = R.prompt_performance(prompt_versions)
    return sections
