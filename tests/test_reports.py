import datetime as dt
import math

from pyspark.sql import functions as F

from correctionlab.functions.expressions import percent_text, ratio, week_key
from correctionlab.operators import reports as R


def test_week_key_equals_strftime(spark):
    days = [dt.date(1999, 12, 20) + dt.timedelta(days=k) for k in range(3000)]
    df = spark.createDataFrame([(d, d.strftime("%Y-%W")) for d in days], "d date, want string")
    assert df.where(week_key(F.col("d")) != F.col("want")).count() == 0


def test_percent_text_equals_python(spark):
    rows = [(a, n, f"{a / n:.0%}") for n in range(1, 201) for a in range(n + 1)]
    df = spark.createDataFrame(rows, "a int, n int, want string")
    assert df.where(percent_text(F.col("a") / F.col("n")) != F.col("want")).count() == 0


def test_ratio_of_nothing_is_zero(spark):
    row = spark.range(1).select(ratio(F.lit(0), F.lit(0)).alias("r"), ratio(F.lit(2), F.lit(3)).alias("s")).first()
    assert (row.r, row.s) == (0.0, 0.6667)


def diffs(spark, rows):
    return spark.createDataFrame(
        rows, "score_id string, human_decision string, auto_accepted boolean, created_at timestamp")


def test_totals(spark):
    d = diffs(spark, [("1", x, False, None) for x in ("accept", "accept", "reject", "edit", None)])
    scores = spark.range(3).select(F.col("id").cast("string"))
    rules = spark.createDataFrame([(True,), (False,)], "is_active boolean")
    got = R.report_totals(d, scores, rules).first().asDict()
    assert got == {"total_scores": 3, "total_corrections": 4, "accept_rate": 0.5, "total_accepts": 2,
                   "total_rejects": 2, "total_edits": 1, "total_rejects_exact": 1, "active_auto_rules": 1}


def test_totals_of_nothing(spark):
    got = R.report_totals(diffs(spark, []), spark.range(0), spark.createDataFrame([], "is_active boolean")).first()
    assert got.total_corrections == 0 and got.accept_rate == 0.0 and got.active_auto_rules == 0


def test_weekly_trend_modes(spark):
    start = dt.datetime(2024, 1, 1)
    d = diffs(spark, [("1", "accept" if k % 2 else "edit", False, start + dt.timedelta(weeks=k)) for k in range(20)])
    oldest = [r.week for r in R.weekly_trends(d).collect()]
    latest = [r.week for r in R.weekly_trends(d, "latest").collect()]
    assert oldest == [f"2024-{k + 1:02}" for k in range(12)]
    assert latest == [f"2024-{k + 1:02}" for k in range(8, 20)]


def test_progress_rounds_half_up(spark):
    rows = [("a", "accept", False, None)] + [("a", None, False, None)] * 7
    rows += [("b", None, True, None), ("b", "edit", False, None)]
    got = {r.score_id: r for r in R.review_progress(diffs(spark, rows)).collect()}
    assert got["a"].pct == math.floor(12.5 + 0.5) == 13 and got["a"].pending == 7 and not got["a"].all_reviewed
    assert got["b"].pct == 100 and got["b"].all_reviewed


def test_prompt_performance_lists_active_versions(spark):
    df = spark.createDataFrame(
        [("a", 1, "t", 0.5, None, 3, True), ("b", 2, "t", None, None, 0, False)],
        "id string, version int, prompt_text string, accept_rate double, reject_rate double, total_uses bigint, is_active boolean")
    assert [tuple(r) for r in R.prompt_performance(df).collect()] == [("a", 1, 3, 0.5, None)]


def test_bands_and_export_status(spark):
    df = spark.createDataFrame([("1", 0.8, 0.5), ("2", 0.79, 0.49)], "id string, omr_confidence double, vision_confidence double")
    assert [tuple(r) for r in R.confidence_bands(df).orderBy("id").collect()] == [("1", "high", "mid"), ("2", "mid", "low")]
    scores = spark.createDataFrame([("1", "complete"), ("2", "error")], "id string, status string")
    assert [r.export_status for r in R.export_status(scores).collect()] == ["ready", "error"]


def test_unknown_scores_are_reported(spark):
    scores = spark.createDataFrame([("1", "review", dt.datetime(2024, 1, 1))], "id string, status string, updated_at timestamp")
    wanted = spark.createDataFrame([("1",), ("9",), ("9",)], "score_id string")
    got = {r.score_id: (r.status, r.found) for r in R.score_status(scores, wanted).collect()}
    assert got == {"1": ("review", True), "9": (None, False)}
