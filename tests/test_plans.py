"""Plan shapes that decide how the jobs behave on big data."""

import re

import pytest
from pyspark.sql import functions as F

from correctionlab.operators import documents as D
from correctionlab.operators import patterns as P
from correctionlab.operators import reports as R
from correctionlab.operators import rules as RU
from correctionlab.operators import training as T
from correctionlab.plans import compare, report, sizing
from correctionlab.sources import fixtures as fx


@pytest.fixture
def no_auto_broadcast(spark):
    """Plans as they are when every table is too big to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_registered_operator_needs_a_nested_loop(spark, sf, no_auto_broadcast):
    parts, measures, diffs = fx.parts(spark, sf), fx.measures(spark, sf), fx.diffs(spark, sf)
    located = D.locate_edits(diffs, parts, measures)
    frames = [
        D.apply_edits(measures, located),
        RU.auto_accept(diffs, RU.rule_candidates(fx.current_rules(spark, sf), fx.current_patterns(spark, sf))),
        R.report_totals(diffs, fx.scores(spark, sf), fx.current_rules(spark, sf)),
        R.diff_context(diffs, fx.scores(spark, sf)),
    ]
    for df in frames:
        assert "NestedLoop" not in plan(df) and "CartesianProduct" not in plan(df)


def test_auto_accept_does_not_shuffle_the_diffs(spark, sf):
    candidates = F.broadcast(RU.rule_candidates(fx.current_rules(spark, sf), fx.current_patterns(spark, sf)))
    diffs = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.col("l_orderkey").cast("string").alias("id"), F.col("l_linestatus").alias("difference_type"),
        F.col("l_returnflag").alias("instrument"), F.col("l_discount").alias("omr_confidence"),
        F.col("l_tax").alias("vision_confidence"))
    text = plan(RU.auto_accept(diffs, candidates))
    main = text.split("BroadcastExchange")[0]
    assert main.count("BroadcastHashJoin") == 2 and "Exchange hashpartitioning" not in main


def test_patterns_read_only_what_they_count_and_shuffle_once(spark, sf, tmp_path):
    fx.diffs(spark, sf).write.parquet(str(tmp_path / "diffs"))
    text = plan(P.correction_patterns(spark.read.parquet(str(tmp_path / "diffs"))))
    assert re.search(r"ReadSchema: struct<instrument:string,difference_type:string,human_decision:string>", text)
    assert "PushedFilters: [IsNotNull(human_decision)]" in text
    assert text.count("Exchange") == 1 and "partial_sum" in text


def test_split_numbers_rows_in_many_partitions(spark, sf):
    text = plan(T.assign_split(T.eligible(fx.diffs(spark, sf)), "id"))
    # the only single-partition step is over the counts of the ranges
    single = [line for line in text.splitlines() if "Exchange SinglePartition" in line]
    assert len(single) == 1 and "BroadcastExchange" in text
    assert re.search(r"hashpartitioning\(_range#\d+, 4\)", text)


def test_document_lines_do_not_join_the_measures(spark, sf):
    text = plan(D.document_lines(
        spark.createDataFrame([], "score_id string, layout string, root_open string, root_close string, head_xml string, "
                                  "prefix string"),
        spark.createDataFrame([], "score_id string, part_id string, part_seq int, part_name string, body_seq int, part_xml string"),
        fx.measures(spark, sf), spark.createDataFrame([], "score_id string, part_seq int, group_xml string")))
    branch = text[text.index("<measure"):]
    assert "Join" not in branch


def test_lineage_is_cut_by_a_table_in_the_shared_folder(spark):
    df = sizing.cut_lineage(spark.range(10).withColumn("x", F.rand(1)))
    (name,) = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    assert spark.conf.get("spark.checkpoint.dir") in name
    assert df.count() == 10 and plan(df).count("Scan") == 1


def test_report_sections(spark, sf):
    sections = report.learning_report(
        fx.diffs(spark, sf), fx.scores(spark, sf), fx.current_patterns(spark, sf), fx.current_rules(spark, sf))
    assert sections["totals"].count() == 1 and sections["top_patterns"].count() == 10
    assert sections["chart_rows"].count() == 10 and sections["weekly_trends"].count() == 12
    assert sections["suggested_improvements"].count() <= 10


def test_answers_become_matched_diffs(spark, sf):
    new = compare.diffs_from_answers(
        fx.model_responses(spark, sf).withColumn("instrument", F.lit("Brand#24")), fx.recogniser_logs(spark, sf),
        fx.scores(spark, sf),
        fx.current_rules(spark, sf), fx.current_patterns(spark, sf), fx.as_of())
    assert set(new.columns) == set(fx.diffs(spark, sf).columns) | {"time_signature", "key_signature"}
    assert new.count() == 600
    left, right = fx.page_images(spark, sf)
    assert "prompt" in compare.comparison_requests(left, right, fx.scores(spark, sf)).columns


def test_hot_keys_give_whole_results(spark):
    """A third of all rows on one score, one instrument and one measure."""
    n = 3000
    rows = spark.range(n).select(
        F.format_string("%05d", "id").alias("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 500).cast("string"))).alias("score_id"),
        F.lit("Violin").alias("instrument"), F.lit(1).alias("measure_number"), F.lit("edit").alias("human_decision"),
        F.when(F.col("id") == 2400, "<rest/>").otherwise(F.concat(F.lit("c"), "id")).alias("human_edit_value"),
        F.lit("2024-01-01").cast("timestamp").alias("human_reviewed_at"))
    scores = rows.select("score_id").distinct()
    parts = scores.select("score_id", F.lit(0).alias("part_seq"), F.lit("P1").alias("part_id"), F.lit("Violin").alias("part_name"), F.lit(0).alias("body_seq"))
    measures = parts.select("*", F.lit(0).alias("measure_seq"), F.lit("1").alias("measure_number"), F.lit('<measure number="1"/>').alias("xml"))
    located = D.locate_edits(rows, parts, measures)
    assert located.where("measure_seq = 0").count() == n
    (hot,) = D.apply_edits(measures, located).where("score_id = 'hot'").collect()
    after = [f"<!-- edit: c{i} -->" for i in range(2403, n, 3)]
    assert hot.xml == '<measure number="1"><rest/>' + "".join(after) + "</measure>"
