import datetime as dt
import json

from pyspark.sql import functions as F

from correctionlab.operators import responses as R
from correctionlab.sources import readers

GOOD = {"confidence": 0.35, "has_difference": 1, "description": "tie ends a bar early", "difference_type": "tie"}


def parse(spark, *texts):
    df = spark.createDataFrame([("s", i, "unknown", t) for i, t in enumerate(texts)],
                               "score_id string, page_no int, instrument string, response_text string")
    return {r.measure_number: (r.difference_type, r.description, r.vision_confidence)
            for r in R.parse_responses(df).collect()}


def test_answers_in_every_wrapping(spark):
    body = json.dumps(GOOD)
    want = ("tie", "tie ends a bar early", 0.35)
    got = parse(spark, body, f"  \n{body}\n ", f"```json\n{body}\n```", f"```\n{json.dumps(GOOD, indent=2)}\n```",
                f"Bar 9 differs: {body} -- the rest agrees", f"First\nthen {json.dumps(GOOD, indent=1)}\nmore")
    assert got == {i: want for i in range(6)}


def test_answers_without_a_difference_drop_out(spark):
    assert parse(
        spark, json.dumps({**GOOD, "has_difference": False}), "both pages agree", "", " \t ", "{\"has_difference\": tru", "[3]",
        "[" + json.dumps(GOOD) + "]", '"text"', "null", '{"confidence": 1}', "``` {} ```",
    ) == {}


def test_truth_of_has_difference(spark):
    values = [True, False, None, 0, 1, 0.0, 2.5, "", "false", [], [0], {}, {"a": 1}, -1, "0"]
    got = parse(spark, *[json.dumps({"has_difference": v}) for v in values])
    assert set(got) == {i for i, v in enumerate(values) if v}


def test_defaults_and_confidence(spark):
    got = parse(spark, '{"has_difference": true}', '{"has_difference": true, "confidence": "0.25"}',
                '{"has_difference": true, "confidence": "high"}', '{"has_difference": true, "confidence": null}',
                '{"has_difference": true, "confidence": 1}')
    assert got == {0: ("other", "", 0.5), 1: ("other", "", 0.25), 4: ("other", "", 1.0)}


def test_log_confidence(spark):
    logs = ["x\nGrade: 0.87\n", "grade 1.5", "GRADE::\t2", "recognition: 87%", "Recognition 150%", "recognition: high",
            "Grade: none, recognition: 40%", "", "Grade: 0.3\nrecognition: 90%"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(logs)], "score_id string, log_text string")
    got = [r.confidence for r in R.log_confidence(df).orderBy("score_id").collect()]
    assert got == [0.87, 1.0, 1.0, 0.87, 1.5, 0.5, 0.4, 0.5, 0.3]


def test_pairs_stop_at_the_shorter_side(spark):
    schema = "score_id string, page_no int, path string"
    left = spark.createDataFrame([("s", 1, "a.JPG"), ("s", 2, "b.tiff"), ("t", 1, "c.png")], schema)
    right = spark.createDataFrame([("s", 1, "x/y.v2/name")], schema)
    (row,) = R.pair_pages(left, right).collect()
    assert (row.score_id, row.page_no, row.left_media, row.right_media) == ("s", 1, "image/jpg", "image/png")


def test_prompt_fields_and_defaults(spark):
    pages = spark.createDataFrame([("s", 5), ("t", 1)], "score_id string, page_no int")
    scores = spark.createDataFrame([("s", "Night Ferry 50%", "Ola Brandt", "modern", "lute")],
                                   "id string, title string, composer string, era string, instrument string")
    got = {r.score_id: r.prompt for r in R.comparison_prompts(pages, scores).collect()}
    for text in ('"Night Ferry 50%" by Ola Brandt (modern era)', "lute", "Page: 5"):
        assert text in got["s"]
    assert '"Unknown" by Unknown (unknown era)' in got["t"]


def test_new_diffs_take_the_log_confidence(spark):
    parsed = spark.createDataFrame([("s", 1, "i", "note", "d", 0.9), ("t", 1, "i", "note", "d", 0.9)],
                                   "score_id string, measure_number int, instrument string, difference_type string, "
                                   "description string, vision_confidence double")
    logs = spark.createDataFrame([("s", 0.8)], "score_id string, confidence double")
    as_of = F.lit(dt.datetime(2024, 1, 1))
    got = {r.score_id: r for r in R.new_diffs(parsed, logs, as_of).collect()}
    assert got["s"].omr_confidence == 0.8 and got["t"].omr_confidence == 0.5
    assert got["s"].time_signature == "4/4" and got["s"].human_decision is None and not got["s"].auto_accepted
    assert {r.omr_confidence for r in R.new_diffs(parsed, None, as_of).collect()} == {0.5}


def test_one_log_a_score_and_one_diff_an_answer(spark):
    logs = spark.createDataFrame([("s", "grade 0.2", 2), ("s", "grade 0.9", 1), ("t", "grade 0.4", 1)], "score_id string, log_text string, at long")
    timed = logs.select("score_id", "log_text", F.timestamp_seconds("at").alias("logged_at"))
    assert {r.score_id: r.confidence for r in R.log_confidence(timed).collect()} == {"s": 0.2, "t": 0.4}
    assert {r.score_id: r.confidence for r in R.log_confidence(logs.select("score_id", "log_text")).collect()} == {"s": 0.9, "t": 0.4}
    parsed = spark.createDataFrame([("s", 1, "i", "note", "d", 0.3), ("s", 1, "i", "note", "d", 0.6), ("s", 1, None, "note", "d", 0.6)],
                                   "score_id string, measure_number int, instrument string, difference_type string, "
                                   "description string, vision_confidence double")
    got = R.new_diffs(parsed, R.log_confidence(logs), F.lit(dt.datetime(2024, 1, 1))).collect()
    assert len(got) == len({r.id for r in got}) == 2 and {r.vision_confidence for r in got} == {0.6}


def test_readers(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "score-1.log").write_text("line\nGrade: 0.7\n")
    got = readers.read_logs(spark, str(tmp_path / "logs")).collect()
    assert [(r.score_id, r.log_text) for r in got] == [("score-1", "line\nGrade: 0.7\n")]
    (tmp_path / "answers.jsonl").write_text(json.dumps(
        {"score_id": "s", "page_no": 2, "instrument": "i", "response_text": json.dumps(GOOD)}) + "\n")
    assert R.parse_responses(readers.read_responses(spark, str(tmp_path / "answers.jsonl"))).first().measure_number == 2
