import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from correctionlab.operators import training as T
from correctionlab.sources import writers

DIFF = ("id string, measure_number int, instrument string, difference_type string, description string, "
        "omr_confidence double, vision_confidence double, human_decision string, human_edit_value string, "
        "pdf_snippet_path string, musicxml_snippet_path string")


def diffs(spark, n=1, **kw):
    base = dict(measure_number=1, instrument="Flöte", difference_type="note", description="d", omr_confidence=0.5,
                vision_confidence=0.9, human_decision="accept", human_edit_value=None, pdf_snippet_path="a.png",
                musicxml_snippet_path="a.xml")
    base.update(kw)
    return spark.createDataFrame([dict(base, id=f"{k:06}") for k in range(n)], DIFF)


def test_eligibility_and_label(spark):
    assert T.eligible(diffs(spark, human_decision="reject")).count() == 0
    assert T.eligible(diffs(spark, pdf_snippet_path="")).count() == 0
    assert T.eligible(diffs(spark)).first().label == "a.xml"
    assert T.eligible(diffs(spark, human_decision="edit", human_edit_value="<rest/>")).first().label == "<rest/>"
    assert T.eligible(diffs(spark, human_decision="edit", human_edit_value="")).first().label == "a.xml"


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_ordinal_split_is_exactly_eighty_ten_ten(spark, digits):
    rows = T.assign_split(diffs(spark, 1000).repartition(7), "id", digits=digits).collect()
    assert sorted(r.ordinal for r in rows) == list(range(1, 1001))
    for r in rows:
        assert r.split == {0: "test", 9: "val"}.get(r.ordinal % 10, "train")


def test_ordinal_order_does_not_depend_on_the_ranges(spark):
    a, b = ({r.id: r.ordinal for r in T.assign_split(diffs(spark, 300), "id", digits=d).collect()} for d in (1, 4))
    assert a == b


def test_hash_split_is_stable_and_near_the_ratio(spark):
    rows = T.assign_split(diffs(spark, 5000), "id", "hash").groupBy("split").count().collect()
    counts = {r.split: r["count"] for r in rows}
    assert 3800 < counts["train"] < 4200 and 400 < counts["val"] < 600 and 400 < counts["test"] < 600


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        T.assign_split(diffs(spark), "id", "random")


def test_append_adds_each_diff_once(spark):
    now = F.lit(dt.datetime(2024, 1, 1))
    first = T.finetuning_rows(diffs(spark, 20), now)
    again = T.append_finetuning(first, T.finetuning_rows(diffs(spark, 30), now))
    assert again.count() == 30 and again.select("flagged_diff_id").distinct().count() == 30
    assert T.append_finetuning(again, T.finetuning_rows(diffs(spark, 30), now)).count() == 30


def test_jsonl_and_partitioned_dataset(spark, tmp_path):
    writers.write_finetuning_jsonl(T.training_records(diffs(spark, description=None)), str(tmp_path / "out"))
    (line,) = [x for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    record = json.loads(line)
    assert record == {"image_path": "a.png", "label": "a.xml", "metadata": {
        "measure_number": 1, "instrument": "Flöte", "difference_type": "note", "description": None,
        "audiveris_confidence": 0.5, "claude_vision_confidence": 0.9, "human_decision": "accept"}}
    writers.write_finetuning_dataset(T.finetuning_rows(diffs(spark, 50), F.current_timestamp()), str(tmp_path / "ds"))
    assert {p.name for p in (tmp_path / "ds").glob("split=*")} == {"split=train", "split=val", "split=test"}
