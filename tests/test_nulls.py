"""Rows without a text neither fail a job nor vanish from it unnoticed."""

from correctionlab.operators import catalogue as C
from correctionlab.operators import documents as D
from correctionlab.operators import responses as R
from correctionlab.sources import readers


def test_missing_documents_are_errors(spark):
    docs = spark.createDataFrame([("a", None), ("b", "<score-partwise/>")], "score_id string, xml string")
    assert [r.score_id for r in readers.errors_of(readers.shred(docs)).collect()] == ["a"]
    got = {r.score_id: r.well_formed for r in D.validate_documents(readers.inspect(docs)).collect()}
    assert got == {"a": False, "b": True}


def test_missing_texts(spark):
    answers = spark.createDataFrame([("s", 1, "i", None)], "score_id string, page_no int, instrument string, response_text string")
    assert R.parse_responses(answers).count() == 0
    logs = spark.createDataFrame([("s", None)], "score_id string, log_text string")
    assert R.log_confidence(logs).first().confidence == 0.5
    pages = spark.createDataFrame([(1, "http://x.org", None)], "page_id bigint, url string, html string")
    assert C.page_links(pages).count() == 0
    assert C.page_metadata(pages).first()[1:3] == ("", "")


def test_missing_file_content(spark):
    files = spark.createDataFrame([("a.mxl", None), ("b.pdf", None)], "path string, content binary")
    got = {r.path: r.error for r in readers.unpack_archives(files).collect()}
    assert got["b.pdf"] is None and "unreadable archive" in got["a.mxl"]
