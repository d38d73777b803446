from correctionlab.operators import decisions
from correctionlab.operators import documents as D
from correctionlab.plans import queries, sizing
from correctionlab.sources import fixtures as fx


def test_more_rows_make_more_tasks(spark):
    enough = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sizing.tasks_for(spark, 10 * enough, 10) is None and sizing.tasks_for(spark, 0) is None
    assert sizing.tasks_for(spark, 10 * enough + 1, 10) == enough + 1


def test_dealt_queries_give_the_same_rows(spark, sf, monkeypatch):
    names = ("cascade_delete", "locate_edits", "apply_edits")
    want = [queries.QUERIES[n](spark, sf) for n in names]
    monkeypatch.setattr(queries, "tasks_for", lambda *_: 11)
    for name, plain in zip(names, want):
        got = queries.QUERIES[name](spark, sf)
        assert got.count() == plain.count() and got.exceptAll(plain).count() == 0


def test_joins_deal_the_big_side(spark, sf):
    diffs, measures = fx.diffs(spark, sf), fx.measures(spark, sf)
    gone = diffs.select("score_id").limit(1)
    _, kept, _ = decisions.delete_scores(fx.scores(spark, sf), diffs, diffs.select(diffs.id.alias("flagged_diff_id")), gone, 23)
    edits = D.find_measures(D.place_edits(D.edits_of(diffs), fx.parts(spark, sf)), measures, 23)
    for df in (kept, edits, D.apply_edits(measures, edits, tasks=23)):
        assert ", 23)" in df._jdf.queryExecution().executedPlan().toString()
