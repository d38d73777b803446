from correctionlab.sources import fixtures as fx
from correctionlab.sources import readers as R


def test_kinds_come_with_their_own_columns(spark, sf):
    documents = fx.documents(spark, sf)
    whole = R.shred(documents)
    for kind, view in (("part", R.parts_of), ("measure", R.measures_of), ("error", R.errors_of), ("head", R.heads_of), ("group", R.groups_of)):
        some = R.shred(documents, (kind,))
        assert len(some.columns) < len(whole.columns)
        got, want = view(some), view(whole)
        assert got.schema == want.schema and got.count() == want.count() > 0
        assert got.exceptAll(want).count() == 0


def test_document_bodies_are_made_once(spark, sf):
    plan = fx.documents(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "<measure number=" in plan
