"""Every registered query equals its SQL counterpart on the smallest test set."""

import pytest

import __spark_entry__ as entry
import check_queries
from correctionlab.plans.oracles import ORACLES
from correctionlab.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return check_queries.duck(sf)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sf, con, name):
    ok, note = check_queries.compare(
        spark, con, sf, name, entry.queries()[name], entry.oracle_sql()[name]
    )
    assert ok, note
    assert "types" not in note, note
