"""A task writes one SQLite file, so files must become more with the rows, not longer."""

import glob

from correctionlab.plans import queries as Q


def test_files_grow_in_number(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "scratch_path", lambda _, what: f"{tmp_path}/{what}")
    monkeypatch.setattr(Q, "SQLITE_ROWS", 500)
    rows = Q.sqlite_tables(spark, sf).count()
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    found = [f for f in glob.glob(f"{tmp_path}/sqlite/**", recursive=True) if open_header(f)]
    assert rows > 0 and len(found) == -(-lines // 500) > 8


def open_header(path):
    try:
        with open(path, "rb") as f:
            return f.read(15) == b"SQLite format 3"
    except IsADirectoryError:
        return False
