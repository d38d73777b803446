import datetime as dt
import sqlite3

import pytest
from pyspark.sql import functions as F

from correctionlab.sources import sqlite as S

T0 = dt.datetime(2024, 5, 1, 12, 30, 0, 250)
ROW = "id string, n int, big bigint, x double, ok boolean, at timestamp, local timestamp_ntz"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(
        [("a", 1, 2**40, 0.5, True, T0, T0), ("b'; --", None, -1, None, False, None, None), ("漢", 7, 0, -2.5, None, T0, T0)], ROW)


def test_round_trip(spark, tmp_path, rows):
    path = str(tmp_path / "db")
    S.write_sqlite(rows.repartition(3), path, "things")
    back = S.load_sqlite(spark, path, "things", ROW)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    assert not [f for f in (tmp_path / "db").iterdir() if not f.name.endswith(S.ENDING)]
    S.write_sqlite(rows.limit(1), path, "things")
    assert S.load_sqlite(spark, path, "things").count() == 4
    S.write_sqlite(rows.limit(1), path, "things", mode="overwrite")
    assert S.load_sqlite(spark, path, "things").count() == 1


def test_ranges_filters_and_columns_of_a_file_made_elsewhere(spark, tmp_path):
    file = tmp_path / "store.db"
    with sqlite3.connect(file) as con:
        con.execute("create table diffs (id text, n integer, kind varchar(20), at datetime)")
        con.executemany("insert into diffs values (?, ?, ?, ?)", [(f"d{k}", k % 10, None if k % 7 == 0 else "Note" if k % 2 else "note", "2024-05-01 10:00:00.000000") for k in range(1_000)])
        con.execute("delete from diffs where rowid between 300 and 500")
    table = S.load_sqlite(spark, str(file), "diffs", rowsPerPartition="128")
    assert table.rdd.getNumPartitions() == 8 and table.count() == 799
    assert [f.dataType.simpleString() for f in table.schema] == ["string", "int", "string", "timestamp_ntz"]
    all_rows = [r.asDict() for r in table.collect()]
    for where, python in [([("n", ">=", 3), ("n", "<", 5)], lambda r: 3 <= r["n"] < 5), ([("kind", "=", "note")], lambda r: r["kind"] == "note"),
                          ([("kind", "null")], lambda r: r["kind"] is None), ([("n", "in", [1, 2]), ("kind", "not null")], lambda r: r["n"] in (1, 2) and r["kind"]),
                          ([("kind", ">", "Z")], lambda r: (r["kind"] or "") > "Z"), ([("id", "<>", "d1' or '1")], lambda r: True)]:
        got = S.load_sqlite(spark, str(file), "diffs", where=where, rowsPerPartition="300")
        assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in all_rows if python(r)), where
    assert sorted(r["id"] for r in table.where("kind > 'Z' or n = 1").collect()) == sorted(r["id"] for r in all_rows if (r["kind"] or "") > "Z" or r["n"] == 1)
    narrow = S.load_sqlite(spark, str(file), "diffs", "n int")
    assert narrow.agg(F.sum("n")).first()[0] == sum(r["n"] for r in all_rows)


def test_conditions_become_sql_with_values_apart():
    from pyspark.sql import types as T

    columns = T.StructType([T.StructField("n", T.IntegerType()), T.StructField('s"x', T.StringType()), T.StructField("at", T.TimestampType())])
    assert S.conditions_of([("n", "=", 3), ('s"x', "in", ["it's"])], columns) == (['"n" = ?', '"s""x" IN (?)'], [3, "it's"])
    for wrong in (("at", "=", "2024"), ("n", "= 1 or", 1)):
        with pytest.raises(ValueError):
            S.conditions_of([wrong], columns)


def test_a_failed_write_leaves_nothing(spark, tmp_path, rows):
    with pytest.raises(Exception):
        S.write_sqlite(rows.withColumn("id", F.raise_error(F.lit("no")).cast("string")), str(tmp_path / "db"), "things")
    assert not list((tmp_path / "db").iterdir())
    with pytest.raises(Exception, match="no SQLite type"):
        S.write_sqlite(rows.select(F.array("id").alias("ids")), str(tmp_path / "other"), "things")


def test_empty_tables(spark, tmp_path, rows):
    with sqlite3.connect(tmp_path / "e.db") as con:
        con.execute("create table t (id text)")
    assert S.load_sqlite(spark, str(tmp_path / "e.db"), "t").count() == 0
