"""Domain tables in SQLite files, as a Spark data source (S1).

    load_sqlite(spark, folder, "diffs", schemas.DIFFS, where=[("measure_number", ">=", 2), ("human_decision", "not null")])
    register_sqlite(spark)
    df.write.format("sqlite").options(path=folder, table="diffs").mode("append").save()

`path` is one SQLite file or a folder of them, on storage that all executors mount. Each file is read in ranges of its row ids, a
partition each, and filters that SQLite decides as Spark does run there. Only the columns of the schema are read. A write makes one
file a task, which appears in the folder when the job commits.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import sqlite3
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)

ROWS_AT_ONCE = 10_000
PARTITION_ROWS = 200_000
ENDING = ".sqlite"
# what SQLite holds for a Spark type; times are text, as object mappers write them
COLUMN_TYPES = {
    T.StringType: "TEXT", T.IntegerType: "INTEGER", T.LongType: "BIGINT", T.DoubleType: "DOUBLE", T.BooleanType: "BOOLEAN",
    T.TimestampType: "DATETIME", T.TimestampNTZType: "DATETIME",
}
SPARK_TYPES = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "REAL": "double", "FLOAT": "double", "BOOLEAN": "boolean", "DATETIME": "timestamp_ntz"}
COMPARISONS = ("=", "<>", ">", ">=", "<", "<=")
COMPARED = (T.StringType, T.IntegerType, T.LongType, T.DoubleType, T.BooleanType)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def local_path(path: str) -> str:
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def database_files(path: str) -> list[str]:
    """The file itself, or the files of a folder in order of their names."""
    path = local_path(path)
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(ENDING)) if os.path.isdir(path) else [path]


def opened(file: str) -> sqlite3.Connection:
    """A connection that only reads."""
    return sqlite3.connect(f"file:{file}?mode=ro", uri=True)


def conditions_of(where: list, columns: T.StructType) -> tuple[list[str], list]:
    """SQL conditions and their values for (column, comparison) or (column, comparison, value).

    Comparisons are = <> > >= < <=, in, null and not null, of columns of the schema; text compares by bytes, as in Spark. Times are text
    in SQLite and are not compared here.
    """
    found, values = [], []
    for name, how, *value in where:
        kind = type(columns[name].dataType)
        if how in ("null", "not null"):
            found.append(f"{quoted(name)} IS {how.upper()}")
        elif kind not in COMPARED:
            raise ValueError(f"{name} can't be compared in SQLite")
        elif how == "in":
            found.append(f"{quoted(name)} IN ({', '.join('?' * len(value[0]))})")
            values += value[0]
        elif how in COMPARISONS:
            found.append(f"{quoted(name)} {how} ?")
            values += value
        else:
            raise ValueError(f"no comparison {how}")
    return found, values


@dataclass
class RowRange(InputPartition):
    """Rows of one file with row ids in [low, high]."""

    file: str
    low: int
    high: int


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class SQLiteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        """The declared columns of the first file; what SQLite knows no Spark type for is a string."""
        with opened(database_files(self.options["path"])[0]) as con:
            columns = con.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        return ", ".join(f"`{c[1]}` {SPARK_TYPES.get(c[2].upper(), 'string')}" for c in columns)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SQLiteReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return SQLiteWriter(self.options, schema, overwrite)


class SQLiteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: T.StructType):
        self.path, self.table, self.columns = options["path"], options["table"], columns
        self.rows = int(options.get("rowsPerPartition", PARTITION_ROWS))
        self.conditions, self.values = conditions_of(json.loads(options.get("where", "[]")), columns)

    def partitions(self) -> list[RowRange]:
        """Even ranges of row ids, about `rowsPerPartition` rows each where ids are dense; the bounds come from each file's index."""
        found = []
        for file in database_files(self.path):
            with opened(file) as con:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            if low is not None:
                found += [RowRange(file, at, min(at + self.rows - 1, high)) for at in range(low, high + 1, self.rows)]
        return found

    def read(self, partition: RowRange | None):
        if partition is None:  # of a table without rows
            return
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.columns)
        where = " AND ".join(["rowid BETWEEN ? AND ?", *self.conditions])
        select = ", ".join(quoted(n) for n in self.columns.names) or "NULL"
        times = [isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) for f in self.columns.fields]
        truths = [isinstance(f.dataType, T.BooleanType) for f in self.columns.fields]
        with opened(partition.file) as con:
            rows = con.execute(f"SELECT {select} FROM {quoted(self.table)} WHERE {where}", [partition.low, partition.high, *self.values])
            while some := rows.fetchmany(ROWS_AT_ONCE):
                arrays = []
                for values, field, time, truth in zip(zip(*some), schema, times, truths):
                    if time:
                        values = [v and dt.datetime.fromisoformat(v) for v in values]
                        if field.type.tz:
                            values = [v and (v if v.tzinfo else v.replace(tzinfo=dt.UTC)) for v in values]
                    elif truth:
                        values = [None if v is None else bool(v) for v in values]
                    arrays.append(pa.array(values, field.type))
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)


class SQLiteWriter(DataSourceArrowWriter):
    """One file a task below a hidden folder; the files move to their place when the job commits."""

    def __init__(self, options: dict[str, str], columns: T.StructType, overwrite: bool):
        self.path, self.table, self.columns, self.overwrite = local_path(options["path"]), options["table"], columns, overwrite
        self.staged = os.path.join(self.path, f"_staged-{uuid.uuid4().hex}")
        odd = [f.name for f in columns.fields if type(f.dataType) not in COLUMN_TYPES]
        if odd:
            raise ValueError(f"no SQLite type for {', '.join(odd)}")
        os.makedirs(self.staged, exist_ok=True)

    def write(self, iterator) -> Written:
        fields = self.columns.fields
        made = ", ".join(f"{quoted(f.name)} {COLUMN_TYPES[type(f.dataType)]}{'' if f.nullable else ' NOT NULL'}" for f in fields)
        file = os.path.join(self.staged, f"part-{uuid.uuid4().hex}{ENDING}")
        con = None
        for batch in iterator:
            if con is None:
                con = sqlite3.connect(file, isolation_level=None)
                con.execute("PRAGMA journal_mode = OFF")
                con.execute("PRAGMA synchronous = OFF")
                con.execute(f"CREATE TABLE {quoted(self.table)} ({made})")
                con.execute("BEGIN")
            columns = []
            for array, field in zip(batch.columns, fields):
                values = array.to_pylist()
                if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
                    values = [v and v.replace(tzinfo=None).isoformat(" ", "microseconds") for v in (x and (x if x.tzinfo is None else x.astimezone(dt.UTC)) for x in values)]
                columns.append(values)
            con.executemany(f"INSERT INTO {quoted(self.table)} VALUES ({', '.join('?' * len(fields))})", zip(*columns))
        if con is None:
            return Written(None)
        con.execute("COMMIT")
        con.close()
        return Written(file)

    def commit(self, messages) -> None:
        old = database_files(self.path) if self.overwrite else []
        for m in messages:
            if m is not None and m.file:
                os.replace(m.file, os.path.join(self.path, os.path.basename(m.file)))
        for file in old:
            os.remove(file)
        self.abort(messages)

    def abort(self, messages) -> None:
        """Nothing of what was staged is left."""
        if os.path.isdir(self.staged):
            for name in os.listdir(self.staged):
                os.remove(os.path.join(self.staged, name))
            os.rmdir(self.staged)


def register_sqlite(spark: SparkSession) -> None:
    """Make format "sqlite" known to a session."""
    spark.dataSource.register(SQLiteSource)


def load_sqlite(
    spark: SparkSession, path: str, table: str, schema: T.StructType | str | None = None, where: list[tuple] = (), **options: str
) -> DataFrame:
    """A table of SQLite files; times are those of UTC. Without a schema the declared columns of the first file are read.

    `where` holds conditions that all must be true, for `conditions_of`; they run in SQLite.
    """
    register_sqlite(spark)
    reader = spark.read.format("sqlite").options(path=path, table=table, where=json.dumps(list(where)), **options)
    return (reader.schema(schema) if schema is not None else reader).load()


def write_sqlite(df: DataFrame, path: str, table: str, mode: str = "append") -> None:
    """Write a table as SQLite files, one a partition that has rows."""
    register_sqlite(df.sparkSession)
    df.write.format("sqlite").options(path=path, table=table).mode(mode).save()
