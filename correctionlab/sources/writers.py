"""Writing results: training records, datasets, documents and table snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_finetuning_jsonl(records: DataFrame, path: str) -> None:
    """One JSON object a line with image_path, label and metadata; nulls are written."""
    records.select("image_path", "label", "metadata").write.option("ignoreNullFields", "false").json(path)


def write_finetuning_dataset(rows: DataFrame, path: str) -> None:
    """Dataset rows, one folder per split."""
    rows.write.partitionBy("split").parquet(path)


def write_corrected(lines: DataFrame, path: str) -> None:
    """Documents as text, one folder per score.

    A range sort spreads a long document over several tasks; its files, read in name order, are the
    document. Lines of a score never gather in one row.
    """
    keys = ["score_id", "section", "seq"]
    lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select("score_id", "line").write.partitionBy(
        "score_id"
    ).text(path)


def write_parts(lines: DataFrame, path: str) -> None:
    """Part documents as text, one folder per score and part file."""
    keys = ["score_id", "file_name", "section", "seq"]
    lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "score_id", "file_name", "line"
    ).write.partitionBy("score_id", "file_name").text(path)


# --- snapshots of mutable tables ------------------------------------------------


def _file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path; only names pass through the driver."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def committed(spark: SparkSession, table_path: str) -> dict[int, tuple[str, str]]:
    """Versions of a table: number to (data folder, note), by one listing of names; of a version committed twice the first by name counts."""
    files, folder = _file_system(spark, f"{table_path}/versions")
    if not files.exists(folder):
        return {}
    found: dict[int, tuple[str, str]] = {}
    for name in sorted(status.getPath().getName() for status in files.listStatus(folder)):
        number, token, *note = name.split("-", 2)
        found.setdefault(int(number[1:]), (f"{table_path}/data/{number}-{token}", "".join(note)))
    return found


def commit(df: DataFrame, table_path: str, version: int, note: str = "", known: dict | None = None) -> str:
    """Write `df` as a version of a table, to a folder of its own, and make it visible by an empty file that names folder and note.

    A version that is there already stays as it is, so a repeated batch changes nothing. Readers of other versions are not disturbed.
    """
    spark = df.sparkSession
    known = committed(spark, table_path) if known is None else known
    if version in known:
        return known[version][0]
    name = f"v{version:019d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{table_path}/data/{name}")
    files, marker = _file_system(spark, f"{table_path}/versions/{name}" + (f"-{note}" if note else ""))
    files.create(marker, False).close()
    return f"{table_path}/data/{name}"


def expire(spark: SparkSession, table_path: str, keep_from: int) -> list[int]:
    """Delete the versions below `keep_from`, names first, so that no reader finds a version without its data."""
    gone = {v: folder for v, (folder, _) in committed(spark, table_path).items() if v < keep_from}
    files, names = _file_system(spark, f"{table_path}/versions")
    if gone:
        for status in files.listStatus(names):
            if int(status.getPath().getName().split("-", 1)[0][1:]) in gone:
                files.delete(status.getPath(), False)
    for folder in gone.values():
        files.delete(_file_system(spark, folder)[1], True)
    return sorted(gone)


def write_snapshot(df: DataFrame, table_path: str, version: int) -> str:
    """Write `df` as a whole version of a table; see `commit`."""
    return commit(df, table_path, version)


def latest_version(spark: SparkSession, table_path: str) -> int | None:
    return max(committed(spark, table_path), default=None)


def read_snapshot(
    spark: SparkSession, table_path: str, version: int | None = None, below: int | None = None
) -> DataFrame | None:
    """A version of a table: the given one, or the latest, or the latest before `below`.

    None when there is no such version.
    """
    known = {v: p for v, (p, _) in committed(spark, table_path).items() if below is None or v < below}
    wanted = max(known, default=None) if version is None else version
    return spark.read.parquet(known[wanted]) if wanted in known else None
