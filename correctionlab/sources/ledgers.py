"""Tables that change by small deltas: a base, numbered deltas, and a merge when they are read.

    {path}/base      snapshots; version n holds all deltas up to n
    {path}/deltas    one version for each change, numbered from 1

A writer adds a delta as large as its own change and reads nothing. Readers merge the deltas behind the newest base into it. From
time to time `compact` folds them into a new base. Merging must give the same whether deltas come at once or folded in between, in
any order within a call.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from correctionlab.sources import writers

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def start_ledger(df: DataFrame, path: str) -> None:
    """Make a ledger whose base is `df`; a ledger that is there stays as it is."""
    writers.commit(df, f"{path}/base", 0)


def append_delta(df: DataFrame, path: str, number: int, note: str = "") -> None:
    """Add the delta of this number (from 1); a repeated one changes nothing."""
    writers.commit(df, f"{path}/deltas", number, note)


def deltas(spark: SparkSession, path: str, after: int = 0, below: int | None = None) -> DataFrame | None:
    """All rows of the deltas with numbers after the one given; None where there are none. A missing column is null in older ones."""
    folders = [f for n, (f, _) in sorted(writers.committed(spark, f"{path}/deltas").items()) if n > after and (below is None or n < below)]
    return spark.read.option("mergeSchema", "true").parquet(*folders) if folders else None


def last_note(spark: SparkSession, path: str, below: int | None = None) -> str | None:
    """The note of the newest delta; None where there is none."""
    notes = {n: note for n, (_, note) in writers.committed(spark, f"{path}/deltas").items() if below is None or n < below}
    return notes[max(notes)] if notes else None


def read_ledger(spark: SparkSession, path: str, merge: Merge, below: int | None = None) -> DataFrame:
    """The table as of its newest delta, or of the newest one `below` a number."""
    bases = {n: f for n, (f, _) in writers.committed(spark, f"{path}/base").items() if below is None or n < below}
    if not bases:
        raise FileNotFoundError(f"no ledger at {path}")
    base = spark.read.parquet(bases[max(bases)])
    behind = deltas(spark, path, max(bases), below)
    return base if behind is None else merge(base, behind)


def compact(spark: SparkSession, path: str, merge: Merge) -> int:
    """Fold the deltas behind the newest base into a new one; gives the number up to which the base now holds them.

    Readers that began before go on with the old base, which `expire_ledger` deletes once nobody needs it. A delta that is being added
    meanwhile is behind the new base: writers count upwards.
    """
    newest = max(writers.committed(spark, f"{path}/deltas"), default=0)
    if newest > writers.latest_version(spark, f"{path}/base"):
        writers.commit(read_ledger(spark, path, merge, below=newest + 1), f"{path}/base", newest)
    return newest


def expire_ledger(spark: SparkSession, path: str) -> None:
    """Delete old bases and the deltas that the newest base holds, the newest delta's name and note excepted."""
    base = writers.latest_version(spark, f"{path}/base")
    writers.expire(spark, f"{path}/base", base)
    writers.expire(spark, f"{path}/deltas", min(base + 1, max(writers.committed(spark, f"{path}/deltas"), default=0)))
