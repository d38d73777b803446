"""Latest decision per diff, kept up to date from a stream of decisions.

There is no state in the query: a micro-batch adds what it decided, reduced to a row a diff, to a ledger, and readers take the greatest
of all by (ts, event_id). So nothing is held for settled diffs, a decision of any age counts by its time, and a restart
needs the stream's offsets alone. `compact_decisions` folds the deltas, as often as reading gets slow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from correctionlab.operators.decisions import decision_is_valid, latest_decisions
from correctionlab.sources import ledgers


def merge_latest(before: DataFrame, changes: DataFrame) -> DataFrame:
    """The greatest last decision and last edit value of each diff; the same in whatever order changes come."""
    return before.unionByName(changes).groupBy("diff_id").agg(
        F.max("last").alias("last"), F.max("last_single").alias("last_single")
    )


def start_latest_decisions(
    log: DataFrame, path: str, checkpoint: str, **trigger: object
) -> StreamingQuery:
    """Add the latest valid decisions of each micro-batch to the ledger at `path`; a batch that runs again changes nothing."""
    nothing = log.sparkSession.createDataFrame([], log.schema)
    ledgers.start_ledger(latest_decisions(nothing), path)

    def add(batch: DataFrame, batch_id: int) -> None:
        ledgers.append_delta(latest_decisions(batch), path, batch_id + 1)

    return (
        log.where(decision_is_valid()).writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def read_latest_decisions(spark: SparkSession, path: str) -> DataFrame:
    """The newest row per diff over all batches, in the form `with_latest` takes."""
    return ledgers.read_ledger(spark, path, merge_latest)


def compact_decisions(spark: SparkSession, path: str) -> int:
    return ledgers.compact(spark, path, merge_latest)
