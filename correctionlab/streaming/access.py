"""Payment webhooks and request limits on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from correctionlab.functions import fixed_values as V
from correctionlab.operators.access import (
    completed_sessions, completions, in_own_window, merge_completed, merge_grants, new_grants, over_limit,
)
from correctionlab.sources import ledgers


def start_books(payments: DataFrame, score_access: DataFrame, root: str) -> None:
    """Make the two ledgers that settlement adds to, `payments` and `score_access` below `root`."""
    ledgers.start_ledger(payments.withColumn("completed_event", F.lit(None).cast("long")), f"{root}/payments")
    ledgers.start_ledger(score_access, f"{root}/score_access")


def settle_batch(root: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that adds the batch's completed sessions and grants as deltas below `root`.

    A batch writes as many rows as it has sessions and grants, and reads neither table. Batch b adds delta b + 1 to both ledgers;
    a batch that runs again changes nothing. No completion is too late, so there is no watermark and no state: repeats are
    reduced when the ledgers are read (`payments_now`, `score_access_now`) or folded (`compact_books`).
    """
    def settle(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        ledgers.append_delta(completed_sessions(held), f"{root}/payments", batch_id + 1)
        ledgers.append_delta(new_grants(held), f"{root}/score_access", batch_id + 1)
        held.unpersist()

    return settle


def _in_type_of(column: str, base_column: str, merge: Callable) -> Callable:
    """Merging with the deltas' times in the type that the base has."""
    return lambda base, changes: merge(base, changes.withColumn(column, F.col(column).cast(dict(base.dtypes)[base_column])))


MERGE_PAYMENTS = _in_type_of("ts", "completed_at", merge_completed)
MERGE_GRANTS = _in_type_of("granted_at", "granted_at", merge_grants)


def payments_now(spark: SparkSession, root: str) -> DataFrame:
    return ledgers.read_ledger(spark, f"{root}/payments", MERGE_PAYMENTS).drop("completed_event")


def score_access_now(spark: SparkSession, root: str) -> DataFrame:
    return ledgers.read_ledger(spark, f"{root}/score_access", MERGE_GRANTS)


def compact_books(spark: SparkSession, root: str) -> None:
    """Fold the deltas into new bases; run it as a job of its own, as often as reading gets slow. The stream may go on meanwhile."""
    ledgers.compact(spark, f"{root}/payments", MERGE_PAYMENTS)
    ledgers.compact(spark, f"{root}/score_access", MERGE_GRANTS)


def start_settlement(
    bodies: DataFrame, root: str, checkpoint: str, **trigger: object
) -> StreamingQuery:
    return (
        completions(bodies).writeStream.foreachBatch(settle_batch(root))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def start_over_limit(
    requests: DataFrame, limit: int, window: str, delay: str, path: str, checkpoint: str, **trigger: object
) -> StreamingQuery:
    """Append clients over the limit once their window is closed; later requests are dropped."""
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return (
        over_limit(timed, limit, window).writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


OPEN_WINDOWS = "starts array<long>, ends array<long>, counts array<long>, allowed long"
CLOSED = "action string, client string, start long, end long, requests long"


def count_windows(key, batches, state):
    """Open windows of one client and action, in ms; a window over its limit comes out when the watermark has passed its end."""
    import pandas as pd

    starts, ends, counts, allowed = state.get if state.exists else ((), (), (), 0)
    held = {int(s): [int(e), int(n)] for s, e, n in zip(starts, ends, counts)}
    if not state.hasTimedOut:
        for rows in batches:
            for (start, end, limit), n in rows.groupby(["start", "end", "allowed"]).size().items():
                held.setdefault(int(start), [int(end), 0])[1] += int(n)
                allowed = int(limit)
    mark = state.getCurrentWatermarkMs()
    closed = [(s, e, n) for s, (e, n) in sorted(held.items()) if e <= mark]
    held = {s: x for s, x in held.items() if x[0] > mark}
    if held:
        state.update(([*held], [e for e, _ in held.values()], [n for _, n in held.values()], allowed))
        state.setTimeoutTimestamp(max(min(e for e, _ in held.values()) - 1, mark + 1))
    elif state.exists:
        state.remove()
    told = [(*key, s, e, n) for s, e, n in closed if n > allowed]
    if told:
        yield pd.DataFrame(told, columns=[c.split()[0] for c in CLOSED.split(", ")])


def start_over_request_limits(
    requests: DataFrame, delay: str, path: str, checkpoint: str,
    limits: dict[str, tuple[int, str]] = V.REQUEST_LIMITS, **trigger: object,
) -> StreamingQuery:
    """Append (action, client, window_start, window_end, requests) over the limit of their action once their window is closed.

    One operator keeps the open windows of all actions, whatever their lengths; a timer in event time closes them. Requests later than
    `delay` are dropped. A client's state is its open windows alone.
    """
    timed = requests.select(F.col("client").cast("string").alias("client"), F.col("ts").cast("timestamp").alias("ts"), "action").withWatermark("ts", delay)
    placed = in_own_window(timed, limits).select(
        "action", "client", "ts", F.unix_millis("window_start").alias("start"), F.unix_millis("window_end").alias("end"), F.col("allowed").cast("long").alias("allowed"))
    closed = placed.groupBy("action", "client").applyInPandasWithState(count_windows, CLOSED, OPEN_WINDOWS, "append", "EventTimeTimeout")
    told = closed.select(
        "action", "client", F.timestamp_millis("start").alias("window_start"), F.timestamp_millis("end").alias("window_end"), "requests")
    return (
        told.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
