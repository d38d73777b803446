"""The learning loop per micro-batch, and matching of new diffs as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from correctionlab.operators.patterns import add_counts, decision_counts, rate_counts
from correctionlab.operators.rules import auto_accept
from correctionlab.plans.learning import store_learning_update
from correctionlab.plans.sizing import broadcast_within
from correctionlab.sources import ledgers, writers
from correctionlab.sources.writers import read_snapshot, write_snapshot


def learn_from_batch(
    root: str, as_of: Callable[[int], Column] = lambda batch_id: F.current_timestamp()
) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that folds reviewed diffs into counts, patterns and rules below `root`.

    A batch holds newly reviewed diffs (instrument, difference_type, human_decision), with a weight
    of -1 for a decision that is taken back. Only the batch and the small count table are read, not
    the diffs seen before. All three tables get the batch id as version, and a version that exists
    is never written again: a batch that runs twice counts once.
    """
    def learn(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counts = decision_counts(batch)
        before = read_snapshot(spark, f"{root}/counts", below=batch_id)
        if before is not None:
            counts = add_counts(before, counts)
        written = spark.read.parquet(write_snapshot(counts, f"{root}/counts", batch_id))
        store_learning_update(spark, root, rate_counts(written), batch_id, as_of(batch_id))

    return learn


def start_learning(
    reviewed: DataFrame, root: str, checkpoint: str,
    as_of: Callable[[int], Column] = lambda batch_id: F.current_timestamp(), **trigger: object,
) -> StreamingQuery:
    return (
        reviewed.writeStream.foreachBatch(learn_from_batch(root, as_of))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def start_auto_accept(
    new_diffs: DataFrame, candidates: DataFrame, path: str, checkpoint: str, **trigger: object
) -> StreamingQuery:
    """Append new diffs with the rule that accepts them: a join of the stream with a static table.

    The rules are those of the start of the query; `start_live_accept` follows rules that change.
    """
    return (
        auto_accept(new_diffs, candidates).writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


# --- rules that change while diffs arrive ------------------------------------------

RULES = "rules"
MATCHES = "matches"


def publish_rules(candidates: DataFrame, root: str, version: int) -> None:
    """Make a version of `rule_candidates` known to the running matching below `root`; its next micro-batch uses it."""
    writers.commit(candidates, f"{root}/{RULES}", version)


def match_batch(root: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that gives new diffs the oldest rule they satisfy, by the newest published rules.

    Batch b commits one delta, b + 1: the diffs it was given or found waiting, with a rule or without. Diffs without one wait; when
    the rules have changed since the last batch, those waiting whose type has rules now are matched again. All of a
    batch is one commit, whose note is the version of the rules, so a batch that runs again, perhaps by other rules, neither loses nor
    doubles a diff.
    """
    def match(batch: DataFrame, batch_id: int) -> None:
        spark, number = batch.sparkSession, batch_id + 1
        version = writers.latest_version(spark, f"{root}/{RULES}")
        before = ledgers.last_note(spark, f"{root}/{MATCHES}", below=number)
        new = batch
        if version is None:
            candidates = None
        else:
            candidates = broadcast_within(writers.read_snapshot(spark, f"{root}/{RULES}", version))
            if before is not None and before != str(version):
                ruled = candidates.select("difference_type").distinct()
                new = new.unionByName(waiting_diffs(spark, root, below=number).join(ruled, "difference_type", "left_semi").select(*batch.columns))
        told = _unmatched(new) if candidates is None else auto_accept(new, candidates)
        ledgers.append_delta(told, f"{root}/{MATCHES}", number, note="" if version is None else str(version))

    return match


def _unmatched(diffs: DataFrame) -> DataFrame:
    return diffs.withColumn("auto_accepted", F.lit(False)).withColumn("auto_accept_rule_id", F.lit(None).cast("string"))


def _settle_matches(base: DataFrame, changes: DataFrame) -> DataFrame:
    """One row a diff: with its rule if it has got one, else waiting. A diff gets a rule once, so both are its only rows."""
    both = base.unionByName(changes, allowMissingColumns=True)
    best = F.max_by(F.struct(*[F.col(c) for c in both.columns if c != "id"]), F.col("auto_accepted"))
    return both.groupBy("id").agg(best.alias("row")).select("id", "row.*").select(*both.columns)


def matches_now(spark: SparkSession, root: str, below: int | None = None) -> DataFrame:
    """Every diff that came, with its rule or waiting for one (auto_accepted is false)."""
    return ledgers.read_ledger(spark, f"{root}/{MATCHES}", _settle_matches, below)


def waiting_diffs(spark: SparkSession, root: str, below: int | None = None) -> DataFrame:
    return matches_now(spark, root, below).where(~F.col("auto_accepted"))


def compact_matches(spark: SparkSession, root: str) -> None:
    ledgers.compact(spark, f"{root}/{MATCHES}", _settle_matches)


def start_live_accept(
    new_diffs: DataFrame, root: str, checkpoint: str, **trigger: object
) -> StreamingQuery:
    """Match new diffs (id, instrument, difference_type, confidences) as they arrive, by rules that may change meanwhile.

    Publish rules by `publish_rules`, read results by `matches_now`, fold them by `compact_matches`. Waiting diffs are matched again
    by the first batch after a new version; a batch with no new diffs is enough.
    """
    empty = _unmatched(new_diffs.sparkSession.createDataFrame([], new_diffs.schema))
    ledgers.start_ledger(empty, f"{root}/{MATCHES}")
    return (
        new_diffs.writeStream.foreachBatch(match_batch(root))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
