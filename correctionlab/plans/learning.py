"""The learning update as one job: analyse, merge into the knowledge base, promote rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from correctionlab import schemas
from correctionlab.operators.patterns import as_patterns, correction_patterns, update_knowledge_base
from correctionlab.operators.rules import promote_rules
from correctionlab.sources.writers import read_snapshot, write_snapshot


def learning_update(
    analysis: DataFrame, patterns: DataFrame, rules: DataFrame, as_of: Column, deactivate_below: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(patterns, rules) after an analysis. Lazy; the second result contains the plan of the first."""
    merged = update_knowledge_base(patterns, analysis, as_of).drop("change")
    return merged, promote_rules(merged, rules, as_of, deactivate_below)


def _empty_patterns(analysis: DataFrame, as_of: Column) -> DataFrame:
    return as_patterns(analysis, as_of).limit(0)


def _empty_rules(spark: SparkSession, as_of: Column) -> DataFrame:
    empty = spark.createDataFrame([], schemas.RULES)
    kind = spark.range(1).select(as_of.alias("t")).schema["t"].dataType
    return empty.withColumn("created_at", F.col("created_at").cast(kind))


def store_learning_update(
    spark: SparkSession, root: str, analysis: DataFrame, version: int, as_of: Column
) -> None:
    """Write the next version of patterns and rules below `root`.

    Rules are promoted from the written patterns, so the diffs are read once. Both writes leave a
    version alone that exists, so a job that is started again with the same number changes nothing.
    """
    def stored(name: str, empty: DataFrame) -> DataFrame:
        before = read_snapshot(spark, f"{root}/{name}", below=version)
        return empty if before is None else before

    old_patterns = stored("patterns", _empty_patterns(analysis, as_of))
    merged = update_knowledge_base(old_patterns, analysis, as_of).drop("change")
    path = write_snapshot(merged, f"{root}/patterns", version)
    written = spark.read.parquet(path)
    old_rules = stored("rules", _empty_rules(spark, as_of))
    write_snapshot(promote_rules(written, old_rules, as_of), f"{root}/rules", version)


def run_learning_update(spark: SparkSession, root: str, diffs: DataFrame, version: int, as_of: Column) -> None:
    """The update a user triggers by hand, over all diffs."""
    store_learning_update(spark, root, correction_patterns(diffs), version, as_of)
