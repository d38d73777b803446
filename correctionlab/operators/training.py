"""Export of reviewed diffs as a training dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from correctionlab.functions import fixed_values as V
from correctionlab.functions.expressions import blank_to_null


def eligible(diffs: DataFrame) -> DataFrame:
    """Accepted or edited diffs that have an image; label is the edit, else the snippet."""
    return diffs.where(
        F.col("human_decision").isin("accept", "edit") & (F.col("pdf_snippet_path") != "")
    ).withColumn(
        "label", F.coalesce(blank_to_null(F.col("human_edit_value")), F.col("musicxml_snippet_path"))
    )


def _split_of(ordinal: Column) -> Column:
    return F.when(ordinal % 10 == 0, "test").when(ordinal % 10 == 9, "val").otherwise("train")


def assign_split(df: DataFrame, key: str, mode: str = "ordinal", digits: int = 4) -> DataFrame:
    """80/10/10 split by position (`ordinal`) or by key alone (`hash`).

    Ordinal numbers every row 1, 2, 3, ... in the order of (md5(key), key). The first `digits` hex
    digits of the digest cut the rows into 16**digits evenly filled ranges of that order, whatever
    the keys look like. Rows are numbered inside their range in parallel, and each range adds the
    count of the rows before it. Those counts are one row per range, so their table is bounded by
    16**digits rows and safe to broadcast. Hash mode needs no shuffle, but is 80/10/10 only on
    average.
    """
    if mode == "hash":
        bucket = F.pmod(F.xxhash64(key), F.lit(10))
        return df.withColumn("split", _split_of(bucket))
    if mode != "ordinal":
        raise ValueError(f"mode must be ordinal or hash, not {mode!r}")
    keyed = df.withColumn("_digest", F.md5(F.col(key).cast("string").cast("binary")))
    keyed = keyed.withColumn("_range", F.substring("_digest", 1, digits))
    counts = keyed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy("_digest", key)
    ordinal = F.row_number().over(inside) + F.col("_before")
    return (
        keyed.join(F.broadcast(offsets), "_range")
        .withColumn("ordinal", ordinal)
        .withColumn("split", _split_of(F.col("ordinal")))
        .drop("_digest", "_range", "_before")
    )


def finetuning_rows(diffs: DataFrame, as_of: Column, mode: str = "ordinal") -> DataFrame:
    """Dataset rows with their split."""
    chosen = eligible(diffs).select(
        F.col("id").alias("flagged_diff_id"), F.col("pdf_snippet_path").alias("image_path"), "label"
    )
    return assign_split(chosen, "flagged_diff_id", mode).select(
        F.sha2(F.concat(F.lit("ft|"), "flagged_diff_id"), 256).alias("id"),
        "flagged_diff_id", "image_path",
        F.coalesce("label", F.lit("")).alias("label"),
        "split",
        as_of.alias("exported_at"),
    )


def append_finetuning(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rows and those new rows whose diff is not in the dataset yet."""
    return existing.unionByName(new.join(existing, "flagged_diff_id", "left_anti"))


def training_records(diffs: DataFrame) -> DataFrame:
    """One record per eligible diff: image_path, label, metadata."""
    metadata = F.struct(*[F.col(ours).alias(key) for key, ours in V.TRAINING_METADATA_KEYS.items()])
    return eligible(diffs).select(
        "id", F.col("pdf_snippet_path").alias("image_path"), "label", metadata.alias("metadata")
    )
