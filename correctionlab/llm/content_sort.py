"""Exact duplicates by sorting contents (operator 4).

Texts without their white space are dealt to ranges between sampled splitters, sorted there by Spark's external sort, and
each is compared in full with its neighbour: a group ends where a text differs from the one before it. Nothing is decided
by a digest.

Splitters are sampled on the driver, so they must be small: ranges follow the first `PREFIX` characters, and among texts that
share these a hash of the whole. Equal texts stay adjacent, and texts with a common beginning don't fill one range.

A text with a large share of all rows would fill one range. So copies are counted first by a 64-bit hash, which only
serves to spread work: a text with more than 1/`PIECES` of all rows is cut into pieces of about that size by a second sort
key. The first of each piece then meets the firsts of the others in a second content sort, which has at most
2 x `PIECES` rows because the pieces can't be smaller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from correctionlab.llm.common import SPACES, text_or_empty
from correctionlab.plans.sizing import cut_lineage

# Texts with more than 1/PIECES of all rows are split; so at most PIECES texts are, and their list is small (16 bytes each).
PIECES = 16_384
LEAST_COPIES = 8
PREFIX = 32


def exact_groups(docs: DataFrame, pieces: int = PIECES, least_copies: int = LEAST_COPIES, name: str = "content") -> DataFrame:
    """One row for each row of `docs` (doc_id, text, ...): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without ASCII white space; null counts as empty, and all empty texts are one
    group. Of equal texts the one with the most code points stays, then the smallest doc_id (null before all).
    Of rows that repeat doc_id and text exactly one has `kept`. Other columns are ignored.
    """
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.translate(text_or_empty("text"), SPACES, "").alias("content"),
        F.length(text_or_empty("text")).alias("chars"),
    ).withColumn("hash", F.xxhash64("content"))
    most = max(least_copies, -(-docs.count() // pieces))
    hot = (
        base.groupBy("hash").agg(F.count("*").alias("copies")).where(F.col("copies") > most)
        .select("hash", F.ceil(F.col("copies") / most).cast("int").alias("parts"))
    )
    rows = base.join(F.broadcast(hot), "hash", "left").withColumn(
        "piece", F.when(F.col("parts").isNull(), -1).otherwise(F.pmod(F.xxhash64("doc_id", "chars"), F.col("parts")).cast("int"))
    )
    # the range partitioning satisfies the window, so whole texts move once
    rows = rows.withColumn("prefix", F.left("content", F.lit(PREFIX)))
    piece = Window.partitionBy("prefix", "hash", "piece", "content")
    in_order = piece.orderBy(F.desc("chars"), "doc_id")
    sorted_rows = (
        rows.repartitionByRange("prefix", "hash", "piece")
        .select(
            "doc_id", "chars", "hash", "piece", "content",
            F.row_number().over(in_order).alias("place"),
            F.first("doc_id").over(in_order).alias("first_id"),
            F.count("*").over(piece).alias("rows"),
        )
        .select(
            "doc_id", "chars", "hash", "piece", "place", "first_id", "rows", F.sha2("content", 256).alias("text_sha256"),
            F.when((F.col("piece") >= 0) & (F.col("place") == 1), F.col("content")).alias("content"),
        )
    )
    placed = cut_lineage(sorted_rows, name)
    whole = Window.partitionBy("hash", "content")
    firsts = (
        placed.where(F.col("content").isNotNull())
        .select("hash", "content", "piece", "doc_id", "chars", "rows", "text_sha256")
        .repartitionByRange("hash")
        .select(
            "text_sha256", "piece",
            F.row_number().over(whole.orderBy(F.desc("chars"), "doc_id")).alias("piece_place"),
            F.first("doc_id").over(whole.orderBy(F.desc("chars"), "doc_id")).alias("all_first"),
            F.sum("rows").over(whole).alias("all_rows"),
        )
    )
    # at most 2 x PIECES rows without texts
    return placed.join(F.broadcast(firsts), ["text_sha256", "piece"], "left").select(
        "doc_id",
        F.when(F.col("piece") < 0, F.col("first_id")).otherwise(F.col("all_first")).alias("keep_id"),
        F.when(F.col("piece") < 0, F.col("rows")).otherwise(F.col("all_rows")).alias("group_size"),
        ((F.col("place") == 1) & ((F.col("piece") < 0) | (F.col("piece_place") == 1))).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The doc_ids that stay."""
    return exact_groups(docs).where("kept").select("doc_id")
