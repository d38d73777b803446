"""What the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space: space and \t \n \v \f \r
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(text: Column) -> Column:
    """How many runs without white space `text` has: the white space runs, less those at the ends.

    Runs are cut down to one character each, so nothing the size of a word list is built.
    """
    one = F.regexp_replace(text, WORD, "x")
    return (F.length(one) - F.length(F.translate(one, "x", ""))).cast("long")


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone; 52 bits of their hash."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 12).cast("double") / F.lit(float(1 << 52))


def tidy(run):
    """`run` over batches, so that a worker gives memory back to the system when its task ends; workers live on and serve other stages."""

    def tidied(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return tidied
