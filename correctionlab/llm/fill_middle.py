"""Fill-in-middle transformation (operator 13): blocks exchanged in place by three reversals.

A text becomes prefix, middle and suffix at two cuts drawn from its document's id. The three lie in a bytearray, each
behind its sentinel:

    <P>prefix<M>middle<S>suffix

and two neighbouring blocks x y change places by reversing x, reversing y and reversing both together, so nothing but the
array itself is needed:

    psm   the blocks of middle and suffix      <P>prefix<S>suffix<M>middle
    spm   the block of suffix and all before   <S>suffix<P>prefix<M>middle

The same rotations with the lengths exchanged restore the first form; without its sentinels it is the text. Cuts are
counted in code points and found in the bytes by their lead bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Form:
    """Sentinels, the seed of the draws, and the shares in percent: texts transformed, and spm among these."""

    prefix: str = "<P>"
    middle: str = "<M>"
    suffix: str = "<S>"
    seed: str = "1"
    transformed: int = 90
    spm: int = 20


def draw(doc_id: Column, seed: str, k: int) -> Column:
    """The k-th of eight numbers below 2^32 drawn for a document; a null id is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def plan(docs: DataFrame, form: Form = Form()) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars) for each row of `docs`: what is drawn, before anything moves."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.length("text").cast("long"))
    first, second = (F.pmod(draw(F.col("doc_id"), form.seed, k), F.col("n") + 1) for k in (0, 1))
    marked = F.lit(False)
    for sentinel in (form.prefix, form.suffix, form.middle):
        marked = marked | F.contains("text", F.lit(sentinel))
    plain = (F.col("n") == 0) | marked | (draw(F.col("doc_id"), form.seed, 2) % 100 >= form.transformed)
    name = F.when(plain, "plain").when(draw(F.col("doc_id"), form.seed, 3) % 100 < form.spm, "spm").otherwise("psm")
    moved = F.col("form") != "plain"
    return rows.withColumn("form", name).select(
        "doc_id", "text", "n", "form",
        F.when(moved, F.least(first, second)).alias("prefix_chars"),
        F.when(moved, F.greatest(first, second) - F.least(first, second)).alias("middle_chars"))


def exchange(held: bytearray, start: int, between: int, end: int) -> None:
    """Let the blocks [start, between) and [between, end) change places, by three reversals in place."""
    for lo, hi in ((start, between), (between, end), (start, end)):
        held[lo:hi] = held[lo:hi][::-1]


def byte_places(text, chars: list[int]) -> list[int]:
    """Where in a UTF-8 text the given numbers of code points end."""
    import numpy as np

    lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    if lead.all():
        return chars
    starts = np.append(np.flatnonzero(lead), len(lead))
    return starts[chars].tolist()


def transform(text: bytes, form: str, prefix_chars: int, middle_chars: int, marks: tuple[bytes, bytes, bytes]) -> bytearray:
    """The output for a text; `marks` are the sentinels of prefix, middle and suffix."""
    held = bytearray(text)
    if form == "plain":
        return held
    a, b = byte_places(text, [prefix_chars, prefix_chars + middle_chars])
    p, m, s = marks
    for at, mark in ((b, s), (a, m), (0, p)):  # from the back, so that places stay right
        held[at:at] = mark
    middle = a + len(p)
    suffix = b + len(p) + len(m)
    exchange(held, middle if form == "psm" else 0, suffix, len(held))
    return held


def restore(output: bytes, form: str, marks: tuple[bytes, bytes, bytes]) -> bytearray:
    """The text behind an output: sentinels are found, blocks rotated back, sentinels taken out."""
    held = bytearray(output)
    if form == "plain":
        return held
    p, m, s = marks
    start, middle = held.index(s), held.index(m)
    # behind the suffix begins the middle (psm) or the prefix (spm)
    between = middle if form == "psm" else held.index(p, start + len(s))
    exchange(held, start, between, len(held))
    for mark in (p, m, s):
        at = held.index(mark)
        del held[at:at + len(mark)]
    return held


def _marks(form: Form) -> tuple[bytes, bytes, bytes]:
    return form.prefix.encode(), form.middle.encode(), form.suffix.encode()


def fill_in_middle(docs: DataFrame, form: Form = Form()) -> DataFrame:
    """One row for each row of `docs` (doc_id, text, ...): doc_id, n, form, prefix_chars, middle_chars, output.

    n is the number of code points. `form` is plain where the text is empty, holds a sentinel, or was not drawn; lengths are null
    there and the output is the text. Null text is empty. Rows that repeat a doc_id get the same draws, each for its own text; rows
    without an id share the draws of an empty id. Texts are whole however long: a row needs a few times its own size.
    Other columns are ignored. No shuffle.
    """
    marks = _marks(form)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("form", "prefix_chars", "middle_chars")]
            texts = batch.column("text").cast(pa.binary())
            for lo in range(0, len(texts), 256):  # a few rows leave at a time, whatever their lengths
                rows = zip(texts.slice(lo, 256), *(c[lo:lo + 256] for c in columns))
                made = pa.array([bytes(transform(t.as_py(), f, p, m, marks)) for t, f, p, m in rows], pa.binary()).cast(pa.string())
                kept = batch.select(["doc_id", "n", "form", "prefix_chars", "middle_chars"]).slice(lo, 256)
                yield pa.RecordBatch.from_arrays([*kept.columns, made], names=[*kept.schema.names, "output"])

    return plan(docs, form).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(made: DataFrame, form: Form = Form()) -> DataFrame:
    """`made` (form, output, ...) with `restored`, the text rebuilt from these two columns alone."""
    marks = _marks(form)
    schema = made.select("*", F.lit("").alias("restored")).schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            forms, outputs = batch.column("form").to_pylist(), batch.column("output").cast(pa.binary())
            for lo in range(0, len(forms), 256):
                texts = pa.array([bytes(restore(o.as_py(), f, marks)) for o, f in zip(outputs.slice(lo, 256), forms[lo:lo + 256])], pa.binary()).cast(pa.string())
                kept = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([*kept.columns, texts], names=[*kept.schema.names, "restored"])

    return made.mapInArrow(run, schema)
