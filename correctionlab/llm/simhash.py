"""Near duplicates by SimHash (operator 1): pivot distance tables.

A document's fingerprint takes the majority of each bit over the XXH64 hashes of its word shingles. Fingerprints with few
different bits are linked, and what is linked in a chain is one group.

Distinct fingerprints alone are compared. They meet in buckets: of `BLOCKS` blocks of bits, two fingerprints that
differ in at most `max_bits` bits share at least BLOCKS - max_bits blocks, so each is put under every choice of that many
blocks, and no pair is missed. In a bucket, the Hamming distances of each fingerprint to the reference fingerprints are
its row of the pivot table. By the triangle inequality a pair whose distances to some reference differ by more
than `max_bits` can't be near; such pairs fall, reference by reference, and the survivors are compared bit by bit. Pairs
that are already linked in a chain are not compared again, and only links that join two chains come out, so a bucket
gives fewer links than it has members. A bucket of more than `CELL` fingerprints is cut into parts, and each pair of parts
is a task's work.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from correctionlab.llm.components import stars
from correctionlab.plans.sizing import cut_lineage

SHINGLE = 4
MAX_BITS = 4
BLOCKS = 6
REFERENCES = 32
CELL = 2_048
SEED = 42
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text: A-Z lowered, words between ASCII white space, hashes of all shingles counted bit by bit.

    Fewer words than a shingle are one shingle; no word gives 0.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n]
    ends = ends[min(shingle, len(words)) - 1:]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        pairs = zip(starts[at:at + SHINGLES_AT_ONCE].tolist(), ends[at:at + SHINGLES_AT_ONCE].tolist())
        hashes = np.array([xxh64_intdigest(line[s:e], 42) for s, e in pairs], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for each row of `docs`; fp is the fingerprint as a signed long. Null text is empty."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            out = np.array([fingerprint(t.as_py() or b"", shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int = BLOCKS, max_bits: int = MAX_BITS) -> list[int]:
    """One mask, as a signed long, for each choice of blocks that two near fingerprints may share."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    block = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(blocks)]
    masks = [sum(chosen) for chosen in combinations(block, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def reference_fingerprints(n: int = REFERENCES):
    import numpy as np
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(k.to_bytes(4, "little"), SEED) for k in range(n)], np.uint64)


def chains(values, group, max_bits: int, references):
    """Links (positions i, j) that join the near fingerprints of each group into chains; a group's members stand together."""
    import numpy as np

    # the pivot table: one row a fingerprint, one column a reference
    distances = np.bitwise_count(values[:, None] ^ references[None, :]).astype(np.int16)
    root, links, lag = np.arange(len(values)), [], 1
    at = np.arange(len(values))
    while True:
        at = at[at + lag < len(values)]
        at = at[group[at] == group[at + lag]]
        if not len(at):
            return links
        pairs = at[root[at] != root[at + lag]]
        for column in distances.T:
            if not len(pairs):
                break
            pairs = pairs[np.abs(column[pairs] - column[pairs + lag]) <= max_bits]
        pairs = pairs[np.bitwise_count(values[pairs] ^ values[pairs + lag]) <= max_bits]
        for i in pairs.tolist():
            a, b = i, i + lag
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((i, i + lag))
        while len(pairs) and (deeper := root[root]).tobytes() != root.tobytes():
            root = deeper
        lag += 1


def near_links(nodes: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, cell: int = CELL) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp); chains of links connect all that are chained by near pairs."""
    masks = block_masks(blocks, max_bits)
    keyed = nodes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for k, m in enumerate(masks)])).alias("b")).select("fp", "b.*")
    shared = keyed.groupBy("choice", "bits").agg(F.count("*").alias("members")).where("members > 1")
    parts = F.ceil(F.col("members") / cell).cast("int")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cells = (
        keyed.join(shared, ["choice", "bits"]).withColumn("parts", parts).withColumn("part", part)
        .select("fp", "choice", "bits", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        .select("fp", "choice", "bits", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    )

    def link(batches):
        import numpy as np
        import pyarrow as pa

        references = reference_fingerprints()
        held = np.zeros((0, 5), np.int64)

        def out(rows):
            values = np.ascontiguousarray(rows[:, 0]).view(np.uint64)
            group = np.concatenate([[0], np.cumsum((rows[1:, 1:] != rows[:-1, 1:]).any(axis=1))])
            found = np.array(chains(values, group, max_bits, references), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(rows[found[:, 0], 0]), pa.array(rows[found[:, 1], 0])], names=["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("fp", "choice", "bits", "lo", "hi")], axis=1)
            held = np.concatenate([held, rows])
            if len(held):  # the last cell may go on in the next batch
                last = len(held) - int(np.argmin((held[::-1, 1:] == held[-1, 1:]).all(axis=1))) if (held[:, 1:] != held[-1, 1:]).any() else 0
                if last:
                    yield out(held[:last])
                    held = held[last:]
        if len(held):
            yield out(held)

    order = ["choice", "bits", "lo", "hi"]
    return cells.repartition(*order).sortWithinPartitions(*order).select("fp", *order).mapInArrow(link, "a long, b long")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """One row for each row of `docs` (doc_id, text, ...): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id of those that links reach. Null and empty texts have fingerprint 0 and are linked like
    others. Rows that repeat a doc_id have rows of their own. A null doc_id is never the smallest, except where all are null.
    Other columns are ignored. More `blocks` make smaller buckets and more rows (blocks choose blocks - max_bits for each
    fingerprint): 6 hold 21 bits in 15 rows, 7 hold 27 in 35, 8 hold 32 in 70.
    """
    fps = cut_lineage(fingerprints(docs, shingle), "fingerprints")
    nodes = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    star = stars(cut_lineage(near_links(nodes, max_bits, blocks), "links"))
    smallest = star.join(nodes, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("first").alias("component"))
    label = star.join(smallest, "root").select(F.col("node").alias("fp"), "component")
    named = nodes.join(label, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """`docs` with one document of each group: the one whose doc_id names it. Rows that repeat a doc_id stay or fall together."""
    stays = near_groups(docs, **options).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stays")).distinct()
    return docs.join(stays, F.col("doc_id").cast("long").eqNullSafe(F.col("stays")), "left_semi")
