"""Near copies by SimHash and pivot distance tables, at a similarity of 4/5 of five-word shingles.

Each set of shingles has a fingerprint of 256 bits, the majorities over its shingles' hashes, and a row of the pivot table: the
fingerprint's Hamming distances to `PIVOTS` reference fingerprints. Both are made once, as a written column.

Pairs meet by pivot distances too. A set's distance to a pivot is the mean Hamming distance of its shingles' hashes, which the votes
behind the majorities tell. Each of `TABLES` tables has 256 pivots in `GROUPS` groups; a key of a table names one pivot of each group
that is among the nearest or the farthest, and which of both it is. Each set has the `CHOICES` keys of each table whose distances stand
out most. Near sets have nearly the same votes and so the same outstanding pivots; two unrelated ones share one key of a table with odds
of one to some millions. Votes tell much more than bits: blocks of bits would need hundreds of keys a set at this similarity.

A candidate pair is discarded where some coordinate of its two rows differs by more than `APART`, survivors where their fingerprints
differ in more than `RADIUS` bits, then those whose votes are too far apart, and what is left is verified on whole sets. Sets with a similarity of 4/5 differ in about 39 of
the 256 bits (at most 48 for the smallest sets), each of which moves a coordinate up or down by one; a coordinate then differs by more
than `APART` about once in 3,000 times (5 of 15,600 drawn pairs), while unrelated rows nearly always have one that does. A bound that never errs (`RADIUS`
itself) would discard nothing, as distances of unrelated fingerprints only spread by 11.

The votes themselves tell how much sets have apart: the votes of two sets differ by those of the hashes that only one has, d of them, so
the mean square of 256 differences is about d, with a deviation of an eleventh. A pair goes where that is `SPREAD` deviations above the
most d that its sizes allow, which a near pair is once in 200,000 times at most; pairs below a similarity of about 0.7 go nearly
always, while fingerprints leave those down to 0.4. Votes are kept as signed bytes, large ones without their last bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from correctionlab.llm.near_sets import Nearness, described, near_groups
from correctionlab.plans.sizing import broadcast_within, cut_lineage

SHINGLE = 5
WORDS = 4  # of 64 bits
PIVOTS = 128
APART = 28
RADIUS = 80
SPREAD = 5
TAIL = 5 + 64 * WORDS  # of a sketch: size, how many last bits are left out, votes
TABLES, GROUPS, CHOICES = 16, 4, 8
OUTSTANDING = 4  # of a group, that keys are made of
TOKENS_AT_ONCE = 2_048


def votes(tokens):
    """For each of 256 bits, how many more of the 64-bit shingle hashes of a set have it than not."""
    import numpy as np

    counts = np.zeros(64 * WORDS, np.int64)
    odd = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
    for at in range(0, len(tokens), TOKENS_AT_ONCE):
        mixed = tokens[at:at + TOKENS_AT_ONCE, None] * odd
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        counts += np.unpackbits(mixed.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return 2 * counts - len(tokens)


def majorities(leads):
    """The fingerprint of votes: each bit is 1 if set in over half of the hashes."""
    import numpy as np

    return np.packbits(leads > 0).view(np.uint64)


def fingerprint(tokens):
    """256 bits, as four words, of a set of 64-bit shingle hashes."""
    return majorities(votes(tokens))


def table_signs(tables: int = TABLES):
    """For each table 256 signs; they and the 256 patterns of a Hadamard matrix (as 16 by 16 patterns, `halves`) make its pivots."""
    import numpy as np

    bits = np.unpackbits(references(tables).view(np.uint8), axis=1)
    half = np.ones((1, 1))
    for _ in range(4):
        half = np.block([[half, half], [half, -half]])
    return 1.0 - 2.0 * bits, half


def pivot_sums(leads, signs, halves):
    """(table, pivot): votes for a pivot's bits less those against them. The mean distance of n hashes to it is half of 256 - this / n."""
    first = ((leads * signs).reshape(-1, 16) @ halves).reshape(len(signs), 16, 16)
    return (first.transpose(0, 2, 1).reshape(-1, 16) @ halves).reshape(len(signs), 256)


def pivot_keys(leads, signs, halves):
    """The keys (64 bit, unsigned) of a set's votes, `CHOICES` of each table."""
    import numpy as np

    tables = len(signs)
    sums = pivot_sums(leads, signs, halves).reshape(tables, GROUPS, -1)
    left = np.abs(sums)
    t, g = np.ogrid[:tables, :GROUPS]
    codes, stand = np.zeros((2, OUTSTANDING, tables, GROUPS), np.int64)
    for k in range(OUTSTANDING):
        at = left.argmax(axis=2)
        codes[k], stand[k] = 2 * at + (sums[t, g, at] > 0), left[t, g, at]
        left[t, g, at] = -1
    keys, total = np.arange(tables)[:, None], np.zeros((tables, 1), np.int64)
    for group in range(GROUPS):
        keys = (keys[:, :, None] * (512 // GROUPS) + codes[:, :, group].T[:, None]).reshape(tables, -1)
        total = (total[:, :, None] + stand[:, :, group].T[:, None]).reshape(tables, -1)
    most = np.argsort(-total, axis=1, kind="stable")[:, :CHOICES]
    return np.take_along_axis(keys, most, axis=1).ravel().astype(np.uint64)


def references(n: int = PIVOTS):
    """Reference fingerprints, the same everywhere."""
    import numpy as np
    from xxhash import xxh64_intdigest

    return np.array([[xxh64_intdigest(f"{k}:{w}".encode()) for w in range(WORDS)] for k in range(n)], np.uint64)


def pivot_row(bits, pivots):
    """Hamming distances of a fingerprint to all pivots; 255 stands for 256 too."""
    import numpy as np

    return np.minimum(np.bitwise_count(pivots ^ bits).sum(axis=1, dtype=np.int64), 255).astype(np.uint8)


def vote_row(leads, size: int) -> bytes:
    """Size, bits left out, and votes of a set."""
    import numpy as np

    out = max(int(np.abs(leads).max()).bit_length() - 7, 0)
    short = np.clip((leads + ((1 << out) >> 1)) >> out, -127, 127).astype(np.int8)
    return np.array([size], "<u4").tobytes() + bytes([out]) + short.tobytes()


def votes_apart(x, y):
    """For tails of sketches, pair by pair: the sizes together, and about how many hashes only one of both sets has."""
    import numpy as np

    def whole(t):
        t = np.ascontiguousarray(t)
        return t[:, 5:].view(np.int8).astype(np.int64) << t[:, 4:5].astype(np.int64)

    sizes = sum(np.ascontiguousarray(t[:, :4]).view("<u4").ravel().astype(np.int64) for t in (x, y))
    return sizes, ((whole(x) - whole(y)) ** 2).mean(axis=1)


def survivors(x, y, apart: int = APART, radius: int = RADIUS, least: int = 4, of: int = 5):
    """For rows of (fingerprint, pivot row, votes): which pairs neither a coordinate nor the fingerprints nor the votes discard. For fingerprints alone, those."""
    import numpy as np

    head = 8 * WORDS
    if x.shape[1] == head:
        return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= radius
    u, v = x[:, head:-TAIL], y[:, head:-TAIL]
    keep = (np.maximum(u, v) - np.minimum(u, v)).max(axis=1, initial=0) <= apart
    left = np.flatnonzero(keep)
    keep[left] = np.bitwise_count(x[left, :head] ^ y[left, :head]).sum(axis=1, dtype=np.int64) <= radius
    left = np.flatnonzero(keep)
    sizes, differ = votes_apart(x[left, -TAIL:], y[left, -TAIL:])
    keep[left] = differ * (of + least) <= sizes * (of - least) * (1 + SPREAD * (2 / (64 * WORDS)) ** 0.5)
    return keep


def nearness(least: int = 4, of: int = 5, shingle: int = SHINGLE, pivots: int = PIVOTS) -> Nearness:
    made: list = []

    def describe(tokens):
        if not made:
            made.extend((references(pivots), *table_signs()))
        leads = votes(tokens)
        bits = majorities(leads)
        return pivot_keys(leads, *made[1:]), bits.tobytes() + pivot_row(bits, made[0]).tobytes() + vote_row(leads, len(tokens))

    def likely(x, y):
        return survivors(x, y, least=least, of=of)

    return Nearness(least, of, shingle, describe, likely, 8 * WORDS)


def near_copy_groups(docs: DataFrame, how: Nearness | None = None) -> DataFrame:
    """(doc_id, h, component) for each row of `docs`: its text's hash, and the name of its group; rows that a chain of near copies
    links have one. Texts without a word, null ones too, are one group."""
    how = how or nearness()
    rows = cut_lineage(described(docs, how), "described")
    return near_groups(docs, rows, how).select("doc_id", "h", F.col("root").alias("component"))


def one_of_each(docs: DataFrame, how: Nearness | None = None) -> DataFrame:
    """`docs` with one row of each group: the smallest doc_id, null last, then the smallest hash of the text; equal rows are one."""
    groups = cut_lineage(near_copy_groups(docs, how), "groups")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "h"))
    stays = cut_lineage(groups.groupBy("component").agg(best.alias("b")).select(F.col("b.doc_id").alias("_of"), F.col("b.h").alias("_oh")), "stays")
    same = groups.join(stays, F.col("doc_id").eqNullSafe(F.col("_of")) & (F.col("h") == F.col("_oh")), "left_semi")
    counted = cut_lineage(same.groupBy(F.col("doc_id").alias("_of"), F.col("h").alias("_oh")).agg((F.count("*") > 1).alias("repeated")), "stays")
    keyed = docs.withColumn("_h", F.xxhash64(F.coalesce("text", F.lit(""))))
    here = F.col("doc_id").cast("long").eqNullSafe(F.col("_of")) & (F.col("_h") == F.col("_oh"))
    lone = keyed.join(counted.where("not repeated"), here, "left_semi")
    more = keyed.join(broadcast_within(counted.where("repeated")), here, "left_semi").dropDuplicates(["doc_id", "_h"])
    return lone.unionByName(more).drop("_h")
