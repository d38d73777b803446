"""Which shingle sets are near: candidates of shared keys, verified on whole sets, with work that grows with the rows.

A caller gives each text's set some keys and a sketch. Equal sets are one node; nodes under one key are candidates. The links that
come out connect all candidates that chains of near pairs connect:

1. Keys with the same nodes are one. The smallest node of a key is its hub.
2. Each node is compared with one hub, the one it shares the most keys with; then any two groups that have come out and share a key,
   by one pair of hub and node. Hubs with many others are dealt over cells, the hub's set going to each.
3. What a key's nodes have not been joined by then is compared within the key, across what is joined only. Keys that one group leads
   are one where that makes fewer pairs, so a node of a large group is a row for the group instead of one for each of its keys. A key of
   more than `CELL` nodes is cut into parts, and pairs of parts are cells; parts of the group that leads it meet the other parts only.
   First the heads of sketches meet, which drop what meets by chance, then whole sketches. What they leave of a cell goes on as pairs of
   nodes, once for all cells, or, where there are over `PAIRS` for each node, as the cell.

Step 2 only spares step 3 work: a node is in no more than one of its pairs for itself, however many keys a large group has. A cell gives
fewer links than it has nodes. No pair of sets is ever a row, and pairs of nodes are rows in proportion to the nodes only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from correctionlab.llm.common import tidy
from correctionlab.llm.components import stars
from correctionlab.plans.sizing import broadcast_within, cut_lineage

CELL = 1_024
PAIRS = 8
ROWS_AT_ONCE = 2_048
FREQUENT_NODES = 10_000
ROWS = "doc_id long, h long, node binary, n int, keys array<long>, sketch binary"


@dataclass(frozen=True)
class Nearness:
    """Sets are near where `of` * common >= `least` * union. `describe` gives a set's keys (64 bit, unsigned) and sketch (bytes of one length);
    `likely` tells of rows of two sketch tables, pair by pair, which may be near; it takes the first `head` bytes of sketches too."""

    least: int
    of: int
    shingle: int
    describe: Callable
    likely: Callable
    head: int

    def sizes_fit(self, m, n):
        """Whether two sizes leave room for near sets; for columns and arrays."""
        return (self.of * m >= self.least * n) & (self.of * n >= self.least * m)

    def near(self, x, y) -> bool:
        """Of two sorted arrays without repeats."""
        import numpy as np

        common = len(x) + len(y) - len(np.union1d(x, y))
        return self.of * common >= self.least * (len(x) + len(y) - common)


def shingle_set(text: bytes, shingle: int):
    """Hashes of a UTF-8 text's different word shingles, sorted: A-Z lowered, words between ASCII white space; fewer words are one shingle."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    size = min(shingle, len(words))
    if not size:
        return hashes
    mixed = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ hashes[k:k + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")


def _node(tokens) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(tokens.tobytes())


def described(docs: DataFrame, how: Nearness) -> DataFrame:
    """(doc_id, h, node, n, keys, sketch) for each row of `docs`: its text's hash, its set's 128-bit hash and size, and what `how` says of the set."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lo in range(0, len(texts), 1_024):
                nodes, sizes, keys, sketches = [], [], [], []
                for text in texts.slice(lo, 1_024):
                    mine = shingle_set(text.as_py() or b"", how.shingle)
                    nodes.append(_node(mine))
                    sizes.append(len(mine))
                    k, s = how.describe(mine) if len(mine) else (np.zeros(0, np.uint64), b"")
                    keys.append(k.view(np.int64))
                    sketches.append(s)
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                part = batch.slice(lo, 1_024)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("h"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys))), pa.array(sketches, pa.binary())],
                    names=["doc_id", "h", "node", "n", "keys", "sketch"])

    return _identified(docs).mapInArrow(tidy(run), ROWS)


def _sketches(rows: DataFrame, wanted: DataFrame, width: int | None = None) -> DataFrame:
    """(node, sketch) of the wanted nodes: whole sketches, or their first bytes."""
    wanted = broadcast_within(cut_lineage(wanted, "wanted"))
    some = rows.select("node", F.substring("sketch", 1, width).alias("sketch") if width else "sketch").join(wanted, "node", "left_semi")
    return cut_lineage(some.groupBy("node").agg(F.min("sketch").alias("sketch")), "sketches")


def _sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, how: Nearness) -> DataFrame:
    """(node, tokens) of the wanted nodes, from the text of one row of each."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lo in range(0, len(texts), 256):
                sets = [shingle_set(t.as_py() or b"", how.shingle) for t in texts.slice(lo, 256)]
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.binary()), pa.array([s.view("int64") for s in sets], pa.list_(pa.int64()))], names=["node", "tokens"])

    wanted = broadcast_within(cut_lineage(wanted, "wanted"))
    one = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("r"))
    one = broadcast_within(cut_lineage(one.select(F.col("r.doc_id").alias("of"), F.col("r.h").alias("oh")), "wanted"))
    texts = _identified(docs).join(one, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("oh")), "left_semi").select("text")
    return cut_lineage(texts.mapInArrow(tidy(run), "node binary, tokens array<long>").dropDuplicates(["node"]), "sets")


def _likely_pairs(pairs: DataFrame, rows: DataFrame, how: Nearness) -> DataFrame:
    """The pairs (hub, node) whose sketches may be near."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), -1) for c in "xy")
            if len(batch):
                yield batch.select(["hub", "node"]).filter(pa.array(how.likely(x, y)))

    for width in (how.head, None):
        sketches = _sketches(rows, pairs.select("node").union(pairs.select("hub")).distinct(), width)
        both = pairs.join(sketches.select("node", F.col("sketch").alias("y")), "node").join(sketches.select(F.col("node").alias("hub"), F.col("sketch").alias("x")), "hub")
        pairs = cut_lineage(both.select("hub", "node", "x", "y").mapInArrow(tidy(run), "hub binary, node binary"), "pairs")
    return pairs


def _hub_links(pairs: DataFrame, docs: DataFrame, rows: DataFrame, how: Nearness, cell: int) -> DataFrame:
    """The pairs (hub, node) that are near, as links (a, b)."""
    many = pairs.groupBy("hub").agg(F.ceil(F.count("*") / cell).cast("int").alias("parts"))
    dealt = pairs.join(many, "hub").select("hub", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "node")
    hubs = dealt.select("hub", "part").distinct().withColumn("node", F.col("hub"))
    work = cut_lineage(dealt.unionByName(hubs), "cells")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hub = tokens = None
        for batch in batches:
            a, b = [], []
            lists = batch.column("tokens")
            for k, (mine, node) in enumerate(zip(batch.column("hub").to_pylist(), batch.column("node").to_pylist())):
                other = np.asarray(lists[k].values).view(np.uint64)
                if mine == node:  # first of its cell
                    hub, tokens = mine, other.copy()
                elif hub != mine:
                    raise ValueError("a cell without its hub")
                elif how.near(tokens, other):
                    a.append(hub)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    held = _sets(docs, rows, work.select("node").distinct(), how).join(broadcast_within(work), "node").withColumn("other", F.col("hub") != F.col("node"))
    cells = held.repartition("hub", "part").sortWithinPartitions("hub", "part", "other", "node").select("hub", "node", "tokens")
    return cut_lineage(cells.mapInArrow(tidy(run), "a binary, b binary"), "links")


def likely_places(group, root, sizes, sketches, how: Nearness):
    """Pairs of places, one lag after the other, of one group, different roots and sketches that may be near; a group's rows stand together."""
    import numpy as np

    at, lag = np.arange(len(group)), 1
    while True:
        at = at[at + lag < len(group)]
        at = at[group[at] == group[at + lag]]
        if not len(at):
            return
        open_ = at[(root[at] != root[at + lag]) & how.sizes_fit(sizes[at], sizes[at + lag])]
        for lo in range(0, len(open_), 4_096):
            some = open_[lo:lo + 4_096]
            some = some[how.likely(sketches[some], sketches[some + lag])]
            if len(some):
                yield some, some + lag
        lag += 1


CELL_KEYS = ["key", "lo", "hi"]


def _cells_of(batches, columns: list[str]):
    """Arrow tables that hold whole cells; batches end anywhere."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held = None
    for batch in (b.slice(lo, ROWS_AT_ONCE) for b in batches for lo in range(0, len(b), ROWS_AT_ONCE)):
        now = pa.Table.from_batches([batch]).select(columns)
        held = now if held is None else pa.concat_tables([held, now]).combine_chunks()
        if not len(held):
            continue
        same = None
        for c in CELL_KEYS:
            this = pc.equal(held[c], held[c][len(held) - 1])
            same = this if same is None else pc.and_(same, this)
        whole = len(held) - pc.sum(pc.cast(same, pa.int64())).as_py()  # the last cell may go on
        if whole:
            yield held.slice(0, whole)
            held = held.slice(whole)
    if held is not None and len(held):
        yield held


def _arrays(cells):
    """(group, root, sizes, sketches) of whole cells, as arrays."""
    import numpy as np

    keys = np.stack([cells[c].to_numpy().astype(np.int64) for c in CELL_KEYS], axis=1)
    group = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])
    root = np.unique(np.array(cells["root"].to_pylist(), object), return_inverse=True)[1]
    sketches = np.frombuffer(b"".join(cells["sketch"].to_pylist()), np.uint8).reshape(len(cells), -1)
    return group, root, cells["n"].to_numpy().astype(np.int64), sketches


def _open_keys(named: DataFrame) -> DataFrame:
    """(key, node, n, root) of the keys whose nodes have several roots; `named` has all keys.

    Keys that one root leads, by its number of nodes, are one key where its nodes together make fewer pairs than theirs do one by one.
    """
    key, count = Window.partitionBy("key"), F.count("*")
    seen = named.repartition("key").withColumn("times", count.over(Window.partitionBy("key", "root"))).withColumn("m", count.over(key))
    seen = seen.withColumn("lead", F.max(F.struct("times", "root")).over(key)).where("times < m").withColumn("lead", F.col("lead.root"))
    left = cut_lineage(seen.select("key", "node", "n", "root", "lead", "m"), "open")
    # the squares of the keys' sizes are the sum of these sizes over all rows
    nodes = cut_lineage(left.groupBy("lead", "node", "n", "root").agg(F.sum("m").cast("double").alias("alone")), "open")
    one = nodes.groupBy("lead").agg(F.count("*").cast("double").alias("together"), F.sum("alone").alias("alone")).where("together * together < alone")
    one = broadcast_within(cut_lineage(one.select("lead"), "open"))
    plain = left.join(one, "lead", "left_anti").select("key", "node", "n", "root")
    return cut_lineage(plain.unionByName(nodes.join(one, "lead", "left_semi").select(F.xxhash64("lead").alias("key"), "node", "n", "root")), "members")


def _dealt(left: DataFrame, cell: int) -> DataFrame:
    """`left` (key, node, n, root) with the cells (lo, hi) of each node.

    Nodes of the key's leading root have parts of their own. They are joined, so these parts meet those of the others only.
    """
    counts = left.groupBy("key", "root").agg(F.count("*").alias("m"))
    keys = counts.groupBy("key").agg(F.max(F.struct("m", "root")).alias("lead"), F.sum("m").alias("m"))
    joined = F.when(F.col("m") > cell, F.ceil(F.col("lead.m") / cell)).otherwise(0).cast("int")
    others = F.when(F.col("m") > cell, F.ceil((F.col("m") - F.col("lead.m")) / cell)).otherwise(1).cast("int")
    keys = keys.select("key", F.col("lead.root").alias("lead"), joined.alias("joined"), others.alias("others"))
    leads, number = (F.col("joined") > 0) & (F.col("root") == F.col("lead")), F.xxhash64("node")
    part = F.when(leads, F.col("others") + F.pmod(number, F.greatest("joined", F.lit(1)))).otherwise(F.pmod(number, "others")).cast("int")
    meets = F.explode(F.sequence(F.lit(0), F.col("others") - 1 + F.when(leads, 0).otherwise(F.col("joined"))))
    dealt = left.join(keys, "key").select("key", "node", "n", "root", "joined", "others", part.alias("part"), meets.alias("other"))
    # a part meets itself in every cell it has
    dealt = dealt.where((F.col("part") != F.col("other")) | (F.col("joined") + F.col("others") == 1))
    return dealt.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "node", "n", "root")


def _open_links(left: DataFrame, docs: DataFrame, rows: DataFrame, how: Nearness, cell: int) -> DataFrame:
    """Links (a, b) within the keys of `left` (key, node, n, root), between nodes of different roots."""
    plain = [*CELL_KEYS, "node", "n", "root"]
    dealt = _dealt(left, cell).select(*plain)
    columns = [*plain, "sketch"]
    schema = "key long, lo int, hi int, node binary, n int, root binary"

    def keep(batches):
        import numpy as np
        import pyarrow as pa

        for cells in _cells_of(batches, columns):
            group, root, sizes, sketches = _arrays(cells)
            alive = np.zeros(len(group), bool)
            for i, j in likely_places(group, root, sizes, sketches, how):
                alive[i] = alive[j] = True
            yield from cells.select(plain).filter(pa.array(alive)).to_batches()

    def pair(batches):
        """Pairs (hub, node), or rows of cells, where hub is null."""
        import numpy as np
        import pyarrow as pa

        for cells in _cells_of(batches, columns):
            group, root, sizes, sketches = _arrays(cells)
            rows_, found = np.bincount(group), np.zeros(group[-1] + 1, np.int64)
            alive, pairs = np.zeros(len(group), bool), []
            for i, j in likely_places(group, root, sizes, sketches, how):
                alive[i] = alive[j] = True
                found += np.bincount(group[i], minlength=len(found))
                few = found[group[i]] <= PAIRS * rows_[group[i]]
                pairs.append((i[few], j[few]))
            nodes, few = cells["node"].to_pylist(), found <= PAIRS * rows_
            two = {(min(nodes[p], nodes[q]), max(nodes[p], nodes[q])) for i, j in pairs for p, q in zip(i.tolist(), j.tolist()) if few[group[p]]}
            some = cells.select(plain).filter(pa.array(alive & ~few[group]))
            yield from some.append_column("hub", pa.nulls(len(some), pa.binary())).to_batches()
            if two:
                hub, node = (pa.array(x, pa.binary()) for x in zip(*sorted(two)))
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(two), t) for t in (pa.int64(), pa.int32(), pa.int32())), node, pa.nulls(len(two), pa.int32()), pa.nulls(len(two), pa.binary()), hub], names=[*plain, "hub"])

    def link(batches):
        import numpy as np
        import pyarrow as pa

        for cells in _cells_of(batches, [*columns, "tokens"]):
            group, root, sizes, sketches = _arrays(cells)
            lists, nodes = cells["tokens"].combine_chunks(), cells["node"].to_pylist()
            up: dict[int, int] = {}

            def top(r):
                while r in up:
                    r = up[r]
                return r

            a, b, last = [], [], -1
            # cell by cell, so that what is joined in one says nothing of another
            for cell_ in np.split(np.arange(len(group)), np.flatnonzero(np.diff(group)) + 1):
                up.clear()
                lo = cell_[0]
                for i, j in likely_places(group[cell_], root[cell_], sizes[cell_], sketches[cell_], how):
                    for p, q in zip((i + lo).tolist(), (j + lo).tolist()):
                        r, s = top(int(root[p])), top(int(root[q]))
                        if r != s and how.near(*(np.asarray(lists[k].values).view(np.uint64) for k in (p, q))):
                            up[max(r, s)] = min(r, s)
                            a.append(nodes[p])
                            b.append(nodes[q])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    def in_cells(rows_: DataFrame) -> DataFrame:
        return rows_.repartition(*CELL_KEYS).sortWithinPartitions(*CELL_KEYS, "node")

    heads = _sketches(rows, left.select("node").distinct(), how.head)
    alive = cut_lineage(in_cells(dealt.join(heads, "node").select(*columns)).mapInArrow(tidy(keep), schema), "cells")
    sketches = _sketches(rows, alive.select("node").distinct())
    cells = cut_lineage(in_cells(alive.join(sketches, "node").select(*columns)).mapInArrow(tidy(pair), schema + ", hub binary").distinct(), "cells")
    links = _hub_links(cells.where("hub is not null").select("hub", "node"), docs, rows, how, cell)
    many = cells.where("hub is null").select(*plain)
    if many.isEmpty():
        return links
    sets = _sets(docs, rows, many.select("node").distinct(), how).join(sketches, "node")
    full = many.join(sets, "node").select(*columns, "tokens")
    return links.union(cut_lineage(in_cells(full).mapInArrow(tidy(link), "a binary, b binary"), "links"))


def near_roots(docs: DataFrame, rows: DataFrame, how: Nearness, cell: int = CELL) -> DataFrame:
    """(node, root) of the nodes that are linked with others; `rows` is `described(docs, how)`, written."""
    # one shuffle of all keys, as two numbers a row; what is shared gets its nodes afterwards. Two nodes of one number would only be compared too
    number, key = F.xxhash64("node"), Window.partitionBy("key")
    held = rows.select(number.alias("number"), F.explode("keys").alias("key")).repartition("key")  # before the halves are made, else they are shuffled too
    halves = (F.sum(half).over(key) for half in (F.col("number").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("number", 32)))
    ends = held.select("key", "number", F.min("number").over(key).alias("least"), F.max("number").over(key).alias("most"), *(h.alias(f"half_{k}") for k, h in enumerate(halves)))
    # keys with the same nodes are one, named by them; keys of other nodes that got one name would only be compared too
    same = F.xxhash64("least", "most", "half_0", "half_1").alias("key")
    shared = cut_lineage(ends.where("least <> most").select(same, "number", "least").groupBy("key", "number", "least").agg(F.count("*").alias("times")), "shared")
    wanted = shared.select("number").distinct()
    nodes = cut_lineage(rows.groupBy("node").agg(F.first("n").alias("n")).withColumn("number", number).join(wanted, "number", "left_semi"), "numbers")
    hubs = shared.select("key", "least").distinct().join(nodes.groupBy(F.col("number").alias("least")).agg(F.min(F.struct("node", "n")).alias("hub")), "least")
    members = cut_lineage(shared.select("key", "number", "times").join(nodes, "number").join(hubs.select("key", "hub"), "key").select("key", "node", "n", "times", "hub"), "members")
    fit = (F.col("node") != F.col("hub.node")) & how.sizes_fit(F.col("n"), F.col("hub.n"))
    pairs = cut_lineage(members.where(fit).groupBy("node", F.col("hub.node").alias("hub")).agg(F.sum("times").alias("times")), "pairs")
    best = F.max(F.struct("times", "hub", "node")).alias("best")
    first = pairs.groupBy("node").agg(best).select("best.hub", "best.node")
    links = _hub_links(_likely_pairs(cut_lineage(first, "pairs"), rows, how), docs, rows, how, cell)
    star = cut_lineage(stars(links), "star")
    apart = _rooted(_rooted(pairs, star, "node", "p"), star, "hub", "q").where("p <> q")
    second = apart.groupBy(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(best).select("best.hub", "best.node")
    second = cut_lineage(second.join(first, ["hub", "node"], "left_anti"), "pairs")
    links = _hub_links(_likely_pairs(second, rows, how), docs, rows, how, cell)
    star = cut_lineage(stars(_edges(star).union(links)), "star")
    left = _open_keys(cut_lineage(_rooted(members.select("key", "node", "n"), star, "node", "root"), "members"))
    more = _open_links(left, docs, rows, how, cell)
    return cut_lineage(stars(_edges(star).union(more)), "star")


def _edges(star: DataFrame) -> DataFrame:
    return star.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))


def _rooted(table: DataFrame, star: DataFrame, column: str, root: str) -> DataFrame:
    """`table` with the root of the node in `column`: the node itself where it is linked with none."""
    named = star.select(F.col("node").alias("_of"), F.col("root").alias("_root"))
    return table.join(named, F.col(column) == F.col("_of"), "left").withColumn(root, F.coalesce("_root", column)).drop("_of", "_root")


def near_groups(docs: DataFrame, rows: DataFrame, how: Nearness, cell: int = CELL) -> DataFrame:
    """(doc_id, h, node, n, root, first) for each row of `docs`: root names its group, first is the smallest doc_id of it (null only if all are).

    Nodes that stand for over a 10,000th of all rows, at most 10,000, meet their rows by a broadcast; the others by a shuffle.
    """
    star = near_roots(docs, rows, how, cell)
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("own"), F.count("*").alias("copies"))
    named = cut_lineage(nodes.join(star, "node", "left").select("node", "own", "copies", F.coalesce("root", "node").alias("root")), "nodes")
    smallest = named.groupBy("root").agg(F.min("own").alias("first"))
    label = cut_lineage(named.join(smallest, "root").select("node", "root", "first", "copies"), "labels")
    often = F.col("copies") * FREQUENT_NODES >= rows.count()
    hot, plain = F.broadcast(label.where(often).drop("copies")), rows.select("doc_id", "h", "node", "n")
    rare = plain.join(hot.select("node"), "node", "left_anti").join(label.where(~often).drop("copies"), "node")
    columns = ["doc_id", "h", "node", "n", "root", "first"]
    return plain.join(hot, "node").select(*columns).unionByName(rare.select(*columns))
