"""Mixing sources to target weights (operator 8).

Each source's documents stand in a random order that only their ids decide, cut into about sqrt(rows) blocks. A source is
drawn in whole passes over its blocks and, for the rest of its target, in a last pass up to the block and document where
the target is reached; one further document, of the size nearest to what is then missing, closes the gap. Documents
are always drawn whole.

The number of blocks each source owes is dealt to the output shards by a splitting tree: a node's left child gets half
of its blocks, drawn without replacement (a multivariate hypergeometric draw over its sources), the right child the
rest. So every block goes to one shard and the quotas add up exactly. A shard takes the next blocks of each source's
order, and shuffles its documents by a key of its own.

What is joined to the documents has one row a source or a block; the documents themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from correctionlab.llm.common import text_or_empty, uniform, word_count
from correctionlab.plans.sizing import cut_lineage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
DEPTH = 3
SEED = 8


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_PASSES) -> DataFrame:
    """Targets of sources (source, source_size, rows): weights go round in code point order, null last.

    Targets are min(level x weight, `most` x size) with the level at which they add up to `share` of all sizes; that is where
    resharing the excess by weight, again and again, ends. Sources are sorted by the level at which they are full: the level
    is the first one, over the sources not yet full, that doesn't fill the next source.
    """
    alone = Window.partitionBy(F.lit(0))  # one row a source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(alone.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights) + 1).cast("int"))
    full = alone.orderBy("full_at", F.asc_nulls_last("source"))
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sources.withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(most)))
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(alone) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
                    / (F.sum("weight").over(alone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(alone)["level"])
        .withColumn("target", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("most"))))
        .drop("most", "full_at", "level")
    )


def split_tree(quotas: DataFrame, depth: int = DEPTH, seed: int = SEED) -> DataFrame:
    """Deal quotas (source, quota) to 2^depth shards: (shard, source, n), n adding up to the quota of each source.

    One row holds the quotas of one node, one entry a source. A node's blocks are passed one by one: the next goes left with
    probability (places left)/(blocks left), which draws the left half without replacement.
    """
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("source", "quota"))).alias("quotas")).withColumn("node", F.lit(0).cast("long"))
    long = lambda n: F.lit(n).cast("long")

    def draw(state: Column, entry: Column, node: Column, level: int) -> Column:
        got = F.aggregate(
            F.when(entry["quota"] > 0, F.sequence(long(1), entry["quota"])).otherwise(F.array().cast("array<bigint>")),
            F.struct(state["places"].alias("places"), state["blocks"].alias("blocks")),
            lambda s, j: F.struct(
                (s["places"] - F.when(uniform(F.lit(seed), F.lit(level), node, entry["source"], j) * s["blocks"] < s["places"], long(1)).otherwise(long(0))).alias("places"),
                (s["blocks"] - 1).alias("blocks"),
            ),
        )
        return F.struct(
            got["places"].alias("places"), got["blocks"].alias("blocks"),
            F.concat(state["left"], F.array(F.struct(entry["source"].alias("source"), (state["places"] - got["places"]).alias("quota")))).alias("left"),
        )

    def drawer(level: int):
        return lambda s, e: draw(s, e, F.col("node"), level)

    for level in range(depth):
        total = F.aggregate("quotas", long(0), lambda s, e: s + e["quota"])
        start = lambda: F.struct(
            F.expr("total div 2").alias("places"), F.col("total").alias("blocks"), F.array().cast("array<struct<source:string,quota:bigint>>").alias("left"))
        nodes = (
            nodes.withColumn("total", total)
            .withColumn("left", F.aggregate("quotas", start(), drawer(level))["left"])
            .withColumn("right", F.zip_with("quotas", "left", lambda q, x: F.struct(q["source"].alias("source"), (q["quota"] - x["quota"]).alias("quota"))))
            .select(F.explode(F.array(
                F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")),
                F.struct((F.col("node") * 2 + 1).alias("node"), F.col("right").alias("quotas")))).alias("child"))
            .select("child.*")
        )
    return nodes.select(F.col("node").cast("int").alias("shard"), F.explode("quotas").alias("q")).select("shard", "q.source", F.col("q.quota").alias("n"))


def _keys(seed: int) -> list[Column]:
    """A document's place in the order of its source, and the id that parts equal places."""
    return [uniform(F.lit(seed), F.col("doc_id")).alias("u"), F.col("doc_id")]


def draw_plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_PASSES, seed: int = SEED) -> DataFrame:
    """From rows (doc_id, source, size, u), one row a source: size, target, blocks, passes, and where the last pass ends.

    `last_block` and `last_key` say up to which document the last pass goes, `extra_key` names the one that closes the gap.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sources = cut_lineage(
        source_targets(sources, weights, share, most)
        .withColumn("blocks", F.ceil(F.sqrt("rows")).cast("long"))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "sources")
    mine = sources.select(F.col("source").alias("of"), "blocks", "rest")
    rows = sized.join(mine, F.col("source").eqNullSafe(F.col("of")), "inner").withColumn("block", F.floor(F.col("u") * F.col("blocks")).cast("long"))
    in_source = Window.partitionBy("source").orderBy("block")
    sums = (
        rows.groupBy("source", "block", "rest").agg(F.sum("size").alias("words"))
        .withColumn("before", F.sum("words").over(in_source) - F.col("words"))
    )
    # the block in which the rest runs out; where nothing rests, the first one, of which nothing is then taken
    last = (
        sums.where(F.col("before") <= F.col("rest")).groupBy("source")
        .agg(F.max(F.struct("block", "before")).alias("m")).select(F.col("source").alias("of"), F.col("m.block").alias("last_block"), F.col("m.before").alias("before"))
    )
    sources = cut_lineage(sources.join(last, F.col("source").eqNullSafe(F.col("of")), "left").drop("of"), "sources")
    edge = sources.select(F.col("source").alias("of"), "blocks", "rest", "last_block", "before")
    near = sized.join(edge, F.col("source").eqNullSafe(F.col("of")), "inner").withColumn("block", F.floor(F.col("u") * F.col("blocks")).cast("long"))
    # rows that stand at the same place are taken together
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("u", "doc_id"))
    taken = (
        near.where(F.col("block") == F.col("last_block")).withColumn("upto", F.col("before") + upto)
        .where(F.col("upto") <= F.col("rest")).groupBy("source")
        .agg(F.max(F.struct("u", "doc_id")).alias("last_key"), F.max("upto").alias("reached")).withColumnRenamed("source", "of")
    )
    sources = cut_lineage(sources.join(taken, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
                          .withColumn("gap", F.col("rest") - F.coalesce("reached", "before", F.lit(0))), "sources")
    edge = sources.select(F.col("source").alias("of"), "blocks", "last_block", "last_key", "gap")
    more = (
        sized.where(F.col("size") > 0).join(edge, F.col("source").eqNullSafe(F.col("of")), "inner")
        .withColumn("block", F.floor(F.col("u") * F.col("blocks")).cast("long"))
        .where(~_in_last_pass()).withColumn("off", F.abs(F.col("size") - F.col("gap"))).where(F.col("off") < F.col("gap"))
        .groupBy("source").agg(F.min(F.struct("off", "u", "doc_id")).alias("m"))
        .select(F.col("source").alias("of"), F.struct(F.col("m.u").alias("u"), F.col("m.doc_id").alias("doc_id")).alias("extra_key"))
    )
    return cut_lineage(sources.join(more, F.col("source").eqNullSafe(F.col("of")), "left").drop("of"), "sources")


def _in_last_pass() -> Column:
    key = F.struct("u", "doc_id")
    return F.coalesce((F.col("block") < F.col("last_block")) | ((F.col("block") == F.col("last_block")) & (key <= F.col("last_key"))), F.lit(False))


def with_shards(plan: DataFrame, depth: int = DEPTH, seed: int = SEED) -> DataFrame:
    """`plan` with `shard_ends`: a source's blocks are numbered through its passes, and shard k has those below its end."""
    last = F.when(F.col("last_key").isNotNull() | F.col("extra_key").isNotNull(), F.col("last_block") + 1).otherwise(F.coalesce("last_block", F.lit(0)))
    dealt = split_tree(plan.select("source", (F.col("passes") * F.col("blocks") + last).cast("long").alias("quota")), depth, seed)
    ends = (
        dealt.withColumn("end", F.sum("n").over(Window.partitionBy("source").orderBy("shard")))
        .groupBy(F.col("source").alias("of")).agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda e: e["end"]).alias("shard_ends"))
    )
    return cut_lineage(plan.join(ends, F.col("source").eqNullSafe(F.col("of")), "left").drop("of"), "sources")


def drawn(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """`rows` (source, doc_id, u, ...) with source_size, target, and the shards that their copies go to, in order of the passes."""
    of = plan.select(F.col("source").alias("of"), "source_size", "target", "blocks", "passes", "last_block", "last_key", "extra_key", "shard_ends")
    rows = rows.join(of, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("block", F.floor(F.col("u") * F.col("blocks")).cast("long"))
    closes = F.coalesce(F.struct("u", "doc_id") == F.col("extra_key"), F.lit(False))
    none = F.array().cast("array<bigint>")
    whole = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1), lambda p: p * F.col("blocks") + F.col("block"))).otherwise(none)
    # the document that closes the gap goes with the last block
    once = F.when(_in_last_pass() | closes, F.array(F.col("passes") * F.col("blocks") + F.when(closes, F.col("last_block")).otherwise(F.col("block")))).otherwise(none)
    shards = F.transform(F.concat(whole, once), lambda b: F.size(F.filter(F.col("shard_ends"), lambda e: e <= b)))
    return rows.withColumn("shards", shards).drop("of", "blocks", "passes", "last_block", "last_key", "extra_key", "shard_ends", "block")


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return cut_lineage(mine.select(*_keys(seed), "source", word_count(text_or_empty("text")).alias("size")), "sized")


def mixture(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_PASSES, depth: int = DEPTH, seed: int = SEED) -> DataFrame:
    """One row for each row of `docs` (doc_id, text, source, ...): doc_id, size, source_size, target, taken, shards.

    Size is the number of words; null text has none. A null source is a source of its own, the last one. A source without words
    has target 0. `taken` is size x copies, and there are at most `most` copies, one for each entry of `shards` (comma-joined).
    Rows that repeat a doc_id stand at one place of the order and are drawn together. The order depends on ids and `seed`
    alone, so that reruns agree.
    """
    sized = _sized(docs, seed)
    rows = drawn(sized, with_shards(draw_plan(sized, weights, share, most, seed), depth, seed))
    return rows.select(
        "doc_id", "size", "source_size", F.col("target").cast("double").alias("target"),
        (F.col("size") * F.size("shards")).alias("taken"), F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_PASSES, depth: int = DEPTH, seed: int = SEED) -> DataFrame:
    """The mix itself: each copy drawn is a row with all columns of `docs`, and mix_shard and mix_key (the order in the shard).

    Write it partitioned by mix_shard and sorted by mix_key. Columns of these names in `docs` give way.
    """
    sized = _sized(docs, seed)
    plan = with_shards(draw_plan(sized, weights, share, most, seed), depth, seed)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("mix_shard", "mix_key")]).alias("row"))
    keyed = packed.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").cast("string").alias("source")).select("row", "source", *_keys(seed))
    copies = drawn(keyed, plan).select("row", "doc_id", F.posexplode("shards").alias("copy", "mix_shard"))
    return copies.select("row.*", "mix_shard", uniform(F.lit(seed), F.col("mix_shard"), F.col("doc_id"), F.col("copy")).alias("mix_key"))
