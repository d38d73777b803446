"""Personal data by bootstrapped contextual extraction (operator 10).

Base detectors find e-mail addresses, IP addresses, payment cards and phone numbers. Their finds are seeds. Around each
seed and each other token shaped like an identifier, lexical patterns are taken: the two words before, and the word before
with the word after. Patterns and instances form a graph that Spark scores in rounds: a pattern of a kind is as sure as
the share of the distinct instances it surrounds that are of that kind; an instance is of a kind as surely as some of its
sure patterns is right. Instances over the bar join the seeds of the next round. What they stand for in the texts is added to the base spans.

Positions come from the pieces between matches: a match starts where the pieces and matches before it end. The patterns are
written so that no text makes them backtrack or start over in the middle of a run: runs are possessive, and a run that
failed at its start is not tried from within. Digits too few for a card are not matched at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from correctionlab.llm.common import text_or_empty
from correctionlab.plans.sizing import cut_lineage

# The base detectors, in the order of kinds.
KINDS = ("email", "ip", "card", "phone")
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9](?:[\x20-]?[0-9]){13})[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
EDGES_BEFORE = r"^[\"'(\[{<]+"
EDGES_AFTER = r"[\"')\]}>.,;:!?]+$"
SHORTEST = 6
# Tokens that hold a digit or an at sign, between white space, and are long enough.
TOKEN = rf"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]{{{SHORTEST}}})[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
PLACED_AT_ONCE = 256
BIN = 64               # spans that touch share a stretch of so many characters
CONTEXT = 80           # characters beside a span in which its words are looked for
ROUNDS = 3
SUPPORT = 3.0          # a pattern needs the weight of so many distinct instances
PATTERN_BAR = 0.8
INSTANCE_BAR = 0.8

SPAN = "struct<start:bigint,end:bigint,value:string>"


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) < 4) & F.forall(
            F.split(value, r"\."), lambda p: F.coalesce(F.right(F.concat(F.lit("0"), p), F.lit(4)).cast("int"), F.lit(0)) <= 255)
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))
    return F.length(digits).between(10, 15)


def spans_of(text: Column, pattern: str, matches: Column) -> Column:
    """Start, end (code points, end exclusive) and value of the leftmost non-overlapping matches of a pattern."""
    pieces = F.split(text, pattern, -1)
    zipped = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.struct(F.length(p).cast("bigint").alias("gap"), m.alias("value")))

    def place(part: Column, at: Column) -> Column:
        return F.aggregate(
            part, F.struct(at.alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")),
            lambda s, z: F.struct(
                (s["at"] + z["gap"] + F.length(z["value"])).alias("at"),
                F.concat(s["out"], F.array(F.struct((s["at"] + z["gap"]).alias("start"), (s["at"] + z["gap"] + F.length(z["value"])).alias("end"), z["value"].alias("value")))).alias("out"),
            ))

    # an array grows by being copied, so long lists are made of short ones
    start = F.struct(
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")).alias("last"),
        F.array().cast(f"array<array<{SPAN}>>").alias("done"))
    folded = F.aggregate(
        F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / PLACED_AT_ONCE).cast("int")), start,
        lambda s, k: F.struct(
            place(F.slice(zipped, k * PLACED_AT_ONCE + 1, F.lit(PLACED_AT_ONCE)), s["last"]["at"]).alias("last"),
            F.concat(s["done"], F.array(s["last"]["out"])).alias("done")),
        lambda s: F.flatten(F.concat(s["done"], F.array(s["last"]["out"]))))
    return F.when(F.size(matches) > 0, folded).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text, one column of spans for each kind and `tokens`); h is a hash of the text."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).withColumn("h", F.xxhash64("text"))
    # a kind's pattern is tried only on texts that have a character it can't do without
    has = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.contains("+"), "tokens": text.rlike("[0-9@]")}
    every = {**PATTERNS, "tokens": TOKEN}
    none = F.array().cast("array<string>")
    rows = rows.select("*", *[F.when(has[k], F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"m_{k}") for k, p in every.items()])
    return rows.select("doc_id", "h", "text", *[
        (_filter_kind(k, spans) if k in KINDS else spans).alias(k)
        for k, p in every.items() for spans in [spans_of(text, p, F.col(f"m_{k}"))]])


def _filter_kind(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def _with_context(text: Column, span: Column) -> list[Column]:
    """The words beside a span, lower-cased; empty at the ends of the text."""
    before = text.substr(F.greatest(span["start"] - CONTEXT, F.lit(0)).cast("int") + 1, F.least(span["start"], F.lit(CONTEXT)).cast("int"))
    after = text.substr(span["end"].cast("int") + 1, F.lit(CONTEXT))
    word = r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+"
    return [
        F.lower(F.regexp_extract(before, word + r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*$", 1)).alias("left2"),
        F.lower(F.regexp_extract(before, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)).alias("left1"),
        F.lower(F.regexp_extract(after, r"^[^\x20\x09-\x0D]*[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)", 1)).alias("right1"),
    ]


def _named(kind: str, order: int) -> Column:
    return F.transform(kind, lambda s: F.struct(
        s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end"), F.lower(s["value"]).alias("value")))


def occurrences(found: DataFrame) -> DataFrame:
    """From base spans one row for each document with `base` and `others`, spans with their values and contexts.

    `others` are tokens shaped like identifiers, without the punctuation around them.
    """
    text = F.col("text")
    base = F.flatten(F.array(*[
_named(k, n) for n, k in enumerate(KINDS)]))
    found = found.select("doc_id", "h", "text", "tokens", F.array_sort(base).alias("base"))
    trimmed = F.transform("tokens", lambda s: F.struct(
        s["start"].alias("start"), F.regexp_replace(s["value"], EDGES_BEFORE, "").alias("inner"), F.length(s["value"]).alias("whole")))
    tokens = F.transform(trimmed, lambda s: F.struct(
        (s["start"] + s["whole"] - F.length(s["inner"])).alias("start"), F.regexp_replace(s["inner"], EDGES_AFTER, "").alias("value")))
    tokens = F.transform(tokens, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["value"])).alias("end"), F.lower(s["value"]).alias("value")))
    found = found.select("doc_id", "h", "text", "base", F.filter(tokens, lambda s: (F.length(s["value"]) >= SHORTEST) & s["value"].rlike("[0-9@]")).alias("others"))
    return found.select(
        "doc_id", "h",
        F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["order"].alias("order"), b["kind"].alias("kind"), b["end"].alias("end"), b["value"].alias("value"), *_with_context(text, b))).alias("base"),
        F.transform("others", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), *_with_context(text, s))).alias("others"),
    )


def free_tokens(rows: DataFrame) -> DataFrame:
    """The tokens of `others` that no base span touches: doc_id, h, start, end, value and context."""
    def binned(column: str) -> DataFrame:
        one = rows.where((F.size("base") > 0) & (F.size("others") > 0)).select("doc_id", "h", F.explode(column).alias("s")).select("doc_id", "h", F.col("s.start").alias("start"), F.col("s.end").alias("end"))
        return one.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor(F.col("end") / BIN))))

    token, base = binned("others").alias("t"), binned("base").alias("b")
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "h", "bin")]
    touched = (
        token.join(base, same + [F.col("t.start") < F.col("b.end"), F.col("b.start") < F.col("t.end")], "left_semi")
        .select(F.col("doc_id").alias("of"), F.col("h").alias("oh"), F.col("start").alias("at")).distinct()
    )
    every = rows.where(F.size("others") > 0).select("doc_id", "h", F.explode("others").alias("s")).select("doc_id", "h", "s.*")
    return every.join(touched, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("oh")) & (F.col("start") == F.col("at")), "left_anti")


def pattern_edges(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Distinct (pattern, value, kind): which values the patterns surround; kind is null for values that no base detector found."""
    words = ("value", "left2", "left1", "right1")
    base = rows.where(F.size("base") > 0).select(F.explode("base").alias("s")).select("s.kind", *[f"s.{w}" for w in words])
    seen = base.unionByName(others.select(F.lit(None).cast("string").alias("kind"), *words))
    return seen.select("kind", "value", F.explode(F.array(
        F.when((F.col("left1") != "") & (F.col("left2") != ""), F.concat_ws(" ", "left2", "left1", F.lit("_"))),
        F.when((F.col("left1") != "") & (F.col("right1") != ""), F.concat_ws(" ", "left1", F.lit("_"), "right1")),
    )).alias("pattern")).where("pattern is not null").distinct()


def bootstrap(edges: DataFrame, rounds: int = ROUNDS, support: float = SUPPORT, pattern_bar: float = PATTERN_BAR, instance_bar: float = INSTANCE_BAR) -> DataFrame:
    """From edges (pattern, value, kind) the values found beside the seeds: (value, kind, score).

    Sums over the graph are partial before they are shuffled, so a pattern that stands everywhere costs a row a task. Patterns over the bar
    are the only ones that are joined to their values.
    """
    seeds = edges.where("kind is not null").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    graph = edges.select("pattern", "value").distinct()
    unseen = cut_lineage(graph.join(seeds.select("value").distinct(), "value", "left_anti"), "unseen")
    # what seeds give to patterns stays the same through the rounds
    total = graph.groupBy("pattern").agg(F.count("*").alias("values"))
    seeded = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").cast("double").alias("weight"))
    fixed = cut_lineage(seeded.join(total, "pattern"), "patterns")
    learned = cut_lineage(unseen.sparkSession.createDataFrame([], "value string, kind string, score double"), "learned")
    for _ in range(rounds):
        more = unseen.join(learned, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("more"))
        sure = (
            fixed.join(more, ["pattern", "kind"], "left").withColumn("weight", F.col("weight") + F.coalesce("more", F.lit(0.0)))
            .withColumn("sureness", F.col("weight") / F.col("values")).where((F.col("weight") >= support) & (F.col("sureness") >= pattern_bar))
            .select("pattern", "kind", F.least("sureness", F.lit(0.99)).alias("sureness"))
        )
        scored = unseen.join(sure, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("sureness"))))).alias("score")).where(F.col("score") >= instance_bar)
        best = scored.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b")).select("value", "b.kind", "b.score")
        before, learned = learned, cut_lineage(best, "learned")
        if learned.count() == before.count():
            break
    return learned


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text, ...): doc_id, base and spans, arrays of (start, order, kind, end).

    Null text is empty and has no span; so has text without digits and at signs. Texts are read whole. Repeated rows have equal spans.
    `spans` has those of `base` and those that the method adds, by start, then kind. Other columns are ignored.
    """
    rows = cut_lineage(occurrences(base_spans(docs)), "spans")
    others = cut_lineage(free_tokens(rows), "tokens")
    learned = bootstrap(cut_lineage(pattern_edges(rows, others), "edges"))
    order = reduce(lambda c, k: c.when(F.col("kind") == k[1], k[0]), enumerate(KINDS), F).otherwise(len(KINDS))
    extra = (
        others.join(learned, "value").select("doc_id", "h", F.struct("start", order.alias("order"), "kind", "end").alias("s")).distinct()
        .groupBy("doc_id", "h").agg(F.collect_list("s").alias("extra")).select(F.col("doc_id").alias("of"), F.col("h").alias("oh"), "extra")
    )
    slim = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["order"].alias("order"), b["kind"].alias("kind"), b["end"].alias("end")))
    return rows.join(extra, (F.col("h") == F.col("oh")) & F.col("doc_id").eqNullSafe(F.col("of")), "left").select(
        "doc_id", slim.alias("base"), F.array_sort(F.when(F.col("extra").isNull(), slim).otherwise(F.concat(slim, F.col("extra")))).alias("spans"))


def digest(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
