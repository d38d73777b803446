"""Score documents: locating and applying edits, splitting, checking, and header insertion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from correctionlab.functions import fixed_values as V
from correctionlab.functions import xml as X
from correctionlab.functions.expressions import blank_to_null, safe_file_name, strip
from correctionlab.plans.sizing import dealt

MEASURE_KEY = ("score_id", "part_id", "measure_seq")


# --- statistics -----------------------------------------------------------------


def measures_per_part(measures: DataFrame) -> DataFrame:
    return measures.groupBy("score_id", "part_id").agg(F.count(F.lit(1)).alias("measures"))


def measure_counts(measures: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Measure elements, parts and the longest part of each score.

    In a document that nests parts in measures, each measure element holds all parts; with `heads`
    such scores count every measure once.
    """
    per_score = (
        measures_per_part(measures)
        .groupBy("score_id")
        .agg(
            F.sum("measures").alias("measure_elements"),
            F.count(F.lit(1)).alias("parts"),
            F.max("measures").alias("longest_part"),
        )
    )
    if heads is None:
        return per_score
    elements = F.when(F.col("layout") == "timewise", F.col("longest_part")).otherwise(F.col("measure_elements"))
    return per_score.join(heads.select("score_id", "layout"), "score_id", "left").select(
        "score_id", elements.alias("measure_elements"), "parts", "longest_part"
    )


# --- edits ------------------------------------------------------------------------


GRAM = 3


def _grams(text: str, size: Column) -> Column:
    """Distinct substrings of this length of a column; none if it is shorter."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(text), i, size)))


def names_containing(names: DataFrame, needles: DataFrame) -> DataFrame:
    """(name, needle) wherever the needle is part of the name.

    An inverted index of the names' short substrings: each needle looks up the one of its own substrings of
    GRAM characters (all of it, if it is shorter) that the fewest names have, and is then looked for in these names. The index is
    as long as the names times GRAM, no array is longer than a name, and both inputs are vocabularies, not rows of the big tables.
    """
    needles = needles.select("needle").where(F.col("needle").isNotNull()).distinct()
    sized = needles.withColumn("size", F.least(F.length("needle"), F.lit(GRAM)))
    index = (
        names.select("name").where(F.col("name") != "").distinct()
        .select("name", F.explode(F.sequence(F.lit(0), F.least(F.length("name"), F.lit(GRAM)))).alias("size"))
        .join(sized.select("size").distinct(), "size", "left_semi")
        .select("name", F.explode(_grams("name", F.col("size"))).alias("gram"))
    )
    held = index.groupBy("gram").agg(F.count(F.lit(1)).alias("names"))
    rarest = (
        sized.select("needle", F.explode(_grams("needle", F.col("size"))).alias("gram"))
        .join(held, "gram", "left")
        .groupBy("needle").agg(F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "gram")).alias("least"))
        .where(F.col("least.names") > 0).select("needle", F.col("least.gram").alias("gram"))
    )
    return index.join(rarest, "gram").where(F.contains("name", "needle")).select("name", "needle")


def edits_of(diffs: DataFrame) -> DataFrame:
    """Diffs whose decision is an edit with a value; nothing else changes a document."""
    return diffs.where((F.col("human_decision") == "edit") & (F.col("human_edit_value") != "")).select(
        "id", "score_id", "instrument", "measure_number", "human_edit_value", "human_reviewed_at"
    )


def place_edits(edits: DataFrame, parts: DataFrame, tasks: int | None = None) -> DataFrame:
    """Target part of every edit: the first listed one, present in the document, whose name contains
    the instrument, else the first part of the document."""
    edits = edits.withColumn("needle", F.lower("instrument"))
    edited = edits.select("score_id").distinct()
    present = dealt(parts.where(F.col("body_seq").isNotNull()), tasks, "score_id").join(edited, "score_id", "left_semi")
    named = present.where(F.col("part_name").isNotNull()).select(
        "score_id", "part_seq", "part_id", F.lower("part_name").alias("name")
    )
    by_name = (
        named.join(names_containing(named, edits), "name")
        .groupBy("score_id", "needle")
        .agg(F.min_by("part_id", "part_seq").alias("named_part"))
    )
    first = present.groupBy("score_id").agg(F.min_by("part_id", "body_seq").alias("first_part"))
    return (
        edits.join(by_name, ["score_id", "needle"], "left")
        .join(first, "score_id", "left")
        .select(
            "id", "score_id", "instrument", "measure_number", "human_edit_value", "human_reviewed_at",
            F.coalesce("named_part", "first_part").alias("part_id"),
            F.col("named_part").isNotNull().alias("matched_by_name"),
        )
    )


def find_measures(placed: DataFrame, measures: DataFrame, tasks: int | None = None) -> DataFrame:
    """Target measure of every placed edit: the part's first with the edit's number.

    `measure_seq` is null where there is none, and such edits change nothing. Of the measures only
    keys are read, and only those some edit names are grouped. `tasks`, here and in the other steps, is the number of partitions
    that the measures or parts are dealt into.
    """
    key = ["score_id", "part_id", "number"]
    placed = placed.withColumn("number", F.col("measure_number").cast("string"))
    numbered = measures.select(
        "score_id", "part_id", F.col("measure_number").alias("number"), "measure_seq"
    )
    positions = (
        dealt(numbered, tasks, *key).join(placed.select(*key).distinct(), key, "left_semi")
        .groupBy(*key)
        .agg(F.min("measure_seq").alias("measure_seq"))
    )
    return placed.join(positions, key, "left").drop("number")


def locate_edits(diffs: DataFrame, parts: DataFrame, measures: DataFrame) -> DataFrame:
    """Target part and measure of every edit among the diffs, as one lazy plan.

    The plan reads the edits several times; `plans.export.located_edits` writes them out between
    the steps instead.
    """
    return find_measures(place_edits(edits_of(diffs), parts), measures)


def measure_changes(located: DataFrame, comment_label: str = "edit") -> DataFrame:
    """What the edits of one measure amount to: the last replacement and the comments after it.

    In the order (human_reviewed_at, id), an XML value replaces the content and wipes what came
    before it, and any other value appends a comment. Edits before the last replacement therefore
    cannot show; they go before anything is collected, and what is collected is exactly text of the
    resulting measure.
    """
    value = strip(F.col("human_edit_value"))
    long_ago = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    edits = located.where(F.col("measure_seq").isNotNull()).select(
        *MEASURE_KEY,
        F.struct(
            F.coalesce(F.col("human_reviewed_at").cast("timestamp_ntz"), long_ago).alias("at"), "id"
        ).alias("rank"),
        value.alias("value"),
        F.when(value.startswith("<") & value.endswith(">"), X.is_fragment(value))
        .otherwise(F.lit(False)).alias("is_xml"),
    )
    last = edits.where("is_xml").groupBy(*MEASURE_KEY).agg(F.max("rank").alias("since"))
    comment = F.when(~F.col("is_xml"), F.struct("rank", "value"))
    rendered = F.transform(
        F.array_sort(F.collect_list(comment)),
        # two hyphens would end or break the comment
        lambda c: F.concat(F.lit(f"<!-- {comment_label}: "), F.regexp_replace(c.value, "-(?=-)", "- "), F.lit(" -->")),
    )
    return (
        edits.join(last, list(MEASURE_KEY), "left")
        .where(F.col("since").isNull() | (F.col("rank") >= F.col("since")))
        .groupBy(*MEASURE_KEY)
        .agg(
            F.max(F.when(F.col("is_xml"), F.col("value"))).alias("new_content"),
            F.array_join(rendered, "").alias("comments"),
        )
    )


def apply_edits(measures: DataFrame, located: DataFrame, comment_label: str = "edit", tasks: int | None = None) -> DataFrame:
    """Measures with the located edits applied; `edited` marks the ones that changed."""
    changes = measure_changes(located, comment_label)
    head, inner, end = X.element_parts(F.col("xml"))
    changed = F.concat(
        head, F.lit(">"), F.coalesce("new_content", inner), F.col("comments"), end
    )
    hit = F.col("comments").isNotNull()
    joined = dealt(measures, tasks, *MEASURE_KEY).join(changes, list(MEASURE_KEY), "left")
    return joined.select(
        *[F.when(hit, changed).otherwise(F.col("xml")).alias("xml") if c == "xml" else F.col(c)
          for c in measures.columns],
        hit.alias("edited"),
    )


# --- documents as ordered lines -----------------------------------------------------


def _tag_lines(heads: DataFrame, parts: DataFrame) -> DataFrame:
    """Start and end tag of every part that is present in its document, around its measures."""
    escaped = F.replace(F.replace("part_id", F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    start = F.concat(F.lit("<"), "prefix", F.lit('part id="'), escaped, F.lit('">'))
    end = F.concat(F.lit("</"), "prefix", F.lit("part>"))
    return (
        parts.where(F.col("body_seq").isNotNull())
        .join(heads.select("score_id", "prefix"), "score_id")
        .select(
            "score_id", "part_id", "part_seq", "part_name", "body_seq",
            F.inline(F.array(
                F.struct(F.lit(-1).alias("seq"), start.alias("line")),
                F.struct(F.lit(2**31 - 1).alias("seq"), end.alias("line")),
            )),
        )
    )


def _measure_lines(measures: DataFrame) -> DataFrame:
    return measures.select(
        "score_id", "part_id", "part_seq", "part_name", "body_seq",
        F.col("measure_seq").alias("seq"), F.col("xml").alias("line"),
    )


XML_DECLARATION = "<?xml version='1.0' encoding='utf-8'?>"


def document_lines(heads: DataFrame, parts: DataFrame, measures: DataFrame, groups: DataFrame) -> DataFrame:
    """Whole documents as rows (score_id, section, seq, line); sorted by the keys they read as XML.

    The entries of the part list, parts and groups, stand in their one sequence.

    Measures carry their part's place in the document, so they are only projected here, not joined
    or shuffled, and a document is never gathered into one value.
    """
    def fixed(section: int, line: Column) -> DataFrame:
        return heads.select("score_id", F.lit(section).alias("section"), F.lit(0).alias("seq"), line.alias("line"))

    # sections: 0 declaration to head, 1 list start, 2 list entries, 3 list end, from 4 the parts, last the root end
    entries = parts.where(F.col("part_xml").isNotNull()).select(
        "score_id", F.lit(2).alias("section"), F.col("part_seq").alias("seq"), F.col("part_xml").alias("line")
    ).unionByName(groups.select("score_id", F.lit(2).alias("section"), F.col("part_seq").alias("seq"), F.col("group_xml").alias("line")))
    body = _tag_lines(heads, parts).unionByName(_measure_lines(measures)).select(
        "score_id", (F.col("body_seq") + 4).alias("section"), "seq", "line"
    )
    return (
        fixed(0, F.concat(F.lit(XML_DECLARATION), "root_open", "head_xml"))
        .unionByName(fixed(1, F.concat(F.lit("<"), "prefix", F.lit("part-list>"))))
        .unionByName(entries)
        .unionByName(fixed(3, F.concat(F.lit("</"), "prefix", F.lit("part-list>"))))
        .unionByName(body)
        .unionByName(fixed(2**31 - 1, F.col("root_close")))
    )


def extract_parts(heads: DataFrame, parts: DataFrame, measures: DataFrame) -> DataFrame:
    """One document per listed part as rows (score_id, part_id, part_name, file_name, section, seq, line).

    The documents are partwise whatever the source was. Equal part names get apart by the part id
    in the file name.
    """
    listed = parts.where(F.col("part_xml").isNotNull())
    before = F.concat(
        F.lit(XML_DECLARATION), "root_open", "head_xml", F.lit("<"), "prefix", F.lit("part-list>"),
        "groups_before", "part_xml", "groups_after", F.lit("</"), "prefix", F.lit("part-list>"),
    )
    frame = listed.join(heads, "score_id").select(
        "score_id", "part_id", "part_name",
        F.inline(F.array(
            F.struct(F.lit(0).alias("section"), F.lit(0).alias("seq"), before.alias("line")),
            F.struct(F.lit(2).alias("section"), F.lit(0).alias("seq"), F.col("root_close").alias("line")),
        )),
    )
    body = (
        _tag_lines(heads, listed).unionByName(_measure_lines(measures.where(F.col("part_seq").isNotNull())))
        .select("score_id", "part_id", "part_name", F.lit(1).alias("section"), "seq", "line")
    )
    name = F.coalesce("part_name", "part_id")
    return frame.unionByName(body).select(
        "score_id", "part_id", name.alias("part_name"),
        F.concat(safe_file_name(name), F.lit("_"), "part_id", F.lit(".xml")).alias("file_name"),
        "section", "seq", "line",
    )


def verbatim_lines(documents: DataFrame) -> DataFrame:
    """Documents (score_id, xml) as one line each, their text as it is."""
    return documents.select(
        "score_id", F.lit(0).alias("section"), F.lit(0).alias("seq"), F.coalesce("xml", F.lit("")).alias("line"))


# --- metadata and validation ------------------------------------------------------

def document_metadata(inspected: DataFrame) -> DataFrame:
    """title, opus, subtitle, composer and arranger; all null when malformed.

    Of several creators of a kind the last one with a text counts.
    """
    return inspected.select("score_id", "title", "opus", "subtitle", "composer", "arranger")


def validate_documents(inspected: DataFrame) -> DataFrame:
    """Well-formedness, and the lenient and strict root checks."""
    tag = F.lower("root_tag")
    local = F.substring_index(tag, "}", -1)
    return inspected.select(
        "score_id", "well_formed",
        F.coalesce(tag.contains("score"), F.lit(False)).alias("lenient"),
        F.coalesce(local.isin(*V.STRICT_ROOTS), F.lit(False)).alias("strict"),
    )


def validate_pdfs(files: DataFrame) -> DataFrame:
    return files.select("path", (F.substring("content", 1, 4) == F.lit(b"%PDF")).alias("valid_pdf"))


# --- engraving sources --------------------------------------------------------------


def inject_headers(sources: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Engraving sources (key, content) with a header block made of their metadata.

    Sources that have a header, or no metadata, stay as they are. The block goes after the version
    line when there is one, else to the top.
    """
    def field(name: str, prefix: str = "") -> Column:
        escaped = F.replace(F.col(name), F.lit('"'), F.lit('\\"'))
        return F.concat(F.lit(f'  {name} = "{prefix}'), escaped, F.lit('"'))

    fields = F.array_compact(F.array(
        field("title"), field("subtitle"), field("composer"), field("opus"), field("arranger", "arr. "),
    ))
    block = F.concat(F.lit("\\header {\n"), F.array_join(fields, "\n"), F.lit("\n}\n\n"))
    content = F.col("content")
    version = r'\\version\s+"[^"]+"\s*\n'
    at = F.regexp_instr(content, F.lit(version))
    cut = at - 1 + F.length(F.regexp_extract(content, version, 0))
    placed = F.when(
        at > 0,
        F.concat(
            F.substring(content, F.lit(1), cut), F.lit("\n"), block,
            F.substring(content, cut + 1, F.length(content)),
        ),
    ).otherwise(F.concat(block, content))
    wanted = (F.coalesce(F.size(fields), F.lit(0)) > 0) & ~content.rlike(r"\\header\s*\{")
    return sources.join(metadata, key, "left").select(
        key, F.when(wanted, placed).otherwise(content).alias("content"), wanted.alias("injected")
    )
