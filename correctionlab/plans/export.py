"""Export of corrected documents and part documents for all scores at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from correctionlab.operators import documents as D
from correctionlab.plans.sizing import cut_lineage, hashed, tasks_for
from correctionlab.sources import readers, writers
from correctionlab.sources.containers import write_containers


def located_edits(diffs: DataFrame, parts: DataFrame, measures: DataFrame, tasks: int | None = None) -> DataFrame:
    """`locate_edits` with its steps written out: the edits, a small share of the diffs, are read
    from the diffs once, and the plans stay short."""
    return place_written(cut_lineage(D.edits_of(diffs), "edits"), parts, measures, tasks)


def place_written(edits: DataFrame, parts: DataFrame, measures: DataFrame, tasks: int | None = None) -> DataFrame:
    placed = cut_lineage(D.place_edits(edits, parts, tasks), "placed")
    return cut_lineage(D.find_measures(placed, measures, tasks), "located")


def edited_and_whole(
    documents: DataFrame, diffs: DataFrame, comment_label: str = "edit"
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(lines of edited documents, all others as one line each, located edits, pieces of the documents named by edits) of all documents (score_id, xml).

    Only documents that some edit names are shredded, and only those in which an edit has a target are
    laid out anew, partwise. All others come out as the one line they are. Texts of documents meet tables of ids alone and are not sorted for it;
    documents that are dealt by `score_id` are not shuffled either.
    """
    edits = cut_lineage(D.edits_of(diffs), "edits")
    named = hashed(cut_lineage(edits.select("score_id").distinct(), "named"))
    pieces = cut_lineage(readers.shred(documents.join(named, "score_id", "left_semi")), "pieces", "kind")
    measures = readers.measures_of(pieces)
    tasks = tasks_for(documents.sparkSession, measures.count())
    located = place_written(edits, readers.parts_of(pieces), measures, tasks)
    changed = hashed(cut_lineage(located.where("measure_seq is not null").select("score_id").distinct(), "changed"))

    def of(table: DataFrame) -> DataFrame:
        return table.join(changed, "score_id", "left_semi")

    corrected = D.apply_edits(of(measures), located, comment_label, tasks)
    lines = D.document_lines(of(readers.heads_of(pieces)), of(readers.parts_of(pieces)), corrected, of(readers.groups_of(pieces)))
    return lines, D.verbatim_lines(documents.join(changed, "score_id", "left_anti")), located, pieces


def corrected_documents(
    documents: DataFrame, diffs: DataFrame, comment_label: str = "edit"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, located edits, pieces of the edited documents) of all documents (score_id, xml), as in `edited_and_whole`.

    `status` tells edited, unchanged and malformed (named by an edit, but not to be taken apart) ones.
    """
    lines, whole, located, pieces = edited_and_whole(documents, diffs, comment_label)
    broken = hashed(cut_lineage(readers.errors_of(pieces).select("score_id", F.lit("malformed").alias("status")), "broken"))
    whole = whole.join(broken, "score_id", "left")
    every = lines.withColumn("status", F.lit("edited")).unionByName(whole.withColumn("status", F.coalesce("status", F.lit("unchanged"))).select(*lines.columns, "status"))
    return every, located, pieces


def export_scores(
    documents: DataFrame, diffs: DataFrame, path: str, with_parts: bool = False, comment_label: str = "edit",
    in_containers: bool = False,
) -> DataFrame:
    """Write corrected documents below `path`/scores, and with `with_parts` part documents below `path`/parts.

    With `in_containers` many documents share a file and an index tells where each lies (`sources.containers`); else each has a
    folder of its own.

    Returns the edits that had no target measure. Part documents are made of every document that can be
    taken apart, so they need all pieces.
    """
    lines, whole, located, pieces = edited_and_whole(documents, diffs, comment_label)
    if in_containers:
        lines = cut_lineage(lines, "lines")
        tasks = tasks_for(documents.sparkSession, lines.count())
        write_containers(lines, f"{path}/scores", ["score_id"], ["section", "seq"], whole, tasks=tasks)
    else:
        writers.write_corrected(cut_lineage(lines.unionByName(whole), "lines"), f"{path}/scores")
    if with_parts:
        pieces = cut_lineage(readers.shred(documents), "pieces", "kind")
        corrected = D.apply_edits(readers.measures_of(pieces), located, comment_label)
        parts = D.extract_parts(readers.heads_of(pieces), readers.parts_of(pieces), corrected)
        parts = cut_lineage(parts, "part-lines")
        if in_containers:
            write_containers(parts, f"{path}/parts", ["score_id", "file_name"], ["section", "seq"])
        else:
            writers.write_parts(parts, f"{path}/parts")
    return located.where("measure_seq is null")
