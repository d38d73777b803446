"""Page pairs, comparison requests, and the answers and logs that come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from correctionlab.functions import fixed_values as V
from correctionlab.functions.expressions import hash_id, media_type, strip


def pair_pages(left: DataFrame, right: DataFrame) -> DataFrame:
    """Scanned and rendered page of the same number; pages only one side has are left out."""
    return left.select("score_id", "page_no", F.col("path").alias("left_path")).join(
        right.select("score_id", "page_no", F.col("path").alias("right_path")), ["score_id", "page_no"]
    ).select(
        "score_id", "page_no", "left_path", "right_path",
        media_type(F.col("left_path")).alias("left_media"),
        media_type(F.col("right_path")).alias("right_media"),
    )


def comparison_prompts(pages: DataFrame, scores: DataFrame) -> DataFrame:
    """Request text per page; absent metadata reads Unknown or unknown."""
    meta = scores.select(
        F.col("id").alias("score_id"),
        *[F.col(c) for c in ("title", "composer", "era", "instrument") if c in scores.columns],
    )
    joined = pages.join(meta, "score_id", "left")

    def field(name: str, default: str) -> Column:
        return F.coalesce(name, F.lit(default)) if name in meta.columns else F.lit(default)

    text = F.format_string(
        V.COMPARISON_PROMPT,
        field("title", "Unknown"), field("composer", "Unknown"), field("era", "unknown"),
        field("instrument", "unknown"), F.col("page_no"),
    )
    return joined.select(*pages.columns, text.alias("prompt"))


def _truthy(v: Column) -> Column:
    """Whether a JSON value counts as true: no zero, no blank, nothing empty."""
    kind, text = F.schema_of_variant(v), v.cast("string")
    return (
        F.when(v.isNull() | (kind == "VOID"), F.lit(False))
        .when(kind == "BOOLEAN", text == "true")
        .when(kind == "STRING", text != "")
        .when(kind.startswith("ARRAY"), text != "[]")
        .when(kind.startswith("OBJECT"), text != "{}")
        .otherwise(text.cast("double") != 0)
    )


def _differences(text: Column) -> Column:
    """Array with the difference the answer reports, or an empty one.

    Written as steps over one-element arrays: each step's value is computed once and then used by
    name, where plain columns would repeat the JSON parse for every use.
    """
    def field(json: Column, name: str) -> Column:
        return F.try_variant_get(json, f"$.{name}", "variant").alias(name)

    parsed = F.transform(
        F.array(text),
        lambda t: F.coalesce(F.try_parse_json(t), F.try_parse_json(F.regexp_extract(t, r"(?s)\{.*\}", 0))),
    )
    fields = F.transform(parsed, lambda j: F.struct(*[
        field(j, name) for name in ("has_difference", "difference_type", "description", "confidence")
    ]))
    wanted = F.transform(F.filter(fields, lambda f: _truthy(f.has_difference)), lambda f: F.struct(
        F.coalesce(f.difference_type.cast("string"), F.lit("other")).alias("difference_type"),
        F.coalesce(f.description.cast("string"), F.lit("")).alias("description"),
        F.when(f.confidence.isNull(), F.lit(V.DEFAULT_VISION_CONFIDENCE))
        .otherwise(F.try_variant_get(f.confidence, "$", "double")).alias("vision_confidence"),
    ))
    return F.filter(wanted, lambda f: f.vision_confidence.isNotNull())


def parse_responses(responses: DataFrame) -> DataFrame:
    """Differences the answers report.

    An answer is JSON, JSON in a code fence, or prose around one JSON object. Answers without
    JSON, without an object, without a difference, or with a confidence that is no number, drop out.
    """
    text = strip(F.col("response_text"))
    unfenced = F.regexp_replace(text, r"(?s)\A```[^\n]*\n(.*)\n[^\n]*\z", "$1")
    return responses.select(
        "score_id", F.col("page_no").alias("measure_number"), "instrument", F.inline(_differences(unfenced))
    )


def log_confidence(logs: DataFrame) -> DataFrame:
    """Recogniser confidence per score: a grade held to [0, 1], else a percentage, else 0.5.

    Of several logs of a score the latest by `logged_at` counts; without that column, or at equal
    times, the last by its text.
    """
    logged_at = F.col("logged_at") if "logged_at" in logs.columns else F.lit(None).cast("timestamp")
    logs = logs.groupBy("score_id").agg(F.max(F.struct(logged_at.alias("at"), F.col("log_text").alias("text"))).alias("m")).select(
        "score_id", F.col("m.text").alias("log_text"))
    grade = F.regexp_extract("log_text", V.GRADE_PATTERN, 1)
    percent = F.regexp_extract("log_text", V.RECOGNITION_PATTERN, 1)
    value = (
        F.when(grade != "", F.least(F.greatest(grade.cast("double"), F.lit(0.0)), F.lit(1.0)))
        .when(percent != "", percent.cast("double") / 100)
        .otherwise(F.lit(V.DEFAULT_OMR_CONFIDENCE))
    )
    return logs.select("score_id", value.alias("confidence"))


def new_diffs(parsed: DataFrame, confidences: DataFrame | None, as_of: Column) -> DataFrame:
    """Parsed answers as undecided diff rows; recogniser confidence from the score's log.

    Answers that say the same of a page are one diff, with the greatest confidence.
    """
    said = ("score_id", "measure_number", "instrument", "difference_type", "description")
    df = parsed.groupBy(*said).agg(F.max("vision_confidence").alias("vision_confidence"))
    if confidences is not None:
        df = df.join(confidences.withColumnRenamed("confidence", "omr_confidence"), "score_id", "left")
    else:
        df = df.withColumn("omr_confidence", F.lit(None).cast("double"))
    return df.select(
        hash_id(*said).alias("id"),
        "score_id", "measure_number", "instrument",
        F.lit(V.DEFAULT_TIME_SIGNATURE).alias("time_signature"),
        F.lit(V.DEFAULT_KEY_SIGNATURE).alias("key_signature"),
        "difference_type", "description",
        F.lit("").alias("pdf_snippet_path"),
        F.lit("").alias("musicxml_snippet_path"),
        F.coalesce("omr_confidence", F.lit(V.DEFAULT_OMR_CONFIDENCE)).alias("omr_confidence"),
        "vision_confidence",
        F.lit(None).cast("string").alias("human_decision"),
        F.lit(None).cast("string").alias("human_edit_value"),
        F.lit(None).cast("timestamp_ntz").alias("human_reviewed_at"),
        F.lit(False).alias("auto_accepted"),
        F.lit(None).cast("string").alias("auto_accept_rule_id"),
        as_of.alias("created_at"),
    )
