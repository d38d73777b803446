"""Small Catalyst expressions used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from correctionlab.functions import fixed_values as V


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole to four places, 0.0 when there is nothing to divide by."""
    return F.when(whole > 0, F.round(part / whole, 4)).otherwise(F.lit(0.0))


def percent_text(rate: Column) -> Column:
    """0.825 -> '82%': ties go to the even neighbour before formatting."""
    return F.format_string("%.0f%%", F.bround(rate * 100))


def round_half_up(c: Column) -> Column:
    """Rounding as browsers do it: floor(x + 0.5)."""
    return F.floor(c + 0.5)


def week_key(ts: Column) -> Column:
    """Year and Monday-first week of year (00-53); days before the first Monday are week 00."""
    week = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7)
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-"), F.lpad(week.cast("string"), 2, "0"))


def band(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.5, "mid").otherwise("low")


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def era_column(composer: Column, year: Column) -> Column:
    """Year decides when present; else the first list with a name contained in the composer."""
    by_year = F.when(year.isNull(), None)
    for era, below in V.ERA_YEAR_BOUNDS:
        by_year = by_year.when(year < below, era)
    name = F.lower(composer)
    by_name = None
    for era, names in V.ERA_COMPOSERS:
        hit = name.rlike("|".join(names))
        by_name = F.when(hit, era) if by_name is None else by_name.when(hit, era)
    return (
        F.when(year.isNotNull(), by_year.otherwise(V.DEFAULT_ERA))
        .otherwise(by_name.otherwise(V.DEFAULT_ERA))
    )


def media_type(path: Column) -> Column:
    # the extension of the last path segment; a leading dot alone is a name, not an extension
    ext = F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))
    return F.concat(F.lit("image/"), F.when(ext.isin(*V.IMAGE_EXTENSIONS), ext).otherwise("png"))


def safe_file_name(name: Column) -> Column:
    return F.translate(name, " /", "_-")


def url_file_name(url: Column) -> Column:
    """Last path segment without its query; always ends in the score suffix."""
    last = F.split_part(F.substring_index(url, "/", -1), F.lit("?"), F.lit(1))
    name = F.coalesce(blank_to_null(last), F.lit(V.DEFAULT_FILE_NAME))
    return F.when(F.lower(name).endswith(V.LINK_SUFFIX), name).otherwise(
        F.concat(name, F.lit(V.LINK_SUFFIX))
    )


def hash_id(*columns: str) -> Column:
    """An id from texts: each with its length before it, so that no two lists of texts run together; null is n."""
    parts = [F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat_ws(":", F.length(F.col(c).cast("string")).cast("string"), F.col(c).cast("string"))) for c in columns]
    return F.sha2(F.concat(*parts), 256)
