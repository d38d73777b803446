"""Links, composers and descriptions out of fetched catalogue pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from correctionlab.functions import fixed_values as V
from correctionlab.functions import html as H
from correctionlab.functions.expressions import blank_to_null, era_column, strip, url_file_name


@dataclass(frozen=True)
class LinkRules:
    """Which anchors lead to a score. The four strategies are tried in this order."""

    row_tag: str = V.LINK_ROW_TAG
    row_class: str | None = V.LINK_ROW_CLASS
    gateway: str = V.LINK_GATEWAY
    suffix: str = V.LINK_SUFFIX
    image_pattern: str = V.LINK_IMAGE_PATTERN


@dataclass(frozen=True)
class PageLayout:
    """Where a page keeps its heading and its body text."""

    heading_class: str = V.HEADING_CLASS
    body_tag: str = V.BODY_TAG
    body_class: str | None = V.BODY_CLASS
    category_href: str = V.CATEGORY_HREF


def link_list(html: Column, url: Column, rules: LinkRules, limit: int) -> Column:
    """Distinct absolute links in strategy order, the first `limit` of them."""

    def gateway(h: Column) -> Column:
        return h.contains(rules.gateway)

    def document(h: Column) -> Column:
        return F.lower(h).endswith(rules.suffix)

    rows = H.elements(html, rules.row_tag, rules.row_class)
    in_rows = F.flatten(F.transform(rows, lambda row: H.hrefs(row)))
    anywhere = H.hrefs(html)
    ordered = F.concat(
        F.filter(in_rows, lambda h: gateway(h) | document(h)),
        F.filter(anywhere, gateway),
        F.filter(anywhere, document),
        F.filter(anywhere, lambda h: h.rlike(rules.image_pattern)),
    )
    absolute = F.transform(F.array_distinct(ordered), lambda h: H.absolute_url(url, h))
    return F.slice(F.array_distinct(absolute), 1, limit)


def page_links(
    pages: DataFrame, rules: LinkRules = LinkRules(), limit: int = V.LINKS_PER_PAGE
) -> DataFrame:
    """One row per link: page_id, position from 1, link, and the file name it would be stored as."""
    visible = pages.select("page_id", "url", H.visible(F.col("html")).alias("html"))
    links = visible.select("page_id", F.posexplode(link_list(F.col("html"), F.col("url"), rules, limit)))
    return links.select(
        "page_id", (F.col("pos") + 1).cast("bigint").alias("position"), F.col("col").alias("link"),
        url_file_name(F.col("col")).alias("file_name"),
    )


def _composer(html: Column, layout: PageLayout) -> Column:
    header_cell = (
        rf"(?is)<th(?=[\s>]){H.ATTRIBUTES}>((?:(?!<th[\s>]|</tr|<tr[\s>]).)*?)</th\s*>"
        rf"(?:(?!<td[\s>]|</tr|<tr[\s>]).)*?<td(?=[\s>]){H.ATTRIBUTES}>(.*?)(?=</td\s*>|<td[\s>]|</tr|\z)"
    )
    labels = F.transform(H.all_matches(html, header_cell, 1), lambda x: F.lower(H.text_of(x)))
    values = F.transform(H.all_matches(html, header_cell, 2), lambda x: H.text_of(x))
    from_infobox = F.get(values, F.array_position(labels, "composer").cast("int") - 1)

    heading = F.get(H.elements(html, "h1", layout.heading_class), F.lit(0))
    from_heading = strip(F.regexp_extract(H.text_of(heading, trim_each=False), r"\(([^)]+)\)$", 1))

    category = rf"(?is)<a(\s{H.ATTRIBUTES})>(.*?)</a\s*>"
    anchors = F.arrays_zip(
        H.all_matches(html, category, 1).alias("tag"), H.all_matches(html, category, 2).alias("text")
    )
    names = F.transform(
        F.filter(
            anchors,
            lambda a: F.coalesce(H.attribute(a.tag, "href").contains(layout.category_href), F.lit(False)),
        ),
        lambda a: strip(H.text_of(a.text, trim_each=False)),
    )
    generic = "|".join(V.GENERIC_CATEGORY_WORDS)
    person = F.filter(names, lambda n: (n != "") & ~F.lower(n).rlike(generic))
    return F.coalesce(
        blank_to_null(from_infobox), blank_to_null(from_heading), F.get(person, F.lit(0)), F.lit("")
    )


def _description(html: Column, layout: PageLayout) -> Column:
    body = H.container(html, layout.body_tag, layout.body_class)
    long_enough = F.filter(H.paragraphs(body), lambda p: F.length(p) > V.DESCRIPTION_MIN_CHARS)
    return F.coalesce(F.substring(F.get(long_enough, F.lit(0)), 1, V.DESCRIPTION_MAX_CHARS), F.lit(""))


def page_metadata(pages: DataFrame, layout: PageLayout = PageLayout()) -> DataFrame:
    """Composer, era by composer, and description of each page."""
    visible = pages.select("page_id", H.visible(F.col("html")).alias("html"))
    found = visible.select(
        "page_id",
        _composer(F.col("html"), layout).alias("composer"),
        _description(F.col("html"), layout).alias("description"),
    )
    return found.withColumn("era", era_column(F.col("composer"), F.lit(None).cast("int")))


def url_file_names(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", url_file_name(F.col("url")).alias("file_name"))
