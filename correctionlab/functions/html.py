"""Reading links and texts out of HTML with Catalyst expressions only.

Pages are tag soup, so these are patterns, not a tree: comments, scripts and styles are removed
first, then tags are found whatever their case, quoting or attribute order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from correctionlab.functions.expressions import strip

# fixed values: the named and numeric entities that are decoded, ampersand last
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
    ("&#39;", "'"), ("&#x27;", "'"), ("&#34;", '"'), ("&#38;", "&"), ("&amp;", "&"),
)
INVISIBLE = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
# possessive runs: nothing is tried again, and a page of any length needs no more stack
ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
# a paragraph ends at its end tag, at the next block element, or where its container ends
BLOCK_START = (
    r"<(?:p|div|ul|ol|dl|table|h[1-6]|pre|blockquote|form|hr|address|fieldset)(?=[\s/>])"
)
BLOCK_END = r"</(?:p|div|body|html|td|th|li|article|section)\s*>"


def visible(html: Column) -> Column:
    return F.regexp_replace(html, INVISIBLE, "")


def decode(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def all_matches(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def text_of(html: Column, trim_each: bool = True) -> Column:
    """Text of a fragment; with `trim_each`, every piece between tags is trimmed before joining."""
    pieces = F.transform(F.split(html, r"<[^>]*>"), lambda x: decode(x))
    if trim_each:
        pieces = F.transform(pieces, lambda x: strip(x))
    return F.array_join(pieces, "")


def attribute(tag: Column, name: str) -> Column:
    """Decoded attribute value of one tag; null when the tag has no such attribute."""
    hit = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(tag, hit, g) for g in (1, 2, 3)])
    return F.when(tag.rlike(hit), decode(value))


def hrefs(html: Column) -> Column:
    """Targets of all anchors in page order."""
    tags = all_matches(html, rf"(?is)<a\s{ATTRIBUTES}>", 0)
    return F.array_compact(F.transform(tags, lambda tag: attribute(tag, "href")))


def elements(html: Column, tag: str, css_class: str | None) -> Column:
    """Inner HTML of elements that do not nest in themselves (rows, list items, headings)."""
    if css_class is None:
        opening = rf"<{tag}(?=[\s>]){ATTRIBUTES}>"
    else:
        has_class = rf"""(?=[^>]*\sclass\s*=\s*["']?(?:[^"'>]*\s)?{css_class}(?=["'\s>]))"""
        opening = rf"<{tag}{has_class}{ATTRIBUTES}>"
    closing = rf"(?=</{tag}\s*>|<{tag}(?=[\s>])|</table\s*>|\z)"
    return all_matches(html, rf"(?is){opening}(.*?){closing}", 1)


def container(html: Column, tag: str, css_class: str | None) -> Column:
    """Inner HTML of the first element of that kind, up to its own end tag; null if there is none.

    The end is found by counting: after each end tag, as many elements are open as start tags were
    seen minus end tags. The first piece that brings the count to zero is the last one inside.
    """
    if css_class is None:
        opening = rf"(?is)<{tag}(?=[\s>]){ATTRIBUTES}>"
    else:
        opening = (
            rf"""(?is)<{tag}(?=[^>]*\sclass\s*=\s*["']?(?:[^"'>]*\s)?{css_class}(?=["'\s>]))"""
            rf"{ATTRIBUTES}>"
        )
    start = F.regexp_instr(html, F.lit(opening))
    first_tag = F.regexp_extract(html, opening, 0)
    after = F.substring(html, start + F.length(first_tag), F.length(html))
    pieces = F.split(after, rf"(?i)</{tag}\s*>")
    zero = F.struct(F.lit(1).alias("open"), F.lit(0).alias("taken"))

    def step(state: Column, piece: Column) -> Column:
        opened = F.size(F.split(piece, rf"(?i)<{tag}(?=[\s>])")) - 1
        going = state.open > 0
        return F.struct(
            F.when(going, state.open + opened - 1).otherwise(0).alias("open"),
            (state.taken + going.cast("int")).alias("taken"),
        )

    taken = F.aggregate(pieces, zero, step).getField("taken")
    inner = F.array_join(F.slice(pieces, F.lit(1), taken), f"</{tag}>")
    return F.when(start > 0, inner)


def paragraphs(html: Column) -> Column:
    """Texts of the paragraphs in page order."""
    inner = all_matches(html, rf"(?is)<p(?=[\s>]){ATTRIBUTES}>(.*?)(?={BLOCK_START}|{BLOCK_END}|\z)", 1)
    return F.transform(inner, lambda p: text_of(p))


def absolute_url(base: Column, href: Column) -> Column:
    """Resolve a reference against the page it stands on, dot segments included."""
    origin = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    scheme = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*:", 0)
    base_path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    no_fragment = F.regexp_extract(base, r"^[^#]*", 0)
    no_query = F.regexp_extract(base, r"^[^?#]*", 0)
    folder = F.regexp_replace(base_path, r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    path = F.regexp_extract(href, r"^[^?#]*", 0)
    rest = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    merged = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    return (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("?"), F.concat(no_query, href))
        .when(href.startswith("#"), F.concat(no_fragment, href))
        .otherwise(F.concat(origin, _without_dots(merged), rest))
    )


def _without_dots(path: Column) -> Column:
    segments = F.split(path, "/")

    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(segment == ".", kept)
            .when(segment == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1))))
            .otherwise(F.array_append(kept, segment))
        )

    kept = F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), F.array(F.lit("")), step)
    ends_in_dots = path.rlike(r"/\.\.?$")
    joined = F.array_join(kept, "/")
    cleaned = F.when(ends_in_dots, F.concat(joined, F.lit("/"))).otherwise(joined)
    return F.when(path.rlike(r"/\.\.?(/|$)"), cleaned).otherwise(path)
