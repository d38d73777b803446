"""XML checks and edits as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CORRUPT = "struct<_corrupt:string>"
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
_WRAPPER = "wrapped_fragment"


def _parses(text: Column) -> Column:
    parsed = F.from_xml(text, _CORRUPT, _OPTIONS)
    return (text != "") & parsed.isNotNull() & parsed.getField("_corrupt").isNull()


def _prefixes_declared(text: Column) -> Column:
    """Every name prefix in the text is bound somewhere in it."""
    in_tags = F.regexp_extract_all(text, F.lit(r"</?([A-Za-z_][\w.\-]*):[A-Za-z_]"), F.lit(1))
    in_attributes = F.regexp_extract_all(
        text, F.lit(r"""<[^>]*?\s([A-Za-z_][\w.\-]*):[A-Za-z_][\w.\-]*\s*=\s*["']"""), F.lit(1)
    )
    used = F.array_distinct(F.concat(in_tags, in_attributes))
    return F.forall(
        used, lambda p: p.isin("xml", "xmlns") | F.contains(text, F.concat(F.lit("xmlns:"), p))
    )


def is_fragment(text: Column) -> Column:
    """Whether the text is well-formed as the content of an element.

    The parser stops at the end of the wrapping element, so a text that closes the wrapper itself
    is refused first; undeclared prefixes are checked apart because the parser accepts them.
    """
    wrapped = F.concat(F.lit(f"<{_WRAPPER}>"), text, F.lit(f"</{_WRAPPER}>"))
    closes_itself = F.contains(text, F.lit(f"</{_WRAPPER}"))
    return F.coalesce(~closes_itself & _parses(wrapped) & _prefixes_declared(text), F.lit(False))


def element_parts(xml: Column) -> tuple[Column, Column, Column]:
    """(open tag without its end, inner XML, end tag) of a serialised element."""
    head = F.regexp_extract(xml, r"^(<[^>]*?)\s*/?>", 1)
    name = F.regexp_extract(xml, r"^<([^\s/>]+)", 1)
    close = F.concat(F.lit("</"), name, F.lit(">"))
    open_length = F.length(F.regexp_extract(xml, r"^<[^>]*>", 0))
    inner = F.when(
        F.regexp_extract(xml, r"^<[^>]*>", 0).endswith("/>"), F.lit("")
    ).otherwise(F.substring(xml, open_length + 1, F.length(xml) - open_length - F.length(name) - 3))
    return head, inner, close
