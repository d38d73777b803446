"""Reading the domain tables and raw inputs."""

from __future__ import annotations

import html
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from correctionlab import schemas
from correctionlab.functions import fixed_values as V


def load_tables(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Domain tables stored as parquet folders below `folder`, with their declared schemas."""
    return {
        name: spark.read.schema(schemas.TABLES[name]).parquet(f"{folder}/{name}")
        for name in names or schemas.TABLES
    }


def load_jdbc(
    spark: SparkSession, url: str, name: str, key: str, lower: int, upper: int, partitions: int, **options: str
) -> DataFrame:
    """A domain table from a relational store, read in parallel ranges of a numeric or date key."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=name, partitionColumn=key, lowerBound=lower, upperBound=upper,
                 numPartitions=partitions, **options)
        .load()
    )


# --- files --------------------------------------------------------------------


def file_type(content: Column, filename: Column) -> Column:
    """pdf, musicxml or unknown: magic bytes first, then markers near the start, then the suffix."""
    head = F.lower(F.decode(F.substring(content, 1, V.SNIFF_BYTES), "ISO-8859-1"))
    kind = F.when(F.substring(content, 1, 4) == F.lit(b"%PDF"), "pdf")
    for marker in V.XML_MARKERS:
        kind = kind.when(F.contains(head, F.lit(marker)), "musicxml")
    name = F.lower(filename)
    for type_name, suffixes in V.FILE_EXTENSIONS:
        for suffix in suffixes:
            kind = kind.when(name.endswith(suffix), type_name)
    return kind.otherwise("unknown")


def is_archive(content: Column, filename: Column) -> Column:
    return (F.substring(content, 1, 4) == F.lit(b"PK\x03\x04")) | F.lower(filename).endswith(".mxl")


def describe_files(files: DataFrame, on_unknown: str = "keep") -> DataFrame:
    """Add original_filename, file_type and size_bytes; `on_unknown` is keep or raise."""
    name = F.substring_index("path", "/", -1)
    kind = file_type(F.col("content"), name)
    failed = F.col("content").isNull() | (F.col("error").isNotNull() if "error" in files.columns else F.lit(False))
    kind = F.when(failed, "unknown").otherwise(kind)
    if on_unknown == "raise":
        message = F.concat(
            F.lit("no known kind of score file: "), name
        )
        kind = F.when(kind == "unknown", F.raise_error(message).cast("string")).otherwise(kind)
    return files.select(
        "path", name.alias("original_filename"), kind.alias("file_type"),
        F.length("content").cast("bigint").alias("size_bytes"), "content",
        *[c for c in files.columns if c not in ("path", "content")],
    )


def ingest_files(spark: SparkSession, glob: str, on_unknown: str = "keep") -> DataFrame:
    """Score files with archives unpacked before their type is decided, as an upload would be."""
    raw = spark.read.format("binaryFile").load(glob).select("path", "content")
    return describe_files(unpack_archives(raw), on_unknown)


ARCHIVE_SCHEMA = "path string, content binary, error string"
ARCHIVE_ARROW = pa.schema([("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])


def _unpack(content: bytes) -> tuple[bytes | None, str | None]:
    """The score inside a zip container: the named root file, else the first other XML entry."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            names = archive.namelist()
            wanted = None
            if V.CONTAINER_ENTRY in names:
                try:
                    listing = ET.fromstring(archive.read(V.CONTAINER_ENTRY))
                    paths = (e.get("full-path") for e in listing.iter()
                             if e.tag.rpartition("}")[2].lower() == "rootfile")
                    wanted = next((p for p in paths if p), None)
                except ET.ParseError:
                    pass
            if wanted not in names:
                entries = (n for n in sorted(names)
                           if n.lower().endswith(".xml") and not n.startswith("META-INF"))
                wanted = next(entries, None)
            if wanted is None:
                return None, "no score document among the entries of the archive"
            return archive.read(wanted), None
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError) as exc:
        return None, f"unreadable archive: {exc}"


def _batches_of(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose second value is the big one, bounded by its length."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1] or "")
        if len(held) >= PIECES_PER_BATCH or size >= CHARS_PER_BATCH:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def unpack_archives(files: DataFrame) -> DataFrame:
    """Replace the content of zip containers by the document inside; failures become error rows.

    Only archives pass through Python workers; other files keep their content inside the JVM.
    """
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((path.as_py(), *_unpack(content.as_py())) for b in batches for path, content in zip(b["path"], b["content"]))
        yield from _batches_of(rows, ARCHIVE_ARROW)

    archive = F.coalesce(is_archive(F.col("content"), F.col("path")), F.lit(False))
    plain = files.where(~archive).select("path", "content", F.lit(None).cast("string").alias("error"))
    packed = files.where(archive).select("path", "content").mapInArrow(unpack, ARCHIVE_SCHEMA)
    return plain.unionByName(packed)


_DECLARED = re.compile(rb"""\A\s*<\?xml[^>]*?\sencoding\s*=\s*["']([A-Za-z][A-Za-z0-9._-]*)["']""")
_MARKS = (("utf-8-sig", b"\xef\xbb\xbf"), ("utf-16", b"\xff\xfe"), ("utf-16", b"\xfe\xff"))
DOCUMENT_SCHEMA = "score_id string, xml string, error string"
DOCUMENT_ARROW = pa.schema([("score_id", pa.string()), ("xml", pa.string()), ("error", pa.string())])


def _decode(content: bytes | None) -> tuple[str | None, str | None]:
    """Text of a document: by its byte order mark, else as its declaration says, else UTF-8."""
    if content is None:
        return None, "no content"
    declared = _DECLARED.match(content)
    name = next((n for n, mark in _MARKS if content.startswith(mark)), declared[1].decode() if declared else "utf-8")
    try:
        return content.decode(name), None
    except (UnicodeError, LookupError) as exc:
        return None, f"not readable as {name}: {exc}"


def documents_from_files(files: DataFrame) -> DataFrame:
    """Documents (score_id, xml, error) of unpacked files (path, content, error): the id is the file name without its suffix.

    Failed archives and texts that can't be decoded come out with an error and no xml; `shred` takes the others.
    """
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    files = files.select(name.alias("score_id"), "content", F.col("error") if "error" in files.columns else F.lit(None).cast("string").alias("error"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for score_id, content, error in zip(*(batch[c] for c in ("score_id", "content", "error"))):
                    xml, wrong = _decode(content.as_py())
                    yield score_id.as_py(), xml, error.as_py() or wrong

        yield from _batches_of(rows(), DOCUMENT_ARROW)

    return files.mapInArrow(run, DOCUMENT_SCHEMA)


# --- score documents ------------------------------------------------------------

# kind is head, part, group, measure or error; xml holds a measure, an entry of the part list, or the head. Entries of
# the part list, parts and groups alike, are numbered in one sequence; a part has the groups before and after it too.
PIECE_SCHEMA = (
    "score_id string, kind string, part_seq int, part_id string, part_name string, body_seq int,"
    " measure_seq int, measure_number string, xml string, root_open string, root_close string,"
    " layout string, groups_before string, groups_after string"
)
PIECE_COLUMNS = [column.split()[0] for column in PIECE_SCHEMA.split(", ")]
PIECE_ARROW = pa.schema([
    (name, pa.int32() if kind == "int" else pa.string())
    for name, kind in (column.split() for column in PIECE_SCHEMA.split(", "))
])
PIECES_PER_BATCH, CHARS_PER_BATCH = 20_000, 32_000_000
# what each kind has; other columns are null, and left out where no kind asked for has them
_PLACED = {"score_id", "kind", "part_seq", "part_id", "part_name", "body_seq", "xml"}
KIND_COLUMNS = {
    "head": {"score_id", "kind", "part_name", "xml", "root_open", "root_close", "layout"},
    "part": _PLACED | {"groups_before", "groups_after"},
    "measure": _PLACED | {"measure_seq", "measure_number"},
    "group": {"score_id", "kind", "part_seq", "xml"},
    "error": {"score_id", "kind", "xml"},
}

# tags that structure a score, and whatever may hold text that only looks like a tag
_ATTRS = r"""(?P<attrs>[^>"'/]*+(?:(?:"[^"]*+"|'[^']*+'|/(?!>))[^>"'/]*+)*+)"""


def _tags(prefix: str, names: str = "part-list|part-group|score-part|part-name|part|measure") -> re.Pattern[str]:
    return re.compile(
        rf"""<(?:(?P<end>/?)(?P<name>{prefix}(?:{names}))(?=[\s/>])"""
        rf"""{_ATTRS}(?P<empty>/?)>"""
        r"""|!--.*?-->|!\[CDATA\[.*?\]\]>|\?.*?\?>|!DOCTYPE[^\[>]*(?:\[.*?\]\s*)?>)""",
        re.DOTALL,
    )


_TAGS, _PREFIXED_TAGS = _tags(""), _tags(r"(?:[\w.\-]+:)?")
_PART_TAGS = _tags("", "part-list|part-group|score-part|part-name|part")
_MEASURE = re.compile(rf"(<measure(?=[\s>]){_ATTRS}>.*?</measure>)", re.DOTALL)
_ROOT = re.compile(
    r"""\s*(?:(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^\[>]*(?:\[.*?\]\s*)?>)\s*)*"""
    r"""(?P<open><(?P<name>[^\s/>]+)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*?)(?P<empty>/?)>)""",
    re.DOTALL,
)
_ATTRIBUTES = {
    name: re.compile(rf"""\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""") for name in ("id", "number")
}


def _attribute(tag_attributes: str, name: str, default: str | None = None) -> str | None:
    hit = _ATTRIBUTES[name].search(tag_attributes)
    if hit is None:
        return default
    return html.unescape(hit[1] if hit[1] is not None else hit[2])


def _well_formed(xml: str) -> str | None:
    """None, or what the parser says is wrong."""
    parser = expat.ParserCreate("utf-8", " ")
    try:
        parser.Parse(xml.encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError as exc:
        return str(exc)
    return None


class _Element:
    """A structuring element and its place in the text; children are structuring elements too."""

    __slots__ = ("name", "attrs", "begin", "inner", "inner_end", "over", "children")

    def __init__(self, name: str, attrs: str, begin: int, inner: int):
        self.name, self.attrs, self.begin, self.inner = name, attrs, begin, inner
        self.inner_end = self.over = inner
        self.children: list[_Element] = []


def _plain_structure(xml: str, start: int, end: int, whole: bool) -> tuple[list[_Element], dict[int, list]] | None:
    """(`_structure` without measures, measures (number, text) by the place of their part) of an ordinary partwise document.

    None where that could differ from `_structure`: with text that only looks like a tag, prefixes, parts in parts, and measures that are
    empty, nested or outside of parts. Unless `whole`, measures are left out.
    """
    if any(mark in xml for mark in (":part", ":score-part", ":measure")) or xml.find("<!", start) >= 0 or xml.find("<?", start) >= 0:
        return None
    elements = _structure(xml, start, end, _PART_TAGS)
    parts = [el for el in elements if el.name == "part"]
    if any(el.children for el in parts):
        return None
    measures: dict[int, list] = {}
    if whole:
        for el in parts:
            measures[el.begin] = [(_attribute(attrs, "number"), text) for text, attrs in _MEASURE.findall(xml, el.inner, el.inner_end)]
        ends = xml.count("</measure>")
        if not (sum(map(len, measures.values())) == ends == xml.count("</measure") - xml.count("</measure-")
                == xml.count("<measure") - xml.count("<measure-")):
            return None
    return elements, measures


def _structure(xml: str, start: int, end: int, tags: re.Pattern[str] | None = None) -> list[_Element]:
    """Structuring elements below the root of a well-formed document whose content is xml[start:end]."""
    top = _Element("", "", start, start)
    open_elements = [top]
    # looking for prefixes takes most of the time, and most documents have none
    prefixed = tags is None and any(name in xml for name in (":part", ":score-part", ":measure"))
    inside = top.children
    for tag in (tags or (_PREFIXED_TAGS if prefixed else _TAGS)).finditer(xml, start, end):
        closing, name, attrs, empty = tag.groups()
        if name is None:
            continue
        if closing:
            done = open_elements.pop()
            done.inner_end, done.over = tag.span()
            inside = open_elements[-1].children
        else:
            element = _Element(name.rpartition(":")[2] if prefixed else name, attrs, *tag.span())
            inside.append(element)
            if not empty:
                open_elements.append(element)
                inside = element.children
    return top.children


def _error_row(score_id: str, error: str) -> tuple[list[tuple], list[tuple]]:
    return [(score_id, "error", None, None, None, None, None, None, error, None, None, None, None, None)], []


_MARKED = re.compile(r"<!\[CDATA\[(?P<raw>.*?)\]\]>|<!--.*?-->|<\?.*?\?>", re.DOTALL)


def _text(inner: str) -> str:
    """The text of an element without children: marked sections as they are, comments and instructions left out."""
    return html.unescape(_MARKED.sub(lambda m: html.escape(m["raw"] or "", quote=False), inner)).strip()


def _pieces(score_id: str, xml: str, kinds: tuple[str, ...] | None = None) -> tuple[list[tuple], list[tuple]]:
    """Rows of one document, cut out of the text as they are: its head and its parts, and a run of measures for each part.

    Kinds that are not among the given ones may be left out.

    A document that isn't well-formed, or that lists or has a part twice, is one error row.
    """
    xml = xml.removeprefix("\ufeff")
    error = _well_formed(xml)
    if error is not None:
        return _error_row(score_id, error)
    root = _ROOT.match(xml)
    prefix = root["name"].rpartition(":")[0]
    prefix = prefix + ":" if prefix else ""
    timewise = "timewise" in root["name"].lower()
    tag = f"{prefix}score-partwise" if timewise else root["name"]
    stop = root.end() if root["empty"] else xml.rindex("</")

    listed: dict[str, tuple[str | None, str]] = {}
    # entries of the part list in order: (part id, text), with None for a group
    entries: list[tuple[str | None, str]] = []
    # part id -> its measures as (number, text), in the order the parts first appear
    body: dict[str, list[tuple[str | None, str]]] = {}
    timed: list[tuple[str, dict[str, list[str]]]] = []
    head, at = [], root.end()
    whole = kinds is None or not {"measure", "head"}.isdisjoint(kinds)
    plain = None if timewise else _plain_structure(xml, root.end(), stop, whole)
    for el in plain[0] if plain else _structure(xml, root.end(), stop):
        if el.name not in ("part-list", "part", "measure"):
            continue
        head.append(xml[at:el.begin])
        at = el.over
        if el.name == "part-list":
            for entry in el.children:
                text = xml[entry.begin:entry.over]
                if entry.name == "score-part":
                    names = (xml[n.inner:n.inner_end] for n in entry.children if n.name == "part-name")
                    part_id = _attribute(entry.attrs, "id", "")
                    if part_id in listed:
                        return _error_row(score_id, f"part {part_id} is listed twice")
                    listed[part_id] = (_text(next(names, "")) or None, text)
                    entries.append((part_id, text))
                elif entry.name == "part-group":
                    entries.append((None, text))
        elif el.name == "part" and not timewise:
            found = plain[1].get(el.begin, []) if plain else [
                (_attribute(m.attrs, "number"), xml[m.begin:m.over]) for m in el.children if m.name == "measure"]
            part_id = _attribute(el.attrs, "id", "")
            if part_id in body:
                return _error_row(score_id, f"part {part_id} occurs twice")
            body[part_id] = found
        elif el.name == "measure" and timewise:
            inside: dict[str, list[str]] = {}
            for p in el.children:
                if p.name == "part":
                    inside.setdefault(_attribute(p.attrs, "id", ""), []).append(xml[p.inner:p.inner_end])
            timed.append((el.attrs, inside))
    head.append(xml[at:stop])
    wanted = kinds is None or "measure" in kinds
    numbers = [_attribute(attrs, "number") for attrs, _ in timed] if wanted else []
    for part_id in dict.fromkeys(p for _, inside in timed for p in inside):
        body[part_id] = [
            (number, f"<{prefix}measure{attrs}>{''.join(inside.get(part_id, ()))}</{prefix}measure>")
            for number, (attrs, inside) in zip(numbers, timed)
        ]

    rows = [(
        score_id, "head", None, None, prefix, None, None, None, "".join(head).strip(),
        f"<{tag}{root['attrs']}>", f"</{tag}>", "timewise" if timewise else "partwise", None, None,
    )]
    order = {part_id: i for i, part_id in enumerate(body)}
    sequence = {part_id: i for i, (part_id, _) in enumerate(entries) if part_id is not None}
    rows.extend(
        (score_id, "group", i, None, None, None, None, None, text, None, None, None, None, None)
        for i, (part_id, text) in enumerate(entries) if part_id is None
    )
    for part_id in dict.fromkeys([*listed, *body]):
        label, entry = listed.get(part_id, (None, None))
        rows.append((score_id, "part", sequence.get(part_id), part_id, label, order.get(part_id),
                     None, None, entry, None, None, None, *_groups_beside(entries, sequence.get(part_id))))
    runs = [
        (score_id, sequence.get(part_id), part_id, listed.get(part_id, (None,))[0], order[part_id], measures)
        for part_id, measures in body.items()
    ]
    return rows, runs


def _groups_beside(entries: list[tuple[str | None, str]], at: int | None) -> tuple[str, str]:
    """Texts of the groups before and after an entry of the part list."""
    if at is None or all(part_id is not None for part_id, _ in entries):
        return "", ""
    return tuple("".join(text for part_id, text in side if part_id is None) for side in (entries[:at], entries[at:]))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _measure_batch(runs: list[tuple], schema: pa.Schema = PIECE_ARROW) -> pa.RecordBatch:
    """Runs of measures as rows; what a run's measures share is made once and repeated in Arrow."""
    counts = np.array([len(r[5]) for r in runs])
    places = np.repeat(np.arange(len(runs)), counts)
    numbers, texts = [m[0] for r in runs for m in r[5]], [m[1] for r in runs for m in r[5]]
    shared = dict(zip(("score_id", "part_seq", "part_id", "part_name", "body_seq"), zip(*(r[:5] for r in runs))))
    columns = []
    for field in schema:
        if field.name in shared:
            columns.append(pa.array(shared[field.name], field.type).take(pa.array(places)))
        elif field.name == "kind":
            columns.append(pa.repeat("measure", len(texts)))
        elif field.name == "measure_seq":
            columns.append(pa.array(np.arange(len(texts)) - np.repeat(np.cumsum(counts) - counts, counts), field.type))
        elif field.name in ("measure_number", "xml"):
            columns.append(pa.array(numbers if field.name == "measure_number" else texts, field.type))
        else:
            columns.append(pa.nulls(len(texts), field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def shred(documents: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """All pieces of the documents (score_id, xml), or those of some kinds with their columns alone, one pass of Arrow batches over them.

    A document is parsed by the task that holds its row, so the biggest file, not the table, sets
    the memory a task needs. The parser only checks the text; pieces are slices of it, so
    what an edit does not touch comes out byte for byte.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, runs, held, chars = [], [], 0, 0
        for batch in batches:
            for score_id, xml in zip(batch["score_id"], batch["xml"]):
                text = xml.as_py() or ""
                mine, measures = _pieces(score_id.as_py(), text, kinds)
                rows.extend(mine if kinds is None else [r for r in mine if r[1] in kinds])
                if kinds is None or "measure" in kinds:
                    runs.extend(r for r in measures if r[5])
                    held += sum(len(r[5]) for r in measures)
                chars += len(text)
                if len(rows) + held >= PIECES_PER_BATCH or chars >= CHARS_PER_BATCH:
                    yield from batches_of(rows, runs)
                    rows, runs, held, chars = [], [], 0, 0
        yield from batches_of(rows, runs)

    some = [c for c in PIECE_COLUMNS if kinds is None or any(c in KIND_COLUMNS[k] for k in kinds)]
    places, arrow = [PIECE_COLUMNS.index(c) for c in some], pa.schema([PIECE_ARROW.field(c) for c in some])

    def batches_of(rows: list[tuple], runs: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(columns[k], f.type) for k, f in zip(places, arrow)], schema=arrow)
        if runs:
            yield _measure_batch(runs, arrow)

    schema = ", ".join(c for c in PIECE_SCHEMA.split(", ") if c.split()[0] in some)
    return documents.select("score_id", "xml").mapInArrow(run, schema)


def heads_of(pieces: DataFrame) -> DataFrame:
    return pieces.where("kind = 'head'").select(
        "score_id", "layout", "root_open", "root_close", F.col("xml").alias("head_xml"),
        F.col("part_name").alias("prefix"),
    )


def groups_of(pieces: DataFrame) -> DataFrame:
    return pieces.where("kind = 'group'").select("score_id", "part_seq", F.col("xml").alias("group_xml"))


def parts_of(pieces: DataFrame) -> DataFrame:
    return pieces.where("kind = 'part'").select(
        "score_id", "part_seq", "part_id", "part_name", "body_seq", F.col("xml").alias("part_xml"),
        "groups_before", "groups_after",
    )


def measures_of(pieces: DataFrame) -> DataFrame:
    return pieces.where("kind = 'measure'").select(
        "score_id", "part_id", "part_seq", "part_name", "body_seq", "measure_seq", "measure_number", "xml"
    )


def errors_of(pieces: DataFrame) -> DataFrame:
    return pieces.where("kind = 'error'").select("score_id", F.col("xml").alias("error"))


def shred_scores(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parts, measures) of the documents. To use both, write `shred(documents)` out first."""
    pieces = shred(documents)
    return parts_of(pieces), measures_of(pieces)


INSPECTION_SCHEMA = (
    "score_id string, well_formed boolean, root_tag string, title string, opus string, subtitle string,"
    " composer string, arranger string"
)
INSPECTION_ARROW = pa.schema([
    (name, pa.bool_() if kind == "boolean" else pa.string())
    for name, kind in (column.split() for column in INSPECTION_SCHEMA.split(", "))
])


def _inspect(score_id: str, xml: str) -> tuple:
    """Whether the text is one well-formed document, its root tag, and its descriptive fields."""
    try:
        root = ET.fromstring(xml.removeprefix("\ufeff").encode("utf-8", "surrogatepass"),
                             ET.XMLParser(encoding="utf-8"))
    except ET.ParseError:
        return (score_id, False, None, None, None, None, None, None)

    first: dict[str, str] = {}  # of each field the first element, with a text or not
    creators, identified = {}, set()
    for child in root:
        name = child.tag.rpartition("}")[2]
        if name == "work":
            for c in child:
                first.setdefault(c.tag.rpartition("}")[2], c.text or "")
        elif name == "movement-title":
            first.setdefault("/movement-title", child.text or "")
        elif name == "identification" and child.tag not in identified:
            identified.add(child.tag)
            for c in child:
                if c.text and c.tag.rpartition("}")[2] == "creator":
                    creators[(c.get("type") or "").lower()] = c.text.strip()

    def text(field: str) -> str | None:
        return first.get(field, "").strip() or None

    return (
        score_id, True, root.tag, text("work-title"), text("work-number"), text("/movement-title"),
        creators.get("composer"), creators.get("arranger"),
    )


def inspect(documents: DataFrame) -> DataFrame:
    """Validity, root and descriptive fields of the documents (score_id, xml) in one parse.

    Spark's XML functions stop at the end of the root element and accept undeclared prefixes, so
    they cannot tell a valid document; a real parser in Arrow batches can, and is faster here.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_inspect(i.as_py(), x.as_py() or "") for i, x in zip(batch["score_id"], batch["xml"])]
            if rows:
                yield _batch(rows, INSPECTION_ARROW)

    return documents.select("score_id", "xml").mapInArrow(run, INSPECTION_SCHEMA)


# --- answers, logs, pages, webhooks -----------------------------------------------


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Model answers as JSON lines."""
    return spark.read.schema(schemas.MODEL_RESPONSES).json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.WORK_PAGES).parquet(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Recogniser logs, one file per score; the file name without suffix is the score id."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(
        name.alias("score_id"), F.col("value").alias("log_text")
    )


def read_webhooks(spark: SparkSession, path: str) -> DataFrame:
    """Raw webhook bodies, one JSON object a line, with arrival columns beside the body."""
    schema = "event_id bigint, ts timestamp, body string"
    return spark.read.schema(schema).json(path)
