import datetime as dt
import random
from xml.etree import ElementTree as ET

import pytest
from pyspark.sql import functions as F

from correctionlab.functions import xml as X
from correctionlab.operators import documents as D
from correctionlab.plans.export import corrected_documents, export_scores
from correctionlab.sources import readers



def score(parts, title="Harbour Pieces", number="No. 12b", movement="Slow Tide", people=(("composer", "Ina Velde"), ("arranger", "Tomas Reuter"))):
    """A partwise document on one line: parts are (id, name, measures as text)."""
    listed = "".join(f'<score-part id="{i}"><part-name>{name}</part-name></score-part>' for i, name, _ in parts)
    body = "".join(f'<part id="{i}">{measures}</part>' for i, _, measures in parts)
    creators = "".join(f'<creator type="{kind}">{name}</creator>' for kind, name in people)
    return (f"<?xml version='1.0' encoding='utf-8'?><score-partwise version=\"3.1\"><work><work-number>{number}</work-number>"
            f"<work-title>{title}</work-title></work><movement-title>{movement}</movement-title><identification>{creators}</identification>"
            f"<part-list>{listed}</part-list>{body}</score-partwise>")


TOLD = ("Harbour Pieces", "No. 12b", "Slow Tide", "Ina Velde", "Tomas Reuter")
DOC = score([
    ("P1", "Alto Flute", '<measure number="1" width="3"><note><step>C</step></note></measure><measure number="2"/>'),
    ("P2", "Tall Harp", '<measure number="1"><note/></measure><measure number="2"><note/></measure>'),
])
TIMEWISE = """<score-timewise><work><work-title>T</work-title></work><part-list>
  <score-part id="P1"><part-name>Alto Flute</part-name></score-part><score-part id="P2"><part-name>Harp</part-name></score-part></part-list>
  <measure number="1"><part id="P1"><note a="1"/></part><part id="P2"><rest/></part></measure>
  <measure number="2"><part id="P2"><chord/></part></measure></score-timewise>"""


def docs(spark, *texts):
    return spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "score_id string, xml string")


def edit(id, value, measure=1, instrument="Harp", decision="edit", score="s0", minute=0):
    return (id, score, instrument, measure, decision, value, dt.datetime(2024, 1, 1, 0, minute))


def edits(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, score_id string, instrument string, measure_number int, "
                                             "human_decision string, human_edit_value string, human_reviewed_at timestamp")


def corrected(spark, *rows, doc=DOC):
    parts, measures = readers.shred_scores(docs(spark, doc))
    located = D.locate_edits(edits(spark, *rows), parts, measures)
    return {(r.part_id, r.measure_number): r.xml for r in D.apply_edits(measures, located).where("edited").collect()}


# --- well-formedness ------------------------------------------------------------------------

FRAGMENTS = ["<rest/>", "<a/></wrapped_fragment><wrapped_fragment>", "<a><b></a>", "<a>&amp;</a>", "<a>&nope;</a>", "<a b=1/>",
             "<a/><b/>", "<a/>x<b/>", "<!-- c --><a/>", "<a xmlns:q='u' q:z='1'/>", "<q:a/>", "<a q:z='1'/>", "<a b='1' b='2'/>",
             "<a/><", "< a/>", "<?xml version='1.0'?><a/>", "<a>\x01</a>", "<![CDATA[x]]>", "<>", "<a><b/></a>", "<ä/>"]


def parsed(text):
    try:
        return ET.fromstring(text)
    except ET.ParseError:
        return None


def test_fragment_check_equals_a_parser(spark):
    df = spark.createDataFrame([(t,) for t in FRAGMENTS], "t string").select("t", X.is_fragment(F.col("t")).alias("ok"))
    got = {r.t: r.ok for r in df.collect()}
    assert got == {t: parsed(f"<wrapped_fragment>{t}</wrapped_fragment>") is not None for t in FRAGMENTS}


DOCUMENTS = [DOC, TIMEWISE, "<score/>", "<Score-Partwise a='>'/>", "<a/>", "<a></a>", "<a></a><b/>", "<a/><b/>", "<a></a>text", "text<a/>", "",
             "  ", "<a>", "<a></b>", "<a><b></a>", "<!-- x --><a/><!-- y -->", "<a></a ><?p x?>\n", "<?xml version='1.0'?>\n<!DOCTYPE a SYSTEM 'x'>\n<a/>",
             "<a></a><a></a>", "<m:score-partwise xmlns:m='u'></m:score-partwise>", "<m:score></m:score>", "<a>&lt;</a>", "<a>&x;</a>",
             "<a><!-- </a> --></a>", "<a><b/></a>\n", " <a/>", " <?xml version='1.0'?><a/>", "\ufeff<?xml version='1.0'?><score/>", "<html><score-partwise/></html>"]


def test_document_checks_equal_a_parser(spark):
    got = {r.score_id: (r.well_formed, r.lenient, r.strict)
           for r in D.validate_documents(readers.inspect(docs(spark, *DOCUMENTS))).collect()}
    errors = {r.score_id for r in readers.errors_of(readers.shred(docs(spark, *DOCUMENTS))).collect()}
    for i, text in enumerate(DOCUMENTS):
        root = parsed(text.encode())
        tag = "" if root is None else root.tag.lower()
        local = tag.rpartition("}")[2]
        want = (root is not None, "score" in tag, local in ("score-partwise", "score-timewise", "score"))
        assert got[f"s{i}"] == want, text
        assert (f"s{i}" in errors) == (root is None), text


# --- metadata ---------------------------------------------------------------------------------


def test_metadata(spark):
    row = D.document_metadata(readers.inspect(docs(spark, DOC))).first()
    assert row[1:] == TOLD


def test_metadata_with_namespace_and_of_malformed_text(spark):
    spaced = DOC.replace("<score-partwise", '<score-partwise xmlns="http://example.org/m"')
    prefixed = ("<m:score xmlns:m='u'><m:work><m:work-title> A &amp; B </m:work-title></m:work><m:identification>"
                "<m:creator type='Composer'>X</m:creator><m:creator type='composer'>Y</m:creator><m:creator type='composer'/>"
                "</m:identification></m:score>")
    got = {r.score_id: r[1:] for r in D.document_metadata(readers.inspect(docs(spark, spaced, prefixed, DOC[:-9], "<score/>"))).collect()}
    assert got["s0"] == TOLD
    assert got["s1"] == ("A & B", None, None, "Y", None)
    assert got["s2"] == got["s3"] == (None,) * 5


# --- shredding ------------------------------------------------------------------------------------


def test_shred_partwise(spark):
    parts, measures = readers.shred_scores(docs(spark, DOC))
    assert [(r.part_seq, r.part_id, r.part_name, r.body_seq) for r in parts.orderBy("part_seq").collect()] == [
        (0, "P1", "Alto Flute", 0), (1, "P2", "Tall Harp", 1)]
    rows = measures.orderBy("part_id", "measure_seq").collect()
    assert [(r.part_id, r.measure_seq, r.measure_number) for r in rows] == [("P1", 0, "1"), ("P1", 1, "2"), ("P2", 0, "1"), ("P2", 1, "2")]
    assert rows[0].xml == '<measure number="1" width="3"><note><step>C</step></note></measure>'


def test_shred_timewise_turns_measures_inside_out(spark):
    _, measures = readers.shred_scores(docs(spark, TIMEWISE))
    got = {(r.part_id, r.measure_number): r.xml for r in measures.collect()}
    assert got == {("P1", "1"): '<measure number="1"><note a="1"/></measure>', ("P1", "2"): '<measure number="2"></measure>',
                   ("P2", "1"): '<measure number="1"><rest/></measure>', ("P2", "2"): '<measure number="2"><chord/></measure>'}


def test_shred_parts_without_body_or_entry_and_errors(spark):
    odd = "<score-partwise><part-list><score-part id='A'/><score-part id='B'><part-name> </part-name></score-part></part-list>" \
          "<part id='C'><measure/></part><part id='B'/></score-partwise>"
    pieces = readers.shred(docs(spark, odd, "<broken"))
    got = {r.part_id: (r.part_seq, r.part_name, r.body_seq) for r in readers.parts_of(pieces).collect()}
    assert got == {"A": (0, None, None), "B": (1, None, 1), "C": (None, None, 0)}
    assert [r.score_id for r in readers.errors_of(pieces).collect()] == ["s1"]


def test_measure_counts(spark):
    pieces = readers.shred(docs(spark, DOC, TIMEWISE))
    got = {r.score_id: r[1:] for r in D.measure_counts(readers.measures_of(pieces), readers.heads_of(pieces)).collect()}
    assert got == {"s0": (4, 2, 2), "s1": (2, 2, 2)}


# --- edits --------------------------------------------------------------------------------------------


def test_only_edits_with_a_value_change_anything(spark):
    assert corrected(spark, edit("1", "x", decision="accept"), edit("2", "x", decision="reject"), edit("3", ""), edit("4", None)) == {}


def test_fragment_replaces_content_and_keeps_attributes(spark):
    assert corrected(spark, edit("1", " <note><step>G</step></note> ", instrument="violin")) == {
        ("P1", "1"): '<measure number="1" width="3"><note><step>G</step></note></measure>'}


def test_text_becomes_a_comment(spark):
    assert corrected(spark, edit("1", "add forte $1", measure=2), edit("2", "<bad", measure=1), edit("3", "<a><b></a>", measure=2, minute=1)) == {
        ("P2", "1"): '<measure number="1"><note/><!-- edit: <bad --></measure>',
        ("P2", "2"): '<measure number="2"><note/><!-- edit: add forte $1 --><!-- edit: <a><b></a> --></measure>'}
    assert corrected(spark, edit("1", "x", measure=2, instrument="Alto Flute")) == {
        ("P1", "2"): '<measure number="2"><!-- edit: x --></measure>'}


def test_order_of_edits_on_a_measure(spark):
    assert corrected(spark, edit("3", "<b/>", minute=2), edit("1", "first", minute=0), edit("2", "<a/>", minute=1),
                     edit("5", "last", minute=3), edit("4", "same minute", minute=3)) == {
        ("P2", "1"): '<measure number="1"><b/><!-- edit: same minute --><!-- edit: last --></measure>'}


def test_unknown_instrument_goes_to_the_first_part_and_unknown_measure_nowhere(spark):
    parts, measures = readers.shred_scores(docs(spark, DOC))
    rows = (edit("1", "x", instrument="Tuba"), edit("2", "x", measure=9), edit("3", "x", score="none"), edit("4", "x", instrument=""))
    got = {r.id: (r.part_id, r.matched_by_name, r.measure_seq) for r in D.locate_edits(edits(spark, *rows), parts, measures).collect()}
    assert got == {"1": ("P1", False, 0), "2": ("P2", True, None), "3": (None, False, None), "4": ("P1", True, 0)}


def test_part_lookup_equals_brute_force(spark):
    rnd = random.Random(3)
    words = ["Harp", "harp I", "Harp II", "Harpsichord", "LUTE", "Arch Lute", "Bögen", "", None]
    names = ["har", "Harp", "lute", "bögen", "r", "", "gong", "Harp II x"]
    parts, want, rows = [], {}, []
    for s in range(40):
        listed = [rnd.choice(words) for _ in range(rnd.randrange(1, 5))]
        bodies = list(range(len(listed)))
        rnd.shuffle(bodies)
        present = [b if rnd.random() < 0.8 else None for b in bodies]
        parts += [(f"s{s}", k, f"P{k}", n, b) for k, (n, b) in enumerate(zip(listed, present))]
        for k, name in enumerate(names):
            id_ = f"{s}-{k}"
            rows.append(edit(id_, "x", instrument=name, score=f"s{s}"))
            hits = [f"P{i}" for i, n in enumerate(listed) if present[i] is not None and n and name.lower() in n.lower()]
            rest = sorted((b, f"P{i}") for i, b in enumerate(present) if b is not None)
            want[id_] = hits[0] if hits else rest[0][1] if rest else None
    table = spark.createDataFrame(parts, "score_id string, part_seq int, part_id string, part_name string, body_seq int")
    measures = spark.createDataFrame([], "score_id string, part_id string, measure_number string, measure_seq int")
    got = {r.id: r.part_id for r in D.locate_edits(edits(spark, *rows), table, measures).collect()}
    assert got == want


# --- whole documents -----------------------------------------------------------------------------------


def text_of(lines, *keys):
    rows = lines.orderBy(*keys).collect()
    return "".join(r.line for r in rows)


@pytest.mark.parametrize("doc", [DOC, DOC.replace("<score-partwise", '<score-partwise xmlns="http://example.org/m"')])
def test_lines_make_up_the_same_document(spark, doc):
    pieces = readers.shred(docs(spark, doc))
    lines = D.document_lines(readers.heads_of(pieces), readers.parts_of(pieces), readers.measures_of(pieces), readers.groups_of(pieces))
    again = text_of(lines, "section", "seq").removeprefix("<?xml version='1.0' encoding='utf-8'?>")
    flat = lambda x: ET.canonicalize(x, strip_text=True)
    assert flat(again) == flat(doc.split("?>", 1)[1])


@pytest.mark.parametrize("doc", [DOC, TIMEWISE])
def test_part_documents_hold_one_part(spark, doc):
    pieces = readers.shred(docs(spark, doc))
    lines = D.extract_parts(readers.heads_of(pieces), readers.parts_of(pieces), readers.measures_of(pieces))
    for part_id in ("P1", "P2"):
        root = ET.fromstring(text_of(lines.where(F.col("part_id") == part_id), "section", "seq").encode())
        assert root.tag == "score-partwise" and root.find("work/work-title") is not None
        assert [p.get("id") for p in root.iterfind("part-list/score-part")] == [part_id]
        assert [p.get("id") for p in root.iterfind("part")] == [part_id]
        assert [m.get("number") for m in root.iterfind("part/measure")] == ["1", "2"]


def test_file_names_are_safe_and_distinct(spark):
    doc = DOC.replace("Alto Flute", "Low Gong 3/4").replace("Tall Harp", "Low Gong 3/4")
    pieces = readers.shred(docs(spark, doc))
    lines = D.extract_parts(readers.heads_of(pieces), readers.parts_of(pieces), readers.measures_of(pieces))
    assert {r.file_name for r in lines.collect()} == {"Low_Gong_3-4_P1.xml", "Low_Gong_3-4_P2.xml"}


def test_export_writes_readable_documents(spark, tmp_path):
    rows = (edit("1", "<forward/>"), edit("2", "note this", measure=2, score="s1"), edit("3", "x", measure=9))
    lost = export_scores(docs(spark, DOC, TIMEWISE), edits(spark, *rows), str(tmp_path), with_parts=True)
    assert [r.id for r in lost.collect()] == ["3"]
    for score in ("s0", "s1"):
        files = sorted((tmp_path / "scores" / f"score_id={score}").glob("part-*"))
        text = "".join(f.read_text() for f in files)
        ET.fromstring(text.encode())
        assert ("<forward/>" in text) == (score == "s0") and ("<!-- edit: note this -->" in text) == (score == "s1")
    assert len(list((tmp_path / "parts").glob("score_id=*/file_name=*"))) == 4


# --- header blocks ----------------------------------------------------------------------------------------


def header(spark, content, **meta):
    fields = ("title", "subtitle", "composer", "opus", "arranger")
    sources = spark.createDataFrame([("1", content)], "id string, content string")
    table = spark.createDataFrame([["1"] + [meta.get(f) for f in fields]], "id string, " + ", ".join(f"{f} string" for f in fields))
    return D.inject_headers(sources, table, "id").first().content


def test_header_goes_below_the_version(spark):
    body = "upper = { g'2 a'2 }\n"
    got = header(spark, '\\version "2.22.1"\n' + body, title="Night Ferry", composer="Ola Brandt", arranger="K. Moe")
    assert got == '\\version "2.22.1"\n\n\\header {\n  title = "Night Ferry"\n  composer = "Ola Brandt"\n  arranger = "arr. K. Moe"\n}\n\n' + body


def test_header_goes_to_the_top_in_a_fixed_order(spark):
    got = header(spark, "upper = { }\n", opus="WoO 3", subtitle="for six", title='The "Long" $9 \\Way')
    assert got == '\\header {\n  title = "The \\"Long\\" $9 \\Way"\n  subtitle = "for six"\n  opus = "WoO 3"\n}\n\nupper = { }\n'


def test_sources_with_a_header_or_without_metadata_stay(spark):
    has_one = '\\header{ piece = "II" }\nupper = { }\n'
    assert header(spark, has_one, title="Night Ferry") == has_one
    assert header(spark, "upper = { }\n") == "upper = { }\n"


# --- export without loss ----------------------------------------------------------------------------------

GROUPED = DOC.replace("<score-part id=\"P1\">", '<part-group number="1" type="start"/><score-part id="P1">').replace(
    "</score-part><score-part", '</score-part><part-group number="1" type="stop"/><score-part').replace(
    "Tall Harp", "<![CDATA[Tall <&> Harp]]><!-- or lute -->")


def exported(spark, texts, *rows):
    lines, _, _ = corrected_documents(docs(spark, *texts), edits(spark, *rows))
    got = {}
    for r in lines.orderBy("score_id", "section", "seq").collect():
        status, text = got.get(r.score_id, (r.status, ""))
        got[r.score_id] = (status, text + r.line)
    return got


def test_documents_that_no_edit_changes_come_out_as_they_are(spark):
    declared = "<?xml version='1.0'?>\n<!DOCTYPE score-timewise [<!ENTITY x 'y'>]>\n" + TIMEWISE
    texts = [declared, DOC[:-9], DOC, "", None, DOC.replace("P2", "P1")]
    rows = [edit("1", "x", score="s1"), edit("2", "x", score="s2", measure=99), edit("3", "x", score="s5"), edit("4", "x", score="gone")]
    got = exported(spark, texts, *rows)
    assert got == {"s0": ("unchanged", declared), "s1": ("malformed", DOC[:-9]), "s2": ("unchanged", DOC), "s3": ("unchanged", ""),
                   "s4": ("unchanged", ""), "s5": ("malformed", texts[5])}


def test_part_groups_keep_their_place_and_names_are_read(spark):
    parts = readers.parts_of(readers.shred(docs(spark, GROUPED))).orderBy("part_seq").collect()
    assert [(r.part_seq, r.part_name) for r in parts] == [(1, "Alto Flute"), (3, "Tall <&> Harp")]
    status, text = exported(spark, [GROUPED], edit("1", "x", instrument="Tall"))["s0"]
    root = ET.fromstring(text.encode())
    assert status == "edited" and [e.tag for e in root.find("part-list")] == ["part-group", "score-part", "part-group", "score-part"]
    lines = D.extract_parts(readers.heads_of(p := readers.shred(docs(spark, GROUPED))), readers.parts_of(p), readers.measures_of(p))
    first = ET.fromstring(text_of(lines.where("part_id = 'P1'"), "section", "seq").encode())
    assert [e.get("type") or e.tag for e in first.find("part-list")] == ["start", "score-part", "stop"]


def test_comments_cannot_break_the_document(spark):
    got = corrected(spark, edit("1", "too high -- a third --> lower ---"))
    ET.fromstring(got[("P2", "1")])


def test_names_are_found_by_their_rarest_substring(spark):
    rnd = random.Random(11)
    names = ["".join(rnd.choice("ab c") for _ in range(rnd.randint(1, 12))) for _ in range(60)] + ["", "x" * 9_990 + "violin ii", "ünï漢字"]
    needles = ["".join(rnd.choice("ab c") for _ in range(rnd.randint(1, 6))) for _ in range(40)] + ["", "violin", "n", "ii", "漢字", "zzz", "x" * 5_000, "much longer than any"]
    got = D.names_containing(spark.createDataFrame([(n,) for n in names + names], "name string"), spark.createDataFrame([(n,) for n in needles + [None]], "needle string"))
    assert sorted(map(tuple, got.collect())) == sorted({(n, x) for n in names for x in needles if n and x in n})
