import io
import zipfile

import pytest

from correctionlab.sources import readers

XML = b"<?xml version='1.0'?>\n<score-partwise/>"


def archive(entries, container=None):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        if container is not None:
            z.writestr("META-INF/container.xml", container)
        for name, content in entries:
            z.writestr(name, content)
    return buffer.getvalue()


def files(spark, *rows):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")


SNIFFED = [
    ("file.bin", b"%PDF-1.4 x", "pdf"), ("file.bin", XML, "musicxml"), ("file.bin", b"<score-partwise>", "musicxml"),
    ("file.bin", b" " * 150 + b"<SCORE-TIMEWISE", "musicxml"), ("file.bin", b" " * 200 + b"<score-partwise", "unknown"),
    ("score.pdf", b"random", "pdf"), ("score.XML", b"random", "musicxml"), ("score.mxl", b"random", "musicxml"),
    ("score.musicxml", b"random", "musicxml"), ("file.docx", b"random", "unknown"), ("a.pdf/b", b"x", "unknown"),
    ("x.pdf", XML, "musicxml"), ("x.bin", bytes(range(128, 256)) + b"<?xml", "musicxml"), ("empty", b"", "unknown"),
]


def test_file_type(spark):
    df = readers.describe_files(files(spark, *[(name, content) for name, content, _ in SNIFFED]).coalesce(1))
    assert [r.file_type for r in df.collect()] == [kind for _, _, kind in SNIFFED]


def test_unknown_type_can_raise(spark):
    with pytest.raises(Exception, match="no known kind of score file: file.docx"):
        readers.describe_files(files(spark, ("a/file.docx", b"random")), on_unknown="raise").collect()


def test_unpacking(spark):
    listing = b'<c xmlns="urn:x"><rootfiles><rootfile full-path=""/><rootfile full-path="in/s.xml"/></rootfiles></c>'
    rows = [
        ("named.mxl", archive([("a.xml", b"<no/>"), ("in/s.xml", XML)], listing)),
        ("magic.bin", archive([("z.xml", b"<z/>"), ("b.XML", XML)])),
        ("missing.mxl", archive([("b.xml", XML)], b'<rootfile full-path="gone.xml"/>')),
        ("broken-list.mxl", archive([("b.xml", XML)], b"<rootfile")),
        ("none.mxl", archive([("README.txt", b"x")])),
        ("bad.mxl", b"not a zip"),
        ("plain.xml", XML),
    ]
    got = {r.path: (r.content and bytes(r.content), r.error) for r in readers.unpack_archives(files(spark, *rows)).collect()}
    for name in ("named.mxl", "magic.bin", "missing.mxl", "broken-list.mxl", "plain.xml"):
        assert got[name] == (XML, None), name
    assert got["none.mxl"][0] is None and "no score document" in got["none.mxl"][1]
    assert got["bad.mxl"][0] is None and "unreadable archive" in got["bad.mxl"][1]


def test_ingest(spark, tmp_path):
    (tmp_path / "a.mxl").write_bytes(archive([("s.xml", XML)]))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4")
    got = {r.original_filename: (r.file_type, r.size_bytes, r.error) for r in readers.ingest_files(spark, f"{tmp_path}/*").collect()}
    assert got == {"a.mxl": ("musicxml", len(XML), None), "b.pdf": ("pdf", 8, None)}


def test_failed_archives_are_unknown_or_raise(spark):
    broken = readers.unpack_archives(files(spark, ("bad.mxl", b"not a zip")))
    assert [r.file_type for r in readers.describe_files(broken).collect()] == ["unknown"]
    with pytest.raises(Exception, match="no known kind"):
        readers.describe_files(broken, on_unknown="raise").collect()


def test_files_become_documents(spark):
    text = '<?xml version="1.0" encoding="{}"?><score a="å"/>'
    rows = [("d/one.xml", text.format("utf-8").encode()), ("d/two.xml", text.format("UTF-16").encode("utf-16")), ("d/three.xml", text.format("latin-1").encode("latin-1")),
            ("d/four.xml", b"\xef\xbb\xbf<score/>"), ("d/five.xml", b"<score a='\xe5'/>"), ("d/six.xml", text.format("no-such").encode()), ("d/seven.mxl", b"no archive"),
            ("d/eight.mxl", archive([("s.xml", text.format("utf-16").encode("utf-16"))]))]
    got = {r.score_id: r for r in readers.documents_from_files(readers.unpack_archives(files(spark, *rows))).collect()}
    assert got["one"].xml == text.format("utf-8") and got["two"].xml == text.format("UTF-16") and got["three"].xml == text.format("latin-1")
    assert got["four"].xml == "<score/>" and got["eight"].xml == text.format("utf-16")
    assert all(got[k].xml is None and got[k].error for k in ("five", "six", "seven"))
    whole = readers.shred(readers.documents_from_files(files(spark, *rows[:4])).select("score_id", "xml"))
    assert readers.errors_of(whole).count() == 0
