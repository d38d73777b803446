import textwrap

import pytest
from correctionlab.llm import license_scan as L

OF = {name: of[0] for name, of in L.SENTENCES.items()}
MIT = ["MIT License", "Copyright (c) 2020 Someone", OF["mit-grant"], OF["mit-condition"] + ".", "THE SOFTWARE IS PROVIDED \"AS IS\"."]
BSD2 = ["Copyright 2020 Someone", OF["bsd-grant"], "1. " + OF["bsd-source"] + ".", "2. " + OF["bsd-binary"] + "."]
BSD3 = [*BSD2, "3. " + OF["bsd-endorse"] + "."]
GPL = ["This file is part of a thing.", OF["gpl-program"] + "."]


def wrapped(paragraphs, mark, width=60, between=True, end="\n"):
    lines = []
    for p in paragraphs:
        lines += [mark + line for line in textwrap.wrap(p, width)] + ([mark.rstrip()] if between else [])
    return end.join(lines)


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_wrapped_texts_have_their_licenses(docs, mark):
    texts, want = [], []
    for paragraphs, name in ((MIT, "MIT"), (BSD2, "BSD-2-Clause"), (BSD3, "BSD-3-Clause"), (GPL, "GPL-3.0-or-later")):
        for between in (True, False):
            for end in ("\n", "\r\n"):
                texts.append(wrapped(paragraphs, mark, between=between, end=end))
                want.append(name)
    assert [r["licenses"] for r in L.scan_licenses(docs(texts)).orderBy("doc_id").collect()] == want


def test_lines_stand_alone_too(docs):
    texts = [
        "words before\nReleased under the MIT License\nwords after", "words before\n\nLicensed under the\nMIT License", "not Licensed under the\nMIT License", "Licensed under the\n\nMIT License",
        "Licensed under the. MIT License", "Licensed --- " + "- " * 4_000 + "under the MIT License", "\x02Licensed\x02under the MIT License\x02"]
    got = [r["licenses"] for r in L.scan_licenses(docs(texts)).orderBy("doc_id").collect()]
    assert got == ["MIT", "MIT", "", "", "", "MIT", "MIT"]
