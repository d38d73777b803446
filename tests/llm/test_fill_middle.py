import hashlib
import random

import pytest
from correctionlab.llm import fill_middle as M

MARKS = (b"<P>", b"<M>", b"<S>")


def plain(doc_id, text):
    """The contract by slices of a string."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(text)
    p, q = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    x, y, z = text[:p], text[p:q], text[q:]
    out = f"<S>{z}<P>{x}<M>{y}" if h4 % 100 < 20 else f"<P>{x}<S>{z}<M>{y}"
    return n, "spm" if h4 % 100 < 20 else "psm", p, q - p, out


def test_rows_equal_slices_and_come_back(spark, docs):
    r = random.Random(9)
    signs = list("ab<>PSM 漢é😀\n") + ["<P", "<S", "S>", "<M>"]
    texts = [None, "", "<", "<P", "a<P>b", "ok <M> x"] + ["".join(r.choice(signs[:-1] if k % 9 else signs) for _ in range(r.randint(1, 40))) for k in range(600)]
    got = M.restored(M.fill_in_middle(docs(texts))).orderBy("doc_id").collect()
    for r_, t in zip(got, texts, strict=True):
        assert (r_["n"], r_["form"], r_["prefix_chars"], r_["middle_chars"], r_["output"]) == plain(r_["doc_id"], t)
        assert r_["restored"] == (t or "")
    assert {r_["form"] for r_ in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_rotations_undo_each_other(form):
    text = "pre漢mid😀suf".encode()
    for a in range(12):
        for b in range(12 - a):
            made = M.transform(text, form, a, b, MARKS)
            assert M.restore(bytes(made), form, MARKS) == text
    held = bytearray(b"0123456789")
    M.exchange(held, 2, 5, 9)
    assert held == b"0156782349"
    M.exchange(held, 2, 6, 9)
    assert held == b"0123456789"


def test_own_sentinels_and_shares(spark, docs):
    form = M.Form("<fim_prefix>", "<fim_middle>", "<fim_suffix>", seed="7", transformed=100, spm=100)
    got = M.restored(M.fill_in_middle(docs(["some text <P>", "x <fim_suffix> y"]), form), form).orderBy("doc_id").collect()
    assert [r["form"] for r in got] == ["spm", "plain"] and got[0]["output"].startswith("<fim_suffix>")
    assert [r["restored"] for r in got] == ["some text <P>", "x <fim_suffix> y"]


def test_odd_rows(spark, odd, none):
    made = M.fill_in_middle(odd)
    assert made.count() == odd.count() and M.fill_in_middle(none).count() == 0
    back = {(r["doc_id"], r["restored"]) for r in M.restored(made).collect()}
    assert back == {(r["doc_id"], r["text"] or "") for r in odd.select("doc_id", "text").collect()}
