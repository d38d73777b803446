import hashlib
import random

import public_tokenizers
import pytest
from correctionlab.llm import token_align as T

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Tokens of a text, each with its bytes, by the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet = T.byte_alphabet()

    def piece(i):
        name = b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return [], []
        x = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, piece(i)) for i in b.encode(text)]
        raw = (" " + text).encode()
        return (x, y) if b"".join(t for _, t in x) == raw == b"".join(t for _, t in y) else ([], [])

    return tokens


def spans(tokens):
    at, out = 0, []
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(texts, tokens):
    """The contract, token by token."""
    rows, counts = [], {}
    for text in texts:
        a, b = map(spans, tokens(text))
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [([i for i, s, e in a if lo <= s and e <= hi], [i for i, s, e in b if lo <= s and e <= hi]) for lo, hi in zip([0, *cuts], cuts)]
        links = [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e]
        for link in links:
            counts[link] = counts.get(link, 0) + 1
        rows.append((len(a), len(b), groups, links))
    highest = {}
    for (_, j), n in counts.items():
        highest[j] = max(n, highest.get(j, 0))
    out = []
    for n_a, n_b, groups, links in rows:
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links),
                    hashlib.sha256(told.encode()).hexdigest() if n_a else ""))
    return out


def hard_texts():
    r = random.Random(8)
    odd = ["plain words here", "", None, " leading", "trailing  ", "two  spaces and\n\nlines \t tabs", "<|endoftext|> <s> </s> <unk> text",
           "Ünïcode 漢字 😀👩‍👩‍👧 é   x y\u0085z", "a▁b", "▁", "don't I'll we've 's 'S", "x" * 300, "1234567890 12,345.67 -1", "\x00\x01 \x7f", "ﬁ ² ½ Å"]
    signs = list("aeinst .,'-!\n\t0159éß漢😀_") + ["  ", " the", "ing "]
    return odd + ["".join(r.choice(signs) for _ in range(r.randint(1, 80))) for _ in range(120)]


def test_rows_equal_brute_force(spark, docs, plain):
    texts = hard_texts() * 2
    got = T.align_tokenizers(docs(texts), A, B).orderBy("doc_id").collect()
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    want = brute(texts, plain)
    for r, w, t in zip(got, want, texts, strict=True):
        assert tuple(r[c] for c in columns) == w, t


def test_rare_pairs_meet_by_a_shuffle_too(spark, docs, plain):
    texts = hard_texts()
    for frequent in (0, 1, 50):
        got = T.align_tokenizers(docs(texts), A, B, frequent=frequent).orderBy("doc_id").collect()
        assert [(r["n_best"], r["count_sum"]) for r in got] == [w[4:6] for w in brute(texts, plain)]


def test_segments_cut_where_both_start_anew(plain):
    aligner = T.Aligner(A, B, cached=50)
    for text in hard_texts():
        if text:
            whole, parts = plain(text), [plain(s) for s in aligner.segments(text)]
            if all(p[0] for p in parts) and whole[0]:
                assert [[i for p in parts for i, _ in p[k]] for k in (0, 1)] == [[i for i, _ in w] for w in whole], text
    for _ in range(2):
        assert [x[4] for x in aligner.align(["one two", None, "one two one"])][0] == aligner.align(["one two"])[0][4]


def test_unusual_characters_go_to_the_library():
    bpe = T.ByteLevel(A)
    assert bpe.fast is not None
    bpe.odd.add("q")
    assert bpe.encode(" quick") == bpe._slow(" quick") == bpe.fast.encode_ordinary(" quick")


def test_odd_rows(spark, odd, none):
    got = T.align_tokenizers(odd, A, B)
    assert got.count() == odd.count() and T.align_tokenizers(none, A, B).count() == 0
    rows = [r for r in got.collect() if r["doc_id"] in (0, 1)]
    assert all((r["n_a"], r["n_links"], r["count_sum"], r["groups_sha256"]) == (0, 0, 0, "") for r in rows)
