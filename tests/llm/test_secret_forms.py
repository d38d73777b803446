import pytest
from correctionlab.llm import secret_scan as S

KEY = "0123456789abcdefABCDEF0123456789abcd"


@pytest.mark.parametrize("text, value", [
    (f"export GITHUB_TOKEN=ghp_{KEY}\n", f"ghp_{KEY}"), (f"SECRET_KEY={KEY}", KEY), (f'db_password = "{KEY}"', KEY), (f'GITHUB_TOKEN = "{KEY}"', KEY),
    (f'aws_secret_access_key = "{KEY}"', KEY), ('password = "hunter2!"', "hunter2!"), ("DB_PASSWORD=p@ss$word", "p@ss$word"), ("pwd: 'two words'", "two words"),
    ('"client_secret": "a#b"', "a#b"), (f"token: {KEY}==", f"{KEY}=="), ("my-api-key: x", "x"), (f"secret = \"{KEY} and more\"", f"{KEY} and more"),
])
def test_values_under_a_name_are_candidates_and_positive(text, value):
    start, end, before, candidate, after = list(S.candidates("words here " + text))[-1]
    assert candidate == value and S.ASSIGNED.search(before)
    assert ("words here " + text)[start:end] == value


def test_names_need_their_ends_and_other_names_are_none():
    assert not list(S.candidates("monkey = short, authors: none, tokenize: yes, mytoken=1"))
    [(_, _, before, candidate, _)] = S.candidates(f"CHECKSUM={KEY}==")
    assert candidate == f"{KEY}==" and not S.ASSIGNED.search(before)
    assert [c[3] for c in S.candidates(f"{KEY}=={KEY}")] == [KEY, KEY]


def test_secrets_of_all_forms_are_found(spark, docs):
    forms = [f"x export GITHUB_TOKEN=ghp_{KEY}\n y", f'the db_password = "{KEY[5:33]}" here', "login with DB_PASSWORD=tR7!xq$9Lm2 now"]
    table = docs(forms + ["plain words of a text that holds nothing at all"] * 5)
    assert {r["doc_id"] for r in S.scan_secrets(table).where("secret").collect()} >= {0, 1}
    assert {r["doc_id"] for r in S.scan_secrets(table).collect()} == {0, 1, 2}


def test_the_lexicon_counts_all_documents(spark, docs, monkeypatch):
    """Words of a rare source that a sample of a few documents leaves out; letter pairs as counted one by one."""
    texts = ["common words stand here"] * 200 + ["zebu quokka"] * 3
    monkeypatch.setattr(S, "SAMPLE_DOCS", 1)
    got = S.corpus_lexicon(docs(texts))
    want = S.Lexicon({"common": 200, "words": 200, "stand": 200, "here": 200, "zebu": 3, "quokka": 3})
    assert got.words == want.words and got.cost == pytest.approx(want.cost)
    monkeypatch.setattr(S, "WORD_SHARE", 100)
    assert S.corpus_lexicon(docs(texts)).words == {"common", "words", "stand", "here"}
    assert not S.corpus_lexicon(docs([])).words
