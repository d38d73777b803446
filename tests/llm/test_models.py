"""Language ID, secret scans and decontamination: held-out accuracy and brute force."""

import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from correctionlab.llm import decontaminate as D
from correctionlab.llm import language_id as L
from correctionlab.llm import secret_scan as S


def test_languages_are_told_on_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = L.identify(docs.withColumn("score", F.lit(1)).withColumn("p", F.lit("de"))).collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_held_out_rows_teach_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wrong = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    key = lambda df: sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in L.identify(df).collect())
    assert key(docs) == key(wrong)


def test_signs_that_are_no_letters_have_no_language(spark, docs):
    texts = ["½ ² ①", "Ⅷ ½ 12", "² a", "漢 ½", "\u0301", "½" * 50 + "é"]
    assert [L.has_letter(t) for t in texts] == [any(c.isalpha() for c in t) for t in texts] == [False, False, True, True, False, True]
    rows = [(k, t, None) for k, t in enumerate(texts)] + [(100 + k, "the words of this text", "en") for k in range(9)] + [(200 + k, "der Satz ist kurz", "de") for k in range(9)]
    got = {r["doc_id"]: r["lang_pred"] for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[k] == "und" for k in range(6)] == [True, True, False, False, True, False]


def test_training_is_the_same_whatever_the_partitions(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    few, many = (L.train(t, rows=200) for t in (table.coalesce(1), table.repartition(40)))
    assert few["languages"] == many["languages"] and (few["weights"] == many["weights"]).all()


def test_tables_without_labels_stay_whole(spark):
    table = spark.createDataFrame([(1, "some text", None), (2, None, None), (2, None, None)], "doc_id long, text string, lang string")
    assert L.known_language(table).count() == 3
    assert {r["lang_pred"] for r in L.identify(table).collect()} == {"und"}


@pytest.mark.parametrize("n", [2, 4, 7, 12])
def test_codewords_are_apart(n):
    code = L.codewords(n)
    assert code.shape[0] == n and np.isin(code, (-1, 1)).all()
    apart = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
    assert min(apart) >= code.shape[1] // 4


def test_decoding_mends_wrong_bits():
    code = L.codewords(5)
    model = {"languages": list("abcde"), "code": code, "weights": np.eye(15, dtype=np.float32), "bias": np.zeros(15, np.float32), "trust": np.ones(15, np.float32)}
    for k, word in enumerate(code):
        for bit in range(15):
            bent = 4 * word.copy()
            bent[bit] *= -1
            assert L.decode(model, bent[None])[0][0] == k
    assert L.decode(model, np.zeros((1, 15), np.float32))[1][0] == pytest.approx(0.2)


def test_odd_rows_have_no_language(spark, odd, none, docs):
    got = {r["doc_id"]: r for r in L.identify(odd).collect() if r["doc_id"] is not None}
    assert [got[k]["lang_pred"] for k in (0, 1, 2, 7)] == ["und"] * 4
    assert {got[k]["lang_pred"] for k in (3, 4, 8)} == {"en"}
    assert L.identify(odd).count() == odd.count()
    assert L.identify(none).count() == 0 == L.known_language(none).count()
    assert L.known_language(odd).columns == odd.columns
    assert {r["lang_pred"] for r in L.identify(docs(["some words", "more words"], lang=None)).collect()} == {"und"}


def assigned(text):
    return [(m.start(1), m.end(1)) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', text or "")]


def test_planted_secrets_are_found_and_nothing_else(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {(r["doc_id"], *span) for r in docs.collect() for span in assigned(r["text"])}
    got = {(r["doc_id"], r["start"], r["end"]) for r in S.scan_secrets(docs).where("secret").collect()}
    assert want and got == want


def test_forest_on_findings_it_has_not_seen(spark):
    lexicon = S.Lexicon({w: 10 for w in "the main build service report module of and secret release stable handler".split()})
    model = S.train(spark, S.drawn_findings(seed=1), lexicon)
    rows = [(*S.describe(b, c, a, lexicon), float(label)) for b, c, a, label in S.drawn_findings(seed=2)]
    from pyspark.ml.feature import VectorAssembler
    table = VectorAssembler(inputCols=list(S.FEATURES), outputCol="features").transform(
        spark.createDataFrame(rows, ", ".join(f"{f} double" for f in (*S.FEATURES, "label"))))
    right = model.transform(table).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    assert right >= 0.95


def test_secret_features():
    lexicon = S.Lexicon({"release": 5, "module": 5})
    told = dict(zip(S.FEATURES, S.describe('x = "', "releaseMODULE0123456789", '"', lexicon)))
    assert told["length"] == 23 and told["assigned"] == told["quoted"] == 1
    assert told["coverage"] == pytest.approx(13 / 23) and told["digit_share"] == pytest.approx(10 / 23)
    assert list(S.candidates(None)) == [] and [c[3] for c in S.candidates("a " + "b" * 16)] == ["b" * 16]


def test_secret_scan_of_odd_rows(odd, none):
    assert S.scan_secrets(odd).count() == 0
    assert S.scan_secrets(none).count() == 0


def plain_leaks(rows, items):
    out = set()
    for doc_id, text in rows:
        words = D.words_of(text)
        document = {n: D.grams(words, n) for n in range(1, 6)}
        for item, of in items:
            if D.words_of(of) and all(D.overlap(p, document) >= 0.8 for p in D.question_and_answer(of)):
                out.add((doc_id, item))
    return out


def test_leaks_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, items).collect()}
    want = plain_leaks([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert want and got == want
    kept = {r["doc_id"] for r in D.decontaminated(docs, items).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - {d for d, _ in want}


def test_wand_retrieves_all_above_the_threshold():
    rng = np.random.default_rng(3)
    vocabulary = [f"t{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary, rng.integers(5, 80)))) for k in range(70)]
    index = D.Index(items)
    for _ in range(60):
        terms = sorted({int(t) for t in rng.integers(0, len(index.terms), 40)})
        scores = {}
        for t in terms:
            for segment, w in index.postings[t]:
                scores[segment] = scores.get(segment, 0.0) + w
        want = {s for s, x in scores.items() if x >= 0.6}
        got = {s for b in range(index.most.shape[1]) for s, _ in index.wand(terms, b)}
        assert got == want


def test_items_are_found_wherever_they_stand(docs, spark):
    item = "What is the tallest hill near the old harbour town? It is called Blue Crag, and it rises above the mill."
    long = " ".join(f"filler{k}" for k in range(5_000))
    texts = [f"{' '.join(f'pad{k}' for k in range(n))} {item.upper()} {long}" for n in range(0, 70, 7)] + [long, item[:40], None, ""]
    bench = spark.createDataFrame([(5, item), (6, None), (7, ""), (5, item), (8, "x")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in D.find_leaks(docs(texts), bench).collect()) == list(range(10))
    split = list(D.item_groups(bench, most=10))
    assert len(split) == 2


def test_decontamination_of_odd_rows(odd, none, spark):
    bench = spark.createDataFrame([(1, "one two three four five"), (None, "without an id")], "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in D.find_leaks(odd, bench).collect())
    assert got == [("4", 1)] * 3 + [("5", 1), ("None", -1)]
    assert D.decontaminated(odd, bench).count() == odd.count() - 5
    assert D.decontaminated(odd, bench).columns == odd.columns
    assert D.find_leaks(odd, bench.limit(0)).count() == 0 == D.find_leaks(none, bench).count()
    assert D.decontaminated(odd, bench.limit(0)).count() == odd.count()
