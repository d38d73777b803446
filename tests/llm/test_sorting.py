"""Content sort, mixing, license scans, personal data and the pipeline against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from correctionlab.llm import content_sort, decontaminate, language_id, license_scan, mixing, pii, simhash, token_files


def plain_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), doc_id is not None, doc_id))
    return groups


@pytest.mark.parametrize("least", [2, 8])
def test_content_sort_also_of_hot_texts(spark, docs, least):
    texts = [f"a b {k % 3}" + " " * (k % 5) for k in range(200)] + [f"lone {k}" for k in range(50)]
    got = {r["doc_id"]: r for r in content_sort.exact_groups(docs(texts).repartition(7), pieces=40, least_copies=least).collect()}
    for content, group in plain_groups(enumerate(texts)).items():
        keep = min(group)[2]
        for _, _, k in group:
            assert (got[k]["keep_id"], got[k]["group_size"], got[k]["kept"]) == (keep, len(group), k == keep)
            assert got[k]["text_sha256"] == hashlib.sha256(content.encode()).hexdigest()


@pytest.mark.parametrize("least", [1, 8])
def test_content_sort_of_odd_rows(odd, none, least):
    got = content_sort.exact_groups(odd, least_copies=least).collect()
    assert len(got) == odd.count()
    want = plain_groups([(r["doc_id"], r["text"]) for r in odd.collect()])
    for r in got:
        group = next(g for c, g in want.items() if hashlib.sha256(c.encode()).hexdigest() == r["text_sha256"])
        assert (r["keep_id"], r["group_size"]) == (min(group)[2], len(group))
    assert sum(r["kept"] for r in got) == len(want)
    assert content_sort.exact_groups(none).count() == 0


def plain_targets(sizes, weights=(5, 2, 1)):
    """Reshare the excess until no source is above twice its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s, t in share.items() if t > 2 * sizes[s]}
        if not over:
            return {s: share.get(s, 2.0 * sizes[s]) for s in names}
        full |= over


@given(st.dictionaries(st.one_of(st.none(), st.text("abcXYé", min_size=1, max_size=3)), st.integers(0, 1_000), min_size=1, max_size=9))
@settings(max_examples=12, deadline=None, phases=[Phase.generate])
def test_targets_equal_resharing(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(table).collect()}
    for s, t in plain_targets(sizes).items() if sum(sizes.values()) else []:
        assert got[s] == pytest.approx(t, abs=1e-6)


def test_mixture_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    source, size = {r["doc_id"]: r["source"] for r in rows}, {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0d]+", r["text"])) for r in rows}
    got = mixing.mixture(docs.repartition(9)).collect()
    again = mixing.mixture(docs).collect()
    assert sorted(got) == sorted(again) and len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    want = plain_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[source[r["doc_id"]]] and r["target"] == pytest.approx(want[source[r["doc_id"]]])
    assert all(abs(taken[s] - t) <= 0.03 * t for s, t in want.items())
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 0.01 * sum(sizes.values())


def test_splitting_tree_deals_every_block_once(spark):
    quotas = {"a": 100, "b": 7, None: 50, "z": 0}
    got = mixing.split_tree(spark.createDataFrame(list(quotas.items()), "source string, quota long"), depth=3).collect()
    by_source, by_shard = Counter(), Counter()
    for r in got:
        assert r["n"] >= 0
        by_source[r["source"]] += r["n"]
        by_shard[r["shard"]] += r["n"]
    assert dict(by_source) == quotas
    assert sorted(by_shard) == list(range(8)) and max(by_shard.values()) - min(by_shard.values()) <= 1
    # the left half of the root draws a's blocks in proportion, and not always the same number
    left = [sum(r["n"] for r in mixing.split_tree(spark.createDataFrame([("a", 100), ("b", 100)], "source string, quota long"), depth=1, seed=s).where("shard = 0 and source = 'a'").collect()) for s in range(8)]
    assert 40 <= sum(left) / 8 <= 60 and len(set(left)) > 1


def test_mix_documents_are_the_mixture(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("mix_key", F.lit("own"))
    plan = {r["doc_id"]: r["shards"].split(",") if r["shards"] else [] for r in mixing.mixture(docs).collect()}
    rows = mixing.mix_documents(docs).collect()
    dealt = defaultdict(list)
    for r in rows:
        dealt[r["doc_id"]].append(str(r["mix_shard"]))
    assert {k: sorted(v) for k, v in plan.items() if v} == {k: sorted(v) for k, v in dealt.items()}
    assert {r["text"] for r in rows} <= {r["text"] for r in docs.collect()}


def test_mixing_of_odd_rows(odd, none):
    got = mixing.mixture(odd).collect()
    assert len(got) == odd.count() and all(r["taken"] <= 2 * r["size"] for r in got)
    assert {r["size"] for r in got if r["doc_id"] in (0, 1, 2)} == {0}
    assert mixing.mixture(none).count() == 0 == mixing.mix_documents(none).count()
    assert set(odd.columns) < set(mixing.mix_documents(odd).columns)


@pytest.mark.parametrize("text, want", [
    ("x y.\nLicensed under the Apache License, Version 2.0.\nz", "Apache-2.0"),
    ("LICENSED UNDER THE APACHE LICENSE,  VERSION 2.0\nwith LLVM Exceptions.", "Apache-2.0 WITH LLVM-exception"),
    ("Released under the MIT License. Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0,MIT"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
     "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", ""),
    ("It was released under the MIT License.", ""), ("", ""), (None, ""), ("a" * 300_000, ""),
])
def test_licenses(docs, text, want):
    rows = license_scan.scan_licenses(docs([text, text]).withColumn("rest", F.lit(1)).withColumn("ids", F.lit(2)))
    assert [r["licenses"] for r in rows.collect()] == [want, want]


def test_licenses_of_odd_rows(odd, none):
    assert license_scan.scan_licenses(odd).where("n_licenses > 0").count() == 0
    assert license_scan.scan_licenses(odd).count() == odd.count() and license_scan.scan_licenses(none).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def plain_base(text):
    out = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), n, kind, m.end()))
    return sorted(out)


TRICKY = [
    "a@b.c_d@e.f", "a@b@c.d", "x..y@-.-", "1.2.3.4.5.6.7.8", "300.1.1.1 000000255.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111",
    "+1 (017) 555-7713.", "+12", "++1 22 333 4444 55", "é😀 me@x.org 😀", "+1" * 40, "4111111111111111", "a" * 50_000 + "@b.c", "1 " * 20_000, "+1" + "(" * 30_000, None, "",
]


def test_base_spans_equal_plain_patterns(docs):
    got = {r["doc_id"]: r["base"] for r in pii.find_personal_data(docs(TRICKY)).collect()}
    for k, text in enumerate(TRICKY):
        assert [tuple(s) for s in got[k]] == plain_base(text), text


@given(st.lists(st.text("a1.@-+ (é4", max_size=40), min_size=20, max_size=20))
@settings(max_examples=6, deadline=None, phases=[Phase.generate])
def test_base_spans_of_drawn_texts(spark, texts):
    found = pii.base_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in found:
        mine = sorted((s["start"], n, kind, s["end"]) for n, kind in enumerate(BASE) for s in r[kind])
        assert mine == plain_base(r["text"])


def test_patterns_discover_unseen_identifiers(docs):
    seeds = [f"please write to user{k}@mail.org today" for k in range(12)]
    noise = [f"the number x{k}77889 is nothing" for k in range(12)]
    texts = [*seeds, *noise, "please write to bob(at)host77 today", "nothing of bob(at)host77 here"]
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in pii.find_personal_data(docs(texts)).collect()}
    assert got[24] == [(16, "email", 29)] and got[25] == [(11, "email", 24)]
    assert all(len(got[k]) == 1 for k in range(12)) and all(got[k] == [] for k in range(12, 24))


def test_personal_data_of_odd_rows(odd, none):
    got = pii.find_personal_data(odd).collect()
    assert len(got) == odd.count() and all(list(r["base"]) == [] for r in got)
    assert pii.find_personal_data(none).count() == 0


def test_pipeline_stages_equal_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "decontamination", "mixing", "token_files"]
    rows = {r["doc_id"]: r for r in docs.collect()}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    from test_models import plain_leaks
    from test_near_copies import brute

    kept = set(rows)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf)
        if name == "token_files":
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(r["doc_id"] for r in docs.collect())
            assert after.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
            break
        after = spark.createDataFrame(after.collect(), docs.schema)
        assert after.columns == docs.columns
        ids = Counter(r["doc_id"] for r in after.collect())
        if name == "language_id":
            want = {k for k in kept if language_id.has_letter(rows[k]["text"])}
        elif name == "simhash_near_dedup":
            want = brute([(k, rows[k]["text"]) for k in sorted(kept)])
        elif name == "decontamination":
            want = kept - {d for d, _ in plain_leaks([(k, rows[k]["text"]) for k in kept], bench)}
        else:
            want = {r["doc_id"] for r in mixing.mixture(docs).where(F.col("shards") != "").collect()}
            assert set(ids.values()) <= {1, 2}
        assert set(ids) == want
        kept, docs = set(ids), after


def test_pipeline_of_odd_rows(spark, odd, sf):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() > 0
