import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from correctionlab.llm import components, simhash


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_groups(rows):
    """rows: (doc_id, fingerprint); every pair is compared."""
    group = list(range(len(rows)))
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if bin(a ^ rows[j][1]).count("1") <= 4 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return [min((d for (d, _), x in zip(rows, group) if x == g and d is not None), default=None) for g in group]


@given(st.text(alphabet="aAbB é\t\x0b  ß", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint_is_the_majority_of_shingle_hashes(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_long_texts_are_counted_in_blocks(monkeypatch):
    text = " ".join(f"w{k % 31}" for k in range(500))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 7)
    assert simhash.fingerprint(text.encode()) == whole == plain_fingerprint(text)


def test_groups_equal_brute_force(spark, sf):
    got = {r["doc_id"]: r for r in simhash.near_groups(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    for (doc_id, fp), component in zip(rows, plain_groups(rows)):
        assert (got[doc_id]["fingerprint"], got[doc_id]["component_id"]) == (f"{fp:016x}", component)


@pytest.mark.parametrize("cell", [3, 2_048])
def test_dense_groups_keep_every_link(spark, cell):
    """A ball of near fingerprints and lone ones, in one bucket after the other, also when buckets are cut into parts."""
    r = random.Random(1)
    centre = [r.getrandbits(64) for _ in range(4)]
    values = {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for c in centre for _ in range(60)} | {r.getrandbits(64) for _ in range(50)}
    signed = sorted(np.array(sorted(values), np.uint64).view(np.int64).tolist())
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(5)
    links = simhash.near_links(nodes, cell=cell).collect()
    assert len(links) < 15 * len(values) * 3
    root = {r["node"]: r["root"] for r in components.stars(spark.createDataFrame([(x["a"], x["b"]) for x in links], "a long, b long")).collect()}
    rows = [(v, v & (1 << 64) - 1) for v in signed]
    assert [root.get(v, v) for v in signed] == plain_groups(rows)


def test_pivot_rule_drops_no_near_pair():
    r, references = random.Random(2), simhash.reference_fingerprints()
    for _ in range(500):
        a = r.getrandbits(64)
        b = a ^ sum(1 << k for k in r.sample(range(64), 4))
        d = [np.bitwise_count(np.uint64(x) ^ references).astype(int) for x in (a, b)]
        assert abs(d[0] - d[1]).max() <= 4


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 103), (103, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components.stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 103: 100}
    assert components.stars(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, none):
    got = simhash.near_groups(odd).collect()
    assert len(got) == odd.count()
    assert {r["component_id"] for r in got if r["fingerprint"] == "0" * 16} == {0}
    assert [r["component_id"] for r in got if r["doc_id"] in (4, 5)] == [4] * 4
    kept = simhash.near_dedup(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"] is not None) == [0, 3, 4, 4, 4, 6, 7, 8]
    assert simhash.near_groups(none).count() == simhash.near_dedup(none).count() == 0
