import random

import numpy as np
from correctionlab.llm import near_copies as N
from correctionlab.llm import near_sets as S
from correctionlab.plans.sizing import cut_lineage
from test_near_copies import brute, drawn_pair, rows_of


def test_votes_discard_what_fingerprints_leave():
    r, how = random.Random(8), N.nearness()
    sizes = [20, 60, 200, 800, 3_000]
    near = [p for p in (drawn_pair(r, n, 0.805) for n in sizes for _ in range(60)) if how.near(*p)]
    _, sketches = rows_of(how, [s for p in near for s in p])
    assert N.survivors(sketches[::2], sketches[1::2], apart=255).all() and len(near) > 200
    far = [drawn_pair(r, n, 0.6) for n in sizes for _ in range(60)]
    _, sketches = rows_of(how, [s for p in far for s in p])
    head = sketches[:, :how.head]
    assert how.likely(head[::2], head[1::2]).mean() > 0.5  # by their bits alone
    assert how.likely(sketches[::2], sketches[1::2]).mean() < 0.05


def test_votes_tell_how_much_sets_have_apart():
    r = random.Random(9)
    for n in (50, 1_000, 20_000):  # the largest leave out last bits
        x, y = drawn_pair(r, n, 0.8)
        rows = [np.frombuffer(N.vote_row(N.votes(s), len(s)), np.uint8)[None, :] for s in (x, y)]
        sizes, differ = N.votes_apart(*rows)
        assert sizes[0] == len(x) + len(y) and abs(differ[0] / (2 * len(np.union1d(x, y)) - len(x) - len(y)) - 1) < 0.45


def test_a_large_group_gives_a_pair_a_node(spark, docs, monkeypatch):
    """However many keys its nodes share; what is joined later is the same as by all pairs."""
    r, seen = random.Random(10), []
    base = [f"w{r.randint(0, 9_999)}" for _ in range(120)]
    texts = [" ".join(base[:k] + ["x", f"y{k}"] + base[k + 1:]) for k in range(100)] + [" ".join(f"c{k}" for k in range(s, s + 100)) for s in range(0, 60, 6)]
    how, table, real = N.nearness(), docs(texts), S._likely_pairs
    monkeypatch.setattr(S, "_likely_pairs", lambda pairs, *more: seen.append(pairs.count()) or real(pairs, *more))
    rows = cut_lineage(S.described(table, how), "described")
    got = {x["first"] for x in S.near_groups(table, rows, how, cell=16).collect()}
    assert got == brute(list(enumerate(texts))) and seen[0] < len(texts) and sum(seen) < 2 * len(texts)


def test_pairs_and_whole_cells_give_the_same(spark, docs, monkeypatch):
    from test_circulant import hard_texts

    texts = hard_texts(4)
    how, table = N.nearness(), docs(texts)
    rows = cut_lineage(S.described(table, how), "described")
    want = brute([(d, t) for d, t in enumerate(texts)])
    for pairs in (0, 1_000):
        monkeypatch.setattr(S, "PAIRS", pairs)
        with_words = {x["first"] for x in S.near_groups(table, rows, how, cell=7).where("n > 0").collect()}
        assert with_words == {d for d in want if (texts[d] or "").split()}


def test_a_large_group_goes_into_cells_once(spark, docs, monkeypatch):
    """However many of its keys have a text that isn't linked with it."""
    r, seen = random.Random(11), []
    base = [f"w{r.randint(0, 9_999)}" for _ in range(120)]
    apart = [{r.randint(5 * k, 5 * k + 3): f"z{j}" for k in r.sample(range(24), 5)} for j in range(40)]
    texts = [" ".join(base[:k] + [f"y{k}"] + base[k + 1:]) for k in range(100)] + [" ".join(a.get(k, w) for k, w in enumerate(base)) for a in apart]
    how, table, real = N.nearness(), docs(texts), S._open_links
    monkeypatch.setattr(S, "_open_links", lambda left, *more: seen.append(left.count()) or real(left, *more))
    rows = cut_lineage(S.described(table, how), "described")
    got = {x["first"] for x in S.near_groups(table, rows, how, cell=16).collect()}
    assert got == brute(list(enumerate(texts))) and len(got) > 20 and seen[0] < 5 * len(texts)


def test_keys_of_one_group_are_one_where_that_makes_no_more_pairs(spark):
    key = "key long, node binary, n int, root binary"
    group = [(k, b"g%d" % j, 9, b"g0") for k in range(30) for j in range(20)] + [(k, b"s%d" % k, 9, b"s%d" % k) for k in range(30)]
    chain = [(100 + k, b"c%d" % j, 9, b"c0") for k in range(30) for j in (2 * k, 2 * k + 1)] + [(100 + k, b"t%d" % k, 9, b"t%d" % k) for k in range(30)]
    shut = [(200, b"h%d" % j, 9, b"h0") for j in range(5)]
    got = S._open_keys(spark.createDataFrame(group + chain + shut, key)).collect()
    of = lambda first: [x for x in got if bytes(x["node"])[:1] in first]
    assert len(of(b"gs")) == 20 + 30 and len({x["key"] for x in of(b"gs")}) == 1
    assert len(of(b"ct")) == len(chain) and not of(b"h")


def test_parts_of_the_leading_group_meet_the_others_only(spark):
    big = [(1, b"g%d" % j, 9, b"g0") for j in range(400)] + [(1, b"s%d" % j, 9, b"s%d" % (j // 2)) for j in range(25)]
    small = [(2, b"g%d" % j, 9, b"g%d" % j) for j in range(8)]
    rows = S._dealt(spark.createDataFrame(big + small, "key long, node binary, n int, root binary"), 10).collect()
    cells = {}
    for x in rows:
        cells.setdefault((x["key"], x["lo"], x["hi"]), []).append((bytes(x["node"]), bytes(x["root"])))
    met = {(k[0], *sorted((a, b))) for k, c in cells.items() for a, p in c for b, q in c if p != q}
    want = {(t[0][0], *sorted((a[1], b[1]))) for t in (big, small) for a in t for b in t if a[3] != b[3]}
    assert met == want and max(map(len, cells.values())) < 60
    assert len(rows) <= 8 + 400 * 3 + 25 * 43 and len(cells) <= 1 + 3 * 40 + 3
