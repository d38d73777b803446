import random

import numpy as np
from correctionlab.llm import near_copies as N


def hashes(r, n):
    return np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64))


def test_sums_are_mean_distances_to_pivots():
    r, (signs, halves) = random.Random(1), N.table_signs(2)
    tokens = hashes(r, 40)
    bits = np.array([[b == "1" for w in N.fingerprint(tokens[k:k + 1]) for b in f"{int.from_bytes(w.tobytes(), 'big'):064b}"] for k in range(len(tokens))])
    pivots = np.array([[np.kron(halves[j], halves[i]) * s for i in range(16) for j in range(16)] for s in signs]) > 0
    plain = (pivots[:, :, None] != bits).sum(axis=3).mean(axis=2)
    assert np.allclose(sorted((128 - N.pivot_sums(N.votes(tokens), signs, halves) / (2 * len(tokens))).ravel()), sorted(plain.ravel()))


def test_pairs_meet_by_outstanding_pivots():
    r, how = random.Random(2), N.nearness()
    near = missed = 0
    for n in (5, 8, 20, 60, 200, 600):
        for _ in range(60):
            whole = hashes(r, n)
            keys = [set(how.describe(s)[0].tolist()) for s in (whole, whole[:-(-4 * n // 5)])]
            near, missed = near + 1, missed + (not keys[0] & keys[1])
            assert all(len(k) == N.TABLES * N.CHOICES for k in keys)
    assert missed <= near // 100


def test_unrelated_sets_share_hardly_a_key():
    r, how = random.Random(3), N.nearness()
    keys = np.concatenate([how.describe(hashes(r, 50))[0] for _ in range(400)])
    assert len(np.unique(keys)) > 0.999 * len(keys)
