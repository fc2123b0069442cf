import numpy as np

from keyloom.llm.topk import ImpactIndex


def brute(ids, x, asked, q, k):
    out = []
    for i, y in zip(asked, q):
        out += [(int(i), int(j), int(-s)) for s, j in sorted((-int(v @ y), int(j)) for j, v in zip(ids, x) if j != i)[:k]]
    return out


def found(index, asked, q, k, few=64):
    return [tuple(map(int, r)) for r in zip(*index.search(asked, q, k, few))]


def test_the_index_equals_brute_force_whatever_is_proven():
    rng = np.random.default_rng(9)
    for n, width, spread in ((400, 8, 1.0), (400, 8, 3.0), (3, 4, 1.0), (50, 1, 0.0), (60, 5, 1.0)):
        x = np.floor(256 * rng.normal(size=(n, width)) * np.exp(spread * rng.normal(size=(n, width)))).astype(np.int64)
        if n == 60:
            x[:] = x[0]  # ties everywhere
        ids = rng.permutation(1000)[:n]
        q, asked = x[:7].copy(), ids[:7].copy()
        q[3:] = 2 * q[3:]
        asked[-1] = 5000
        index = ImpactIndex(ids, x)
        for few in (0, 5, 64, 1000):
            assert found(index, asked, q, 5, few) == sorted(brute(ids, x, asked, q, 5), key=lambda r: (list(asked).index(r[0]), -r[2], r[1]))


def test_postings_hold_every_component_once_and_proof_stops_early():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(2000, 16)) * np.where(rng.random((2000, 16)) < 0.1, 20000, 3)).astype(np.int64)
    index = ImpactIndex(np.arange(2000), x)
    back = np.zeros_like(x)
    for segment in index.segments:
        for d, rows, values in segment:
            assert not back[rows, d].any()
            back[rows, d] = values
    assert (back == x).all() and len(index.segments) > 3
    want = found(index, np.arange(20), x[:20], 5)
    index.segments[-1] = [(d, rows, np.full(len(rows), np.nan)) for d, rows, _ in index.segments[-1]]  # never reached
    assert found(index, np.arange(20), x[:20], 5) == want
